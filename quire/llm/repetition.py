"""Quality rules by repetition: characters inside repeated n-grams and repeated lines.

Every text is hashed whole, in numpy: one running sum gives the rolling hash of each word, a second one over word
hashes gives that of each n-gram, for all lengths. A document is rejected when the share of its word characters
that lie in n-grams seen earlier in it exceeds the limit of any length, or when the share of its line characters
that lie in lines seen earlier exceeds ``max_line_share``. A first occurrence doesn't count, so that a short clean
text whose heading comes once more at its end is kept.

Cases: a null or empty text, or one of white space only, has zero shares and is kept; a text with fewer words than
the n-gram has share zero for it; rows are judged one by one, so repeated rows give repeated results; an empty table
gives an empty result; only ``id_col`` and ``text_col`` are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: n-gram length -> largest allowed share of characters inside repeated n-grams.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
_BREAK = 10


def measure(cp: np.ndarray, off: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for concatenated texts: words, word_chars, ngram<k> characters, line_chars, dup_line_chars."""
    n = len(off) - 1
    start, end, doc = C.spans(cp, off)
    size = end - start
    salt = C.mix(np.arange(n, dtype=C.U64) + C.U64(0x5BD1E995))
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, weights=size, minlength=n).astype(np.int64),
    }
    h = C.word_hashes(cp, start, end)
    m = len(h)
    for k in lengths:
        covered = np.zeros(n, np.int64)
        if m >= k:
            at = np.flatnonzero(doc[: m - k + 1] == doc[k - 1 :])
            gram = C.mix(C.rolling(h, at, at + k)) ^ salt[doc[at]]
            hit = at[C.repeated(gram)]
            edge = np.zeros(m + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + k, -1)
            inside = np.cumsum(edge[:-1]) > 0
            covered = np.bincount(doc[inside], weights=size[inside], minlength=n).astype(np.int64)
        out[f"ngram{k}"] = covered
    first, last, line_doc = lines(cp, off, start, end)
    width = last - first
    same = C.mix(C.rolling(C.mix(cp.astype(C.U64) + C.U64(1)), first, last)) ^ salt[line_doc]
    twice = C.repeated(same)
    out["line_chars"] = np.bincount(line_doc, weights=width, minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[twice], weights=width[twice], minlength=n).astype(np.int64)
    return out


def lines(cp, off, start, end):
    """Lines without outer white space, empty ones left out: first and last (exclusive) place and text."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z
    breaks = np.cumsum(cp == _BREAK)
    doc = np.searchsorted(off, start, side="right") - 1
    row = breaks[start]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(start)]]) - 1
    return start[head], end[tail], doc[head]


def coverage(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: dict[int, float] | None = None,
    max_line_share: float = MAX_LINE_SHARE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: id, ``carry`` columns, counts, shares and ``keep``."""
    limits = LIMITS if limits is None else limits
    lengths = tuple(sorted(limits))
    counts = ["n_words", "word_chars", *(f"ngram{k}" for k in lengths), "line_chars", "dup_line_chars"]
    read = docs.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        *(F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)),
    )
    fields = [T.StructField(f.name, f.dataType) for f in read.schema.fields if f.name != "__text"]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, 1):
                got = measure(*C.codes(b.column(1)), lengths)
                cols = [b.column(0), *b.columns[2:], *(pa.array(got[c], pa.int64()) for c in counts)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    got = read.mapInArrow(run, schema)
    for k in lengths:
        got = got.withColumn(f"dup{k}_share", share(f"ngram{k}", "word_chars"))
    got = got.withColumn("dup_line_share", share("dup_line_chars", "line_chars"))
    bad = F.col("dup_line_share") > F.lit(float(max_line_share))
    for k in lengths:
        bad = bad | (F.col(f"dup{k}_share") > F.lit(float(limits[k])))
    return got.select(
        F.col("__id").alias(id_col),
        *(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry) if c != id_col),
        "n_words",
        "word_chars",
        *(f"dup{k}_share" for k in lengths),
        "dup_line_share",
        (~bad).alias("keep"),
    )


def reject(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; one pass, no shuffle."""
    whole = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.struct(*docs.columns).alias("row"))
    judged = coverage(whole, id_col="i", text_col="t", carry=("row",), **how)
    return judged.filter("keep").select("row.*")


def sql(table: str = "documents", limits: dict[int, float] | None = None, line_share: float = MAX_LINE_SHARE) -> str:
    """DuckDB twin of ``coverage`` (ids must be unique)."""
    limits = LIMITS if limits is None else limits
    ks = sorted(limits)
    dup = ",\n".join(
        f"""n{k} AS (SELECT doc_id, sum(length(w)) AS c FROM (
  SELECT doc_id, w, bool_or(d) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS inside
  FROM (SELECT doc_id, i, w, g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS d FROM (
    SELECT doc_id, i, w, CASE WHEN count(*) OVER f = {k} THEN string_agg(w, ' ') OVER f END AS g FROM w
    WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)))) WHERE inside GROUP BY doc_id)"""
        for k in ks
    )
    shares = ", ".join(
        f"CASE WHEN coalesce(t.c, 0) > 0 THEN coalesce(n{k}.c, 0)::DOUBLE / t.c ELSE 0.0::DOUBLE END AS dup{k}_share" for k in ks
    )
    joins = " ".join(f"LEFT JOIN n{k} USING (doc_id)" for k in ks)
    ok = " AND ".join([f"dup{k}_share <= {limits[k]}::DOUBLE" for k in ks] + [f"dup_line_share <= {line_share}::DOUBLE"])
    return f"""WITH w AS (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda x: x <> '') AS l FROM {table})),
t AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY doc_id),
{dup},
l AS (SELECT doc_id, regexp_replace(unnest(s), '^[ \\t\\n\\r\\x0B\\f]+|[ \\t\\n\\r\\x0B\\f]+$', '', 'g') AS l, generate_subscripts(s, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {table})),
r AS (SELECT doc_id, sum(length(l)) AS c, sum(CASE WHEN k > 1 THEN length(l) ELSE 0 END) AS d FROM (
  SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS k FROM l WHERE l <> '') GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(t.n, 0)::BIGINT AS n_words, coalesce(t.c, 0)::BIGINT AS word_chars, {shares},
  CASE WHEN coalesce(r.c, 0) > 0 THEN r.d::DOUBLE / r.c ELSE 0.0::DOUBLE END AS dup_line_share
  FROM {table} LEFT JOIN t USING (doc_id) {joins} LEFT JOIN r USING (doc_id))
SELECT *, ({ok}) AS keep FROM s"""
