"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

Lines (trimmed, longer than nothing) are first made distinct by exact text in one shuffle. Signatures of the distinct
lines are banded; lines of one bucket are candidates. With 10 bands of 4 rows a pair at the threshold 0.7 meets with
probability 0.94, one at 0.8 with 0.99. Candidates are verified on their exact shingle sets, if at least ``AGREE`` of
their 40 minima agree (of the pairs at 0.7 that share a band this leaves out 3 in 100,000, and fewer above). In a bucket
each line is verified against the bucket's least line first; after union-find only pairs of lines still in different
components are verified, so none whose answer is settled is paid for.

Cases: null texts have no lines; empty or blank lines are no lines and stay in the text; a line shorter than the
shingle is one shingle; equal lines, also of one document, are one component; ties between places go to the least
(doc_id, line_no); equal rows with one id share their places and are all kept or all dropped, and
``apply`` takes different texts under one id, or without id, for different rows; an empty table gives
an empty result; other columns of the input are passed through by ``apply`` and not read by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as C

SHINGLE = 8
BANDS = 10
ROWS = 4
THRESHOLD = 0.7
#: Of the 40 minima of a pair this many must agree before it is compared.
AGREE = 18
#: Bytes of text hashed at once: the 64-bit shingles of so many lines stay in a core's cache.
CACHED = 1 << 17
_SPACES = " \t\n\r\x0b\f"

_SEEDS = C.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def shingles(cp: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character shingles of concatenated lines (none empty), and n + 1 offsets into them; a line
    shorter than a shingle is filled up with zeros, which no character counts as."""
    value = cp.astype(np.uint64) + np.uint64(1)
    short = np.maximum(0, width - np.diff(off))
    if short.any():
        value = np.insert(value, np.repeat(off[1:], short), 0)
        off = off + np.concatenate([[0], np.cumsum(short)])
    n = max(0, len(value) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += value[j : j + n]
    inside = np.ones(len(value), bool)
    inside[(off[1:, None] - np.arange(1, width)).ravel()] = False
    return C.mix(h[inside[:n]]), np.concatenate([[0], np.cumsum(np.diff(off) - width + 1)])


def quick_shingles(cp: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in 32 bits, for signatures: lines shorter than a shingle are filled up with zeros."""
    short = np.maximum(0, width - np.diff(off))
    if short.any():
        cp = np.insert(cp, np.repeat(off[1:], short), 0)
        off = off + np.concatenate([[0], np.cumsum(short)])
    n = max(0, len(cp) - width + 1)
    h = np.zeros(n, np.uint32)
    for j in range(width):
        h *= np.uint32(0x9E3779B1)
        h += cp[j : j + n]
    inside = np.ones(len(cp), bool)
    inside[(off[1:, None] - np.arange(1, width)).ravel()] = False
    h = h[inside[:n]]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h, np.concatenate([[0], np.cumsum(np.diff(off) - width + 1)])


def minhash(low: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """k minima for each line, as a (k, lines) array of uint32; hash i of a mixed shingle is its product with seed i."""
    out = np.empty((k, len(off) - 1), np.uint32)
    tmp = np.empty_like(low)
    for i in range(k):
        np.multiply(low, _SEEDS[i], out=tmp)
        out[i] = np.minimum.reduceat(tmp, off[:-1])
    return out


def lanes(sig: np.ndarray) -> np.ndarray:
    """Minima as 16-bit hashes that differ by row of the signature, four rows to a 64-bit key: (k / 4, lines)."""
    k, n = sig.shape
    h = C.mix(sig.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))[:, None]) >> np.uint64(48)
    shift = (np.arange(4, dtype=np.uint64) * np.uint64(16))[None, :, None]
    return np.bitwise_or.reduce(h.reshape(k // 4, 4, n) << shift, axis=1)


def signed(lines: DataFrame, width: int, n_bands: int) -> DataFrame:
    """``lines`` (h, line, first, copies) with the bands b0, b1 ..: four minima to a band, 16 bits each."""
    names = [f"b{i}" for i in range(n_bands)]
    schema = T.StructType([*lines.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, 1, CACHED):
                h, off = quick_shingles(*C.codes(b.column(1)), width)
                keys = lanes(minhash(h, off, n_bands * ROWS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in keys)], names=schema.names)

    return lines.mapInArrow(run, schema)


def bands(lines: DataFrame, n_bands: int) -> DataFrame:
    """(bucket, node) of the distinct lines."""
    return lines.select(F.explode(F.array(*(f"b{i}" for i in range(n_bands)))).alias("bucket"), F.col("h").alias("node"))


def _alike(n_bands: int) -> Column:
    """How many minima agree: four lanes of 16 bits a band."""
    total = F.lit(0)
    for i in range(n_bands):
        t = F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))
        for s in (8, 4, 2, 1):
            t = t.bitwiseOR(F.shiftrightunsigned(t, s))
        total = total + (4 - F.bit_count(t.bitwiseAND(F.lit(0x0001000100010001))))
    return total


def jaccard(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of the lines of each pair.

    Keys hold the pair's number above 44 bits of the shingle's hash, so one plain sort orders both at once.
    """
    n = len(a)
    limits = np.arange(n + 1, dtype=np.uint64) << np.uint64(44)
    sides, sizes = [], []
    for col in (a, b):
        keys, off = shingles(*C.codes(col), width)
        keys >>= np.uint64(20)
        keys |= np.repeat(limits[:-1], np.diff(off))
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        sides.append(keys)
        sizes.append(np.diff(np.searchsorted(keys, limits)))
    both = np.concatenate(sides)
    both.sort()
    inter = np.diff(np.searchsorted(both[1:][both[1:] == both[:-1]], limits))
    return inter / (sizes[0] + sizes[1] - inter)


def verified(pairs: DataFrame, lines: DataFrame, width: int, threshold: float, n_bands: int, agree: int) -> DataFrame:
    """The pairs (a, b) whose lines reach the threshold; only those with ``agree`` equal minima are compared."""
    sides = [
        lines.select(F.col("h").alias(k), *(F.col(f"b{i}").alias(f"{v}{i}") for i in range(n_bands))) for k, v in ("ax", "by")
    ]
    close = C.cut(pairs.join(sides[0], "a").join(sides[1], "b").filter(_alike(n_bands) >= agree).select("a", "b"))
    wanted = close.select(F.col("a").alias("h")).union(close.select("b")).distinct()
    texts = C.cut(lines.select("h", "line").join(wanted, "h", "left_semi"))
    full = close.join(texts.withColumnsRenamed({"h": "a", "line": "la"}), "a").join(
        texts.withColumnsRenamed({"h": "b", "line": "lb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, 2, CACHED):
                ok = pa.array(jaccard(b.column(2), b.column(3), width) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(ok)

    return full.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, h) of every non-blank line; the key of a line is a 64-bit hash of its text."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
        .withColumn("line", F.btrim("raw", F.lit(_SPACES)))
        .filter("line <> ''")
        .select("doc_id", "line_no", "line", F.xxhash64("line").alias("h"))
    )


def roots(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    n_bands: int = BANDS,
    threshold: float = THRESHOLD,
    agree: int = AGREE,
) -> tuple[DataFrame, DataFrame]:
    """(distinct lines with their first place, count and bands, (h, root) of lines similar to others)."""
    # repartitioned first, so that the grouping, the table's buckets and the joins below share one shuffle of the texts
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = (
        places(docs, id_col, text_col)
        .repartition(n, "h")
        .groupBy("h")
        .agg(
            F.min("line").alias("line"),
            F.min(F.struct("doc_id", "line_no")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select("h", "line", "first", "copies")
    )
    lines = C.cut_by(signed(lines, width, n_bands), "h")
    members = C.cut(C.meeting(lines, lambda part: bands(part, n_bands)))
    _, found = C.linked(members, lambda pairs: verified(pairs, lines, width, threshold, n_bands, agree))
    return lines, found.withColumnRenamed("node", "h")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every place of a line that occurs or resembles elsewhere: doc_id, line_no, component (a line key), keep, and
    the place kept for the component (kept_doc_id, kept_line_no)."""
    lines, found = roots(docs, id_col, text_col, **how)
    by = Window.partitionBy("root")
    grouped = (
        lines.join(found, "h", "left")
        .withColumn("root", F.coalesce("root", "h"))
        .select("h", "root", "first", "copies")
        .withColumn("best", F.min("first").over(by))
        .withColumn("n", F.sum("copies").over(by))
        .filter("n > 1")
        .select("h", "root", "best")
    )
    return (
        places(docs, id_col, text_col)
        .select("doc_id", "line_no", "h")
        .join(grouped, "h")
        .select(
            F.col("doc_id").alias(id_col),
            "line_no",
            F.col("root").alias("component"),
            (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("line_no") == F.col("best.line_no"))).alias("keep"),
            F.col("best.doc_id").alias("kept_doc_id"),
            F.col("best.line_no").alias("kept_line_no"),
        )
    )


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` without the lines that ``duplicates`` drops. Rows left without any line go, except rows that had no
    line before; ``size_col`` is counted anew where a text changed."""
    # a row's own key, so that rows that share an id, or have none, lose their own lines only; the order by id stays
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    drop = (
        duplicates(keyed, "__row", text_col, **how)
        .filter("NOT keep")
        .groupBy(F.col("__row").alias("__key"))
        .agg(F.collect_set("line_no").alias("__drop"))
    )
    got = keyed.join(drop, F.col("__row").eqNullSafe(F.col("__key")), "left")
    kept = F.filter(
        F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.array_contains("__drop", s["i"]),
    )
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    )
    got = got.withColumn("__new", text).filter(
        F.col("__drop").isNull() | F.col("__new").rlike(r"[^ \t\n\r\x0B\f]")
    )
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__new").alias(c))
        elif c == size_col:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("__drop").isNull(), F.col(c)).otherwise(F.length("__new")).cast(kind).alias(c))
        else:
            cols.append(F.col(c))
    return got.select(*cols)
