"""Substring dedup by content-defined chunking: gear hash cuts, chunks compared by digest.

A cut stands after each character where the gear hash of the ``WINDOW`` characters up to it falls below a limit, so
a text's cuts depend on nothing farther away, and shifts from insertions die out after one chunk. Equal chunks meet
by a 64-bit digest that covers the chunk's length (of 10**9 different chunks two share one with probability 0.03). Runs of touching chunks that stand in another place too, of the
same document or of another, make the spans of the result.

Cases: null and empty texts have no chunks; a text without a cut is one chunk up to ``MAX_CHUNK`` characters, and
longer runs without a cut are cut every ``MAX_CHUNK``; rows that share an id, or have none, are different
places, ordered by a hash of the text; an empty table gives an empty result; other columns aren't read.
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

WINDOW = 16
MEAN_CHUNK = 24
MAX_CHUNK = 1000
MIN_CHARS = 100

_GEAR = C.mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)).astype(np.uint32)


def gear(cp: np.ndarray) -> np.ndarray:
    """At each place the gear hash of the last 16 characters, sum of g[i - j] << j, by doubling (32 bit)."""
    h = _GEAR[(cp ^ (cp >> 16)) & 0xFFFF]
    for k in (1, 2, 4, 8):
        prev = np.zeros_like(h)
        prev[k:] = h[:-k] if len(h) > k else 0
        h = h + (prev << np.uint32(k))
    return h


def chunk(cp: np.ndarray, off: np.ndarray, mean: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of concatenated texts: text number, start and end in the concatenation."""
    limit = np.uint32((1 << 32) // mean)
    # the low bits hold few characters, so the hash is stirred before it is compared
    cuts = np.flatnonzero(gear(cp) * np.uint32(2654435769) < limit) + 1
    doc = np.searchsorted(off, cuts, side="left") - 1
    cuts = cuts[cuts - off[doc] >= WINDOW]
    edge = np.unique(np.concatenate([off, cuts]))
    gap = np.diff(edge)
    pieces = -(-gap // most)
    group, place = C.ranges(pieces)
    start = edge[:-1][group] + place * most
    end = np.minimum(start + most, edge[1:][group])
    return np.searchsorted(off, start, side="right") - 1, start, end


def _row(text_col: str) -> Column:
    """A key of the input row: 40 bits of its text's hash, so that the order of rows is the texts' own, and 24 that tell
    rows with equal texts apart."""
    low = F.lit((1 << 24) - 1)
    return F.xxhash64(text_col).bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low))


def chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean: int = MEAN_CHUNK,
    most: int = MAX_CHUNK,
    row: Column | None = None,
) -> DataFrame:
    """(id, row, loc, digest) of every chunk; row is a key of the input row, loc is start * 1024 + length, in characters."""
    if most > 1023:
        raise ValueError("a chunk's length must fit in ten bits")
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), (_row(text_col) if row is None else row).alias("__row"))
    schema = T.StructType(
        [
            T.StructField("id", read.schema["__id"].dataType),
            T.StructField("row", T.LongType()),
            T.StructField("loc", T.LongType()),
            T.StructField("digest", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, 1):
                cp, off = C.codes(b.column(1))
                doc, start, end = chunk(cp, off, mean, most)
                h = C.rolling(C.mix(cp.astype(np.uint64) + np.uint64(1)), start, end)
                h = C.mix(h ^ (end - start).astype(np.uint64)).view(np.int64)
                loc = (start - off[doc]) * 1024 + (end - start)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(loc, pa.int64()), pa.array(h)], names=schema.names
                )

    return read.mapInArrow(run, schema)


def spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    mean: int = MEAN_CHUNK,
) -> DataFrame:
    """Passages that stand more than once, one row for each place: id, start, end (characters), n_chars, n_chunks,
    repeat_chars (those whose first place, by id and start, is in a row with another id), first_id, copies and
    own_repeat_chars (those whose first place is under the same id: earlier in the text, or in another row). The
    characters of both counts are to be cut out; what is left is the first place of every chunk.

    One shuffle by digest, of 32 bytes a chunk, then one of the repeated chunks only, by row. Hot digests, found in a
    sample, aren't gathered: their counts and first places are aggregated and broadcast.
    """
    return _runs(_shared(docs, id_col, text_col, mean), id_col, min_chars)


def _shared(docs: DataFrame, id_col: str, text_col: str, mean: int, row: Column | None = None) -> DataFrame:
    """(id, row, start, end, copies, first) of every chunk that stands more than once; first is its first place."""
    got = chunks(docs, id_col, text_col, mean, row=row).withColumn("place", F.struct("id", F.expr("loc div 1024").alias("start"), "row"))
    hot = C.hot_keys(chunks(docs.sample(C._HOT_SAMPLE, 11), id_col, text_col, mean, row=row), "digest")
    same = Window.partitionBy("digest")
    cold, whole = got, None
    if hot:
        keys = C.keys_table(docs.sparkSession, hot, "digest")
        totals = got.join(keys, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first"))
        whole = got.join(F.broadcast(C.cut(totals)), "digest")  # at most C.HOT rows
        cold = got.join(keys, "digest", "left_anti")
    cold = cold.withColumn("copies", F.count(F.lit(1)).over(same)).filter("copies > 1").withColumn("first", F.min("place").over(same))
    names = ["id", "row", "loc", "copies", "first"]
    both = cold.select(*names) if whole is None else cold.select(*names).union(whole.filter("copies > 1").select(*names))
    return both.withColumn("start", F.expr("loc div 1024")).withColumn("end", F.expr("loc div 1024 + loc % 1024"))


def _runs(shared: DataFrame, id_col: str, min_chars: int, keep_cuts: bool = False) -> DataFrame:
    is_first = F.struct("id", "start", "row").eqNullSafe(F.col("first"))
    other = ~F.col("id").eqNullSafe(F.col("first.id"))
    length = F.col("end") - F.col("start")
    line = Window.partitionBy("id", "row").orderBy("start", "end")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        shared.withColumn("gap", F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("gap").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "row", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.sum(F.when(other, length).otherwise(0)).alias("repeat_chars"),
            F.min("first.id").alias("first_id"),
            F.max("copies").alias("copies"),
            F.sum(F.when(~other & ~is_first, length).otherwise(0)).alias("own_repeat_chars"),
            # where they lie
            F.array_sort(F.collect_list(F.when(~is_first, F.struct("start", "end")))).alias("cuts"),
        )
    )
    return runs.filter(F.col("end") - F.col("start") >= min_chars).select(
        F.col("id").alias(id_col),
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("n_chars"),
        "n_chunks",
        "repeat_chars",
        "first_id",
        "copies",
        "own_repeat_chars",
        *(["row", "cuts"] if keep_cuts else []),
    )


def apply(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    mean: int = MEAN_CHUNK,
) -> DataFrame:
    """``docs`` without the characters that ``spans`` counts as repeats: of every chunk inside a repeated passage its
    first place stays. Rows stay, also those left empty; null texts stay null; other columns are passed through."""
    # the rows' keys must be the same in both passes, so they are written once
    keyed = C.cut(docs.select("*", _row(text_col).alias("__chunk_row")))
    shared = _shared(keyed, id_col, text_col, mean, F.col("__chunk_row"))
    gone = (
        _runs(shared, "id", min_chars, keep_cuts=True)
        .select(F.col("row").alias("__gone"), F.explode("cuts").alias("c"))
        .groupBy("__gone")
        .agg(F.array_sort(F.collect_list("c")).alias("__cuts"))
    )
    # what lies between the cuts, which don't overlap
    kept = F.expr(
        f"""array_join(transform(sequence(0, size(__cuts)), i -> substring({text_col},
        cast(if(i = 0, 0, element_at(__cuts, greatest(i, 1)).`end`) + 1 as int),
        cast(if(i = size(__cuts), length({text_col}), element_at(__cuts, least(i + 1, size(__cuts))).start)
             - if(i = 0, 0, element_at(__cuts, greatest(i, 1)).`end`) as int))), '')"""
    )
    got = keyed.join(gone, F.col("__chunk_row") == F.col("__gone"), "left")
    new = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(kept)
    return got.select(*(new.alias(c) if c == text_col else F.col(c) for c in docs.columns))
