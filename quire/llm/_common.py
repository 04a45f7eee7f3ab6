"""Shared pieces of the training-data operators: shared-storage cuts, prefix sums, components, text arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, spelled out because Java, RE2 and Python disagree on ``\s``.
SPACE = r"[ \t\n\r\x0B\f]"
_SPACE_CODES = np.array([32, 9, 10, 13, 11, 12], dtype=np.uint32)

#: Text is handed to numpy in slices of about this many bytes; one longer text is a slice by itself.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)


# ~~ shared storage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for cut tables: ``spark.checkpoint.dir``; on one machine (``local`` master) a temporary
    folder where it is unset, on a cluster an error, since executors share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = tempfile.mkdtemp(prefix="quire-")
    return made


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` is set to ``value`` inside, and as before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as the table stands: nothing reads them again, and a table in
    shared storage doesn't need them for recovery."""
    with configured(spark, _CLEANUP, "true"):
        yield


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in shared storage and read it back: later stages survive lost executors.

    The path is kept on the result as ``_cut_path`` so that iterative callers can drop superseded rounds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _PATHS.append((spark, path))
    return out


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """Like ``cut``, but bucketed by ``key``: later joins and groupings on it don't shuffle the table again."""
    spark = df.sparkSession
    name = f"quire_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_dropped(spark):
        df.write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    _PATHS.append((spark, path))
    out = spark.table(name)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    path = getattr(df, "_cut_path", None)
    if path:
        remove(df.sparkSession, path)


_PATHS: list[tuple[SparkSession, str]] = []
_NOTED: list[tuple[SparkSession, str]] = []


@contextmanager
def tables_noted() -> Iterator[None]:
    """What is cut inside may be dropped by ``drop_noted``."""
    start = len(_PATHS)
    try:
        yield
    finally:
        _NOTED.extend(_PATHS[start:])


def drop_noted(docs: DataFrame) -> None:
    """Drop the noted tables, but for those that ``docs`` still reads."""
    if not _NOTED:
        return
    files = docs.inputFiles()
    keep = [(s, p) for s, p in _NOTED if any(p.rsplit("/", 1)[-1] in f for f in files)]
    for spark, path in _NOTED:
        if (spark, path) not in keep and getattr(spark.sparkContext, "_jsc", None) is not None:
            _drop(spark, path)
            _PATHS.remove((spark, path))
    _NOTED[:] = keep


def _drop(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[-1].replace('-', '_')}")
    remove(spark, path)


@atexit.register
def cleanup() -> None:
    """Drop every table that ``cut`` wrote in this session; what a stopped session can't reach stays."""
    while _PATHS:
        spark, path = _PATHS.pop()
        if getattr(spark.sparkContext, "_jsc", None) is None:
            continue
        try:
            _drop(spark, path)
        except Exception:  # noqa: BLE001 - the gateway may already be gone at interpreter exit
            return


# ~~ columns
def words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+")), F.lit(0)).cast("long")


def prefix_sum(
    df: DataFrame, keys: list[str], coarse: str, order: list[str], value: str, out: str
) -> DataFrame:
    """Exclusive running sum of ``value`` inside ``keys``, in the order (``coarse``, ``order``).

    Two levels: totals by (keys, coarse) are summed over first, then rows within one ``coarse`` cell, so that no
    task sorts a whole key. ``coarse`` must have a bounded number of values per key and order before ``order``.
    """
    base = f"__{out}_base"
    cells = df.groupBy(*keys, coarse).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(base, F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    within = Window.partitionBy(*keys, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        got.join(cells, [*keys, coarse])
        .withColumn(out, (F.col(out) + F.col(base)).cast("long"))
        .drop(base)
    )


# ~~ distributed union-find
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of the component.

    Alternating large-star and small-star rounds. Least neighbours are aggregated (combined before the shuffle) and
    joined back, so that a node with very many neighbours is split by the skew join instead of being one window. Each
    round is one table in shared storage, and the one before is dropped; rounds grow with the logarithm of the graph's
    size. Null ends and loops are ignored.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v")
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small = (
            star.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = cut(small)
        new_mark = _mark(new)
        drop_cut(now)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )


def _mark(df: DataFrame) -> tuple:
    row = df.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h"),
    ).first()
    return row["n"], row["h"]


# ~~ candidates by shared buckets
#: Buckets beyond the ``HOT`` largest of a sample hold at most 1 / ``HOT`` of all rows and are grouped in one task.
HOT = 10_000
_HOT_SAMPLE, _HOT_ROWS = 0.01, 200
#: Members of one bucket are compared in blocks of about this many.
_BLOCK = 256


def hot_keys(sample: DataFrame, key: str) -> list[int]:
    """The most frequent values, ``HOT`` at most, of a 1 % sample's column that stand in it ``_HOT_ROWS`` times or more."""
    counts = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= _HOT_ROWS)
    return counts.orderBy(F.desc("n"), key).limit(HOT).toArrow().column(key).to_pylist()


def keys_table(spark: SparkSession, keys: list[int], name: str) -> DataFrame:
    """At most ``HOT`` keys, to be broadcast."""
    return F.broadcast(spark.createDataFrame([(k,) for k in keys], f"{name} long"))


def meeting(source: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(bucket, node, first) of every row of ``rows_of(source)`` (bucket, node) whose bucket holds another node; first is
    the bucket's least node.

    Hot buckets, found in a sample, are not gathered: their least node is aggregated with combining and comes back by a
    broadcast of at most ``HOT`` rows. The sample decides on the way only, not on the result.
    """
    got = rows_of(source)
    hot = hot_keys(rows_of(source.sample(_HOT_SAMPLE, 11)), "bucket")
    whole = None
    if hot:
        keys = keys_table(source.sparkSession, hot, "bucket")
        least = got.join(keys, "bucket", "left_semi").groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"))
        whole = got.join(F.broadcast(cut(least).filter("first < last").select("bucket", "first")), "bucket")
        got = got.join(keys, "bucket", "left_anti")
    cold = _gathered(got, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cold if whole is None else cold.union(whole.select("bucket", "node", "first"))


def _gathered(rows: DataFrame, n: int) -> DataFrame:
    """``meeting`` of buckets that aren't hot: (bucket, node) travel as packed arrays and are grouped in numpy."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            bucket, node = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((mix(bucket.view(U64)) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(n + 1))
            some = np.flatnonzero(at[:-1] < at[1:])
            cols = ([x[order[at[i] : at[i + 1]]].tobytes() for i in some] for x in (bucket, node))
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in cols)], names=["part", "buckets", "nodes"]
            )

        held, count = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            count += b.num_rows
            if count >= 1 << 19:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [[np.frombuffer(x, np.int64) for x in row] for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not have:
            return
        bucket, node = (np.concatenate(x) for x in zip(*have, strict=True))
        del have
        order = np.argsort(bucket)
        bucket, node = bucket[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        first, last = np.minimum.reduceat(node, start), np.maximum.reduceat(node, start)
        size = np.diff(np.concatenate([start, [len(bucket)]]))
        on = np.repeat(first < last, size)
        cols = bucket[on], node[on], np.repeat(first, size)[on]
        for s in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in cols], names=["bucket", "node", "first"])

    packed = rows.select("bucket", "node").mapInArrow(pack, "part int, buckets binary, nodes binary")
    return packed.repartitionById(n, "part").select("buckets", "nodes").mapInArrow(meet, "bucket long, node long, first long")


def linked(
    members: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    extra: DataFrame | None = None,
    sieve: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect every two nodes of one bucket which ``check`` would find similar, and their
    ``components``.

    ``members`` is a cut table as ``meeting`` gives it, dropped on the way; ``check`` keeps the similar ones of distinct pairs (a, b).
    First each node is checked against its bucket's least node. Then pairs of one bucket that are still in different
    components are checked, block against block, so that no bucket is gathered as a whole. Pairs in one component are
    settled and not checked again. ``sieve`` drops hopeless ones of these pairs as they arise, before they are shuffled; it
    sees a, b and the columns of ``extra`` (node, ...) for both, with _a and _b appended.
    """
    star = cut(members.filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    edges = cut(check(star))
    found = cut(components(edges))
    at = members.join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    at = cut(at)
    drop_cut(members)
    mixed = (
        at.groupBy("bucket")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo < hi AND n > 2")
        .select("bucket", F.expr(f"(n + {_BLOCK - 1}) div {_BLOCK}").alias("parts"))
    )
    split = at.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    more = [] if extra is None else [c for c in extra.columns if c != "node"]
    if more:
        split = split.join(extra, "node")
    split = cut(split.select("bucket", "part", "node", "root", *more))
    drop_cut(at)
    left = split.select(
        "bucket",
        F.explode(F.sequence(F.lit(0).cast("long"), "part")).alias("part"),
        F.col("part").alias("own"),
        F.col("node").alias("a"),
        F.col("root").alias("ra"),
        *(F.col(c).alias(f"{c}_a") for c in more),
    )
    right = split.select("bucket", "part", F.col("node").alias("b"), F.col("root").alias("rb"), *(F.col(c).alias(f"{c}_b") for c in more))
    rest = left.join(right, ["bucket", "part"]).filter("ra <> rb AND (own > part OR a > b)")
    if sieve is not None:
        rest = sieve(rest.select("a", "b", *(f"{c}_{k}" for c in more for k in ("a", "b"))))
    rest = (
        rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    rest = cut(rest)
    late = None if rest.isEmpty() else cut(check(rest))
    if late is None or late.isEmpty():
        return edges, found
    edges = edges.union(late)
    return edges, cut(components(edges))


# ~~ text as arrays
def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of at most ``rows`` rows whose texts have about ``limit`` bytes together."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size.astype(np.int64) + 64)
    at = 0
    while at < n:
        base = end[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(end, base + limit, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end (uint32) and the n + 1 offsets; null counts as empty."""
    col = pc.fill_null(column, "") if column.null_count else column
    if len(col) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[off]


def spans(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts: starts, ends (exclusive) and the text that each lies in."""
    solid = cp > 32
    if (~solid).any():
        solid |= ~np.isin(cp, _SPACE_CODES) & ~solid
    edge = np.zeros(len(cp) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]]) if len(cp) else solid
    after = np.concatenate([solid[1:], [False]]) if len(cp) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the rolling hash's odd base modulo 2**64, or of its inverse."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        base = pow(int(_BASE), -1, 1 << 64) if inverse else int(_BASE)
        step = np.full(max(n, 1 << 16), U64(base))
        step[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(step)
    return have[:n]


def rolling(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, from one running sum modulo 2**64."""
    n = len(values)
    run = np.zeros(n + 1, U64)
    np.cumsum(values.astype(U64, copy=False) * powers(n), out=run[1:])
    return (run[end] - run[start]) * powers(n + 1, True)[start]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def word_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(rolling(mix(cp.astype(U64) + U64(1)), start, end))


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether the same key stands earlier."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        at = np.argsort(keys, kind="stable")
        s = keys[at]
        same = s[1:] == s[:-1]
        out[at[1:][same]] = True
    return out


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the group number and the place inside the group of each of sum(c) elements."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    return group, np.arange(len(group)) - np.repeat(first, counts)
