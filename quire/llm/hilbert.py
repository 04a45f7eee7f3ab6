"""Sharding along a Hilbert curve for multidimensional file pruning.

Each metadata dimension is quantised to 2**bits cells of equal depth: a value's cell is its share of rows with smaller
values. Rows are ordered by the curve index of their cells and cut into runs of ``shard_rows``; each run is a file
whose rows lie close together in every dimension, so min/max statistics prune on any of them.

Cases: null is the smallest value of each dimension; a dimension with one value has cell 0 throughout; ties (equal
cells) are ordered by (md5 of the id, id, dimensions), so repeated rows are interchangeable; an empty table gives an
empty result; columns other than the id and the dimensions are neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

DIMENSIONS = ("source", "lang", "n_chars")
BITS = 6
SHARD_ROWS = 4096
#: A table of distinct values is broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def curve_steps(dims: int, bits: int) -> list[list[str]]:
    """The curve index as layers of SQL expressions over x0..x<dims-1> (Skilling's transform), for the SQL twin.

    Each layer is a list of ``expression AS name`` that replaces all x columns; the last one yields h.
    """
    xs = [f"x{i}" for i in range(dims)]
    layers: list[list[str]] = []

    def layer(change: dict[str, str]) -> None:
        layers.append([f"{change.get(x, x)} AS {x}" for x in xs])

    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for x in xs:
            on = f"({x} & {q}) <> 0"
            if x == "x0":
                layer({"x0": f"CASE WHEN {on} THEN xor(x0, {q - 1}) ELSE x0 END"})
            else:
                t = f"(xor(x0, {x}) & {q - 1})"
                layer(
                    {
                        "x0": f"CASE WHEN {on} THEN xor(x0, {q - 1}) ELSE xor(x0, {t}) END",
                        x: f"CASE WHEN {on} THEN {x} ELSE xor({x}, {t}) END",
                    }
                )
    for i in range(1, dims):
        layer({f"x{i}": f"xor(x{i}, x{i - 1})"})
    last = xs[-1]
    t = "0"
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        t = f"xor({t}, CASE WHEN ({last} & {q}) <> 0 THEN {q - 1} ELSE 0 END)"
    layers.append([f"xor({x}, {t}) AS {x}" for x in xs])
    bitsum = " + ".join(
        f"(CASE WHEN ({x} & {1 << b}) <> 0 THEN {1 << (b * dims + dims - 1 - i)} ELSE 0 END)"
        for b in range(bits)
        for i, x in enumerate(xs)
    )
    layers.append([f"CAST({bitsum} AS BIGINT) AS h"])
    return layers


def curve_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The curve index of arrays of cells, by the same transform in numpy."""
    x = [np.asarray(c, np.int64).copy() for c in cells]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, t)
            if i:
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits):
        for i in range(n):
            out |= (((x[i] ^ t) >> b) & 1) << (b * n + n - 1 - i)
    return out


def cell_tables(docs: DataFrame, dims: Sequence[str], bits: int) -> list[DataFrame]:
    """For each dimension (value, x): equal-depth cells over all rows, from one count per distinct value."""
    out = []
    for i, c in enumerate(dims):
        counts = docs.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        before = Window.orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)  # distinct values only
        every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out.append(
            counts.select(
                F.col("v").alias(f"v{i}"),
                (F.coalesce(F.sum("c").over(before), F.lit(0)) * (1 << bits)).alias("num"),
                F.sum("c").over(every).alias("all"),
            ).select(f"v{i}", F.expr("cast(num div all as int)").alias(f"x{i}"))
        )
    return out


def shards(
    docs: DataFrame,
    dims: Sequence[str] = DIMENSIONS,
    bits: int = BITS,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, x0.., h, position, shard) of every row: cells, curve index, place on the curve, file number."""
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the curve index must fit in 62 bits")
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"d{i}") for i, c in enumerate(dims)))
    for i, table in enumerate(cell_tables(docs, dims, bits)):
        table = C.cut(table)
        small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        got = got.join(F.broadcast(table) if small else table, F.col(f"d{i}").eqNullSafe(F.col(f"v{i}")))
    xs = [f"x{i}" for i in range(n)]

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(curve_index([c.to_numpy() for c in cells], bits))

    got = got.select("doc_id", *(f"d{i}" for i in range(n)), *xs, index(*xs).alias("h"))
    # rows of one curve cell are spread by a hash of the id, so that no task gets a whole hot cell
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    got = (
        got.withColumn("key", key)
        .withColumn("cell", F.concat(F.lpad(F.hex("h"), 16, "0"), F.substring("key", 1, 1)))
        .withColumn("one", F.lit(1).cast("long"))
        .withColumn("all", F.lit(0))
    )
    got = C.prefix_sum(got, ["all"], "cell", ["key", "doc_id", *(f"d{i}" for i in range(n))], "one", "position")
    return got.select(
        "doc_id", *xs, "h", "position", F.expr(f"position div {shard_rows}").alias("shard")
    )


def write(docs: DataFrame, path: str, id_col: str = "doc_id", **how) -> None:
    """Write ``docs`` as one file a shard (rows sharing an id go with the first shard of the id)."""
    at = shards(docs, id_col=id_col, **how).groupBy(F.col("doc_id").alias("__id")).agg(F.min("shard").alias("__shard"))
    full = docs.join(at, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))).drop("__id")
    full.repartitionByRange("__shard").sortWithinPartitions("__shard").write.partitionBy("__shard").parquet(path)


def sql(table: str = "documents", dims: Sequence[str] = DIMENSIONS, bits: int = BITS, shard_rows: int = SHARD_ROWS) -> str:
    n = len(dims)
    ctes = []
    for i, c in enumerate(dims):
        ctes.append(
            f"v{i} AS (SELECT v{i}, (coalesce(sum(c) OVER (ORDER BY v{i} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
            f" * {1 << bits} // sum(c) OVER ())::INTEGER AS x{i} FROM (SELECT {c} AS v{i}, count(*) AS c FROM {table} GROUP BY 1))"
        )
    xs = [f"x{i}" for i in range(n)]
    joins = " ".join(f"JOIN v{i} ON t.{c} IS NOT DISTINCT FROM v{i}.v{i}" for i, c in enumerate(dims))
    ds = ", ".join(f"d{i}" for i in range(n))
    cx = ", ".join(f"c{x}" for x in xs)
    ctes.append(
        f"s0 AS (SELECT doc_id, {', '.join(f'{c} AS d{i}' for i, c in enumerate(dims))}, {', '.join(xs)}, "
        f"{', '.join(f'{x} AS c{x}' for x in xs)} FROM {table} t {joins})"
    )
    steps = curve_steps(n, bits)
    for k, step in enumerate(steps):
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT doc_id, {ds}, {cx}, {', '.join(step)} FROM s{k})")
    ctes.append(
        f"p AS (SELECT *, row_number() OVER (ORDER BY h, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 1),"
        f" md5(coalesce(doc_id::VARCHAR, '')), doc_id, {ds}) - 1 AS position FROM s{len(steps)})"
    )
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, {', '.join(f'c{x} AS {x}' for x in xs)}, h, position,"
        f" position // {shard_rows} AS shard FROM p"
    )
