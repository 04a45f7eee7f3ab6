"""Mixing sources to target weights with a low-discrepancy schedule.

Documents of a source are shuffled (by an md5 of seed and id) and laid end to end; every ``block_tokens`` words make
one block. Slot i of the schedule has the golden-ratio point frac(i * phi), kept exact in 32-bit integers; the
cumulative weights cut [0, 1) into one interval a source, so each prefix of the schedule is close to the target
weights. The slots of a source are ranked, and its k-th slot takes block k modulo the number of its blocks; a further
round is a further epoch. With a ``token_budget`` the schedule has as many slots as that needs, and what rare sources
show of themselves follows from their weights. Without one it ends at the slot where the last source has shown all its
blocks once, so nothing is left out and the sources that the target favours are repeated.

Weights default to the 3/4 power of a source's words (smoothed towards equal shares); ``weights`` names others.

Cases: a null, empty or blank text has no words and no place in a block; a null source counts as the source ''; a
source without words or with weight 0 gets no slot; ties in the shuffle (repeated rows) are equal rows, so either
order gives the same result; an empty table gives an empty schedule; other columns are passed through by ``apply``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

BLOCK_TOKENS = 2048
SEED = 17
GOLDEN = 2654435769  # 2**32 / phi
_SPAN = 1 << 32
_SLICE = 1 << 16
_CELLS = 256
#: Slots beyond the exact share within which the rarest source's last block must fall.
_SLACK = 64
#: Without a token budget the schedule shows all blocks; weights that need more slots than this many times their number
#: are an error, as is a positive weight too small for an interval.
MAX_EPOCHS = 1000


def _point(slot: Column) -> Column:
    """frac(slot * phi) * 2**32, exact: slot * GOLDEN mod 2**32 by two 16-bit halves, which can't overflow."""
    low, high = slot.bitwiseAND(F.lit(0xFFFF)), F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * GOLDEN + F.shiftleft((high * GOLDEN).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_SPAN - 1))


def laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: bool = False) -> DataFrame:
    """(source, id, start, n) of every document with words: its place in its source's shuffled run of words."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key")
    cols = [
        F.coalesce(F.col(source_col), F.lit("")).alias("__source"),
        F.col(id_col).cast("long").alias("__id"),
        C.words(F.col(text_col)).alias("__n"),
        key.alias("__key"),
    ]
    read = docs.select(*cols, *([F.struct(*docs.columns).alias("__row")] if keep else []))
    read = read.filter("__n > 0").withColumn("__cell", F.substring("__key", 1, 3))
    return C.prefix_sum(read, ["__source"], "__cell", ["__key", "__id", "__n"], "__n", "__start")


def shares(laid: DataFrame, block_tokens: int, weights: Mapping[str, float] | None) -> DataFrame:
    """(source, blocks, low, high): each source's number of blocks and its interval of [0, 2**32)."""
    got = laid.groupBy("__source").agg(F.sum("__n").alias("tokens"))
    if weights is None:
        got = got.withColumn("w", F.sqrt(F.col("tokens").cast("double")) * F.sqrt(F.sqrt(F.col("tokens").cast("double"))))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        named = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        got = got.withColumn("w", F.coalesce(F.try_element_at(named, F.col("__source")), F.lit(0.0)))
    got = got.filter("w > 0")
    order = Window.orderBy("__source")  # one row a source
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    high = F.round(F.sum("w").over(upto) / total * _SPAN).cast("long")
    got = got.select(
        F.col("__source").alias("source"), F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks"), high.alias("high")
    )
    return got.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source")), F.lit(0)).cast("long"))


def slots(spark, share: DataFrame, n_slots: int | None = None) -> DataFrame:
    """(slot, source, rank, blocks): the schedule, ``n_slots`` long or cut where every block of every source has been shown."""
    row = share.agg(
        F.max(F.ceil((F.col("blocks") + _SLACK) * float(_SPAN) / F.greatest(F.col("high") - F.col("low"), F.lit(1)))).alias("n"),
        F.sum("blocks").alias("blocks"),
        F.expr("count_if(high <= low)").alias("lost"),
    ).first()
    n = int(row["n"] or 0) if n_slots is None else n_slots
    if n_slots is None and (row["lost"] or n > MAX_EPOCHS * ((row["blocks"] or 0) + _SLACK)):
        raise ValueError(
            f"showing every block once takes {n} slots for {row['blocks']} blocks: give a token budget, or less uneven weights"
        )
    # the interval join runs on cells of the unit interval, so it is an equi-join at any number of sources
    cells = share.filter("high > low").withColumn(
        "cell", F.explode(F.sequence(F.expr(f"low div {_SPAN // _CELLS}"), F.expr(f"(high - 1) div {_SPAN // _CELLS}")))
    )
    got = (
        spark.range(n)
        .select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
        .withColumn("cell", F.expr(f"point div {_SPAN // _CELLS}"))
        .join(cells, "cell")
        .filter("point >= low AND point < high")
        .select("slot", "source", "blocks", F.expr(f"slot div {_SLICE}").alias("part"), F.lit(1).cast("long").alias("one"))
    )
    got = C.prefix_sum(got, ["source"], "part", ["slot"], "one", "rank")
    if n_slots is not None:
        return got.select("slot", "source", "rank", "blocks")
    end = got.filter("rank = blocks - 1").agg(F.max("slot").alias("end"))
    return got.crossJoin(F.broadcast(end)).filter("slot <= end").select("slot", "source", "rank", "blocks")


def _slots_of(token_budget: int | None, block_tokens: int) -> int | None:
    return None if token_budget is None else -(-token_budget // block_tokens)


def schedule(
    docs: DataFrame,
    block_tokens: int = BLOCK_TOKENS,
    weights: Mapping[str, float] | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    token_budget: int | None = None,
) -> DataFrame:
    """The mix: one row for each piece of a document in each slot - slot, source, epoch, block, doc_id, and the
    half-open range of the document's words (tok_start, tok_end)."""
    laid = C.cut(laid_out(docs, id_col, text_col, source_col, seed))
    share = C.cut(shares(laid, block_tokens, weights))
    plan = slots(docs.sparkSession, share, _slots_of(token_budget, block_tokens)).select(
        "slot", "source", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block")
    )
    b = block_tokens
    pieces = (
        laid.withColumn("block", F.explode(F.sequence(F.expr(f"__start div {b}"), F.expr(f"(__start + __n - 1) div {b}"))))
        .select(
            F.col("__source").alias("source"),
            "block",
            F.col("__id").alias("doc_id"),
            (F.greatest(F.col("__start"), F.col("block") * b) - F.col("__start")).alias("tok_start"),
            (F.least(F.col("__start") + F.col("__n"), (F.col("block") + 1) * b) - F.col("__start")).alias("tok_end"),
        )
    )
    return plan.join(pieces, ["source", "block"]).select(
        "slot", "source", "epoch", "block", "doc_id", "tok_start", "tok_end"
    )


def apply(
    docs: DataFrame,
    block_tokens: int = BLOCK_TOKENS,
    weights: Mapping[str, float] | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    token_budget: int | None = None,
) -> DataFrame:
    """``docs`` mixed: each document as often as the schedule shows the block in which it begins, never cut; without a
    ``token_budget`` at least once.

    How often follows from the source's number of slots alone, so texts are shuffled once and no block is joined.
    """
    laid = C.cut(laid_out(docs, id_col, text_col, source_col, seed))
    share = C.cut(shares(laid, block_tokens, weights))
    given = slots(docs.sparkSession, share, _slots_of(token_budget, block_tokens)).groupBy("source").agg(F.count(F.lit(1)).alias("given"), F.max("blocks").alias("blocks"))
    block = F.expr(f"__start div {block_tokens}")
    times = F.when(block < F.col("given"), F.expr("(given - 1 - block) div blocks + 1")).otherwise(0)
    full = laid_out(docs, id_col, text_col, source_col, seed, keep=True)
    return (
        full.join(C.cut(given), F.col("__source") == F.col("source"))
        .withColumn("block", block)
        .withColumn("__times", times)
        .filter("__times > 0")
        .select(F.col("__row"), F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__epoch"))
        .select("__row.*")
    )


def sql_parts(table: str, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> str:
    """CTEs laid(source, doc_id, n, start), share(source, blocks, low, high) and plan(slot, source, rank, blocks)."""
    return f"""laid AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY key, doc_id, n ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM (
  SELECT coalesce(source, '') AS source, doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\f]+'))::BIGINT AS n,
    md5(concat('{seed}:', coalesce(doc_id::VARCHAR, ''))) AS key FROM {table}) WHERE n > 0),
tok AS (SELECT source, sum(n)::DOUBLE AS tokens FROM laid GROUP BY source),
wt AS (SELECT source, ceil(tokens / {block_tokens})::BIGINT AS blocks, sqrt(tokens) * sqrt(sqrt(tokens)) AS w FROM tok),
hi AS (SELECT source, blocks, round(sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) / sum(w) OVER () * {_SPAN})::BIGINT AS high FROM wt),
share AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source), 0)::BIGINT AS low FROM hi),
pts AS (SELECT slot, (slot::HUGEINT * {GOLDEN} % {_SPAN})::BIGINT AS point FROM (SELECT unnest(range(
  (SELECT coalesce(max(ceil((blocks + {_SLACK}) * {float(_SPAN)} / greatest(high - low, 1))), 0)::BIGINT FROM share))) AS slot)),
ranked AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM pts JOIN share ON point >= low AND point < high),
plan AS (SELECT * FROM ranked WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = blocks - 1))"""


def sql(table: str = "documents", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> str:
    b = block_tokens
    return f"""WITH {sql_parts(table, b, seed)},
pieces AS (SELECT source, block, doc_id, greatest(start, block * {b}) - start AS tok_start, least(start + n, (block + 1) * {b}) - start AS tok_end
  FROM (SELECT *, unnest(range(start // {b}, (start + n - 1) // {b} + 1)) AS block FROM laid))
SELECT slot, source, rank // blocks AS epoch, block, doc_id, tok_start, tok_end
FROM plan JOIN pieces USING (source) WHERE block = rank % blocks"""
