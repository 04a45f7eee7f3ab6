"""Packing texts into windows by non-negative least squares over the histogram of lengths.

Texts longer than the window are cut: full windows are packs by themselves, the rest is an item like any other.
Lengths are rounded up to ``GRAIN``-ths of the window. All combinations of at most ``DEPTH`` lengths that fill a
window exactly are enumerated; non-negative least squares finds how often each is wanted so that the histogram is
used up; the counts are rounded down to what the histogram holds, and what remains is packed greedily, largest first
with the largest that fit, as whole patterns at a time. All this runs on the histogram, whose size is bounded by
``GRAIN``. Items find their pack by their rank among items of their length: a join with the plan's rank ranges.

Cases: null, empty and blank texts have no item; a text of exactly the window is one full pack; ties in length are
ordered by (md5 of the id, id, piece), so repeated rows are interchangeable; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

WINDOW = 2048
GRAIN = 64
DEPTH = 3


def combinations(grain: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``depth`` positive lengths with sum ``grain``."""
    out: list[tuple[int, ...]] = []

    def add(left: int, most: int, slots: int, head: tuple[int, ...]) -> None:
        if not left:
            out.append(head)
        elif slots:
            for x in range(min(left, most), -(-left // slots) - 1, -1):
                add(left - x, x, slots - 1, (*head, x))

    add(grain, grain, depth, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least squares with x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * n):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 1e-12)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], grain: int = GRAIN, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one pack, number of such packs), which use up the histogram of lengths exactly."""
    left = {u: int(c) for u, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...], times: int) -> None:
        out.append((parts, times))
        for p in parts:
            left[p] -= times
            if not left[p]:
                del left[p]

    have = np.array([left.get(u, 0) for u in range(1, grain + 1)], float)
    combos = [c for c in combinations(grain, depth) if all(p in left for p in c)]
    if combos:
        a = np.zeros((grain, len(combos)))
        for j, c in enumerate(combos):
            for p in c:
                a[p - 1, j] += 1
        # short items fill gaps anyway, so a shortage of long ones weighs more
        weight = np.linspace(0.2, 1, grain)[:, None]
        x = nnls(a * weight, have * weight[:, 0])
        for j in np.argsort(-x, kind="stable"):
            c = combos[j]
            most = min(left.get(p, 0) // c.count(p) for p in set(c))
            if (times := min(int(np.floor(x[j] + 1e-9)), most)) > 0:
                use(c, times)
    while left:
        parts: list[int] = []
        room = grain
        spare = dict(left)
        while fit := [u for u, c in spare.items() if u <= room and c]:
            u = max(fit)
            k = min(room // u, spare[u])
            parts += [u] * k
            spare[u] -= k
            room -= u * k
        use(tuple(parts), min(left[p] // parts.count(p) for p in set(parts)))
    return out


def items(docs: DataFrame, window: int, grain: int, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """(doc_id, piece, tok_start, n_tokens, unit) of every piece; unit = length in grains, rounded up."""
    per = window // grain
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.words(F.col(text_col)).alias("n"), F.col(text_col).alias("whole"))
    got = got.filter("n > 0")
    if with_text:
        # only texts of several pieces are split; a word keeps the white space after it
        body = F.btrim("whole", F.lit(" \t\n\r\x0b\f"))
        got = got.withColumn(
            "parts", F.when(F.col("n") > window, F.split(body, f"(?<={C.SPACE})(?=[^ \\t\\n\\r\\x0B\\f])"))
        )
    got = got if with_text else got.drop("whole")
    return (
        got
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {window}"))))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * window).alias("tok_start"),
            F.least(F.lit(window).cast("long"), F.col("n") - F.col("piece") * window).alias("n_tokens"),
            *([_piece_text(window)] if with_text else []),
        )
        .withColumn("unit", F.expr(f"cast((n_tokens + {per - 1}) div {per} as int)"))
    )


def _piece_text(window: int) -> Column:
    own = F.array_join(F.slice("parts", (F.col("piece") * window + 1).cast("int"), F.lit(window)), "")
    return F.when(F.col("parts").isNull(), F.col("whole")).otherwise(F.rtrim(own, F.lit(" \t\n\r\x0b\f"))).alias("piece_text")


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    grain: int = GRAIN,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """(pack_id, slot, doc_id, piece, tok_start, n_tokens): every piece of every text in one pack.

    Lengths are counted once into a table and ranked from there, without their texts. ``with_text`` adds the piece's
    own text (white space after its last word left out, all other kept) at the price of ranking texts along.
    """
    if window % grain:
        raise ValueError("the window must be a multiple of the grain")
    spark = docs.sparkSession
    parts = items(docs, window, grain, id_col, text_col, with_text)
    if not with_text:
        parts = C.cut(parts)
    hist = {r["unit"]: r["c"] for r in parts.select("unit").groupBy("unit").agg(F.count(F.lit(1)).alias("c")).collect()}  # <= grain rows
    rows, base, used = [], 0, dict.fromkeys(hist, 0)
    for lengths, times in plan(hist, grain, depth):
        for u in sorted(set(lengths), reverse=True):
            k = lengths.count(u)
            # ranks [first, first + times * k) of length u; k to a pack
            rows.append((u, used[u], used[u] + times * k, k, base, lengths.index(u)))
            used[u] += times * k
        base += times
    schema = T.StructType(
        [T.StructField("unit", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("first", "last", "k", "base", "slot0")]
    )
    ranges = spark.createDataFrame(rows, schema)  # bounded by the grain and the number of combinations
    order = (
        parts.withColumn("key", F.md5(F.col("doc_id").cast("string")))
        .withColumn("cell", F.substring(F.coalesce("key", F.lit("")), 1, 3))
        .withColumn("one", F.lit(1).cast("long"))
    )
    ranked = C.prefix_sum(order, ["unit"], "cell", ["key", "doc_id", "piece", "n_tokens"], "one", "rank")
    got = ranked.join(F.broadcast(ranges), "unit").filter("rank >= first AND rank < last")
    return got.select(
        (F.col("base") + F.expr("(rank - first) div k")).alias("pack_id"),
        (F.col("slot0") + F.expr("(rank - first) % k")).cast("int").alias("slot"),
        "doc_id",
        "piece",
        "tok_start",
        "n_tokens",
        *(["piece_text"] if with_text else []),
    )
