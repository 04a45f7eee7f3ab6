"""Metrics of pairs of texts in one pass: edit distance, bags of words and of table cells, counted in Python workers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.text import f
from quire.plans.dialect import SPARK
from quire.plans.registry import built

from . import bags, evaluation, structure

_WORD = re.compile("[A-Za-z0-9_]+")


def edits(a: str, b: str) -> int:
    """Edit distance of ASCII texts: common ends are cut off, the rest goes through the bit-parallel algorithm of Myers."""
    if len(a) < len(b):
        a, b = b, a
    n = _alike(lambda k: a[:k] == b[:k], len(b))
    a, b = a[n:], b[n:]
    n = _alike(lambda k: a[len(a) - k :] == b[len(b) - k :], len(b))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not b:
        return len(a)
    raw = np.frombuffer(a.encode("ascii"), np.uint8)
    at = {c: int.from_bytes(np.packbits(raw == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    full, top, out = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        x = at[c] | down
        same = (((up + (x & up)) ^ up) | x) & full
        right, left = down | (full ^ (up | same)), up & same
        if right & top:
            out += 1
        elif left & top:
            out -= 1
        x = ((right << 1) | 1) & full
        up, down = ((left << 1) & full) | (full ^ (x | same)), x & same
    return out


def _alike(same, most: int) -> int:
    """The largest k up to ``most`` for which ``same`` holds, which then holds for all below."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(mid) else (low, mid - 1)
    return low


def accuracy(g: str | None, t: str) -> float | None:
    if g is None:
        return None
    return 1.0 if g == t else 1 - edits(g, t) / max(len(g), len(t))


def overlap(a: Counter, b: Counter) -> float | None:
    both = bags.common(a, b)
    most = bags.total(a) + bags.total(b) - both
    return both / most if most else None


def _words(text: str | None) -> Counter:
    return Counter(_WORD.findall(text or ""))


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bags._out(f(bags._rows(batches)), schema)

    return df.mapInArrow(run, schema)


def _sides(d) -> str:
    return f"{evaluation.norm(d, 'got')} AS g, {evaluation.norm(d, 'truth')} AS t"


def _short(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, g, t in rows:
        yield doc_id, accuracy(g, t)


def _long(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, same in groupby(rows, lambda r: r[0]):
        a, b = Counter(), Counter()
        for _, g, t in same:
            a.update(_words(g))
            b.update(_words(t))
        got = overlap(a, b)
        if got is not None:
            yield doc_id, got


@built
def pair_text(sql) -> DataFrame:
    """Long texts meet by document, since repeated ones are one bag; a text is no longer once it is normalised."""
    both = f"(SELECT doc_id, {_sides(SPARK)} FROM {{md_pair}}"
    short = sql(f"SELECT doc_id, g, t FROM {both}) AS n WHERE length(t) <= 5000")
    long_ = sql(f"SELECT doc_id, g, t FROM {both} WHERE length(truth) > 5000) AS n WHERE length(t) > 5000")
    schema = "doc_id long, accuracy double"
    return _mapped(short, _short, schema).union(_mapped(long_.repartition("doc_id").sortWithinPartitions("doc_id"), _long, schema))


def _repeated(sql) -> bool:
    """Whether a document comes more than once; its rows then meet each other, as SQL joins them."""
    return bool(sql("SELECT doc_id FROM {md_pair} GROUP BY doc_id HAVING count(*) > 1 LIMIT 1").head(1))


@built
def pair_structure(sql) -> DataFrame | None:
    if _repeated(sql):
        return None
    return sql(f"SELECT doc_id, page_type, {structure.within(SPARK)} AS structure FROM ({structure.marked(SPARK)}) AS q WHERE doc_id IS NOT NULL")


def _cells(got: str | None, truth: str | None) -> tuple[int, int, int]:
    a, b = (Counter(x.split("|")[1:] if x else ()) for x in (got, truth))
    return bags.total(a), bags.total(b), bags.common(a, b)


def _counted(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, got, truth in rows:
        n = _cells(got, truth)
        if n[0] + n[1]:
            yield doc_id, *n


@built
def pair_cells(sql) -> DataFrame | None:
    if _repeated(sql):
        return None
    df = sql(f"SELECT doc_id, {structure.cell_text(SPARK, 'got')} AS got, {structure.cell_text(SPARK, 'truth')} AS truth FROM {{md_pair}}")
    return _mapped(df, _counted, "doc_id long, n_got long, n_truth long, n_both long")


def _metrics(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, page_type, structure_, rate, g, t, got, truth in rows:
        long_ = len(t) > 5000
        acc = overlap(_words(g), _words(t)) if long_ else accuracy(g, t)
        if acc is not None or not long_:
            yield doc_id, page_type, acc, structure_, rate, *_cells(got, truth)


@built
def bench(sql) -> DataFrame | None:
    """All metrics of a pair at once, where SQL joins them by document."""
    if _repeated(sql):
        return None
    d = SPARK
    cells = ", ".join(f"CASE WHEN page_type = 'tables' THEN {structure.cell_text(d, c)} END AS {c}_cells" for c in ("got", "truth"))
    words = ", ".join(f"{evaluation.content_words(d, c)} AS w{k}" for k, c in (("a", "got"), ("b", "truth")))
    texts = f"SELECT *, {_sides(d)}, {words}, {cells} FROM ({structure.marked(d)}) AS m WHERE doc_id IS NOT NULL AND truth IS NOT NULL"
    df = sql(f"SELECT doc_id, page_type, {structure.within(d)} AS structure, {evaluation.rate(d, 'wa', 'wb')} AS rate, g, t, got_cells, truth_cells FROM ({texts}) AS x")
    schema = "doc_id long, page_type string, accuracy double, structure double, rate double, n_got long, n_truth long, n_both long"
    f1, overall = evaluation.weighed(*[""] * 5)
    return sql(
        f"SELECT doc_id, page_type, {evaluation.EXTRACTOR.format('doc_id')} AS extractor, accuracy, structure, CASE WHEN page_type = 'tables' THEN {f1} ELSE {f(0.0)} END AS f1, rate, {overall} AS overall FROM {{metric}}",
        metric=_mapped(df, _metrics, schema),
    )
