"""Token bags counted row by row in Python workers: no token is shuffled, a text crosses the network once.

Rows (file_id, page_num, side, text, ...) of source (side 1) and extraction (side 2) come sorted by document and page; what
SQL states as a full outer join of pages and groupings by token is one pass over them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.text import SPACE
from quire.plans.registry import built

from . import verify

_TOKEN = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", verify.TOKEN))
_STOP = frozenset(verify.STOPWORDS)
_MOJI, _GAPS, _WORD = re.compile(r"ï¿½|Ã[¨©]|â€"), re.compile("  {5,}"), re.compile(f"[{SPACE}]+")


def bag(text: str) -> Counter:
    """Tokens in lower case with their counts; a text is cut before it is lowered, as lowering may make or break tokens."""
    if text.isascii():
        return Counter(_TOKEN.findall(text.lower()))
    return Counter(" ".join(_TOKEN.findall(text)).lower().split())


def content(words: dict[str, int]) -> dict[str, int]:
    stop = _STOP.intersection(words)
    if stop:
        words = dict(words)
        for w in stop:
            del words[w]
    return words


def total(words: dict[str, int]) -> int:
    return sum(words.values())


def common(a: dict[str, int], b: dict[str, int], x: int = 1, y: int = 1) -> int:
    """Tokens of x times a that y times b holds."""
    if a is b and x == y:
        return x * total(a)
    out = 0
    for w in a.keys() & b.keys():
        n, m = x * a[w], y * b[w]
        out += n if n < m else m
    return out


def merged(bags: list[dict[str, int]]) -> dict[str, int]:
    if len(bags) == 1:
        return bags[0]
    out: Counter = Counter()
    for x in bags:
        out.update(x)
    return out


def score(text: str) -> float:
    """``quire.functions.text.score_page`` without images."""
    t = text.strip(SPACE)
    if len(t) < 20:
        return 0.0
    ns = _WORD.sub("", t)
    alpha, mean = sum(map(str.isalpha, ns)) / len(ns), len(ns) / (len(_WORD.findall(t)) + 1)
    gaps, moji = len(_GAPS.findall(text)), len(_MOJI.findall(text))
    out = 1.0 - (0.3 if len(t) < 50 else 0.1 if len(t) < 200 else 0.0)
    out -= 0.25 if alpha < 0.3 else 0.1 if alpha < 0.5 else 0.0
    out -= 0.15 if mean < 2 or mean > 25 else 0.0
    out -= 0.1 if gaps > 10 else 0.0
    out -= 0.2 if moji > 5 else 0.05 if moji > 0 else 0.0
    return max(0.0, min(1.0, out))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for s in range(0, b.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in b.slice(s, 512).columns), strict=True)


def _out(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    for r in rows:
        held.append(r)
        if len(held) == 8192:
            yield batch()
            held = []
    if held:
        yield batch()


def _passed(sides: DataFrame, keys: list[str], f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(f(_rows(batches)), schema)

    return sides.repartition(*keys).sortWithinPartitions("file_id", "page_num", "side").mapInArrow(run, schema)


# ~~ pages
def page_counts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(file_id, page_num, n_src, n_ext, n_both) of each page with tokens. Where a page comes more than once, each of its
    rows meets each of the other side; rows without number meet none and count as one page."""
    for (file_id, page_num), page in groupby(rows, itemgetter(0, 1)):
        bags, n, text, words = [{}, {}], [0, 0], None, {}
        for _, _, side, now in page:
            if now != text:
                text, words = now, content(bag(now))
            if n[side - 1] == 0:
                bags[side - 1] = words
            else:  # the first bag may be the other side's too
                bags[side - 1] = Counter(bags[side - 1]) if n[side - 1] == 1 else bags[side - 1]
                bags[side - 1].update(words)
            n[side - 1] += 1
        a, b = bags
        x, y = (1, 1) if file_id is None or page_num is None else (max(1, n[1]), max(1, n[0]))
        s, e = x * total(a), y * total(b)
        if s or e:
            yield file_id, page_num, s, e, s if a is b and x == y else common(a, b, x, y)


@built
def token_match(sql) -> DataFrame:
    sides = sql(
        "SELECT file_id, page_num, 1 AS side, coalesce(text, '') AS text FROM {source_page} UNION ALL SELECT file_id, page_num, 2, coalesce(text, '') FROM {audited}"
    )
    return _passed(sides, ["file_id", "page_num"], page_counts, "file_id long, page_num long, n_src long, n_ext long, n_both long")


# ~~ presence
def page_presence(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(file_id, page_num, recovered): the share of each page's tokens that its document's extraction holds."""
    for file_id, doc in groupby(rows, itemgetter(0)):
        pages: dict[int | None, Counter] = {}
        whole: Counter = Counter()
        for _, page_num, side, text in doc:
            if side == 1:
                pages.setdefault(page_num, Counter()).update(content(bag(text)))
            else:
                whole.update(bag(text))
        for page_num, words in pages.items():
            if words:
                yield file_id, page_num, common(words, whole) / total(words)


@built
def presence(sql) -> DataFrame:
    sides = sql(
        "SELECT file_id, page_num, 1 AS side, coalesce(text, '') AS text FROM {page} WHERE file_id IS NOT NULL"
        " UNION ALL SELECT file_id, page_num, 2, coalesce(text, '') FROM {ext_page} WHERE file_id IS NOT NULL"
    )
    return _passed(sides, ["file_id"], page_presence, "file_id long, page_num long, recovered double")


# ~~ whole documents
def _aligned(n_src: int, n_ext: int) -> bool:
    """As ``verify.paging`` has it."""
    tenth = n_src // 10 + (1 if n_src % 10 > 5 or n_src % 10 == 5 and n_src // 10 % 2 == 1 else 0)
    return n_src > 0 and n_ext > 0 and abs(n_ext - n_src) <= max(1, tenth)


_NONE = ("", 0, 0.0, 0, 0, False)


def document_pages(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each page of ``verify.measured``, or of ``verify.unsegmented`` where the page counts of both sides differ."""
    for file_id, doc in groupby(rows, itemgetter(0)):
        sides: tuple[dict, dict] = {}, {}
        for _, page_num, side, *have in doc:
            sides[side - 1].setdefault(page_num, []).append(have)
        pairs = []
        for page_num in sorted(sides[0].keys() | sides[1].keys(), key=lambda p: (p is None, p or 0)):
            s, e = sides[0].get(page_num, []), sides[1].get(page_num, [])
            if page_num is None:
                pairs += [(page_num, x, None) for x in s] + [(page_num, None, y) for y in e]
            else:
                pairs += [(page_num, x, y) for x in s or [None] for y in e or [None]]
        made: dict[str, tuple[dict, dict]] = {}

        def words(have, k: int) -> dict[str, int]:
            text = have[0] if have else ""
            if text not in made:
                made[text] = (whole := bag(text)), content(whole)
            return made[text][k]

        if _aligned(sum(x is not None for _, x, _ in pairs), sum(y is not None for _, _, y in pairs)):
            yield from _measured(file_id, pairs, words)
        else:
            yield from _unsegmented(file_id, pairs, words)


def _measured(file_id, pairs, words) -> Iterator[tuple]:
    whole, lost = None, {}
    for page_num, x, y in pairs:
        if (y or _NONE)[1] < 20 and page_num is not None:
            lost.setdefault(page_num, Counter()).update(words(x, 1))
    if lost:
        whole = Counter()
        for _, _, y in pairs:
            whole.update(words(y, 0))
    for page_num, page in groupby(pairs, lambda p: p[0]):
        page = list(page)
        n_src = n_ext = n_both = 0
        if page_num is not None:
            a, b = (merged([words(p[k], 1) for p in page]) for k in (1, 2))
            n_src, n_ext, n_both = total(a), total(b), common(a, b)
        recovered = common(lost[page_num], whole) / total(lost[page_num]) if lost.get(page_num) else None
        align, hallu = n_both / n_src if n_src else 1.0, (n_ext - n_both) / n_ext if n_ext >= 12 else 0.0
        for _, x, y in page:
            _, sc, _, s_rows, s_block, s_head = x or _NONE
            _, ec, conf, e_rows, e_block, e_head = y or _NONE
            yield file_id, page_num, True, sc, ec, conf, align, hallu, recovered, None, s_rows, e_rows, s_block, e_block, s_head, e_head


def _unsegmented(file_id, pairs, words) -> Iterator[tuple]:
    src, ext = ("\n\n".join(p[k][0] for p in pairs if p[k] and p[k][0]) for k in (1, 2))
    bags = [Counter(), Counter(), Counter()]
    lost: dict[int | None, Counter] = {}
    for page_num, x, y in pairs:
        bags[0].update(words(x, 1))
        bags[1].update(words(y, 1))
        bags[2].update(words(y, 0))
        lost.setdefault(page_num, Counter()).update(words(x, 1))
    n_ext, n_both = total(bags[1]), common(bags[0], bags[1])
    hallu = (n_ext - n_both) / n_ext if n_ext >= 12 else 0.0
    sc, ec = len(src.strip(SPACE)), len(ext.strip(SPACE))
    cov, conf = min(1.0, ec / sc) if sc else 1.0, score(ext) if ec else 0.0
    share = {p: common(w, bags[2]) / total(w) for p, w in lost.items() if w and p is not None}
    for page_num, x, _ in pairs:
        if x is not None:
            _, sc, _, s_rows, _, s_head = x
            yield file_id, page_num, False, sc, 0, conf, share.get(page_num, 1.0), hallu, None, cov, s_rows, None, None, None, s_head, None


@built
def compared(sql) -> DataFrame:
    """Pages of ``verify.measured`` (aligned) and of ``verify.unsegmented``; each side is measured before it moves."""
    sides = sql(" UNION ALL ".join(f"SELECT {', '.join(verify.side_columns(no))} FROM {{{rel}}} WHERE file_id IS NOT NULL" for no, rel in ((1, "source_page"), (2, "audited"))))
    schema = (
        "file_id long, page_num long, aligned boolean, sc long, ec long, conf double, alignment double, hallu double, recovered double, doc_cov double,"
        " s_rows long, e_rows long, s_block long, e_block long, s_head boolean, e_head boolean"
    )
    return _passed(sides, ["file_id"], document_pages, schema)
