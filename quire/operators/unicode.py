"""Steps that Catalyst can't state: NFKC, right-to-left order, sequence matching, greedy folds. Vectorised in Arrow
batches, and only rows that need them leave the JVM."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import ARABIC
from quire.plans.registry import spark_query


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


_STRONG_RTL = re.compile(r"[֐-ࣿיִ-﷿ﹰ-﻿]")
_RUN = re.compile(r"[0-9A-Za-z][0-9A-Za-z.,:/%-]*|\s+|.", re.S)


def visual(line: str) -> str:
    """Visual order of a line whose first strong character is right-to-left: runs reversed, numbers and Latin words
    kept whole. Cells of a table row are turned one by one, a heading mark stays in front."""
    if not _STRONG_RTL.search(line):
        return line
    if line.count("|") >= 2:
        return "|".join(visual(c) for c in line.split("|"))
    head = re.match(r"#{1,6}\s+", line)
    if head:
        return head[0] + visual(line[head.end() :])
    return "".join(reversed(_RUN.findall(line)))


@F.pandas_udf(T.StringType())
def bidi(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "\n".join(map(visual, x.split("\n"))))


def normalise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """NFKC for rows that aren't plain ASCII, visual order for rows with right-to-left text. The rows are split by
    filters first: a conditional around a UDF doesn't keep rows out of it. A null text stays null."""
    plain = docs.filter(F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x00-\x7F]"))
    rest = docs.filter(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7F]")).withColumn(text_col, nfkc(text_col))
    rtl = F.col(text_col).rlike(ARABIC)
    return plain.unionByName(rest.filter(~rtl)).unionByName(rest.filter(rtl).withColumn(text_col, bidi(text_col)))


def repair_spaced(line: str) -> str:
    """Letters set apart ("H e l l o  w o r l d") joined again: five or more words, most of them single characters."""
    words = line.split()
    if len(words) < 5 or sum(len(w) == 1 for w in words) * 2 <= len(words):
        return line
    return " ".join("".join(g.split()) for g in re.split(r" {2,}", line.strip()))


@F.pandas_udf(T.StringType())
def respace(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "\n".join(map(repair_spaced, x.split("\n"))))


def fuzzy_fields(keys: DataFrame, fields: list[str], least: float = 0.6) -> DataFrame:
    """(key, field, ratio): the best field of each distinct key by matching blocks, the first one on ties."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["key"]:
                low = "" if k is None else re.sub(r"[^a-z0-9]+", " ", k.lower()).strip()
                best = max(((difflib.SequenceMatcher(None, low, x.replace("_", " ")).ratio(), -i) for i, x in enumerate(fields)), default=(0, 0))
                rows.append((k, fields[-best[1]] if best[0] >= least else None, float(best[0])))
            yield pd.DataFrame(rows, columns=["key", "field", "ratio"])

    return keys.select("key").distinct().mapInPandas(run, "key string, field string, ratio double")


_HEAD = re.compile(r"(#+)\s+(.*)")


def merge_headings(lines: list[str]) -> list[str]:
    """A heading of at most ten characters that is no number joins the heading after it; pairs don't overlap."""
    out, i = [], 0
    while i < len(lines):
        a = _HEAD.match(lines[i])
        j = i + 1
        while a and j < len(lines) and not lines[j].strip():
            j += 1
        b = _HEAD.match(lines[j]) if a and j < len(lines) else None
        if b and len(a[2].strip()) <= 10 and not re.fullmatch(r"[\d.\s]+", a[2]):
            out.append(f"{a[1]} {a[2].strip()} {b[2].strip()}")
            i = j + 1
        else:
            out.append(lines[i])
            i += 1
    return out


@F.pandas_udf(T.StringType())
def merged_headings(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "\n".join(merge_headings(x.split("\n"))))


def _overlap(sets: list[frozenset[str]]) -> Callable[[frozenset[str]], np.ndarray]:
    """The Jaccard overlap of a set with each of ``sets``, counted by the 4-grams that they share, not set by set."""
    number = {g: i for i, g in enumerate(dict.fromkeys(g for s in sets for g in s))}
    size = np.array([len(s) for s in sets], np.int64)
    gram = np.fromiter((number[g] for s in sets for g in s), np.int64, int(size.sum()))
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(gram, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(gram, minlength=len(number))))
    empty = np.zeros(0, np.int64)

    def run(b: frozenset[str]) -> np.ndarray:
        met = [holder[ends[k] : ends[k + 1]] for k in (number[g] for g in b if g in number)]
        both = np.bincount(np.concatenate([*met, empty]), minlength=len(sets))
        return both / (len(b) + size - both)

    return run


def reorder(blocks: list[str], paragraphs: list[str], least: float = 0.3, matched: float = 0.4) -> list[int]:
    """Order of paragraphs by the order of blocks: each block takes its best unused paragraph by 4-gram overlap; with
    too few matches the order stays."""

    def grams(s: str) -> set[str]:
        s = re.sub(r"\s+", " ", re.sub(r"[*#|]", "", s)).strip().lower()
        return {s[i : i + 4] for i in range(max(1, len(s) - 3))}

    made: dict[str, frozenset[str]] = {}

    def of(x: str) -> frozenset[str]:
        if x not in made:
            made[x] = frozenset(grams(x))
        return made[x]

    sets, used, order = [of(p) for p in paragraphs], set(), []
    alike: dict[frozenset[str], list[int]] = {}
    for i in range(len(sets) - 1, -1, -1):
        alike.setdefault(sets[i], []).append(i)
    overlap = None
    for block in blocks:
        same, at = alike.get(of(block), ()), -1
        while same and same[-1] in used:
            same.pop()
        if same and least < 1:
            at = same.pop()  # nothing overlaps more than an equal one
        elif not same:
            overlap = overlap or _overlap(sets)
            share = np.where([i in used for i in range(len(sets))], -1.0, overlap(of(block)))
            best = int(share.argmax()) if len(share) else -1
            if best >= 0 and share[best] > least:
                at = best
        if at >= 0:
            used.add(at)
            order.append(at)
    if not blocks or len(order) < matched * len(blocks):
        return list(range(len(paragraphs)))
    return order + [i for i in range(len(paragraphs)) if i not in used]


def reorder_paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (doc_id, text, blocks array<string>) with paragraphs in the blocks' order."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series, blocks: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(text, blocks, strict=True):
            ps = [] if t is None else t.split("\n\n")
            out.append(None if t is None else "\n\n".join(ps[i] for i in reorder([] if b is None else list(b), ps)))
        return pd.Series(out, dtype=object)

    return pages.withColumn("text", run("text", "blocks"))


@spark_query
def clean_unicode(spark, sf_dir):
    return normalise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@spark_query
def schema_map_fields(spark, sf_dir):
    from quire.plans.registry import run

    keys = run("key_values", spark, sf_dir)
    return fuzzy_fields(keys, ["invoice_no", "order_date", "total_due", "customer", "rate", "currency"])


@spark_query
def heading_merge(spark, sf_dir):
    from quire.plans.registry import run_sql

    return run_sql("SELECT doc_id, text FROM {head_text}", spark, sf_dir).select("doc_id", merged_headings("text").alias("text"))


@spark_query
def paragraph_reorder(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"), F.reverse(F.split("text", "\n")).alias("blocks")
    )
    return reorder_paragraphs(docs).select("doc_id", "text")
