"""The same hard cases for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, and
extra columns whose names clash with inner ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chunk_dedup, hilbert, language_id, licenses, line_dedup, mixing, ngram_join, packing, repetition, transport

COLS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(40_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta.\nsecond line of the text here", "en", "a", 70),
    (1, "alpha beta gamma delta epsilon zeta eta theta.\nsecond line of the text here", "en", "a", 70),
    (2, None, "en", "a", None),
    (3, "", "de", None, 0),
    (4, " \n\t ", None, "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (None, "a row without an id but with several words in it", "en", "b", 40),
    (None, None, None, None, None),
    (7, "x", "fr", "c", 1),
    (8, "naïve 😀 text — with wide characters; ünïcödé everywhere", "de", "c", 50),
]
CLASH = ("h", "line", "id", "node", "bucket", "slot", "rank", "key", "cell", "unit", "piece", "start", "block", "source_", "__id", "text_", "keep", "root")

OPERATORS = {
    "mixing": lambda d: mixing.schedule(d, block_tokens=16),
    "transport": lambda d: transport.demux(transport.encode(d)),
    "language": language_id.identify,
    "lines": line_dedup.duplicates,
    "hilbert": hilbert.shards,
    "join": ngram_join.join,
    "repetition": repetition.coverage,
    "licenses": licenses.scan,
    "packing": packing.pack,
    "packing_text": lambda d: packing.pack(d, with_text=True),
    "chunks": chunk_dedup.spans,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLS)


def wide(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(name, docs):
    op = OPERATORS[name]
    got = sorted(map(str, op(docs).collect()))
    assert got == sorted(map(str, op(wide(docs)).collect()))
    assert got == sorted(map(str, op(docs.repartition(3)).collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, docs):
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(stage, docs, spark, sf):
    f = dict(corpus_pipeline.STAGES)[stage]
    got = f(spark, docs, sf)
    if stage != "packing":
        assert got.columns == docs.columns
        assert dict(got.dtypes) == dict(docs.dtypes)
    got.collect()
    assert f(spark, docs.limit(0), sf).collect() == []
    if stage != "packing":
        clash = f(spark, wide(docs), sf)
        assert clash.columns == wide(docs).columns
        clash.collect()


def test_defined_results(docs):
    rep = {r["doc_id"]: r for r in repetition.coverage(docs).collect()}
    assert rep[2]["keep"] and rep[2]["n_words"] == 0 and rep[3]["keep"] and rep[4]["keep"]
    und = {r["doc_id"]: r["language"] for r in language_id.identify(docs).collect()}
    assert und[2] == und[3] == und[4] == "und"
    pairs = {tuple(r) for r in ngram_join.join(docs).collect()}
    assert pairs == {(5, 5, 2, 2, 0), (6, 5, 2, 2, 0)}
    kept = [r["doc_id"] for r in ngram_join.apply(docs).collect()]
    assert 6 not in kept and kept.count(1) == 2 and kept.count(None) == 2
    lines = {(r["doc_id"], r["line_no"]): r["keep"] for r in line_dedup.duplicates(docs).collect()}
    assert lines[5, 0] and not lines[6, 0] and lines[1, 0]
    left = [r["doc_id"] for r in line_dedup.apply(docs).collect()]
    assert 6 not in left and {1, 2, 3, 4, 5, 7, 8} <= set(left)
    spans = {r["doc_id"]: r for r in chunk_dedup.spans(docs).collect()}
    assert set(spans) == {5, 6} and spans[5]["repeat_chars"] == 0 and spans[6]["repeat_chars"] == len(LONG)
    shards = hilbert.shards(docs).collect()
    assert sorted(r["position"] for r in shards) == list(range(len(ROWS)))
    # nulls are the least values: n_chars has two of them, lang too
    assert {r["x2"] for r in shards if r["doc_id"] == 2} == {0}


def test_rows_lose_only_their_own_lines(spark):
    rows = [(None, "first line here\nfirst line here"), (None, "another one\nquite different"), (3, "aa bb cc\naa bb cc"), (3, "zz yy xx\nww vv uu")]
    got = line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string"), size_col=None).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [
        (0, "another one\nquite different"), (0, "first line here"), (3, "aa bb cc"), (3, "zz yy xx\nww vv uu")
    ]


def test_join_takes_rows_one_by_one(spark):
    """Different texts under one id, without id, and ids that are no numbers."""
    a, u = "one two three four five six", "quite another text that stands nowhere else"
    rows = [("1", a), ("2", a), ("2", u), (None, a), (None, "no relation to any of these")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["text"]) for r in ngram_join.apply(df).collect())
    assert got == sorted([("", a), ("", "no relation to any of these"), ("1", a), ("2", u)])
    assert sorted(tuple(r)[:2] for r in ngram_join.join(df).collect()) == [("1", "1"), ("2", "1")]
    left = sorted((r["doc_id"] or "", r["text"]) for r in line_dedup.apply(df, size_col=None).collect())
    assert ("2", u) in left and ("", "no relation to any of these") in left


def test_registered_transport_query_gives_payloads(spark, sf):
    from quire.llm import queries

    got = queries.op2_transport_streams(spark, sf)
    assert "payload" in got.columns
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    back = {}
    for r in got.filter("pid = 256").collect():
        back.setdefault(r["doc_id"], {})[r["unit"]] = bytes(r["payload"]).decode()
    assert all("\n".join(back[d][i] for i in sorted(back[d])) == t for d, t in text.items() if t)
