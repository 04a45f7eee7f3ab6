"""Literals and properties of the engine's own operators, and of the parts that SQL can't state."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import structured, unicode
from quire.plans.dialect import SPARK
from quire.plans.registry import run
from quire.sources import extractor
from quire.streaming import pages


def one(spark, expr: str, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in cols.items())
    return spark.createDataFrame([tuple(cols[n] for n in names)], schema).selectExpr(f"{expr} AS r").first()["r"]


@pytest.mark.parametrize(
    "text,images,want",
    [
        ("", 0, 0.0),
        ("short", 0, 0.0),
        ("x" * 19, 0, 0.0),
        ("plain words here and there " * 20, 0, 1.0),
        ("plain words here and there " * 2, 0, 0.9),
        ("plain words here and there " * 4, 1, 0.8),
        ("1234567 " * 60, 0, 0.75),
    ],
)
def test_score_page(spark, text, images, want):
    assert one(spark, X.score_page(SPARK, "t", "i"), t=text, i=images) == pytest.approx(want)


def test_score_null(spark):
    assert one(spark, X.score_page(SPARK, "t"), t=None) == 0.0


@pytest.mark.parametrize("chars,images,want", [(0, 0, "empty"), (19, 3, "empty"), (20, 0, "good"), (199, 1, "bad"), (199, 0, "good"), (200, 5, "good")])
def test_page_quality(spark, chars, images, want):
    assert one(spark, X.page_quality("c", "i"), c=chars, i=images) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("28 Feb 2026", "2026-02-28"),
        ("February 28, 2026", "2026-02-28"),
        ("28/02/2026", "2026-02-28"),
        ("2026-02-28", "2026-02-28"),
        ("01-Feb-26", "2026-02-01"),
        ("15 Mar", "2026-03-15"),
        ("31/02/2026", None),
        ("nothing", None),
    ],
)
def test_dates(spark, text, want):
    assert one(spark, structured.date(SPARK, "t"), t=text) == want


@pytest.mark.parametrize(
    "text,amount,direction,currency",
    [
        ("AED 1,234.50", 1234.5, "unknown", "AED"),
        ("(1,234.50)", 1234.5, "debit", None),
        ("$99.00 CR", 99.0, "credit", "USD"),
        ("-12", 12.0, "debit", None),
        ("1.234,50", 1234.5, "unknown", None),
        ("n/a", None, "unknown", None),
    ],
)
def test_amounts(spark, text, amount, direction, currency):
    assert one(spark, structured.amount(SPARK, "t"), t=text) == amount
    assert one(spark, structured.direction(SPARK, "t"), t=text) == direction
    assert one(spark, structured.currency(SPARK, "t"), t=text) == currency


def test_rates(spark):
    assert one(spark, structured.rate(SPARK, "t"), t="3.49% per month") == 3.49
    assert one(spark, structured.period(SPARK, "t"), t="3.49% per month") == "monthly"
    assert one(spark, structured.period(SPARK, "t"), t="41.88% p.a.") == "annual"
    assert one(spark, structured.rate(SPARK, "t"), t="none") is None


def test_clean_text_is_idempotent(spark, sf):
    first = run("clean_text", spark, sf)
    again = first.select("doc_id", F.expr(X.clean_text(SPARK, "text")).alias("again"), "text")
    assert again.filter("again <> text").count() == 0


def test_own_relations_replace_the_tables(spark):
    rows = [(1, 0, 1, "a plain page of words " * 20, "en", 0, "pymupdf", False), (1, 1, 2, None, "en", 1, "pymupdf", False)]
    page = spark.createDataFrame(
        rows, "file_id long, page_num long, doc_id long, text string, lang string, image_count long, extractor string, ocr_applied boolean"
    )
    got = {r["doc_id"]: r["score"] for r in run("page_score", spark, page=page).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_self_verification_is_perfect(spark, sf):
    from quire.plans.registry import run_sql

    src = run_sql("SELECT * FROM {source_page}", spark, sf)
    got = run("verify_pages", spark, source_page=src, audited=src)
    bad = got.filter("verdict NOT IN ('pass', 'unverifiable') AND confidence >= 0.55")
    assert bad.count() == 0
    assert got.filter("alignment < 1 AND verdict = 'pass'").count() == 0


def _verify(spark, src, ext, name="verify_pages"):
    cols = "file_id long, page_num long, text string"
    rel = {"source_page": spark.createDataFrame(src, cols), "audited": spark.createDataFrame(ext, cols)}
    return {(r["file_id"], r["page_num"]) if name == "verify_pages" else r["file_id"]: r for r in run(name, spark, **rel).collect()}


def test_silent_drop_and_table_loss(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row{i} | value{i} |" for i in range(30))
    prose = "substantial paragraph about nothing particular " * 10
    src = [(1, 0, prose), (2, 0, table), (3, 0, table), (4, 0, "")]
    ext = [(1, 0, ""), (2, 0, table[:220]), (3, 0, table.replace("|", " ")), (4, 0, "")]
    got = {k[0]: r for k, r in _verify(spark, src, ext).items()}
    assert got[1]["silent_drop"] and got[1]["verdict"] == "fail"
    assert "table_truncated" in got[2]["flags"]
    assert "table_dropped" in got[3]["flags"] and not got[3]["table_integrity"]
    assert got[4]["flags"] == "blank_page"


def test_missing_pages_extra_pages_and_blobs(spark):
    """Missing last page, page too many, everything in one page with nothing lost, the same with a page lost, nothing at all."""
    p = {i: " ".join(f"{w}{i}{j}" for j in range(12) for w in ("alpha", "bravo", "charlie", "delta")) for i in range(3)}
    src = [(f, i, p[i]) for f in range(1, 6) for i in range(3)]
    ext = [(1, 0, p[0]), (1, 1, p[1])]
    ext += [(2, i, p[i]) for i in range(3)] + [(2, 3, "a page that stands in no source at all")]
    ext += [(3, 0, "\n\n".join(p.values())), (4, 0, f"{p[0]}\n\n{p[2]}")]
    pages = _verify(spark, src, ext)
    got = _verify(spark, src, ext, "verify_manifest")
    assert got[1]["verdict"] == "FAIL" and got[1]["silent_drops"] == "3" and got[1]["page_count"] == 3 and got[1]["page_aligned"]
    assert got[2]["verdict"] == "REVIEW" and got[2]["page_count"] == 4 and pages[2, 3]["verdict"] == "unverifiable"
    assert not got[3]["page_aligned"] and got[3]["verdict"] in ("PASS", "REVIEW") and got[3]["silent_drops"] == ""
    assert all("unsegmented_extraction" in pages[3, i]["flags"] for i in range(3))
    assert not got[4]["page_aligned"] and got[4]["verdict"] == "FAIL" and got[4]["silent_drops"] == "2"
    assert got[5]["verdict"] == "FAIL" and got[5]["silent_drops"] == "1,2,3"


def test_chunks_hold_bound_and_text(spark, sf):
    from quire.operators.chunking import split_oversize
    from quire.plans.registry import run_sql

    sections = run_sql("SELECT * FROM {section}", spark, sf)
    parts = split_oversize(sections, 60).toPandas()
    assert parts["part"].min() == 0
    joined = parts.sort_values(["doc_id", "chunk_index", "part"]).groupby(["doc_id", "chunk_index"])["text"].apply(" ".join)
    whole = sections.toPandas().set_index(["doc_id", "chunk_index"])["text"]
    for k, t in joined.items():
        assert t.split() == whole[k].split()
    long_ = parts[parts["text"].str.len() // 4 > 60]
    assert (long_["text"].str.count(r"[.!?] ") == 0).all()


def test_one_page_event_for_each_page(spark, sf):
    got = run("stream_events", spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.filter("kind = 'page'").count() == n
    assert got.groupBy("file_id", "seq").count().filter("count > 1").count() == 0


def test_unicode_parts(spark):
    df = spark.createDataFrame([(1, "ﬁne"), (2, None), (3, "plain"), (4, "مرحبا 123 ok")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in unicode.normalise(df).collect()}
    assert got[1] == "fine" and got[2] is None and got[3] == "plain"
    assert got[4].startswith("ok") and "123" in got[4]
    assert unicode.repair_spaced("H e l l o  w o r l d") == "Hello world"
    assert unicode.merge_headings(["# Part", "", "# Two words", "x"]) == ["# Part Two words", "x"]
    assert unicode.reorder(["second block text", "first block text"], ["first block text", "second block text"]) == [1, 0]
    fields = {r["key"]: r["field"] for r in unicode.fuzzy_fields(spark.createDataFrame([("Invoice No.",), ("zzz",)], "key string"), ["invoice_no", "total"]).collect()}
    assert fields == {"Invoice No.": "invoice_no", "zzz": None}


def test_extractor_source(spark, tmp_path):
    extractor.register(spark)
    a = tmp_path / "a.txt"
    a.write_text("one\ftwo\fthree")
    paths = json.dumps([str(a), str(tmp_path / "gone.txt")])
    got = spark.read.format("quire_pages").option("paths", paths).option("pages", "[1]").load().collect()
    assert {(r["doc_id"], r["page_num"], r["text"]) for r in got if r["error"] is None} == {("a.txt", 1, "two")}
    assert [r["error"][:13] for r in got if r["error"]] == ["PDF_NOT_FOUND"]
    assert extractor.available()[0] == "fast"


def test_page_stream_equals_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 3 AS image_count")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = pages.page_events(pages.watch(spark, str(tmp_path / "in"), src.schema, 1))
    pages.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "quality", "score")
    want = pages.page_events(src).select("doc_id", "quality", "score")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_telemetry_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pages.telemetry_stream(pages.watch(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.format("memory").queryName("tele").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tele").agg(F.sum("n")).first()[0]
    assert got == events.count()
    assert run("telemetry_windows", spark, sf).count() == spark.table("tele").count()


def test_entry_without_optional_parts(spark, sf, monkeypatch):
    import importlib

    import __spark_entry__

    real = importlib.import_module

    def missing(name, *a):
        if name.startswith(("quire.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name.split(".queries")[0])
        return real(name, *a)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert __spark_entry__.entry(spark).count() > 0


def test_loaders(spark, tmp_path):
    from quire.sources import loaders

    (tmp_path / "a.csv").write_text('File,Output\nx/one.pdf,"text, with comma"\n')
    assert loaders.read_extractions(spark, str(tmp_path / "a.csv")).collect() == [("one.pdf", "text, with comma")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        loaders.read_extractions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "doc.gt.md").write_text("# truth")
    assert loaders.ground_truth(spark, str(tmp_path)).collect() == [("tables", "doc", "# truth")]


def test_parsed_payloads_hold_whole_texts(spark):
    text = "".join(f'line {i} with a "quote" and a \\\\ sign\n' for i in range(20)) + "end"
    page = spark.createDataFrame([(i, text) for i in range(4)] + [(9, '{"1":"one","2":"two"}')], "doc_id long, text string")
    got = {r["doc_id"]: r for r in run("parse_extraction", spark, page=page).collect()}
    assert all(got[i]["page_1"] + got[i]["page_2"] == text for i in range(4))
    assert got[9]["shape"] == "numbered" and got[9]["page_2"] == "two"


def test_accuracy_is_edit_distance_up_to_5000_characters(spark):
    pairs = [(1, "b a " * 500, "a b " * 500), (2, "b a " * 1300, "a b " * 1300)]
    pair = spark.createDataFrame(pairs, "doc_id long, got string, truth string")
    got = {r["doc_id"]: r["text_accuracy"] for r in run("text_accuracy", spark, md_pair=pair).collect()}
    assert 0.9 < got[1] < 1 and got[2] == 1
