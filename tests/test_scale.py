"""Steps that count within the row agree with their SQL on odd inputs too, and move no tokens."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quire.plans import catalogue, registry


def _agree(spark, at: str, con, name: str) -> None:
    got = catalogue.queries()[name](spark, at)
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    a = sorted(repr(tuple(r)) for r in got.selectExpr(*(f"`{c}`" for c in sorted(got.columns))).collect())
    assert a == sorted(map(repr, con.sql(f"SELECT {cols} FROM ({catalogue.oracle_sql()[name]}) AS q").fetchall()))


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The small tables with odd documents: repeated and missing ids, missing texts, letters that lower-case to two."""
    at = tmp_path_factory.mktemp("odd")
    for t in registry.TABLES - {"documents"}:
        (at / f"{t}.parquet").symlink_to(Path(sf) / f"{t}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    more = [
        (7, "twice the same page number, twice"), (7, "twice other words"), (None, "no number here at all"), (None, None), (205, None), (206, "   "),
        (208, "Straße K mixed KELVIN straße | a | b |\n| c | d |\n# Head   wide"), (209, "x " * 400), (211, "| a |\n|---|\n" + "| b |\n" * 9),
    ]
    extra = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    cols = [c for c in docs.columns if c in extra.columns]
    docs.select(cols).unionByName(extra.select(cols)).coalesce(1).write.parquet(str(at / "documents.parquet"))
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    return str(at), con


@pytest.mark.parametrize("name", ["page_alignment", "verify_pages", "verify_manifest", "verify_unsegmented", "page_score"])
def test_odd_documents(name, spark, odd):
    _agree(spark, *odd, name)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["page_alignment", "verify_pages", "verify_manifest", "verify_batch", "verify_summary"])
def test_tokens_are_counted_within_pages(name, spark, sf):
    plan = _plan(catalogue.queries()[name](spark, sf))
    assert "InMemoryRelation" not in plan and "token" not in plan
    assert plan.count("MapInArrow") == 1


def _slow(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_against_the_whole_table():
    import random

    from quire.operators import pairs

    rng = random.Random(3)
    for n in (0, 1, 2, 31, 64, 90):
        for _ in range(25):
            a = "".join(rng.choices("ab c", k=n))
            b = list(a)
            for _ in range(rng.randrange(12)):
                b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = rng.choices("abx|", k=rng.randrange(3))
            b = "".join(b)
            assert pairs.edits(a, b) == pairs.edits(b, a) == _slow(a, b)


@pytest.mark.parametrize("name", ["text_accuracy", "bench_overall", "structure_score", "table_f1"])
def test_metrics_meet_in_one_pass(name, spark, sf):
    plan = _plan(catalogue.queries()[name](spark, sf))
    assert "levenshtein" not in plan
    assert plan.count("Join") <= 1 + plan.count("Union")  # but for the items of an order


@pytest.mark.parametrize("name", ["structure_score", "table_f1", "text_accuracy"])
def test_repeated_pairs(name, spark, sf):
    """A document that comes twice meets itself, as SQL has it."""
    rows = [(1, "# a\n| x | y |\n- b", "# a\n| x | z |\n- b\nc", "tables"), (1, "w", "# q\n| x |", "tables"), (2, "word " * 1500, "word other " * 900, "digital"), (2, "other", "word " * 1200, "digital"), (3, "", "", "digital"), (4, None, None, "digital")]
    con = duckdb.connect()
    con.execute("CREATE TABLE md_pair (doc_id BIGINT, got VARCHAR, truth VARCHAR, page_type VARCHAR)")
    con.executemany("INSERT INTO md_pair VALUES (?, ?, ?, ?)", rows)
    given = spark.createDataFrame(rows, "doc_id long, got string, truth string, page_type string")
    from quire.plans.dialect import DUCK

    text = registry.statement(registry.QUERIES[name](DUCK), DUCK, registry.TABLES | {"md_pair"})
    got = registry.run(name, spark, md_pair=given)
    cols = sorted(got.columns)
    a = sorted(repr(tuple(r)) for r in got.select(cols).collect())
    assert a == sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({text}) AS q").fetchall()))


def test_heading_marks_at_other_letters_and_line_ends(spark):
    from quire.plans.dialect import DUCK

    lines = ["# Le la ére éa", "# Enä en ßa", "# nach der", "# a", "# Table 3\r", "# x = 5  y", "# Teil\u0085 = 4", "## 1234 \r", "# año", "# vor the\r"]
    rows = [(2, "\n".join(lines)), (5, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE md_page (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO md_page VALUES (?, ?)", rows)
    text = registry.statement(registry.QUERIES["heading_demote"](DUCK), DUCK, registry.TABLES | {"md_page"})
    want = con.sql(f"SELECT doc_id, pos, line FROM ({text}) AS q").fetchall()
    got = registry.run("heading_demote", spark, md_page=spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "pos", "line").collect())) == sorted(want)


def _one_by_one(blocks, paragraphs, least=0.3, matched=0.4):
    import re

    def grams(s):
        s = re.sub(r"\s+", " ", re.sub(r"[*#|]", "", s)).strip().lower()
        return {s[i : i + 4] for i in range(max(1, len(s) - 3))}

    used, order = set(), []
    for b in map(grams, blocks):
        best, at = least, -1
        for i, p in enumerate(map(grams, paragraphs)):
            j = len(b & p) / len(b | p)
            if i not in used and j > best:
                best, at = j, i
        if at >= 0:
            used.add(at)
            order.append(at)
    if not blocks or len(order) < matched * len(blocks):
        return list(range(len(paragraphs)))
    return order + [i for i in range(len(paragraphs)) if i not in used]


def test_reorder_compares_no_pairs_of_equal_texts(monkeypatch):
    import random

    from quire.operators import unicode

    rng = random.Random(8)
    for n in (0, 1, 4, 9, 30):
        for least in (0.0, 0.3, 1.0):
            ps = [" ".join(rng.choices(["ha", "ab", "common", "words", "*x*", ""], k=rng.randrange(7))) for _ in range(n)]
            bs = [p if rng.random() < 0.6 else p + " ha" for p in rng.sample(ps, len(ps))]
            assert unicode.reorder(bs, ps, least) == _one_by_one(bs, ps, least)
    monkeypatch.setattr(unicode, "_overlap", None)  # which equal texts don't need
    ps = [f"paragraph {i} of its own {i * 7919}" for i in range(3000)]
    assert unicode.reorder(ps[::-1], ps) == list(range(2999, -1, -1))


@pytest.mark.parametrize("name,most", [("ocr_cell_grid", 3), ("table_overlay", 3)])
def test_grids_are_sorted_once_an_order(name, most, spark, sf):
    df = catalogue.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [page_id") <= most
    assert name != "table_overlay" or "LeftSemi" in _plan(df)
