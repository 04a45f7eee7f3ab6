"""Bindings of the engine's relations to the tables at hand.

A document is 50 consecutive texts (``file_id``), a text is a page; so pages of one document never cross a hot key.
``ext_page`` is an extraction under audit with known damage; ``md_page`` is Markdown from HTML; ``invoice`` renders
orders as text; ``telemetry`` reads events as extraction telemetry.
"""

from __future__ import annotations

from quire.functions import text as X
from quire.plans.registry import relation


@relation
def page(d):
    return (
        f"SELECT {d.idiv('doc_id', '50')} AS file_id, doc_id % 50 AS page_num, doc_id, coalesce(text, '') AS text, lang,"
        " doc_id % 3 AS image_count, CASE WHEN doc_id % 13 = 0 THEN 'rapidocr' ELSE 'pymupdf' END AS extractor,"
        " doc_id % 13 = 0 AS ocr_applied FROM documents"
    )


@relation
def ext_page(d):
    n = d.idiv("length(text)", "2")
    extra = "concat(text, ' ', repeat('fabricated quarterly dividend outlook memorandum ', 60))"
    return (
        "SELECT file_id, page_num, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' "
        f"WHEN doc_id % 5 = 0 THEN substring(text, 1, cast({n} AS INTEGER)) WHEN doc_id % 11 = 0 THEN {extra} ELSE text END AS text FROM {{page}}"
    )


@relation
def md_page(d):
    """HTML to Markdown by tags: headings, paragraphs, list items; scripts, styles and other tags go."""
    s = "html"
    for tag in ("script", "style", "head", "nav"):
        s = d.sub(s, rf"(?s)<{tag}\b.*?</{tag}>")
    s = d.sub(s, r"(?s)<!--.*?-->")
    nl = d.char(10)
    s = f"replace({s}, '<h1>', concat({nl}, {nl}, '# '))"
    s = f"replace({s}, '<h2>', concat({nl}, {nl}, '## '))"
    for end in ("</h1>", "</h2>", "</p>", "<p>", "<br>"):
        s = f"replace({s}, '{end}', concat({nl}, {nl}))"
    s = f"replace({s}, '<li>', concat({nl}, '- '))"
    s = d.sub(s, r"<[^>]+>")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        s = f"replace({s}, '{a}', '{b}')"
    return f"SELECT page_id AS doc_id, {X.strip(d, s)} AS text FROM pages"


@relation
def md_line(d):
    return f"SELECT doc_id, pos, line FROM {d.explode('{md_page}', 'doc_id', X.lines(d, 'text'), 'line', 'pos')} AS e"


@relation
def invoice_line(d):
    return (
        "SELECT l_orderkey AS k, l_linenumber AS n, concat('| ', cast(l_partkey AS VARCHAR(20)), ' | ', cast(cast(l_quantity AS BIGINT) AS VARCHAR(20)), ' | ',"
        " cast(cast(round(l_extendedprice) AS BIGINT) AS VARCHAR(20)), ' |') AS line FROM lineitem"
    )


@relation
def invoice(d):
    """One text an order: key-value lines, then a pipe table of its items."""
    nl = d.char(10)
    day = (
        "concat(lpad(cast(day(o_orderdate) AS VARCHAR(4)), 2, '0'), '/', lpad(cast(month(o_orderdate) AS VARCHAR(4)), 2, '0'), '/', cast(year(o_orderdate) AS VARCHAR(8)))"
    )
    whole = "cast(cast(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20))"
    money = f"concat(substring({whole}, 1, length({whole}) - 2), '.', substring({whole}, length({whole}) - 1, 2))"
    return f"""SELECT o_orderkey AS doc_id, concat('Invoice Number: INV-', cast(o_orderkey AS VARCHAR(20)), {nl}, 'Order Date: ', {day}, {nl},
 'Customer ID......C', cast(o_custkey AS VARCHAR(20)), {nl}, 'Total Amount Due: USD ', {money}, CASE WHEN o_orderkey % 4 = 0 THEN ' CR' ELSE '' END, {nl},
 'Interest Rate      ', cast(o_orderkey % 30 AS VARCHAR(4)), '.5% per month', {nl}, {nl}, '| Part | Qty | Price |', {nl}, '|---|---|---|', {nl}, coalesce(t.body, '')) AS text
FROM orders LEFT JOIN (SELECT k, {d.listagg('line', nl, 'n, line')} AS body FROM {{invoice_line}} GROUP BY k) AS t ON o_orderkey = t.k"""


@relation
def telemetry(d):
    kinds = "CASE event_type WHEN 'click' THEN 'digital' WHEN 'purchase' THEN 'tables' WHEN 'view' THEN 'scanned' ELSE 'mixed' END"
    return (
        f"SELECT event_id, ts, {kinds} AS page_type, CASE WHEN user_id % 3 = 0 THEN 'llm' WHEN user_id % 3 = 1 THEN 'mistral_ocr' ELSE 'docling' END AS extractor,"
        f" least({X.f(1.0)}, value / {X.f(100.0)}) AS confidence, cast(value * 10 AS BIGINT) AS latency_ms,"
        f" CASE WHEN user_id % 3 = 0 THEN {X.f(0.01)} WHEN user_id % 3 = 1 THEN {X.f(0.002)} ELSE {X.f(0.0)} END AS cost_usd FROM events"
    )


@relation
def chat(d):
    """Conversations as Markdown sections: a turn is a page with its role for heading."""
    return f"SELECT conv_id AS doc_id, turn AS page_num, concat('# ', coalesce(role, ''), {d.char(10)}, coalesce(text, '')) AS text FROM conversations"


@relation
def box(d):
    """Page geometry made from line items: one box an item on its order's page of 600 x 800 points."""
    return (
        "SELECT l_orderkey AS page_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS box_id, cast((l_partkey % 3) * 210 + l_suppkey % 40 AS DOUBLE) AS x0,"
        " cast(l_linenumber * 90 + l_partkey % 50 AS DOUBLE) AS y0, cast((l_partkey % 3) * 210 + l_suppkey % 40 + 120 + l_quantity AS DOUBLE) AS x1,"
        " cast(l_linenumber * 90 + l_partkey % 50 + 60 AS DOUBLE) AS y1, CASE WHEN l_suppkey % 5 = 0 THEN 'table' WHEN l_suppkey % 5 = 1 THEN 'image' ELSE 'text' END AS kind FROM lineitem"
    )
