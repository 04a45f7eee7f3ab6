"""Sinks and readers as projections: Markdown, JSON, chunk records, batch manifest, extraction payloads."""

from __future__ import annotations

from quire.functions import text as X
from quire.functions.text import f
from quire.plans.dialect import SPARK
from quire.plans.registry import BUILT, query, relation

from .structure import SEPARATOR


@query
def format_markdown(d):
    """Blanks after heading marks, blank lines before headings, one bullet sign, and the confidence footer."""
    nl = d.char(10)
    s = d.sub("text", r"(?m)^(#{1,6})([^#\s])", "$1 $2")
    s = d.sub(s, r"([^\n]\n)(#+ )", "$1@@QUIRE@@$2")
    s = f"replace({s}, '@@QUIRE@@', {nl})"
    s = d.sub(s, r"(?m)^[*•] ", "- ")
    return f"SELECT doc_id, concat({s}, {nl}, {nl}, '---', {nl}, 'confidence ', cast(cast(round(100 * {X.score_page(d, 'text')}) AS BIGINT) AS VARCHAR(20)), '%') AS markdown FROM {{md_page}}"


def _json_text(d, s: str) -> str:
    s = d.sub(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    b, q = d.char(92), d.char(34)
    for code, to in ((92, f"concat({b}, {b})"), (34, f"concat({b}, {q})"), (10, f"concat({b}, 'n')"), (13, f"concat({b}, 'r')"), (9, f"concat({b}, 't')")):
        s = f"replace({s}, {d.char(code)}, {to})"
    return s


@query
def format_json(d):
    """The locked page record, version 1.1.0."""
    num = lambda x: f"cast({x} AS VARCHAR(20))"
    page = f"""concat('{{"page":', {num('page_num + 1')}, ',"quality":"', quality, '","chars":', {num('chars')}, ',"text":"', {_json_text(d, 'text')}, '"}}')"""
    pages = d.listagg(page, "','", "page_num")
    return f"""SELECT file_id, concat('{{"schema_version":"1.1.0","page_count":', {num('count(*)')}, ',"pages":[', {pages}, ']}}') AS json FROM {{graded}} GROUP BY file_id"""


@query
def ndjson_events(d):
    num = "cast(page_num + 1 AS VARCHAR(20))"
    return f"""SELECT doc_id, concat('{{"type":"page","page":', {num}, ',"quality":"', quality, '"}}') AS line FROM {{graded}}"""


@query
def reader_records(d):
    """Chunks as retrieval libraries take them: text and metadata."""
    return "SELECT doc_id, chunk_index, md5(text) AS text_md5, concat('title=', title, ';pages=', cast(page_start AS VARCHAR(20)), '-', cast(page_end AS VARCHAR(20))) AS metadata FROM {section} WHERE text <> ''"


@query
def rag_file(d):
    return f"SELECT doc_id, count(*) AS total_chunks, cast(sum({X_tokens(d)}) AS BIGINT) AS total_tokens FROM {{section}} WHERE text <> '' GROUP BY doc_id"


def X_tokens(d) -> str:
    from quire.operators.chunking import tokens

    return tokens(d, "text")


@relation
def doc_state(d):
    return f"SELECT file_id, sum(score * chars) / nullif(sum(chars), 0) AS confidence, bool_or(chars = 0) AS broken FROM {{scored}} GROUP BY file_id"


@query
def batch_manifest(d):
    """Counts by confidence bucket, and the strict gate at 0.75."""
    return f"""SELECT count(*) AS documents, count(*) FILTER (WHERE confidence >= {f(0.8)}) AS high, count(*) FILTER (WHERE confidence >= {f(0.5)} AND confidence < {f(0.8)}) AS medium, count(*) FILTER (WHERE confidence < {f(0.5)} OR confidence IS NULL) AS low,
 count(*) FILTER (WHERE coalesce(confidence, 0) < {f(0.75)}) = 0 AS strict_ok FROM {{doc_state}}"""


@query
def batch_errors(d):
    """A code for every text that a batch can't take, null for the others; none is dropped."""
    return f"SELECT doc_id, CASE WHEN chars = 0 THEN 'EXTRACTION_ERROR' WHEN chars > 100000 THEN 'PDF_TOO_LARGE' WHEN score < {f(0.5)} THEN 'PARTIAL_EXTRACTION' END AS error_code FROM {{scored}}"


@relation
def payload(d):
    """Extraction payloads in the shapes that engines emit: page objects, numbered keys, chunks, form feeds, a blob."""
    half = "cast(floor((length(text) + 1) / 2) AS INT)"
    first, second = f"substring(text, 1, {half})", f"substring(text, {half} + 1)"
    a, b = _json_text(d, first), _json_text(d, second)
    return f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('{{"pages":[{{"page":1,"text":"', {a}, '"}},{{"page":2,"text":"', {b}, '"}}]}}') WHEN 1 THEN concat('{{"1":"', {a}, '","2":"', {b}, '"}}')
 WHEN 2 THEN concat('{{"result":{{"chunks":[{{"page":0,"content":"', {a}, '"}},{{"page":1,"content":"', {b}, '"}}]}}}}') WHEN 3 THEN concat({first}, {d.char(12)}, {second}) ELSE text END AS body FROM {{page}}"""


@query
def parse_extraction(d):
    """Pages out of payloads by sniffing their shape, with the hash of what was read."""
    j = lambda *ks: "coalesce(" + ", ".join(d.json("body", k) for k in ks) + ")"
    one = j("pages[0].text", "result.chunks[0].content", "1")
    two = j("pages[1].text", "result.chunks[1].content", "2")
    ff = d.split("body", d.char(12))
    shape = f"CASE WHEN body LIKE '{{\"pages\"%' THEN 'pages' WHEN body LIKE '{{\"result\"%' THEN 'chunks' WHEN body LIKE '{{\"1\"%' THEN 'numbered' WHEN instr(body, {d.char(12)}) > 0 THEN 'form_feed' ELSE 'blob' END"
    return f"""SELECT doc_id, shape, {d.sha256('body')} AS raw_sha256, CASE WHEN shape IN ('pages', 'chunks', 'numbered') THEN {one} WHEN shape = 'form_feed' THEN {d.at(ff, '0')} ELSE body END AS page_1,
 CASE WHEN shape IN ('pages', 'chunks', 'numbered') THEN {two} WHEN shape = 'form_feed' THEN {d.at(ff, '1')} END AS page_2, shape <> 'blob' AS page_aligned FROM (SELECT doc_id, body, {shape} AS shape FROM {{payload}}) AS s"""


@query
def pair_by_stem(d):
    """Source files with the first extraction of the same stem."""
    stem = lambda x: d.group(x, r"([^/]+?)(\.[a-z]+)?$", 1)
    return f"""SELECT s.path AS source, min(e.path) AS extraction FROM (SELECT concat('in/', cast(doc_id AS VARCHAR(20)), '.pdf') AS path FROM {{page}}) AS s
JOIN (SELECT concat('out/', cast(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '.md' END) AS path FROM {{page}} WHERE doc_id % 3 <> 0) AS e ON {stem('s.path')} = {stem('e.path')} GROUP BY s.path"""


@query
def class_histogram(d):
    """Shares of document kinds, as the directory sampler extrapolates them."""
    return "SELECT kind, count(*) AS n, round(cast(count(*) AS DOUBLE) / max(total), 6) AS share FROM {doc_class} AS c CROSS JOIN (SELECT count(*) AS total FROM {doc_class}) AS t GROUP BY kind"


@query
def profile_settings(d):
    """Explicit settings over the user's profile over the built-in one."""
    built = d.values([("invoices", "standard", "json"), ("papers", "high", "llm"), ("receipts", "fast", "json")], ["profile", "quality", "format"])
    user = d.values([("invoices", "high", None), ("papers", None, "markdown")], ["profile", "quality", "format"])
    return f"SELECT b.profile, coalesce(u.quality, b.quality) AS quality, coalesce(u.format, b.format) AS format FROM {built} AS b LEFT JOIN {user} AS u ON b.profile = u.profile"


@query
def raw_fallback(d):
    """Near-empty readings give way to a longer raw text."""
    n = f"length({X.strip(d, 'e.text')})"
    return f"SELECT p.doc_id, {n} < 50 AND length(p.text) > length(e.text) AS raw, md5(CASE WHEN {n} < 50 AND length(p.text) > length(e.text) THEN p.text ELSE e.text END) AS text_md5 FROM {{page}} AS p JOIN {{ext_page}} AS e ON p.doc_id = e.doc_id"


@query
def separator_pages(d):
    """A whole document's Markdown split at rule lines into pages; if their number isn't the expected one, a single page."""
    nl = d.char(10)
    body = d.listagg("replace(text, '---', '-')", f"'{chr(10)}{chr(10)}---{chr(10)}{chr(10)}'", "page_num")
    parts = d.split_re("body", r"\n\n---\n\n")
    split = d.explode(f"(SELECT file_id, {parts} AS parts FROM (SELECT file_id, {body} AS body, count(*) AS n, file_id % 5 = 1 AS odd FROM {{page}} GROUP BY file_id) AS b WHERE NOT odd AND {d.size(parts)} = n) AS s", "file_id", "parts", "part", "page_num")
    return f"""SELECT file_id, page_num, cast(length(part) AS BIGINT) AS n_chars, md5(part) AS text_md5 FROM {split} AS e
UNION ALL SELECT file_id, 0, cast(length(body) AS BIGINT), md5(body) FROM (SELECT file_id, {d.listagg("replace(text, '---', '-')", nl, 'page_num')} AS body FROM {{page}} GROUP BY file_id) AS w WHERE file_id % 5 = 1"""


@relation
def cell_line(d):
    """Where an order comes more than once (see ``whole_cell_line``), its rows of one place are one."""
    cells = d.explode("(SELECT doc_id, block, pos, cells FROM {table_row} WHERE NOT separator) AS r", "doc_id, block, pos", "cells", "cell", "col")
    return f"SELECT doc_id, pos, concat('| ', {d.listagg('cell', chr(39) + ' | ' + chr(39), 'col')}, ' |') AS line FROM {cells} AS c GROUP BY doc_id, pos HAVING cast(count(*) FILTER (WHERE cell <> '') AS DOUBLE) / count(*) >= {f(0.3)}"


def whole_cell_line(sql):
    if sql("SELECT doc_id FROM {table_text} GROUP BY doc_id HAVING count(*) > 1 LIMIT 1").head(1):
        return None
    cells = SPARK.map(SPARK.split("substring(line, 2, length(line) - 2)", "|"), X.strip(SPARK, "x"))
    rows = f"SELECT doc_id, pos, {cells} AS cells FROM {{table_line}} WHERE row AND NOT {SPARK.has('line', SEPARATOR)}"
    return sql(f"SELECT doc_id, pos, concat('| ', array_join(cells, ' | '), ' |') AS line FROM ({rows}) AS r WHERE cast(size(filter(cells, x -> x <> '')) AS DOUBLE) / size(cells) >= {f(0.3)}")


BUILT["cell_line"] = whole_cell_line


@query
def cells_to_table(d):
    """Single cells (row, column, text) put back into pipe rows; rows with under 0.3 of their cells filled go."""
    if d.name == "spark":
        return "SELECT doc_id, pos, line FROM {cell_line}"
    cells = d.explode("(SELECT doc_id, block, pos, cells FROM {table_row} WHERE NOT separator) AS r", "doc_id, block, pos", "cells", "cell", "col")
    return f"SELECT doc_id, pos, concat('| ', {d.listagg('cell', chr(39) + ' | ' + chr(39), 'col')}, ' |') AS line FROM {cells} AS c GROUP BY doc_id, pos HAVING cast(count(*) FILTER (WHERE cell <> '') AS DOUBLE) / count(*) >= {f(0.3)}"


@query
def ocr_cell_grid(d):
    """Recognised boxes to a grid: rows part at gaps over 25 points, columns at gaps over 80; grids of two columns and
    two rows or more with half of the cells filled."""
    if d.name == "spark":  # windows of one order stand together, so that a page's boxes are sorted once for each
        w = lambda c: f"PARTITION BY page_id ORDER BY {c}, box_id"
        cut = lambda c, least, rel, keep: f"SELECT {keep}, sum(b) OVER ({w(c)} ROWS UNBOUNDED PRECEDING) AS {'r' if c == 'y0' else 'c'} FROM (SELECT *, CASE WHEN {c} - lag({c}) OVER ({w(c)}) > {least} THEN 1 ELSE 0 END AS b FROM {rel}) AS {c}_"
        rows = cut("y0", 25, "(SELECT page_id, box_id, x0, y0 FROM {box} WHERE kind = 'text') AS t", "page_id, box_id, x0")
        grid = cut("x0", 80, f"({rows}) AS g", "page_id, r")
        return f"""SELECT page_id, n_rows, n_cols, round(cast(filled AS DOUBLE) / (n_rows * n_cols), 6) AS fill FROM (SELECT page_id, cast(max(r) + 1 AS BIGINT) AS n_rows, cast(max(c) + 1 AS BIGINT) AS n_cols, count(DISTINCT r * 1000 + c) AS filled FROM ({grid}) AS h GROUP BY page_id) AS k
WHERE n_rows >= 2 AND n_cols >= 2 AND filled >= {f(0.5)} * n_rows * n_cols"""
    rows = "SELECT page_id, box_id, x0, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page_id ORDER BY y0, box_id) > 25 THEN 1 ELSE 0 END AS rb, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0, box_id) > 80 THEN 1 ELSE 0 END AS cb FROM {box} WHERE kind = 'text'"
    grid = f"SELECT page_id, box_id, sum(rb) OVER (PARTITION BY page_id ORDER BY y0, box_id ROWS UNBOUNDED PRECEDING) AS r, sum(cb) OVER (PARTITION BY page_id ORDER BY x0, box_id ROWS UNBOUNDED PRECEDING) AS c FROM ({rows}) AS g"
    return f"""SELECT page_id, n_rows, n_cols, round(cast(filled AS DOUBLE) / (n_rows * n_cols), 6) AS fill FROM (SELECT page_id, cast(max(r) + 1 AS BIGINT) AS n_rows, cast(max(c) + 1 AS BIGINT) AS n_cols, count(DISTINCT r * 1000 + c) AS filled FROM ({grid}) AS h GROUP BY page_id) AS k
WHERE n_rows >= 2 AND n_cols >= 2 AND filled >= {f(0.5)} * n_rows * n_cols"""


@query
def provider_resolve(d):
    """Model providers by name: built in, then configured, then plugged in; the later source wins."""
    rows = [("gemini", "builtin", 1, "gemini-flash"), ("claude", "builtin", 1, "claude-sonnet"), ("gemini", "config", 2, "gemini-pro"), ("local", "config", 2, "local"), ("local", "plugin", 3, "local")]
    return f"SELECT name, origin, model FROM (SELECT name, origin, model, row_number() OVER (PARTITION BY name ORDER BY rank DESC) AS r FROM {d.values(rows, ['name', 'origin', 'rank', 'model'])} AS p) AS z WHERE r = 1"
