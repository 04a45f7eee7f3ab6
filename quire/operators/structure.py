"""Lines and islands: pipe tables, cells, headings and their repair, structure counts."""

from __future__ import annotations

from quire.functions import text as X
from quire.functions.text import f
from quire.plans.registry import query, relation

SEPARATOR = r"^[\s|:-]+$"


@relation
def table_text(d):
    """Texts with tables: invoices, some with a borderless or a contents table."""
    nl = d.char(10)
    toc = f"concat('| Chapter | Page |', {nl}, '|---|---|', {nl}, repeat(concat('| Part | 12 |', {nl}), 9))"
    return f"SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN concat(text, {nl}, {nl}, {toc}) ELSE text END AS text FROM {{invoice}}"


def lines_of(d, text: str) -> str:
    trimmed = X.strip(d, "line")
    return f"SELECT doc_id, pos, {trimmed} AS line, {trimmed} LIKE '|%|' AND length({trimmed}) > 1 AS row FROM {d.explode(text, 'doc_id', X.lines(d, 'text'), 'line', 'pos')} AS e"


def rows_of(d, lines: str) -> str:
    cut = d.sub("line", r"^\||\|$")
    if d.name == "spark":  # a row's trimmed line is bounded by pipes
        cut = "substring(line, 2, length(line) - 2)"
    return f"""SELECT doc_id, block, pos, line, {d.has('line', SEPARATOR)} AS separator, {d.map(d.split(cut, '|'), X.strip(d, 'x'))} AS cells FROM (
SELECT doc_id, pos, line, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM {lines} WHERE row) AS i"""


def blocks_of(d, rows: str) -> str:
    last = d.at("cells", f"{d.size('cells')} - 1")
    number = d.has(last, r"^(\d{1,4}|[ivxlcIVXLC]+)$")
    return f"""SELECT doc_id, min(pos) AS first_line, count(*) AS n_lines, count(*) FILTER (WHERE NOT separator) - 1 AS data_rows,
 max({d.size('cells')}) AS n_cols, count(*) FILTER (WHERE {number} AND NOT separator) AS page_numbers,
 round(cast(count(*) FILTER (WHERE {d.size(d.filter('cells', "x <> ''"))} > 0 AND NOT separator) AS DOUBLE) / count(*), 6) AS filled
FROM {rows} GROUP BY doc_id, block HAVING count(*) >= 2"""


@relation
def table_line(d):
    return lines_of(d, "{table_text}")


@relation
def table_row(d):
    """Rows of pipe blocks; a block is an island of touching rows."""
    return rows_of(d, "{table_line}")


@relation
def table_block(d):
    return blocks_of(d, "{table_row}")


@relation
def bare_page(d):
    """Pages without a table."""
    return f"SELECT doc_id FROM {{page}} AS p WHERE NOT {d.has('p.text', r'(?m)^[ \t]*\|.*\|[ \t]*$')}"


@relation
def overlay_row(d):
    """Rows of those texts alone that a page may take."""
    return rows_of(d, f"({lines_of(d, '(SELECT t.doc_id, t.text FROM {table_text} AS t LEFT SEMI JOIN {bare_page} AS b ON t.doc_id = b.doc_id) AS t')}) AS l")


@relation
def overlay_block(d):
    return blocks_of(d, "{overlay_row}")


@query
def table_blocks(d):
    return f"SELECT *, data_rows >= 8 AND n_cols <= 3 AND page_numbers > {f(0.6)} * data_rows AS toc FROM {{table_block}}"


@query
def largest_table(d):
    return "SELECT doc_id, max(n_lines) AS largest, count(*) AS blocks, cast(sum(data_rows) AS BIGINT) AS data_rows FROM {table_block} GROUP BY doc_id"


@query
def csv_cells(d):
    """Cells as a CSV sink writes them: separator rows skipped, edges trimmed."""
    cell = "CASE WHEN x LIKE '%,%' OR x LIKE '%\"%' THEN concat('\"', replace(x, '\"', '\"\"'), '\"') ELSE x END"
    return f"SELECT doc_id, pos, {d.join(d.map('cells', cell), chr(39) + ',' + chr(39))} AS csv FROM {{table_row}} WHERE NOT separator"


@query
def table_overlay(d):
    """Pages without a table take the non-contents tables of the other reading."""
    body = d.listagg("r.line", d.char(10), "r.pos")
    if d.name == "spark":
        return f"""SELECT p.doc_id, t.body FROM {{bare_page}} AS p JOIN (SELECT r.doc_id, {body} AS body FROM {{overlay_row}} AS r JOIN {{overlay_block}} AS b ON r.doc_id = b.doc_id AND r.pos >= b.first_line AND r.pos < b.first_line + b.n_lines
 WHERE NOT (b.data_rows >= 8 AND b.n_cols <= 3 AND b.page_numbers > {f(0.6)} * b.data_rows) GROUP BY r.doc_id) AS t ON p.doc_id = t.doc_id"""
    return f"""SELECT p.doc_id, t.body FROM {{page}} AS p JOIN (SELECT r.doc_id, {body} AS body FROM {{table_row}} AS r JOIN {{table_block}} AS b ON r.doc_id = b.doc_id AND r.pos >= b.first_line AND r.pos < b.first_line + b.n_lines
 WHERE NOT (b.data_rows >= 8 AND b.n_cols <= 3 AND b.page_numbers > {f(0.6)} * b.data_rows) GROUP BY r.doc_id) AS t ON p.doc_id = t.doc_id WHERE NOT {d.has('p.text', r'(?m)^[ \t]*\|.*\|[ \t]*$')}"""


@query
def borderless_regions(d):
    """Runs of three or more lines with an inner gap of two blanks: candidates for tables without rules."""
    s = "replace(replace(text, '|', '   '), '---', ' ')"
    gap = f"length(line) < 200 AND {d.has(X.strip(d, 'line'), r'\S {2,}\S')}"
    return f"""SELECT doc_id, min(pos) AS first_line, count(*) AS n_lines FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
 FROM {d.explode(f"(SELECT doc_id, {s} AS text FROM {{table_text}}) AS t", "doc_id", X.lines(d, "text"), "line", "pos")} AS e WHERE {gap}) AS g GROUP BY doc_id, run HAVING count(*) >= 3"""


@relation
def head_text(d):
    """Markdown with heading trouble: runs, captions, dates, wrapped lines, contents pages."""
    nl = d.char(10)
    runs = f"concat('# One', {nl}, {nl}, '# Two', {nl}, '# Three', {nl}, '# Four', {nl}, '# Five', {nl}, '# Table 3 totals', {nl}, '# January 5', {nl}, 'text here', {nl})"
    return f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat({runs}, text) WHEN 1 THEN concat('# Retrofitting and', {nl}, '# lower start', {nl}, '## 1234', {nl}, text) ELSE text END AS text FROM {{md_page}}"


_MONTH = "jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept(ember)?|oct(ober)?|nov(ember)?|dec(ember)?"
FALSE_HEADING = r"(?i)^#{1,6}\s+(.*=\s*\d|(table|fig(ure|\.))\s+\d|(" + _MONTH + r")\s+\d|\d{2,5}(\s*$|\s+\S.{30,}))"
DANGLING = r"(?i)(\b(a|an|and|for|from|into|of|or|than|the|to|with)|[-–—&:;,])\s*$"


@relation
def head_line(d):
    body = d.sub("line", r"^#{1,6}\s+")
    return f"""SELECT doc_id, pos, line, {d.has('line', r'^#{1,6}\s+\S')} AS head, {d.has('line', r'\S')} AS solid, {d.has('line', FALSE_HEADING)} AS false_head,
 {d.has(body, r'^\p{Ll}')} OR {d.has(body, DANGLING)} AS broken FROM {d.explode('{head_text}', 'doc_id', X.lines(d, 'text'), 'line', 'pos')} AS e"""


@query
def heading_demote(d):
    """Captions, dates, numbers, equations and wrapped lines lose their heading mark."""
    return f"SELECT doc_id, pos, CASE WHEN head AND (false_head OR broken) THEN {d.sub('line', r'^#{1,6}\s+')} ELSE line END AS line FROM {{head_line}}"


@query
def heading_runs(d):
    """Runs of five or more headings with only blank lines between."""
    return f"""SELECT doc_id, min(pos) AS first_line, count(*) AS n FROM (SELECT doc_id, pos, head, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, head ORDER BY pos) AS island
 FROM {{head_line}} WHERE solid) AS i WHERE head GROUP BY doc_id, island HAVING count(*) >= 5"""


@query
def heading_saturation(d):
    return f"SELECT doc_id, count(*) FILTER (WHERE head) AS headings, count(*) FILTER (WHERE solid) AS content, count(*) FILTER (WHERE head) >= 6 AND count(*) FILTER (WHERE head) >= {f(0.5)} * count(*) FILTER (WHERE solid) AS saturated FROM {{head_line}} GROUP BY doc_id"


BOLD_LINE = r"^[*]{2}(.{3,60})[*]{2}$"


@query
def bold_promotion(d):
    """A line that is nothing but bold text of 3 to 60 characters, after a blank line, becomes a heading."""
    new = f"concat('# ', {d.group('line', BOLD_LINE)})"
    rel = d.explode(f"(SELECT doc_id, concat('**Opening**', {d.char(10)}, {d.char(10)}, '**Scope of work**', {d.char(10)}, text) AS text FROM {{md_page}}) AS m", "doc_id", X.lines(d, "text"), "line", "pos")
    return f"""SELECT doc_id, pos, CASE WHEN {d.has('line', BOLD_LINE)} AND (prev IS NULL OR prev = '') THEN {new} ELSE line END AS line
FROM (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM {rel} AS e) AS l"""


@query
def heading_features(d):
    """Numeric features of each line, as a heading classifier takes them."""
    t = X.strip(d, "line")
    return f"""SELECT doc_id, pos, cast(length({t}) AS BIGINT) AS n_chars, cast({d.count(t, r'\S+')} AS BIGINT) AS n_words, {d.has(t, r'^\p{Lu}')} AS capital,
 {d.has(t, r'[.!?]$')} AS sentence, {d.has(t, r'^\d')} AS numbered, {d.has(t, r'^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$')} AS all_caps, cast({d.count(t, r'\d')} AS BIGINT) AS digits, head AS is_heading FROM {{head_line}} WHERE solid"""


def counts(d, s: str) -> str:
    """Headings, list items, table rows, code fences and paragraph starts of a text, in one pass over its line marks."""
    # every row of bars holds a bar, which Spark looks for first; a class of the line's trimmed text is the same in both
    bars = lambda t: f"contains({t}, '|') AND {d.has(t, chr(92) + '|.*' + chr(92) + '|')}" if d.name == "spark" else d.has(t, r"\|.*\|")
    kind = lambda t: (
        f"CASE WHEN {t} LIKE '#%' THEN 'h' WHEN {d.has(t, r'^[-*+]\s')} OR {d.has(t, r'^\d+\.\s')} THEN 'l'"
        f" WHEN {bars(t)} THEN CASE WHEN {d.has(t, SEPARATOR)} THEN 's' ELSE 't' END WHEN {t} LIKE '```%' THEN 'c' WHEN {t} <> '' THEN 'p' ELSE ' ' END"
    )
    marks = d.join(d.map(X.lines(d, s), d.let(X.strip(d, "x"), "t_", kind)), "''")
    n = lambda k: f"cast({d.count('marks', k)} AS BIGINT)"
    return marks, {"headings": n("h"), "lists": n("l"), "table_rows": n("t"), "code_blocks": n("c"), "paragraphs": n("p+")}


@relation
def md_pair(d):
    """Ground truth and an extraction of it with known damage."""
    nl = d.char(10)
    half = d.idiv("2 * length(text)", "3")
    return (
        f"SELECT doc_id, text AS truth, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, cast({half} AS INTEGER)) WHEN 2 THEN {d.sub('text', r'(?m)^#+ ')} ELSE concat(text, {nl}, 'invented remark') END AS got, 'digital' AS page_type FROM {{md_page}}"
        f" UNION ALL SELECT doc_id + 1000000000, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, '| 1', '| 9') ELSE replace(text, '|', ' ') END, 'tables' FROM {{invoice}}"
    )


@query
def structure_score(d):
    return "SELECT doc_id, page_type, round(structure, 6) AS structure_preservation FROM {pair_structure}"


def within(d) -> str:
    """Agreement of the counts of a and b."""
    part = lambda k: f"CASE WHEN b.{k} = 0 AND a.{k} = 0 THEN {f(1.0)} WHEN b.{k} = 0 THEN {f(0.5)} ELSE cast(least(a.{k}, b.{k}) AS DOUBLE) / greatest(a.{k}, b.{k}) END"
    return f"({' + '.join(part(k) for k in counts(d, 'got')[1])}) / {f(5.0)}"


def marked(d) -> str:
    """Pairs with the counts a and b of both texts."""
    (m1, c), (m2, _) = counts(d, "got"), counts(d, "truth")
    both = (f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, ' + e.replace('marks', f'marks_{x}') for k, e in c.items())}) AS {x}" for x in "ab")
    return f"SELECT *, {', '.join(both)} FROM (SELECT *, {m1} AS marks_a, {m2} AS marks_b FROM {{md_pair}}) AS m"


def cell_text(d, col: str) -> str:
    """All normalised table cells of a text, each after a bar (in Spark)."""
    rows = d.filter(X.lines(d, col), f"contains(x, '|') AND {d.has('x', r'\|.*\|')} AND NOT {d.has('x', SEPARATOR)}")
    cells = d.filter(d.split(d.join(rows, "'|'"), "|"), d.has("x", r"\S"))
    return d.join(d.map(cells, f"concat('|', lower({d.sub(X.strip(d, 'x'), chr(92) + 's+', ' ')}))"), "''")


@relation
def pair_structure(d):
    m1, c = counts(d, "got")
    m2, _ = counts(d, "truth")
    cols = ", ".join(f"{e} AS {k}" for k, e in c.items())
    sub = lambda m: f"(SELECT doc_id, page_type, {cols} FROM (SELECT doc_id, page_type, {m} AS marks FROM {{md_pair}}) AS q)"
    return f"SELECT a.doc_id, a.page_type, {within(d)} AS structure FROM {sub(m1)} AS a JOIN {sub(m2)} AS b ON a.doc_id = b.doc_id"


@query
def structure_counts(d):
    m, c = counts(d, "truth")
    return f"SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in c.items())} FROM (SELECT doc_id, {m} AS marks FROM {{md_pair}}) AS q"


@relation
def pair_cells(d):
    """Multiset precision, recall and F1 of table cells."""

    def side(col: str, no: int) -> str:
        rows = d.filter(X.lines(d, col), f"{d.has('x', r'\|.*\|')} AND NOT {d.has('x', SEPARATOR)}")
        cells = d.split(d.join(rows, "'|'"), "|")
        return f"SELECT doc_id, lower({d.sub(X.strip(d, 'cell'), r'\s+', ' ')}) AS cell, {no} AS side FROM {d.explode('{md_pair}', 'doc_id', cells, 'cell')} AS e WHERE {d.has('cell', r'\S')}"

    return f"""SELECT doc_id, cast(sum(a) AS BIGINT) AS n_got, cast(sum(b) AS BIGINT) AS n_truth, cast(sum(least(a, b)) AS BIGINT) AS n_both FROM (
SELECT doc_id, cell, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS b FROM ({side('got', 1)} UNION ALL {side('truth', 2)}) AS u GROUP BY doc_id, cell) AS c GROUP BY doc_id"""


@query
def table_f1(d):
    return f"SELECT doc_id, n_got, n_truth, n_both, CASE WHEN n_got + n_truth = 0 THEN {f(1.0)} ELSE 2 * cast(n_both AS DOUBLE) / (n_got + n_truth) END AS f1 FROM {{pair_cells}}"
