"""Verification of an extraction against its source: token bags, page verdicts, manifests, diffs."""

from __future__ import annotations

from quire.functions import text as X
from quire.functions.text import f
from quire.plans.dialect import SPARK
from quire.plans.registry import query, relation

TOKEN = r"[0-9A-Za-z\x{00C0}-\x{024F}\x{0400}-\x{04FF}\x{0600}-\x{06FF}]{2,}"
STOPWORDS = sorted(
    set(
        "a about above against all an and any are as at be been being below both but by can each few for from he her here him his"
        " how i in into is it its just more most my no nor not of off on once only or other our out over own same she so some such than that the"
        " their them then there these they this those to too under up very was we were what when where which who whom whose why will with you your"
        " down us".split()
    )

)
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
PIPE_ROW = r"(?m)^[ \t]*\|.*\|[ \t]*$"
HEADING = r"(?m)^#{1,6}\s+\S"


def _bag(d, rel: str, keys: str, text: str, side: int) -> str:
    tokens = d.explode(f"(SELECT {keys}, {d.all(text, TOKEN)} AS ts FROM {rel}) AS s", keys, "ts", "raw")
    return f"SELECT {keys}, lower(raw) AS token, {side} AS side FROM {tokens} AS t WHERE lower(raw) NOT IN ({_STOP})"


def _met(d, rel: str, keys: str) -> str:
    """Both bags of ``rel`` (src, ext) met by (keys, token): one shuffle counts both sides."""
    both = f"{_bag(d, rel, keys, 'src', 1)} UNION ALL {_bag(d, rel, keys, 'ext', 2)}"
    return f"""SELECT {keys}, cast(sum(s) AS BIGINT) AS n_src, cast(sum(e) AS BIGINT) AS n_ext, cast(sum(least(s, e)) AS BIGINT) AS n_both
FROM (SELECT {keys}, token, count(*) FILTER (WHERE side = 1) AS s, count(*) FILTER (WHERE side = 2) AS e FROM ({both}) AS b GROUP BY {keys}, token) AS c GROUP BY {keys}"""


def _presence(d, pages: str, whole: str) -> str:
    """The share of each page's tokens (file_id, page_num, src) that its document's extraction (file_id, ext) holds."""
    src = d.explode(f"(SELECT file_id, page_num, {d.all('src', TOKEN)} AS ts FROM {pages}) AS s", "file_id, page_num", "ts", "raw")
    ext = d.explode(f"(SELECT file_id, {d.all('ext', TOKEN)} AS ts FROM {whole}) AS s", "file_id", "ts", "raw")
    return f"""SELECT p.file_id, p.page_num, cast(sum(least(p.n, coalesce(w.n, 0))) AS DOUBLE) / sum(p.n) AS recovered
FROM (SELECT file_id, page_num, lower(raw) AS token, count(*) AS n FROM {src} AS a WHERE lower(raw) NOT IN ({_STOP}) GROUP BY file_id, page_num, lower(raw)) AS p
LEFT JOIN (SELECT file_id, lower(raw) AS token, count(*) AS n FROM {ext} AS b GROUP BY file_id, lower(raw)) AS w ON p.file_id = w.file_id AND p.token = w.token GROUP BY p.file_id, p.page_num"""


@relation
def source_page(d):
    """Source pages under audit: texts, and invoices with their tables."""
    return "SELECT file_id, page_num, doc_id, text FROM {page} UNION ALL SELECT 1000000 + doc_id, 0, doc_id + 1000000000, text FROM {invoice}"


@relation
def audited(d):
    """The extraction of the same pages, with known damage: of ten documents one comes as a single blob, one lacks its last
    pages and one has a page too many; invoice tables lose most rows or all pipes."""
    n = d.idiv("2 * length(text)", "3")
    nl = d.char(10)
    return (
        "SELECT file_id, page_num, text FROM {ext_page} WHERE file_id % 10 NOT IN (3, 4) OR file_id % 10 = 4 AND page_num < 47"
        f" UNION ALL SELECT file_id, 0, {d.listagg('text', f'concat({nl}, {nl})', 'page_num')} FROM {{ext_page}} WHERE file_id % 10 = 3 GROUP BY file_id"
        " UNION ALL SELECT file_id, 50, 'A page that no source page answers to' FROM {ext_page} WHERE file_id % 10 = 5 AND page_num = 0"
        f" UNION ALL SELECT 1000000 + doc_id, 0, CASE doc_id % 4 WHEN 1 THEN substring(text, 1, cast({n} AS INTEGER)) WHEN 2 THEN replace(text, '|', ' ') ELSE text END FROM {{invoice}}"
    )


@relation
def paired(d):
    """Every page of either side, by document and page number; a side that lacks the page has an empty text."""
    return """SELECT coalesce(s.file_id, a.file_id) AS file_id, coalesce(s.page_num, a.page_num) AS page_num, coalesce(s.text, '') AS src, coalesce(a.text, '') AS ext,
 s.file_id IS NOT NULL AS in_src, a.file_id IS NOT NULL AS in_ext FROM {source_page} AS s FULL OUTER JOIN {audited} AS a ON s.file_id = a.file_id AND s.page_num = a.page_num"""


@relation
def paging(d):
    """Whether the page counts of both sides agree to a tenth, rounded half to even, or to one page."""
    tenth = f"{d.idiv('n_src', '10')} + CASE WHEN n_src % 10 > 5 OR n_src % 10 = 5 AND {d.idiv('n_src', '10')} % 2 = 1 THEN 1 ELSE 0 END"
    return f"""SELECT file_id, n_src > 0 AND n_ext > 0 AND abs(n_ext - n_src) <= greatest(1, {tenth}) AS aligned
FROM (SELECT file_id, count(*) FILTER (WHERE in_src) AS n_src, count(*) FILTER (WHERE in_ext) AS n_ext FROM {{paired}} GROUP BY file_id) AS c"""


@relation
def token_match(d):
    return _met(d, "{paired}", "file_id, page_num")


@relation
def off_page(d):
    """For pages with an empty slot only: how much of them the whole extraction of the document holds."""
    lost = f"(SELECT file_id, page_num, src FROM {{paired}} WHERE length({X.strip(d, 'ext')}) < 20) AS l"
    return _presence(d, lost, "{paired}")


@query
def page_alignment(d):
    return (
        f"SELECT file_id, page_num, CASE WHEN n_src = 0 THEN {f(1.0)} ELSE cast(n_both AS DOUBLE) / n_src END AS alignment,"
        f" CASE WHEN n_ext < 12 THEN {f(0.0)} ELSE cast(n_ext - n_both AS DOUBLE) / n_ext END AS hallucination_risk FROM {{token_match}}"
    )


def largest_table(d, s: str) -> str:
    """Rows of the largest run of pipe lines, within the row: lines become marks, runs of marks are measured."""
    row = f"{d.has('x', chr(94) + r'\s*\|.*\|\s*$')} OR {d.has('x', chr(94) + r'\s*\|\s*$')}"
    row = f"contains(x, '|') AND ({row})" if d.name == "spark" else row
    marks = d.join(d.map(X.lines(d, s), f"CASE WHEN {row} THEN 't' ELSE ' ' END"), "''")
    most = f"coalesce({d.amax(d.map(d.split(marks, chr(39) + ' ' + chr(39)), 'length(x)'))}, 0)"
    return f"CASE WHEN contains({s}, '|') THEN {most} ELSE 0 END" if d.name == "spark" else most


@relation
def measured(d):
    align = f"CASE WHEN coalesce(m.n_src, 0) = 0 THEN {f(1.0)} ELSE cast(m.n_both AS DOUBLE) / m.n_src END"
    hallu = f"CASE WHEN coalesce(m.n_ext, 0) < 12 THEN {f(0.0)} ELSE cast(m.n_ext - m.n_both AS DOUBLE) / m.n_ext END"
    return f"""SELECT p.file_id, p.page_num, length({X.strip(d, 'p.src')}) AS sc, length({X.strip(d, 'p.ext')}) AS ec,
 {X.score_page(d, 'p.ext')} AS conf, {align} AS alignment, {hallu} AS hallu, o.recovered, {d.count('p.src', PIPE_ROW)} AS s_rows, {d.count('p.ext', PIPE_ROW)} AS e_rows,
 {largest_table(d, 'p.src')} AS s_block, {largest_table(d, 'p.ext')} AS e_block, {d.has('p.src', HEADING)} AS s_head, {d.has('p.ext', HEADING)} AS e_head
FROM {{paired}} AS p JOIN {{paging}} AS g ON p.file_id = g.file_id LEFT JOIN {{token_match}} AS m ON p.file_id = m.file_id AND p.page_num = m.page_num
LEFT JOIN {{off_page}} AS o ON p.file_id = o.file_id AND p.page_num = o.page_num WHERE g.aligned"""


@relation
def blob(d):
    """Documents whose page boundaries can't be trusted: both sides whole."""
    nl2 = f"concat({d.char(10)}, {d.char(10)})"
    one = lambda c: d.listagg(f"CASE WHEN {c} <> '' THEN {c} END", nl2, "page_num")
    return f"""SELECT p.file_id, coalesce({one('p.src')}, '') AS src, coalesce({one('p.ext')}, '') AS ext
FROM {{paired}} AS p JOIN {{paging}} AS g ON p.file_id = g.file_id WHERE NOT g.aligned GROUP BY p.file_id"""


@relation
def unsegmented(d):
    """Each source page of those documents against the whole extraction, by presence; cover, score and risk are the document's."""
    pages = "(SELECT p.file_id, p.page_num, p.src FROM {paired} AS p JOIN {paging} AS g ON p.file_id = g.file_id WHERE NOT g.aligned) AS q"
    sc, ec = f"length({X.strip(d, 'src')})", f"length({X.strip(d, 'ext')})"
    one, zero = f(1.0), f(0.0)
    return f"""SELECT p.file_id, p.page_num, length({X.strip(d, 'p.src')}) AS sc, coalesce(o.recovered, {one}) AS alignment, w.cov, w.conf,
 CASE WHEN coalesce(m.n_ext, 0) < 12 THEN {zero} ELSE cast(m.n_ext - m.n_both AS DOUBLE) / m.n_ext END AS hallu,
 {d.count('p.src', PIPE_ROW)} AS s_rows, {d.has('p.src', HEADING)} AS s_head
FROM {{paired}} AS p JOIN (SELECT file_id, CASE WHEN {sc} = 0 THEN {one} ELSE least({one}, cast({ec} AS DOUBLE) / {sc}) END AS cov,
 CASE WHEN {ec} = 0 THEN {zero} ELSE {X.score_page(d, 'ext')} END AS conf FROM {{blob}}) AS w ON p.file_id = w.file_id
LEFT JOIN ({_met(d, '{blob}', 'file_id')}) AS m ON p.file_id = m.file_id
LEFT JOIN ({_presence(d, pages, '{blob}')}) AS o ON p.file_id = o.file_id AND p.page_num = o.page_num WHERE p.in_src"""


def side_columns(no: int) -> list[str]:
    """A side's page with its measures: stripped length, score (of an extraction), pipe rows, largest table, heading."""
    d = SPARK
    conf = X.score_page(d, "coalesce(text, '')") if no == 2 else f(0.0)
    rows = f"CASE WHEN contains(text, '|') THEN {d.count('text', PIPE_ROW)} ELSE 0 END"
    measures = [f"length({X.strip(d, 'text')})", rows, largest_table(d, "text"), f"contains(text, '#') AND {d.has('text', HEADING)}"]
    sc, rows, block, head = (f"coalesce({m}, {z})" for m, z in zip(measures, ("0", "0", "0", "false"), strict=True))
    return ["file_id", "page_num", f"{no} AS side", "coalesce(text, '') AS text", f"cast({sc} AS BIGINT) AS sc", f"{conf} AS conf", f"cast({rows} AS BIGINT) AS n_rows", f"cast({block} AS BIGINT) AS block", f"{head} AS head"]


@relation
def page_verif(d):
    state = "CASE WHEN sc < 20 AND ec < 20 THEN 'blank' WHEN sc < 20 THEN 'unreadable' WHEN sc >= 200 AND ec < 20 AND recovered >= 0.5 THEN 'moved' WHEN sc >= 200 AND ec < 20 THEN 'drop' ELSE 'scored' END"
    cov = f"least({f(1.0)}, cast(ec AS DOUBLE) / nullif(sc, 0))"
    trunc = f"((s_rows >= 4 AND e_rows < {f(0.8)} * s_rows) OR (s_block >= 4 AND e_block < {f(0.8)} * s_block))"
    flags = [
        (f"cov < {f(0.6)}", "low_coverage"),
        (f"alignment < {f(0.55)}", "low_alignment"),
        (f"hallu > {f(0.45)}", "hallucination_risk"),
        (f"conf < {f(0.55)}", "low_confidence"),
        ("s_rows >= 2 AND e_rows < 2", "table_dropped"),
        (f"NOT (s_rows >= 2 AND e_rows < 2) AND {trunc}", "table_truncated"),
        ("s_head AND NOT e_head", "headings_dropped"),
        (f"cov < {f(0.25)} AND alignment < {f(0.35)}", "severe_content_loss"),
    ]
    all_ = d.join(d.compact(d.array(*(f"CASE WHEN {c} THEN '{n}' END" for c, n in flags))), "','")
    by = lambda scored, **k: "CASE state " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in k.items()) + f" ELSE {scored} END"
    one, zero, rec = f(1.0), f(0.0), "round(recovered, 4)"
    ub = lambda scored, blank, drop: f"CASE kind WHEN 'blank' THEN {blank} WHEN 'drop' THEN {drop} ELSE {scored} END"
    fail = f"cov < {f(0.25)} AND alignment < {f(0.35)}"
    kind = f"CASE WHEN sc < 20 THEN 'blank' WHEN sc >= 200 AND alignment < {f(0.15)} THEN 'drop' ELSE 'scored' END"
    extra = f"concat(CASE WHEN alignment < {f(0.55)} THEN ',low_alignment' ELSE '' END, CASE WHEN hallu > {f(0.45)} THEN ',hallucination_risk' ELSE '' END)"
    verdict = by(f"CASE WHEN {fail} THEN 'fail' WHEN all_flags <> '' THEN 'review' ELSE 'pass' END", blank="'pass'", unreadable="'unverifiable'", moved="'review'", drop="'fail'")
    flagged = by("all_flags", blank="'blank_page'", unreadable="'source_no_text_layer'", moved="'content_off_page'", drop="'silent_drop'")
    # name, what it is on a page of a document whose pages are aligned, what it is otherwise
    cols = [
        ("coverage", by("round(cov, 4)", blank=one, unreadable=one, moved=rec, drop=zero), ub("round(cov, 4)", one, zero)),
        ("confidence", by("round(conf, 4)", blank=one, unreadable="conf", moved=rec, drop=zero), ub("round(conf, 4)", one, zero)),
        ("alignment", by("round(alignment, 4)", blank=one, unreadable=zero, moved=rec, drop=zero), ub("round(alignment, 4)", one, "round(alignment, 4)")),
        ("hallucination_risk", by("round(hallu, 4)", blank=zero, unreadable=zero, moved=zero, drop=zero), ub("round(hallu, 4)", zero, zero)),
        ("silent_drop", "state = 'drop'", "kind = 'drop'"),
        ("table_integrity", by("NOT (s_rows >= 2 AND e_rows < 2)", blank="true", unreadable="true", moved="true", drop="s_rows < 2"), ub("true", "true", "s_rows < 2")),
        ("heading_integrity", by("NOT (s_head AND NOT e_head)", blank="true", unreadable="true", moved="true", drop="NOT s_head"), ub("true", "true", "NOT s_head")),
        ("verdict", verdict, ub("CASE WHEN extra <> '' THEN 'review' ELSE 'pass' END", "'pass'", "'fail'")),
        ("flags", flagged, ub("concat('unsegmented_extraction', extra)", "'blank_page,unsegmented_extraction'", "'silent_drop,unsegmented_extraction'")),
    ]
    if d.name == "spark":  # one pass over the pages of both kinds
        both = ", ".join(f"CASE WHEN aligned THEN {a} ELSE {u} END AS {n}" for n, a, u in cols)
        return f"""SELECT file_id, page_num, aligned AS page_aligned, sc AS source_chars, ec AS extracted_chars, {both}
FROM (SELECT *, {all_} AS all_flags FROM (SELECT *, {state} AS state, CASE WHEN aligned THEN {cov} ELSE doc_cov END AS cov, {kind} AS kind, {extra} AS extra FROM {{compared}}) AS a) AS b"""
    a = {n: f"{e} AS {n}" for n, e, _ in cols}
    u = {n: e for n, _, e in cols}
    return f"""SELECT file_id, page_num, true AS page_aligned, cast(sc AS BIGINT) AS source_chars, cast(ec AS BIGINT) AS extracted_chars,
 {a['coverage']}, {a['confidence']},
 {a['alignment']}, {a['hallucination_risk']},
 {a['silent_drop']}, {a['table_integrity']},
 {a['heading_integrity']},
 {a['verdict']},
 {a['flags']}
FROM (SELECT *, {all_} AS all_flags FROM (SELECT *, {state} AS state, {cov} AS cov FROM {{measured}}) AS a) AS b
UNION ALL SELECT file_id, page_num, false, cast(sc AS BIGINT), cast(0 AS BIGINT), {u['coverage']}, {u['confidence']}, {u['alignment']},
 {u['hallucination_risk']}, {u['silent_drop']}, {u['table_integrity']}, {u['heading_integrity']},
 {u['verdict']}, {u['flags']}
FROM (SELECT *, {kind} AS kind,
 {extra} AS extra FROM {{unsegmented}}) AS u"""


@query
def verify_pages(d):
    return "SELECT * FROM {page_verif}"


@relation
def manifest(d):
    w = "greatest(1, source_chars)"
    low = f"confidence < {f(0.55)} AND verdict NOT IN ('unverifiable', 'fail')"
    lists = ", ".join(
        f"{d.join(d.map(d.collect(f'CASE WHEN {c} THEN page_num + 1 END'), 'cast(x AS VARCHAR(20))'), chr(39) + ',' + chr(39))} AS {n}"
        for n, c in (("silent_drops", "silent_drop"), ("low_confidence_pages", low), ("review_pages", "verdict = 'review'"), ("unverifiable_pages", "verdict = 'unverifiable'"))
    )
    return f"""SELECT file_id, count(*) AS page_count, bool_and(page_aligned) AS page_aligned, CASE WHEN bool_or(verdict = 'fail' OR silent_drop) THEN 'FAIL' WHEN bool_or(verdict IN ('review', 'unverifiable') OR ({low})) THEN 'REVIEW' ELSE 'PASS' END AS verdict,
 round(sum(confidence * {w}) / sum({w}), 6) AS confidence, round(sum(coverage * {w}) / sum({w}), 6) AS coverage, {lists} FROM {{page_verif}} GROUP BY file_id"""


@query
def verify_manifest(d):
    """With a signature over the manifest's own canonical fields, so that any change of them shows."""
    parts = "concat_ws('|', cast(file_id AS VARCHAR(20)), cast(page_count AS VARCHAR(20)), verdict, silent_drops, low_confidence_pages, review_pages, unverifiable_pages)"
    return f"SELECT *, concat('sha256:', {d.sha256(parts)}) AS signature FROM {{manifest}}"


@query
def verify_batch(d):
    return (
        "SELECT count(*) AS documents, cast(sum(page_count) AS BIGINT) AS pages, count(*) FILTER (WHERE verdict = 'PASS') AS passed, count(*) FILTER (WHERE verdict = 'REVIEW') AS review,"
        " count(*) FILTER (WHERE verdict = 'FAIL') AS failed, round(avg(confidence), 6) AS confidence FROM {manifest}"
    )


@query
def verify_summary(d):
    return "SELECT file_id, concat(verdict, ': ', cast(page_count AS VARCHAR(20)), ' pages', CASE WHEN silent_drops <> '' THEN concat('; silent drops on ', silent_drops) ELSE '' END, CASE WHEN review_pages <> '' THEN concat('; review ', review_pages) ELSE '' END) AS summary FROM {manifest}"


@query
def verify_unsegmented(d):
    """Each source page against the whole extraction of its document, by content presence."""
    pages = "(SELECT file_id, page_num, text AS src FROM {page}) AS q"
    whole = "(SELECT file_id, text AS ext FROM {ext_page}) AS r"
    held = "SELECT * FROM {presence}" if d.name == "spark" else _presence(d, pages, whole)
    return f"""SELECT g.doc_id, g.chars, round(coalesce(a.recovered, 1), 6) AS alignment, g.chars >= 200 AND coalesce(a.recovered, 1) < {f(0.15)} AS silent_drop FROM {{graded}} AS g
JOIN {{page}} AS p ON g.doc_id = p.doc_id LEFT JOIN ({held}) AS a ON p.file_id = a.file_id AND p.page_num = a.page_num"""


@query
def audit_jaccard(d):
    """Word-set overlap with another extractor's text, and a recommendation."""
    bag = lambda s: d.distinct(d.all(f"lower({s})", "[a-z0-9]+"))
    return f"""SELECT doc_id, jaccard, left_only, right_only, CASE WHEN jaccard < {f(0.7)} OR score < {f(0.5)} THEN 'review' ELSE 'ok' END AS recommendation FROM (
SELECT doc_id, score, na - nc AS left_only, nb - nc AS right_only, CASE WHEN na = 0 AND nb = 0 THEN {f(1.0)} WHEN na = 0 OR nb = 0 THEN {f(0.0)} ELSE round(cast(nc AS DOUBLE) / (na + nb - nc), 9) END AS jaccard
FROM (SELECT doc_id, score, {d.size('a')} AS na, {d.size('b')} AS nb, {d.common("a", "b")} AS nc FROM (SELECT p.doc_id, p.score, {bag('p.text')} AS a, {bag('e.text')} AS b FROM {{scored}} AS p JOIN {{ext_page}} AS e ON p.doc_id = e.doc_id) AS x) AS y) AS z"""


@query
def doc_diff(d):
    """Two versions of each Markdown page: characters, headings on one side only."""
    heads = lambda s: d.distinct(d.map(d.filter(X.lines(d, s), d.has("x", r"^#{1,6} ")), "lower(x)"))
    new = f"CASE WHEN doc_id % 2 = 0 THEN text ELSE {d.sub('text', r'(?m)^## .*$', '## Changed')} END"
    return f"""SELECT doc_id, old_chars, new_chars, {d.size('a')} - {d.common('a', 'b')} AS removed_headings, {d.size('b')} - {d.common('a', 'b')} AS added_headings FROM (
SELECT doc_id, cast(length(text) AS BIGINT) AS old_chars, cast(length({new}) AS BIGINT) AS new_chars, {heads('text')} AS a, {heads(new)} AS b FROM {{md_page}}) AS x"""

