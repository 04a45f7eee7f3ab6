"""Page scores, page and document classes, document confidence, OCR budget, sampling."""

from __future__ import annotations

from quire.functions import text as X
from quire.functions.text import f
from quire.plans.registry import query, relation


@relation
def scored(d):
    return (
        f"SELECT file_id, page_num, doc_id, image_count, ocr_applied, text, cast(length({X.strip(d, 'text')}) AS BIGINT) AS chars,"
        f" {X.score_page(d, 'text', 'image_count')} AS score FROM {{page}}"
    )


@relation
def graded(d):
    return f"SELECT *, {X.page_quality('chars', 'image_count')} AS quality FROM {{scored}}"


@query
def page_score(d):
    return "SELECT doc_id, chars, score FROM {scored}"


@query
def page_audit(d):
    return (
        "SELECT doc_id, quality, CASE quality WHEN 'empty' THEN concat('only ', cast(chars AS VARCHAR(20)), ' chars')"
        " WHEN 'bad' THEN concat(cast(chars AS VARCHAR(20)), ' chars with ', cast(image_count AS VARCHAR(20)), ' images')"
        " ELSE concat(cast(chars AS VARCHAR(20)), ' chars') END AS reason FROM {graded}"
    )


@query
def page_quality_counts(d):
    return (
        "SELECT file_id, count(*) FILTER (WHERE quality = 'good') AS good, count(*) FILTER (WHERE quality = 'bad') AS bad,"
        " count(*) FILTER (WHERE quality = 'empty') AS empty, bool_or(quality <> 'good') AS needs_ocr FROM {graded} GROUP BY file_id"
    )


@query
def audit_page_lists(d):
    pick = lambda k: d.collect(f"CASE WHEN quality = '{k}' THEN page_num + 1 END")
    to = lambda a: d.join(d.map(a, "cast(x AS VARCHAR(20))"), "','")
    return f"SELECT file_id, {to(pick('bad'))} AS bad_pages, {to(pick('empty'))} AS empty_pages FROM {{graded}} GROUP BY file_id"


@query
def doc_confidence(d):
    """Score weighted by characters, less penalties for OCR and unrecovered pages, plus a bonus for headings."""
    heading = d.has("text", r"(?m)^#+\s")
    empties = d.collect("CASE WHEN chars < 20 THEN page_num + 1 END")
    first = d.join(d.map(d.slice(empties, "1", "5"), "cast(x AS VARCHAR(20))"), "', '")
    return f"""SELECT file_id, pages, ocr_pages, unrecovered, CASE WHEN total = 0 THEN {f(0.0)} ELSE
 round(greatest({f(0.0)}, least({f(1.0)}, weighted / total - least({f(0.15)}, ocr_pages * {f(0.2)} / pages)
 - least({f(0.4)}, unrecovered * {f(0.5)} / pages) + CASE WHEN headed THEN {f(0.03)} ELSE {f(0.0)} END)), 9) END AS confidence,
 CASE WHEN total = 0 THEN 'No text' WHEN empty_pages = 0 THEN '' WHEN empty_pages <= 5 THEN concat(cast(empty_pages AS VARCHAR(20)), ' empty (', firsts, ')')
 ELSE concat(cast(empty_pages AS VARCHAR(20)), ' empty (first 5: ', firsts, ')') END AS empty_warning,
 CASE WHEN sparse > {f(0.25)} * pages THEN sparse ELSE 0 END AS sparse_warning
FROM (SELECT file_id, count(*) AS pages, count(*) FILTER (WHERE ocr_applied) AS ocr_pages,
 count(*) FILTER (WHERE quality <> 'good' AND NOT ocr_applied) AS unrecovered, sum(score * chars) AS weighted, cast(sum(chars) AS BIGINT) AS total,
 bool_or({heading}) AS headed, count(*) FILTER (WHERE chars < 20) AS empty_pages, {first} AS firsts,
 count(*) FILTER (WHERE chars >= 20 AND chars < 100) AS sparse FROM {{graded}} GROUP BY file_id) AS g"""


@relation
def page_class(d):
    return f"""SELECT file_id, page_num, doc_id, chars, text, image_count, CASE WHEN chars < 20 AND image_count = 0 THEN 'empty' WHEN chars > 50 THEN 'digital'
 WHEN image_count > 0 THEN 'scanned' ELSE 'digital' END AS class, (image_count >= 2 AND chars < 500) OR (image_count >= 1 AND chars < 100) AS graphical,
 page_num < 20 AND {X.arabic_ratio(d, 'text')} > {f(0.05)} AS arabic FROM {{scored}}"""


@relation
def doc_class(d):
    r = "(cast(digital AS DOUBLE) / nullif(digital + scanned, 0))"
    return f"""SELECT file_id, pages, digital, scanned, graphical, arabic,
 CASE WHEN digital + scanned = 0 THEN 'digital' WHEN {r} >= {f(0.8)} THEN 'digital' WHEN {r} <= {f(0.2)} THEN 'scanned' ELSE 'mixed' END AS kind,
 CASE WHEN digital + scanned = 0 THEN {f(0.5)} WHEN {r} >= {f(0.8)} THEN least({f(0.95)}, {r}) WHEN {r} <= {f(0.2)} THEN least({f(0.95)}, 1 - {r}) ELSE {f(0.7)} END AS confidence,
 digital + scanned > 0 AND graphical > {f(0.25)} * pages AS is_graphical
FROM (SELECT file_id, count(*) AS pages, count(*) FILTER (WHERE class = 'digital') AS digital, count(*) FILTER (WHERE class = 'scanned') AS scanned,
 count(*) FILTER (WHERE graphical) AS graphical, bool_or(arabic) AS arabic FROM {{page_class}} GROUP BY file_id) AS g"""


@query
def doc_classify(d):
    return "SELECT * FROM {doc_class}"


@query
def page_analyze(d):
    return (
        "SELECT p.doc_id, p.class, c.kind, p.chars, CASE WHEN p.class = 'scanned' THEN 'scanned' WHEN p.graphical THEN 'graphical' WHEN p.class = 'empty' THEN 'empty'"
        " WHEN p.class = 'digital' THEN 'digital' ELSE 'unknown' END AS label FROM {page_class} AS p JOIN {doc_class} AS c ON p.file_id = c.file_id"
    )


@query
def table_page_sample(d):
    """Up to 20 pages a document: all, or five windows of four at the front, quarters and back."""
    base = "(SELECT file_id, count(*) AS n FROM {page} GROUP BY file_id)"
    starts = d.array("0", d.idiv("n", "4"), f"{d.idiv('n', '2')} - 2", f"{d.idiv('3 * n', '4')} - 2", "n - 4")
    wide = f"(SELECT file_id, n, {starts} AS starts FROM {base} AS b WHERE n > 20)"
    wins = d.explode(wide + " AS w", "file_id, n", "starts", "s")
    nums = d.explode(f"{wins} AS v", "file_id, n", d.series("s", "s + 3"), "page_num")
    small = d.explode(f"(SELECT file_id, n FROM {base} AS b WHERE n <= 20) AS s", "file_id, n", d.series("0", "n - 1"), "page_num")
    return f"SELECT DISTINCT file_id, page_num FROM {nums} AS a WHERE page_num >= 0 AND page_num < n UNION SELECT file_id, page_num FROM {small} AS b"


@relation
def signal(d):
    x = lambda c: d.size(d.filter(X.lines(d, "text"), c))
    dense = f"length(x) >= 20 AND cast({d.count('x', r'[0-9$,%.()-]')} AS DOUBLE) / nullif(length({X.dense(d, 'x')}), 0) >= {f(0.3)}"
    spaced = f"length(x) > 20 AND {d.count('x', r'  {3,}')} >= 3"
    return f"SELECT doc_id, text, {x(dense)} AS numeric_lines, {x(spaced)} AS spaced_lines FROM {{anytext}}"


@relation
def anytext(d):
    return "SELECT doc_id, text FROM {page} UNION ALL SELECT doc_id + 1000000000, text FROM {invoice}"


@query
def table_signals(d):
    return (
        "SELECT doc_id, numeric_lines, spaced_lines, numeric_lines >= 3 AS table_page,"
        " CASE WHEN numeric_lines >= 5 THEN 2 ELSE 0 END + CASE WHEN spaced_lines >= 5 THEN 1 ELSE 0 END AS table_score FROM {signal}"
    )


@query
def ocr_budget_topk(d):
    """Weak pages that fit the document's budget, bad ones first."""
    budget = f"CASE WHEN graphical >= {f(0.5)} * pages THEN {f(1.0)} WHEN graphical > {f(0.25)} * pages THEN {f(0.4)} ELSE {f(0.3)} END"
    return f"""SELECT file_id, page_num, quality, rank FROM (SELECT g.file_id, g.page_num, g.quality, greatest(1, cast(floor(c.pages * {budget}) AS BIGINT)) AS k,
 cast(row_number() OVER (PARTITION BY g.file_id ORDER BY CASE g.quality WHEN 'bad' THEN 0 ELSE 1 END, g.page_num) AS BIGINT) AS rank
 FROM {{graded}} AS g JOIN {{doc_class}} AS c ON g.file_id = c.file_id WHERE g.quality <> 'good') AS r WHERE rank <= k"""


@relation
def candidate(d):
    """Second readings of weak pages, by stage of the cascade."""
    return (
        "SELECT doc_id, 1 AS stage, 'region' AS extractor, substring(concat(text, ' recovered region text'), 1, 60) AS text FROM {graded} WHERE quality <> 'good'"
        " UNION ALL SELECT doc_id, 2, 'rapidocr', concat(text, ' ', text, ' text from a full page reading') FROM {graded} WHERE quality <> 'good'"
        " UNION ALL SELECT doc_id, 3, 'llm', concat(text, ' ', text, ' ', text, ' text from a model reading of the page') FROM {graded} WHERE quality <> 'good'"
    )


@query
def candidate_merge(d):
    """The first acceptable candidate of the cascade replaces a weak page: more than 10 characters for an empty one,
    strictly longer for a bad one."""
    n = f"length({X.strip(d, 'c.text')})"
    return f"""SELECT g.doc_id, g.quality, coalesce(b.extractor, 'original') AS extractor, cast(length(coalesce(b.text, g.text)) AS BIGINT) AS n_chars
FROM {{graded}} AS g LEFT JOIN (SELECT doc_id, extractor, text FROM (SELECT c.doc_id, c.extractor, c.text, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.stage) AS r
 FROM {{candidate}} AS c JOIN {{graded}} AS o ON c.doc_id = o.doc_id WHERE (o.quality = 'empty' AND {n} > 10) OR (o.quality = 'bad' AND {n} > o.chars)) AS z WHERE r = 1) AS b
 ON g.doc_id = b.doc_id"""


@query
def llm_score(d):
    """Score of a model's reading against the fast text: coherence, structure, completeness, consistency."""
    t = "e.text"
    n = f"length({t})"
    alpha, mean = X.ratio(X.letters(d, t), n), X.word_length(d, t)
    coherent = lambda al, me: (
        f"greatest({f(0.0)}, {f(1.0)} - CASE WHEN {n} = 0 THEN {f(0.0)} WHEN {al} < {f(0.3)} THEN {f(0.3)} WHEN {al} < {f(0.5)} THEN {f(0.15)} ELSE {f(0.0)} END"
        f" - CASE WHEN {me} < 2 OR {me} > 20 THEN {f(0.2)} WHEN {me} < 3 OR {me} > 15 THEN {f(0.1)} ELSE {f(0.0)} END)"
    )
    coher = d.let(alpha, "al_", lambda al: d.let(mean, "me_", lambda me: coherent(al, me)))
    any_ = lambda c: f"CASE WHEN {d.size(d.filter(X.lines(d, t), c))} > 0 THEN 1 ELSE 0 END"
    marks = " + ".join(
        [
            any_(d.has("x", r"^\s*#")),
            any_(d.has("x", r"^\s*([-*+]|\d+\.)\s")),
            any_(d.has("x", r"\|.*\|")),
            f"CASE WHEN {d.size(d.filter(X.lines(d, t), d.has('x', chr(94) + chr(92) + 's*$')))} >= 2 THEN 1 ELSE 0 END",
            f"CASE WHEN {d.has(t, r'[*][^*]+[*]')} OR {d.has(t, '_[^_]+_')} THEN 1 ELSE 0 END",
        ]
    )
    fill = f"cast(length({X.strip(d, t)}) AS DOUBLE) / 1250"
    comp = d.let(fill, "fi_", lambda x: f"CASE WHEN {x} = 0 THEN {f(0.0)} WHEN {x} >= {f(0.8)} THEN {f(1.0)} WHEN {x} >= {f(0.5)} THEN {f(0.85)} WHEN {x} >= {f(0.2)} THEN {f(0.65)} WHEN {x} >= {f(0.05)} THEN {f(0.4)} ELSE {f(0.2)} END")
    bag = lambda s: d.distinct(d.filter(d.all(f"lower({s})", r"[\p{L}\p{N}_]+"), "length(x) > 2"))
    return f"""SELECT doc_id, coherence, structure, completeness, consistency, CASE WHEN chars < 5 THEN {f(0.0)} WHEN fast_chars > 20 THEN
 round({f(0.3)} * coherence + {f(0.2)} * structure + {f(0.2)} * completeness + {f(0.3)} * consistency, 6) ELSE round({f(0.4)} * coherence + {f(0.3)} * structure + {f(0.3)} * completeness, 6) END AS score
FROM (SELECT doc_id, chars, fast_chars, round(coherence, 9) AS coherence, {f(0.4)} + {f(0.6)} * (marks / {f(5.0)}) AS structure, completeness,
 CASE WHEN {d.size('wa')} = 0 OR {d.size('wb')} = 0 THEN {f(0.5)} ELSE cast({d.common('wa', 'wb')} AS DOUBLE) / ({d.size('wa')} + {d.size('wb')} - {d.common('wa', 'wb')}) END AS consistency
FROM (SELECT p.doc_id, length({X.strip(d, t)}) AS chars, length({X.strip(d, 'p.text')}) AS fast_chars, {coher} AS coherence, {marks} AS marks, {comp} AS completeness,
 {bag(t)} AS wa, {bag('p.text')} AS wb FROM {{page}} AS p JOIN {{ext_page}} AS e ON p.doc_id = e.doc_id) AS a) AS b"""


@query
def rtl_flags(d):
    return f"SELECT doc_id, {X.rtl_dominant(d, 'text')} AS rtl, round({X.arabic_ratio(d, 'text')}, 9) AS arabic_ratio, {d.has('text', X.ARABIC)} AS has_arabic FROM {{arabic_mix}}"


@relation
def arabic_mix(d):
    return "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('ٱلسَّلامُ  عَلَيْكُم أهلاً ـ مستشفى ', text) WHEN doc_id % 4 = 1 THEN 'مرحبا بالعالم أإآ' ELSE text END AS text FROM {page}"


@query
def normalize_arabic(d):
    return f"SELECT doc_id, {X.normalize_arabic(d, 'text')} AS text FROM {{arabic_mix}}"


@query
def clean_text(d):
    return f"SELECT doc_id, {X.clean_text(d, 'text')} AS text FROM {{dirty}}"


@relation
def dirty(d):
    nl = d.char(10)
    return f"""SELECT doc_id, concat('## Head **bold** [link](http://x.y/z) [12] ', {nl}, {nl}, {nl}, {nl}, {nl}, 'hy-', {nl}, 'phen “quoted” – ● item', {nl}, '| a   b |', {nl}, 'x    y   ', {nl}, text) AS text FROM {{page}}
 UNION ALL SELECT doc_id + 1000000000, text FROM {{md_page}}"""
