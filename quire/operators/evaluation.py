"""Benchmark metrics, summaries, calibration, model ranking."""

from __future__ import annotations

from quire.functions import text as X
from quire.functions.text import f
from quire.plans.registry import query, relation


def norm(d, s: str) -> str:
    """Lower case, single blanks, accents folded: engines count the edits of composed letters differently."""
    return d.sub(X.translate(f"lower({d.sub(X.strip(d, s), d.ws + '+', ' ')})", X._ACCENTS, X._PLAIN), r"[^\x20-\x7E]")


@relation
def pair_text(d):
    """Edit distance, unless the normalised truth is over 5000 characters, as in the reference; bag overlap then."""

    def side(col: str, no: int) -> str:
        long_ = f"(SELECT doc_id, {d.all(norm(d, col), r'[\p{L}\p{N}_]+')} AS ws FROM {{md_pair}} WHERE length({norm(d, 'truth')}) > 5000) AS p"
        return f"SELECT doc_id, w, {no} AS side FROM {d.explode(long_, 'doc_id', 'ws', 'w')} AS e"

    return f"""SELECT doc_id, CASE WHEN g = t THEN {f(1.0)} ELSE 1 - cast(levenshtein(g, t) AS DOUBLE) / greatest(length(g), length(t)) END AS accuracy
FROM (SELECT doc_id, {norm(d, 'got')} AS g, {norm(d, 'truth')} AS t FROM {{md_pair}}) AS n WHERE length(t) <= 5000
UNION ALL SELECT doc_id, cast(sum(least(a, b)) AS DOUBLE) / sum(greatest(a, b)) FROM (SELECT doc_id, w, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS b FROM ({side('got', 1)} UNION ALL {side('truth', 2)}) AS u GROUP BY doc_id, w) AS c GROUP BY doc_id"""


@query
def text_accuracy(d):
    return "SELECT doc_id, round(accuracy, 6) AS text_accuracy FROM {pair_text}"


def content_words(d, s: str) -> str:
    return d.distinct(d.filter(d.all(f"lower({s})", r"[\p{L}\p{N}_]+"), "length(x) > 3 AND x NOT IN ('table', 'cell', 'row', 'column', 'heading', 'list', 'paragraph')"))


def rate(d, a: str, b: str) -> str:
    return f"CASE WHEN {d.size(a)} = 0 THEN {f(0.0)} ELSE cast({d.size(a)} - {d.common(a, b)} AS DOUBLE) / {d.size(a)} END"


@relation
def pair_halluc(d):
    return f"SELECT doc_id, {rate(d, 'a', 'b')} AS rate FROM (SELECT doc_id, {content_words(d, 'got')} AS a, {content_words(d, 'truth')} AS b FROM {{md_pair}}) AS p"


@query
def hallucination_rate(d):
    return "SELECT doc_id, round(rate, 6) AS hallucination_rate FROM {pair_halluc}"


EXTRACTOR = "CASE {} % 3 WHEN 0 THEN 'pymupdf' WHEN 1 THEN 'docling' ELSE 'llm' END"


def weighed(c: str = "c.", a: str = "a.", s: str = "s.", h: str = "h.", p: str = "p.") -> tuple[str, str]:
    """F1 of the cells, and the whole score; the arguments are what stands before the columns' names."""
    f1 = f"CASE WHEN {c}n_got + {c}n_truth > 0 THEN 2 * cast({c}n_both AS DOUBLE) / ({c}n_got + {c}n_truth) ELSE {f(1.0)} END"
    whole = f"CASE WHEN {p}page_type = 'tables' THEN {f(0.3)} * {a}accuracy + {f(0.2)} * {s}structure + {f(0.3)} * {f1} + {f(0.2)} * (1 - {h}rate) ELSE {f(0.4)} * {a}accuracy + {f(0.3)} * {s}structure + {f(0.3)} * (1 - {h}rate) END"
    return f1, whole


@relation
def bench(d):
    f1, overall = weighed()
    return f"""SELECT p.doc_id, p.page_type, {EXTRACTOR.format('p.doc_id')} AS extractor, a.accuracy, s.structure, CASE WHEN p.page_type = 'tables' THEN {f1} ELSE {f(0.0)} END AS f1, h.rate, {overall} AS overall
FROM {{md_pair}} AS p JOIN {{pair_text}} AS a ON p.doc_id = a.doc_id JOIN {{pair_structure}} AS s ON p.doc_id = s.doc_id JOIN {{pair_halluc}} AS h ON p.doc_id = h.doc_id LEFT JOIN {{pair_cells}} AS c ON p.doc_id = c.doc_id"""


@query
def bench_overall(d):
    return "SELECT doc_id, page_type, extractor, round(overall, 5) AS overall FROM {bench}"


@query
def bench_summary(d):
    """Means by type and extractor, with totals by type and over all."""
    return "SELECT coalesce(page_type, '*') AS page_type, coalesce(extractor, '*') AS extractor, count(*) AS n, round(avg(overall), 5) AS overall, round(avg(accuracy), 5) AS text_accuracy, round(avg(f1), 5) AS table_f1 FROM {bench} GROUP BY ROLLUP (page_type, extractor)"


@relation
def labelled(d):
    return f"SELECT s.doc_id, l.quality = 1 AS good, s.score AS confidence, p.lang AS category, s.chars FROM labels AS l JOIN {{scored}} AS s ON l.doc_id = s.doc_id JOIN {{page}} AS p ON l.doc_id = p.doc_id"


@relation
def sweep(d):
    """Confusion counts at fixed thresholds and at every confidence seen; scores are first counted by value, so the
    cross join is between distinct values."""
    fixed = d.values([(i / 20,) for i in range(21)], ["t"])
    n = lambda c, k: f"cast(coalesce(sum({k}) FILTER (WHERE {c}), 0) AS BIGINT)"
    return f"""SELECT t, {n('c >= t', 'g')} AS tp, {n('c >= t', 'b')} AS fp, {n('c < t', 'b')} AS tn, {n('c < t', 'g')} AS fn FROM
(SELECT round(confidence, 6) AS c, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM {{labelled}} GROUP BY round(confidence, 6)) AS v
CROSS JOIN (SELECT t FROM {fixed} AS x UNION SELECT DISTINCT round(confidence, 6) FROM {{labelled}}) AS ts GROUP BY t"""


@relation
def sweep_rates(d):
    p, r = X.ratio("tp", "(tp + fp)"), X.ratio("tp", "(tp + fn)")
    return f"SELECT t, tp, fp, tn, fn, {p} AS p, {r} AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * cast(tp AS DOUBLE) / (2 * tp + fp + fn) ELSE {f(0.0)} END AS f1, cast(tp + tn AS DOUBLE) / greatest(1, tp + fp + tn + fn) AS accuracy FROM {{sweep}}"


@query
def calibration_sweep(d):
    return "SELECT t AS threshold, tp, fp, tn, fn, round(p, 6) AS precision_, round(r, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM {sweep_rates}"


@query
def calibration_pick(d):
    """The lowest threshold that reaches each target precision; without one, that of the best F1."""
    targets = d.values([(0.8,), (0.9,), (0.95,), (0.99,)], ["target"])
    return f"""SELECT target, coalesce(min(t) FILTER (WHERE p >= target AND tp + fp > 0), min(t) FILTER (WHERE best = 1)) AS threshold, bool_or(p >= target AND tp + fp > 0) AS reached
FROM {targets} AS g CROSS JOIN (SELECT *, row_number() OVER (ORDER BY f1 DESC, t) AS best FROM {{sweep_rates}}) AS s GROUP BY target"""


@query
def calibration_by_category(d):
    return "SELECT category, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE chars > 50) AS recovered FROM {labelled} GROUP BY category"


@query
def ab_value_rank(d):
    """Models by value: quality over cost, winner among those of at least 0.60, else the best quality."""
    prices = d.values([("pymupdf", 0.0), ("docling", 0.002), ("llm", 0.01)], ["model", "cost"])
    return f"""SELECT model, n, quality, value, CASE WHEN row_number() OVER (ORDER BY CASE WHEN quality >= {f(0.6)} THEN 0 ELSE 1 END, CASE WHEN quality >= {f(0.6)} THEN value ELSE quality END DESC, model) = 1 THEN 1 ELSE 0 END AS winner
FROM (SELECT m.model, count(*) AS n, round(avg({f(0.5)} * accuracy + {f(0.2)} * structure + {f(0.3)} * (1 - rate)), 6) AS quality, round(avg({f(0.5)} * accuracy + {f(0.2)} * structure + {f(0.3)} * (1 - rate)) / (1 + max(m.cost) / {f(0.01)}), 6) AS value
FROM {{bench}} AS b JOIN {prices} AS m ON b.extractor = m.model GROUP BY m.model) AS q"""
