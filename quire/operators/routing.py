"""Routing by type and strategy, costs, agentic passes, telemetry rankings, cache eviction, event stream."""

from __future__ import annotations

from quire.functions.text import f
from quire.plans.registry import query, relation

_SHORT = {"pm": "pymupdf", "odl": "opendataloader", "dl": "docling", "mk": "marker", "mo": "mistral_ocr", "ro": "rapidocr", "llm": "llm"}
#: page type -> chains of the strategies economy, balanced, premium, cheapest first
CHAINS = {
    "arabic": ("pm", "llm pm", "llm pm"),
    "digital": ("pm", "odl mk pm", "mk odl pm"),
    "scanned": ("mo ro pm", "mo ro llm pm", "llm mo ro pm"),
    "tables": ("dl mo odl pm", "dl mo mk odl llm pm", "llm dl mo mk odl pm"),
    "mixed": ("odl pm", "mk odl pm", "llm mk odl pm"),
    "graphical": ("mo ro pm", "mo ro llm pm", "llm mo ro pm"),
    "handwritten": ("ro mo pm", "llm ro mo pm", "llm ro mo pm"),
    "forms": ("odl dl mo pm", "odl dl mo llm pm", "llm dl mo odl pm"),
    "academic": ("mk odl pm", "mk odl llm pm", "mk llm odl pm"),
    "default": ("pm", "odl pm", "llm odl pm"),
}
COST = dict.fromkeys(("docling", "marker", "opendataloader", "pymupdf", "rapidocr", "surya"), 0.0) | {"llm": 0.01, "mistral_ocr": 0.002}
#: extractor -> estimated quality by page type; 0.5 where none is given
QUALITY = {
    "docling": {"mixed": 0.8, "tables": 0.92, "digital": 0.9},
    "llm": {"academic": 0.85, "forms": 0.85, "handwritten": 0.8, "graphical": 0.82, "mixed": 0.85, "tables": 0.85, "scanned": 0.88, "digital": 0.9},
    "marker": {"forms": 0.78, "academic": 0.95, "mixed": 0.88, "tables": 0.86, "digital": 0.93},
    "mistral_ocr": {"forms": 0.86, "handwritten": 0.7, "graphical": 0.8, "mixed": 0.85, "tables": 0.94, "scanned": 0.92, "digital": 0.88},
    "opendataloader": {"academic": 0.85, "graphical": 0.3, "mixed": 0.85, "tables": 0.85, "scanned": 0.4, "digital": 0.97},
    "pymupdf": {"graphical": 0.15, "mixed": 0.7, "tables": 0.6, "scanned": 0.1, "digital": 0.95},
    "rapidocr": {"mixed": 0.6, "graphical": 0.65, "scanned": 0.75},
}
#: model -> (price in, price out per million tokens, tokens in a page besides the prompt, tokens out)
MODELS = {
    "gemini-flash": (0.15, 0.60, 260, 500),
    "gemini-pro": (1.25, 10.0, 260, 500),
    "claude-sonnet": (3.0, 15.0, 1600, 500),
    "claude-haiku": (1.0, 5.0, 1600, 500),
    "gpt-4o": (2.5, 10.0, 765, 500),
    "gpt-4o-mini": (0.15, 0.60, 765, 500),
    "local": (0.0, 0.0, 800, 500),
}


@relation
def chain(d):
    rows = [
        (kind, strategy, rank, _SHORT[x])
        for kind, chains in CHAINS.items()
        for strategy, c in zip(("economy", "balanced", "premium"), chains, strict=True)
        for rank, x in enumerate(c.split())
    ]
    return f"SELECT * FROM {d.values(rows, ['page_type', 'strategy', 'rank', 'extractor'])} AS v"


@relation
def cost(d):
    return f"SELECT * FROM {d.values(sorted(COST.items()), ['extractor', 'cost'])} AS v"


@relation
def quality_estimate(d):
    rows = [(e, t, q) for e, by in QUALITY.items() for t, q in by.items()]
    return f"SELECT * FROM {d.values(rows, ['extractor', 'page_type', 'quality'])} AS v"


@relation
def request(d):
    """Pages with their type, strategy and remaining budget. Docling and marker aren't installed here."""
    kind = "CASE WHEN p.arabic THEN 'arabic' WHEN p.class = 'scanned' THEN 'scanned' WHEN s.numeric_lines >= 3 THEN 'tables' WHEN p.graphical THEN 'graphical' WHEN c.kind = 'mixed' THEN 'mixed' ELSE 'digital' END"
    return f"""SELECT p.file_id, p.doc_id, {kind} AS page_type, CASE p.doc_id % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'balanced' ELSE 'premium' END AS wanted,
 CASE WHEN p.doc_id % 10 = 0 THEN {f(0.0)} WHEN p.doc_id % 10 < 4 THEN {f(0.005)} ELSE {f(1.0)} END AS budget FROM {{page_class}} AS p JOIN {{doc_class}} AS c ON p.file_id = c.file_id JOIN {{signal}} AS s ON p.doc_id = s.doc_id"""


@relation
def routed(d):
    """The chain of each page after availability and budget, renumbered; pymupdf where nothing is left."""
    strategy = "CASE WHEN budget <= 0 THEN 'economy' ELSE wanted END"
    return f"""SELECT r.doc_id, r.file_id, r.page_type, r.strategy, coalesce(c.extractor, 'pymupdf') AS extractor, row_number() OVER (PARTITION BY r.doc_id ORDER BY c.rank) AS place, coalesce(k.cost, 0) AS cost, coalesce(q.quality, {f(0.5)}) AS quality
FROM (SELECT *, {strategy} AS strategy FROM {{request}}) AS r LEFT JOIN {{chain}} AS c ON r.page_type = c.page_type AND r.strategy = c.strategy AND c.extractor NOT IN ('docling', 'marker') AND NOT (c.extractor = 'llm' AND r.budget < {f(0.01)})
LEFT JOIN {{cost}} AS k ON k.extractor = coalesce(c.extractor, 'pymupdf') LEFT JOIN {{quality_estimate}} AS q ON q.extractor = coalesce(c.extractor, 'pymupdf') AND q.page_type = r.page_type"""


@query
def route_select(d):
    return "SELECT doc_id, page_type, strategy, extractor, cost, quality FROM {routed} WHERE place = 1"


@query
def route_fallback(d):
    """Where the first choice is expected below 0.70, the second of the chain, if there is one."""
    return f"SELECT a.doc_id, CASE WHEN a.quality < {f(0.7)} THEN coalesce(b.extractor, a.extractor) ELSE a.extractor END AS extractor FROM {{routed}} AS a LEFT JOIN {{routed}} AS b ON a.doc_id = b.doc_id AND b.place = 2 WHERE a.place = 1"


@query
def route_cost(d):
    return "SELECT file_id, round(sum(cost), 6) AS cost_usd, count(*) AS pages, count(*) FILTER (WHERE extractor = 'llm') AS llm_pages FROM {routed} WHERE place = 1 GROUP BY file_id"


@query
def route_weighted(d):
    """Ranking by the strategies' weights for quality, cost and speed, among chains' members above their floor."""
    w = d.values([("economy", 0.2, 0.6, 0.6), ("balanced", 0.4, 0.3, 0.7), ("premium", 0.7, 0.1, 0.0)], ["strategy", "wq", "wc", "floor_"])
    return f"""SELECT page_type, strategy, extractor, score FROM (SELECT c.page_type, c.strategy, c.extractor, round(w.wq * q.quality + w.wc * (1 - k.cost / {f(0.01)}), 6) AS score,
 row_number() OVER (PARTITION BY c.page_type, c.strategy ORDER BY round(w.wq * q.quality + w.wc * (1 - k.cost / {f(0.01)}), 6) DESC, c.rank) AS r FROM {{chain}} AS c JOIN {w} AS w ON c.strategy = w.strategy
 JOIN {{cost}} AS k ON c.extractor = k.extractor JOIN {{quality_estimate}} AS q ON c.extractor = q.extractor AND c.page_type = q.page_type WHERE q.quality >= w.floor_) AS z WHERE r = 1"""


@query
def estimate_cost_matrix(d):
    """Each document's price with each model: its pages without text layer, times the tokens of a page."""
    m = d.values([(k, *v[:2], v[2], v[3]) for k, v in sorted(MODELS.items())], ["model", "price_in", "price_out", "tokens_in", "tokens_out"])
    return f"SELECT p.file_id, m.model, p.llm_pages, round(p.llm_pages * ((m.tokens_in + 300) * m.price_in + m.tokens_out * m.price_out) / {f(1e6)}, 8) AS cost_usd FROM (SELECT file_id, count(*) FILTER (WHERE class = 'scanned' OR graphical) AS llm_pages FROM {{page_class}} GROUP BY file_id) AS p CROSS JOIN {m} AS m"


@query
def agentic_improve(d):
    """Up to three passes over low pages (below 0.70, not empty, not OCR): the first strictly better reading within the
    document's budget for model calls is kept. A page's passes are ranks, so no loop runs."""
    got = f"least({f(1.0)}, t.score + k.gain)"
    k = d.values([(1, "opendataloader", 0.0, 0.05), (2, "rapidocr", -0.1, 0.0), (3, "llm", 0.2, 0.01)], ["pass", "extractor", "gain", "cost"])
    return f"""SELECT doc_id, pass, extractor, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass) AS r FROM (
SELECT t.doc_id, k.pass, k.extractor, round({got}, 6) AS confidence, sum(k.cost) OVER (PARTITION BY t.file_id, k.pass ORDER BY t.page_num ROWS UNBOUNDED PRECEDING) AS spent, {got} > t.score AND (k.pass <> 1 OR t.doc_id % 2 = 0) AS better
FROM {{scored}} AS t CROSS JOIN {k} AS k WHERE t.score < {f(0.7)} AND t.chars > 5 AND NOT t.ocr_applied) AS a WHERE better AND spent <= {f(0.5)}) AS z WHERE r = 1"""


@query
def reranker(d):
    """Extractors by type: mean of cost-effective confidence, decayed by half in 14 days, from 50 events on."""
    age = f"({d.epoch('n.now')} - {d.epoch('t.ts')}) / {f(86400.0)}"
    eff = f"CASE WHEN t.cost_usd = 0 THEN t.confidence ELSE least({f(1.0)}, t.confidence / (t.cost_usd * 100 + {f(0.01)})) END"
    return f"""SELECT page_type, extractor, n, score, cast(row_number() OVER (PARTITION BY page_type ORDER BY score DESC, extractor) AS BIGINT) AS place FROM (
SELECT t.page_type, t.extractor, count(*) AS n, round(avg({eff} * exp({f(-0.693)} * {age} / 14)), 6) AS score FROM {{telemetry}} AS t CROSS JOIN (SELECT max(ts) AS now, count(*) AS total FROM {{telemetry}}) AS n WHERE n.total >= 50 GROUP BY t.page_type, t.extractor) AS g"""


@query
def telemetry_windows(d):
    """The batch twin of the streaming aggregate: events by hour, type and extractor."""
    hour = "date_trunc('hour', ts)"
    return f"SELECT {hour} AS hour, page_type, extractor, count(*) AS n, count(*) FILTER (WHERE confidence >= {f(0.7)}) AS ok, round(avg(confidence), 6) AS confidence, round(sum(cost_usd), 6) AS cost_usd FROM {{telemetry}} GROUP BY {hour}, page_type, extractor"


@relation
def cache_entry(d):
    key = f"{d.sha256('text')}"
    return f"SELECT doc_id, concat_ws('|', {key}, CASE doc_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' ELSE 'high' END, 'markdown', '', 'default') AS key, cast(length(text) AS BIGINT) AS size_bytes, doc_id % 45 AS age_days, doc_id AS last_used, doc_id % 5 AS hits FROM {{page}}"


@query
def cache_lookup(d):
    """Requests against the cache: hit within 30 days, else stale or miss."""
    return "SELECT p.doc_id, CASE WHEN c.key IS NULL THEN 'miss' WHEN c.age_days > 30 THEN 'stale' ELSE 'hit' END AS state, coalesce(c.hits, 0) + CASE WHEN c.age_days <= 30 THEN 1 ELSE 0 END AS hits FROM {page} AS p LEFT JOIN (SELECT * FROM {cache_entry} WHERE doc_id % 2 = 0) AS c ON p.doc_id = c.doc_id"


@query
def cache_lru(d):
    """What stays within the size limit of each shard, newest first; the newest always stays."""
    return "SELECT doc_id, key, size_bytes, kept_bytes FROM (SELECT doc_id, key, size_bytes, cast(sum(size_bytes) OVER w AS BIGINT) AS kept_bytes, row_number() OVER w AS r FROM (SELECT *, substring(key, 1, 2) AS shard FROM {cache_entry} WHERE age_days <= 30) AS e WINDOW w AS (PARTITION BY shard ORDER BY last_used DESC ROWS UNBOUNDED PRECEDING)) AS k WHERE kept_bytes <= 12000 OR r = 1"


@query
def cache_stats(d):
    return "SELECT count(*) AS entries, cast(sum(size_bytes) AS BIGINT) AS bytes, cast(sum(hits) AS BIGINT) AS hits FROM {cache_entry}"


@query
def stream_events(d):
    """One classified event a document, one page event a page (good ones first), warnings, one complete event."""
    cols = "file_id, kind, grp, page_num, detail"
    return f"""SELECT file_id, cast(row_number() OVER (PARTITION BY file_id ORDER BY grp, page_num) - 1 AS BIGINT) AS seq, kind, detail FROM (
SELECT file_id, 'classified' AS kind, 0 AS grp, -1 AS page_num, concat(kind, ' ', cast(pages AS VARCHAR(20))) AS detail FROM {{doc_class}}
UNION ALL SELECT file_id, 'page', CASE quality WHEN 'good' THEN 1 ELSE 3 END, page_num, concat(cast(page_num + 1 AS VARCHAR(20)), ' ', quality) FROM {{graded}}
UNION ALL SELECT file_id, 'warning', 2, -1, concat(cast(count(*) AS VARCHAR(20)), ' weak pages') FROM {{graded}} WHERE quality <> 'good' GROUP BY file_id
UNION ALL SELECT file_id, 'complete', 4, -1, cast(pages AS VARCHAR(20)) FROM {{doc_class}}) AS u"""
