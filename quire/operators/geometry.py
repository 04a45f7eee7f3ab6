"""Page geometry: overlaps, weak regions, columns, segments."""

from __future__ import annotations

from quire.functions.text import f
from quire.plans.registry import query, relation

_INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"


@query
def segment_merge(d):
    """Text boxes that lie in a table by more than half of their area go; tables, images and other text stay.
    The page is the equi-key of the overlap join, so it is no nested loop over the corpus."""
    inside = f"(SELECT DISTINCT a.page_id, a.box_id FROM {{box}} AS a JOIN {{box}} AS b ON a.page_id = b.page_id WHERE a.kind = 'text' AND b.kind = 'table' AND {_INTER} > {f(0.5)} * {_AREA})"
    kind = "CASE WHEN t.kind = 'text' AND t.y0 < 80 THEN 'header' WHEN t.kind = 'text' AND t.y1 > 720 THEN 'footer' ELSE t.kind END"
    return f"SELECT t.page_id, t.box_id, {kind} AS kind, cast(row_number() OVER (PARTITION BY t.page_id ORDER BY t.y0, t.x0, t.box_id) AS BIGINT) AS place FROM {{box}} AS t LEFT JOIN {inside} AS i ON t.page_id = i.page_id AND t.box_id = i.box_id WHERE i.box_id IS NULL"


@query
def segment_summary(d):
    return "SELECT page_id, count(*) FILTER (WHERE kind = 'text') AS texts, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE kind = 'image') AS images, count(DISTINCT kind) >= 3 OR (bool_or(kind = 'text') AND bool_or(kind IN ('table', 'image'))) AS mixed FROM {box} GROUP BY page_id"


@query
def weak_regions(d):
    """Images of at least 50 x 50 of which text boxes cover less than 0.15."""
    return f"""SELECT page_id, box_id, round(covered / area, 6) AS coverage FROM (SELECT a.page_id, a.box_id, max({_AREA}) AS area, sum(CASE WHEN b.box_id IS NULL THEN {f(0.0)} ELSE {_INTER} END) AS covered
FROM (SELECT * FROM {{box}} WHERE kind = 'image' AND x1 - x0 >= 50 AND y1 - y0 >= 50) AS a LEFT JOIN (SELECT * FROM {{box}} WHERE kind = 'text') AS b ON a.page_id = b.page_id GROUP BY a.page_id, a.box_id) AS r WHERE covered / area < {f(0.15)}"""


@relation
def box_cluster(d):
    """Clusters of left edges: a gap of more than 100 points begins the next."""
    return f"""SELECT page_id, box_id, x0, x1, y0, y1, cast(sum(brk) OVER (PARTITION BY page_id ORDER BY x0, box_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS col FROM (
SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0, box_id) > 100 THEN 1 ELSE 0 END AS brk FROM {{box}} WHERE kind <> 'image') AS g"""


@query
def column_clusters(d):
    """Columns with their edges: the right one is the next column's left one less 1, the last the page's width."""
    return f"SELECT page_id, col, n, x_min, coalesce(lead(x_min) OVER (PARTITION BY page_id ORDER BY col) - 1, {f(600.0)}) AS x_max FROM (SELECT page_id, col, count(*) AS n, min(x0) AS x_min FROM {{box_cluster}} GROUP BY page_id, col) AS c"


@query
def reading_order(d):
    """Boxes by column, then top to bottom, and the page's share of forward steps of the given order."""
    return f"""SELECT page_id, round(avg(CASE WHEN next_place IS NULL THEN NULL WHEN next_place > place THEN {f(1.0)} WHEN abs(next_x - x0) > 100 THEN {f(0.5)} ELSE {f(0.0)} END), 6) AS forward FROM (SELECT page_id, place, x0, lead(place) OVER (PARTITION BY page_id ORDER BY box_id) AS next_place, lead(x0) OVER (PARTITION BY page_id ORDER BY box_id) AS next_x
FROM (SELECT page_id, box_id, x0, row_number() OVER (PARTITION BY page_id ORDER BY col, y0, box_id) AS place FROM {{box_cluster}}) AS b) AS s GROUP BY page_id"""


@query
def font_census(d):
    """Body size of a page as the size that most characters have, and lines that stand out as headings."""
    span = "(SELECT page_id, box_id, (cast(x1 AS BIGINT) - cast(x0 AS BIGINT)) % 5 + 9 AS size, cast(y1 - y0 AS BIGINT) AS n FROM {box})"
    return f"""SELECT s.page_id, s.box_id, s.size, b.body, CASE WHEN s.size >= {f(1.2)} * b.body THEN 1 WHEN s.size >= {f(1.05)} * b.body THEN 2 ELSE 0 END AS level FROM {span} AS s JOIN (
SELECT page_id, size AS body FROM (SELECT page_id, size, row_number() OVER (PARTITION BY page_id ORDER BY sum(n) DESC, size) AS r FROM {span} AS t GROUP BY page_id, size) AS z WHERE r = 1) AS b ON s.page_id = b.page_id"""
