"""Section and page chunks, page ranges, tokens, overlap, retrieval chunks."""

from __future__ import annotations

from quire.functions import text as X
from quire.plans.registry import query, relation, spark_query


def tokens(d, s: str) -> str:
    return f"cast(greatest(1, {d.idiv(f'length({X.strip(d, s)})', '4')}) AS BIGINT)"


@relation
def chat_line(d):
    return f"SELECT doc_id, page_num, pos, line, {d.has('line', r'^#{1,6}\s+\S')} AS head FROM {d.explode('{chat}', 'doc_id, page_num', X.lines(d, 'text'), 'line', 'pos')} AS e"


@relation
def section(d):
    """Lines numbered by the heading above them; what stands before the first heading is in no section. Page rows are
    kept through, so a section's page range needs no offsets."""
    body = d.listagg("line", d.char(10), "page_num, pos")
    return f"""SELECT doc_id, sec - 1 AS chunk_index, min(page_num) + 1 AS page_start, max(page_num) + 1 AS page_end, max(CASE WHEN head THEN {X.strip(d, d.sub('line', r'^#{1,6}\s+'))} END) AS title, {X.strip(d, body)} AS text FROM (
SELECT doc_id, page_num, pos, line, head, cast(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_num, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sec FROM {{chat_line}}) AS l WHERE sec > 0 GROUP BY doc_id, sec"""


@query
def chunk_sections(d):
    return f"SELECT doc_id, chunk_index, title, page_start, page_end, {tokens(d, 'text')} AS tokens, md5(text) AS text_md5 FROM {{section}} WHERE text <> ''"


@query
def chunk_pages(d):
    """The fallback for documents without headings: a chunk for each page that isn't blank."""
    return f"SELECT doc_id, page_num, concat('Page ', cast(page_num + 1 AS VARCHAR(20))) AS title, {tokens(d, 'text')} AS tokens FROM (SELECT conv_id AS doc_id, turn AS page_num, text FROM conversations WHERE NOT {d.has('text', r'(?m)^#{1,6}\s+\S')}) AS c WHERE {d.has('text', r'\S')}"


@relation
def page_offset(d):
    return "SELECT doc_id, page_num, cast(coalesce(sum(length(text) + 7) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, length(text) AS n FROM {chat}"


@query
def chunk_page_range(d):
    """Offsets of joined pages (separator of seven characters) to page numbers: a range join within the document."""
    at = d.idiv("p.total * q.part", "4")
    return f"""SELECT p.doc_id, q.part, coalesce(min(o.page_num) FILTER (WHERE {at} >= o.a AND {at} <= o.a + o.n), max(o.page_num)) + 1 AS page
FROM (SELECT doc_id, max(a + n) AS total FROM {{page_offset}} GROUP BY doc_id) AS p CROSS JOIN {d.values([(0,), (1,), (2,), (3,), (4,)], ['part'])} AS q JOIN {{page_offset}} AS o ON p.doc_id = o.doc_id GROUP BY p.doc_id, q.part"""


@query
def chunk_overlap(d):
    """The last 20 words of the chunk before go ahead of a chunk, if that one has more."""
    words = d.filter(d.split_re(X.strip(d, "prev"), d.ws + "+"), "x <> ''")
    n = d.size(words)
    tail = d.join(d.slice(words, f"{n} - 19", n), "' '")
    return f"""SELECT doc_id, chunk_index, {tokens(d, 'full_text')} AS tokens, md5(full_text) AS text_md5 FROM (SELECT doc_id, chunk_index, CASE WHEN prev IS NOT NULL AND {n} > 20 THEN concat('...', {tail}, {d.char(10)}, {d.char(10)}, text) ELSE text END AS full_text
FROM (SELECT doc_id, chunk_index, text, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev FROM {{section}}) AS l) AS f"""


def split_oversize(sections, max_tokens: int = 120):
    """Greedy packing of sentences into chunks of at most ``max_tokens``, a left fold inside the row: no Python, no
    shuffle. A sentence longer than the bound is a chunk by itself."""
    return sections.selectExpr(
        "doc_id",
        "chunk_index",
        "title",
        "page_start",
        "page_end",
        f"""posexplode(aggregate(filter(split(text, r'(?<=[.!?])\\s+|\\n\\n+'), x -> x <> ''),
 named_struct('o', cast(array() AS array<string>), 'c', ''),
 (a, s) -> if(a.c = '', named_struct('o', a.o, 'c', s), if(greatest(1, (length(a.c) + 1 + length(s)) div 4) <= {max_tokens},
  named_struct('o', a.o, 'c', concat(a.c, ' ', s)), named_struct('o', array_append(a.o, a.c), 'c', s))),
 a -> if(a.c = '', a.o, array_append(a.o, a.c)))) AS (part, text)""",
    )


@spark_query
def chunk_rag(spark, sf_dir):
    from quire.plans.registry import run_sql

    parts = split_oversize(run_sql("SELECT * FROM {section}", spark, sf_dir))
    return parts.selectExpr("doc_id", "chunk_index", "part", "title", "page_start", "page_end", "greatest(1, length(text) div 4) AS tokens", "text")
