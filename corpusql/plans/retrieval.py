"""Queries of search, tagging, the citation graph and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi
from corpusql.operators import discovery, graph, search, tagging
from corpusql.plans.problems import _doi
from corpusql.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Groups of words with one meaning.
ALIASES = {"snow melt": ["glacier ablation", "frost depth"], "recharge": ["groundwater recharge", "surface infiltration"], "et": ["evapotranspiration", "root uptake"]}


def _q(name: str, sql: str | None, f, *tables: str) -> None:
    QUERIES[name] = lambda spark, d: f(*(table(spark, d, t) for t in tables))
    if sql:
        SQL[name] = sql


_TERMS = search.expand("snow melt", ALIASES)
_PAT = search.pattern(_TERMS)
_FRONT = lambda c: rf"trim(regexp_extract(regexp_extract(coalesce(text, ''), '(?s)^---\r?\n(.*?)\n---', 1), '(?m)^{c}:[ \t]*([^\r\n]*)', 1), ' ')"


def _keyword_sql(where: str = "true") -> str:
    return rf"""WITH t AS (SELECT doc_id, text, lower(text) AS low, len(regexp_extract_all(lower(text), '{_PAT}')) AS n FROM documents WHERE text IS NOT NULL AND {where})
    SELECT doc_id, round(n / greatest(length(text) / 1024.0, 0.1), 6) AS score,
      trim(regexp_replace(substring(text, greatest(strpos(low, regexp_extract(low, '{_PAT}')) - 100, 1), 220), '\s+', ' ', 'g'), ' ') AS snippet
    FROM t WHERE n > 0 ORDER BY score DESC, doc_id LIMIT 50"""


_q("srch_keyword", _keyword_sql(), lambda d: search.keyword(d, _TERMS), "documents")
_q(
    "srch_scope", _keyword_sql(f"doc_kind IN ('section', 'note') AND coalesce(try_cast({_FRONT('year')} AS INT) >= 2010, true)"),
    lambda d: search.keyword(d, _TERMS, year_from=2010, kinds=["section", "note"]), "documents",
)
_BM = ["groundwater", "recharge", "aquifer"]
_q(
    "srch_bm25",
    "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}') AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(w) AS len, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_BM))
    + " FROM d), s AS (SELECT count(*) AS n, avg(len) AS mean, "
    + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))
    + " FROM e) SELECT doc_id, round("
    + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))" for i in range(3))
    + ", 6) AS score FROM e, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0 ORDER BY score DESC, doc_id LIMIT 20",
    lambda d: search.bm25(d, _BM), "documents",
)
_TOP = "(SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, result_id) AS rank FROM search_results)"
_q(
    "srch_enriched",
    f"""SELECT query_text, rank, r.path, coalesce(e.id, '') AS id, coalesce(e.topic, '') AS topic, coalesce(e.doi, '') AS doi FROM {_TOP} r
    LEFT JOIN (SELECT path, min(struct_pack(id := id, topic := coalesce(topic, ''), doi := coalesce(doi, ''))) AS e FROM entries GROUP BY path) ON path = r.path WHERE rank <= 20""".replace(
        "ON path = r.path", "x ON x.path = r.path"
    ),
    search.enriched, "search_results", "entries",
)
_q(
    "srch_fused",
    r"""WITH b AS (SELECT query_text, result_id, score, len(list_filter(regexp_split_to_array(lower(coalesce(snippet, '')), '[^\p{L}]+'), lambda w: list_contains(string_split(lower(query_text), ' '), w))) AS hits FROM search_results),
    s AS (SELECT query_text, result_id, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, result_id) AS r FROM b),
    h AS (SELECT query_text, result_id, row_number() OVER (PARTITION BY query_text ORDER BY hits DESC, result_id) AS r FROM b WHERE hits > 0)
    SELECT query_text, result_id, round(sum(1.0 / (60 + r)), 9)::DOUBLE AS fused FROM (SELECT * FROM s WHERE r <= 100 UNION ALL SELECT * FROM h WHERE r <= 100) GROUP BY ALL""",
    search.fused, "search_results",
)
_q(
    "srch_budget",
    f"""SELECT query_text, rank, result_id, used::BIGINT AS used FROM (SELECT *, sum(greatest(length(coalesce(snippet, '')), 1)) OVER (PARTITION BY query_text ORDER BY rank) AS used FROM {_TOP}) WHERE used <= 2000""",
    lambda r: search.within_budget(r, 500), "search_results",
)
_q(
    "srch_detail", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 800 THEN left(text, 800) || chr(10) || '[cut]' ELSE coalesce(text, '') END AS text FROM documents",
    lambda d: search.detail(d, 200), "documents",
)
_q(
    "vec_nearest",
    """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query, u.vec_id, round(list_cosine_similarity(u.v, q.v), 6) AS cosine FROM u, u q WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id)
    SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) <= 10""",
    search.nearest, "embeddings",
)
_STOP = ", ".join(f"'{w}'" for w in sorted(set(tagging.STOP_WORDS)))
_q(
    "tag_tfidf",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}')) AS tag FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
    tf AS (SELECT doc_id, tag, count(*) AS tf FROM w WHERE tag NOT IN ({_STOP}) GROUP BY ALL), m AS (SELECT doc_id, max(tf) AS most FROM tf GROUP BY doc_id), df AS (SELECT tag, count(*) AS df FROM tf GROUP BY tag)
    SELECT doc_id, tag, score FROM (SELECT tf.doc_id, tf.tag, round((0.5 + 0.5 * tf / most) * ln(n / (1 + df)), 6) AS score FROM tf JOIN m USING (doc_id) JOIN df USING (tag), n WHERE df <= 0.8 * n)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) <= 8""",
    tagging.tfidf, "documents",
)
_q(
    "xref_links",
    """WITH s AS (SELECT id, list_sort(list_distinct(list_concat(coalesce(tags, []), CASE WHEN coalesce(topic, '') <> '' THEN [topic] ELSE [] END))) AS s FROM entries),
    c AS (SELECT s, min(id) AS class_id, count(*) AS n FROM s WHERE len(s) > 0 GROUP BY s),
    p AS (SELECT a.class_id, sum(b.n) AS n FROM c a JOIN c b ON a.s <> b.s AND len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.5 GROUP BY a.class_id)
    SELECT id, coalesce(c.class_id, id) AS class_id, coalesce(c.n - 1 + coalesce(p.n, 0), 0)::BIGINT AS n_links FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN p ON p.class_id = c.class_id""",
    tagging.tag_links, "entries",
)

_EDGES = f"""e AS (SELECT DISTINCT src, dst FROM (SELECT {_doi("doi")} AS src, {_doi("x")} AS dst FROM (SELECT doi, unnest(cites) AS x FROM discovery_results)
    UNION ALL SELECT {_doi("x")}, {_doi("doi")} FROM (SELECT doi, unnest(cited_by) AS x FROM discovery_results)) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"""
_HAVE = f"(SELECT {_doi('doi')} FROM entries WHERE {_doi('doi')} IS NOT NULL)"
_q("grph_edges", f"WITH {_EDGES} SELECT * FROM e", graph.edges, "discovery_results")
_q(
    "grph_degrees", f"WITH {_EDGES} SELECT doi, sum(o)::BIGINT AS n_cites, sum(i)::BIGINT AS n_cited_by FROM (SELECT src AS doi, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY doi",
    lambda d: graph.degrees(graph.edges(d)), "discovery_results",
)
_q(
    "grph_related",
    f"WITH {_EDGES}, i AS (SELECT * FROM e WHERE src IN {_HAVE} AND dst IN {_HAVE}) SELECT src AS doi, 'cites' AS direction, dst AS other FROM i UNION ALL SELECT dst, 'cited_by', src FROM i",
    lambda d, e: graph.related(graph.edges(d), e), "discovery_results", "entries",
)
_q(
    "grph_crawl",
    f"""WITH {_EDGES}, s AS (SELECT DISTINCT {_doi("doi")} AS doi FROM discovery_results WHERE arrival % 100 = 0 AND {_doi("doi")} IS NOT NULL), a AS (SELECT dst AS doi FROM e WHERE src IN (SELECT doi FROM s)), b AS (SELECT dst AS doi FROM e WHERE src IN (SELECT doi FROM a))
    SELECT doi, min(level)::INT AS level FROM (SELECT doi, 0 AS level FROM s UNION ALL SELECT doi, 1 FROM a UNION ALL SELECT doi, 2 FROM b) GROUP BY doi""",
    lambda d: graph.crawl(graph.edges(d), d.filter("arrival % 100 = 0").select(bare_doi("doi").alias("doi"))), "discovery_results",
)
_q(
    "grph_backfill", f"WITH {_EDGES} SELECT id, {_doi('doi')} AS doi FROM entries WHERE type = 'paper' AND {_doi('doi')} IS NOT NULL AND {_doi('doi')} NOT IN (SELECT src FROM e UNION ALL SELECT dst FROM e)",
    lambda e, d: graph.to_backfill(e, graph.edges(d)), "entries", "discovery_results",
)

_FIRST = lambda c: f"arg_min({c}, arrival) FILTER ({c} IS NOT NULL AND trim({c}::VARCHAR, ' ') <> '') AS {c}"
_q(
    "disc_merged",
    f"SELECT {_doi('doi')} AS doi, count(*) AS n, min(arrival) AS first_arrival, {', '.join(_FIRST(c) for c in ('title', 'abstract', 'pdf_url', 'venue', 'year'))}, max(citation_count) AS citations FROM discovery_results WHERE {_doi('doi')} IS NOT NULL GROUP BY 1",
    discovery.merged, "discovery_results",
)
_DOMAIN = r"lower(regexp_extract(coalesce(pdf_url, ''), '^https?://(?:www\.)?([^/:]+)', 1))"
_SCORE = rf"""CASE WHEN {_doi("doi")} IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(trim(pdf_url, ' '), '') <> '' THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(lower(title), '{discovery.ACADEMIC}') THEN 2 ELSE 0 END + CASE WHEN is_open_access THEN 1 ELSE 0 END - CASE WHEN {_DOMAIN} LIKE 'preprints.%' THEN 3 ELSE 0 END"""
_q("disc_quality", f"SELECT arrival, {_SCORE} AS score FROM discovery_results", discovery.quality, "discovery_results")
_q(
    "disc_best", f"SELECT arrival, {_SCORE} AS score FROM discovery_results ORDER BY score DESC, arrival LIMIT 100",
    lambda d: discovery.quality(d).orderBy(F.desc("score"), "arrival").limit(100), "discovery_results",
)
_q("disc_domains", f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM discovery_results WHERE {_DOMAIN} <> '' GROUP BY 1", discovery.domains, "discovery_results")
_q(
    "disc_pdf",
    f"""WITH r AS (SELECT arrival, {_doi("doi")} AS doi, nullif(trim(pdf_url, ' '), '') AS own FROM discovery_results), k AS (SELECT doi, arg_min(own, arrival) AS k FROM r WHERE doi IS NOT NULL AND own IS NOT NULL GROUP BY doi)
    SELECT arrival, coalesce(own, k) AS pdf_url, own IS NULL AND k IS NOT NULL AS was_filled FROM r LEFT JOIN k USING (doi)""",
    discovery.filled_pdf, "discovery_results",
)
_q(
    "disc_open",
    f"""WITH r AS (SELECT lower(trim(source, ' ')) AS source, {_doi("doi")} AS doi, is_open_access FROM discovery_results WHERE {_doi("doi")} IS NOT NULL), e AS (SELECT DISTINCT source, doi, doi IN (SELECT doi FROM r WHERE is_open_access) AS o FROM r)
    SELECT source, count(*) AS n_dois, count(*) FILTER (o) AS n_open, count(*) FILTER (NOT o) AS n_closed FROM e GROUP BY source""",
    discovery.open_access, "discovery_results",
)
_q(
    "disc_rounds",
    f"""WITH f AS (SELECT {_doi("doi")} AS doi, min(batch_no) AS batch_no FROM discovery_results WHERE {_doi("doi")} IS NOT NULL GROUP BY 1), n AS (SELECT batch_no, count(*) AS n_new FROM f GROUP BY 1)
    SELECT batch_no, n_new, sum(n_new) OVER (ORDER BY batch_no)::BIGINT AS n_all, sum(n_new) OVER (ORDER BY batch_no) - n_new < 300 AS needed FROM n""",
    lambda d: discovery.rounds(d, 300), "discovery_results",
)
