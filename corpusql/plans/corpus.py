"""Queries of extraction, reports and streams."""

from __future__ import annotations

from corpusql.operators import discovery, extraction, ingest, reports
from corpusql.plans.problems import _doi
from corpusql.plans.retrieval import _FIRST
from corpusql.session import table
from corpusql.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(name: str, sql: str | None, f, *tables: str) -> None:
    QUERIES[name] = lambda spark, d: f(*(table(spark, d, t) for t in tables))
    if sql:
        SQL[name] = sql


_T = r"t AS (SELECT doc_id, doc_kind, entry_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL)"
_L = _T + ", l AS (SELECT doc_id, doc_kind, entry_id, unnest(range(len(p)))::INT AS n, unnest(p) AS line FROM (SELECT *, string_split(text, chr(10)) AS p FROM t))"
_FRONT = lambda c: rf"trim(regexp_extract(regexp_extract(text, '(?s)^---\n(.*?)\n---', 1), '(?m)^{c}:[ \t]*([^\r\n]*)', 1), ' ')"

_q(
    "ext_front", rf"WITH {_T} SELECT doc_id, {_FRONT('title')} AS title, try_cast({_FRONT('year')} AS INT) AS year, {_FRONT('topic')} AS topic FROM t WHERE regexp_matches(text, '(?s)^---\n.*?\n---')",
    extraction.front_matter, "documents",
)
_q(
    "ext_metadata",
    rf"""WITH {_T}, b AS (SELECT *, regexp_extract(regexp_replace(text, '(?is)\n#{{0,3}} *(references|bibliography)\b.*$', ''), '10\.\d{{4,9}}/[^\s"<>]+', 0) AS raw FROM t)
    SELECT doc_id, coalesce(nullif({_FRONT("title")}, ''), regexp_extract(text, '(?m)^#+ +([^\n]+)', 1)) AS title, coalesce({_doi("raw")}, '') AS doi,
      coalesce(try_cast({_FRONT("year")} AS INT), try_cast(regexp_extract(text, '\(((?:19|20)\d\d)\)', 1) AS INT)) AS year FROM b""",
    extraction.metadata, "documents",
)
_HEAD = r"regexp_matches(line, '^#{1,6} +\S')"
_TITLE = r"trim(regexp_extract(line, '^#+ +(.*)$', 1), ' ')"
_q("ext_headings", rf"WITH {_L} SELECT doc_id, n, length(regexp_extract(line, '^(#+)', 1))::INT AS level, {_TITLE} AS title FROM l WHERE {_HEAD}", extraction.headings, "documents")
_q(
    "ext_sections",
    rf"""WITH {_L}, s AS (SELECT doc_id, line, coalesce(last_value(CASE WHEN {_HEAD} THEN {_TITLE} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS section FROM l)
    SELECT doc_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s GROUP BY ALL""",
    extraction.line_sections, "documents",
)
_q(
    "ext_equations",
    rf"""WITH {_T}, p AS (SELECT doc_id, string_split(text, '$$') AS p FROM t WHERE contains(text, '$$')), e AS (SELECT doc_id, p, unnest(range((len(p) - 1) // 2))::INT AS item FROM p)
    SELECT doc_id, item, trim(regexp_replace(p[item * 2 + 2], '\s+', ' ', 'g'), ' ') AS latex, regexp_extract(coalesce(p[item * 2 + 3], ''), '^\s{{0,20}}\(([0-9A-Z.]+)\)', 1) AS number,
      coalesce(regexp_extract_all(array_to_string(p[1:item * 2 + 1], '$$'), '(?m)^#{{1,6}} +([^\n]*)$', 1)[-1], '') AS section FROM e""",
    extraction.equations, "documents",
)
_q(
    "ext_contexts",
    rf"""WITH {_T}, p AS (SELECT doc_id, text, string_split(text, '$$') AS p FROM t WHERE contains(text, '$$')), e AS (SELECT doc_id, text, p, unnest(range((len(p) - 1) // 2))::INT AS item FROM p),
    a AS (SELECT *, length(array_to_string(p[1:item * 2 + 1], '$$')) AS k, trim(p[item * 2 + 2], ' ') AS x FROM e)
    SELECT doc_id, item, length(x) >= 2 AND NOT regexp_matches(x, '^\^?\{{?[\d,\s-]+\}}?$') AND regexp_matches(x, '[=\_^]') AS is_math,
      left(trim(regexp_replace(replace(substring(text, greatest(k - 60, 0) + 1, k + 60 - greatest(k - 60, 0)), '$', ''), '\s+', ' ', 'g'), ' '), 120) AS context FROM a""",
    extraction.equation_contexts, "documents",
)
_OPS = ", ".join(f"'{x}'" for x in extraction.LATEX_OPERATORS)
_q(
    "ext_symbols",
    rf"""WITH e AS (SELECT scan_id, unnest(equations).latex AS x FROM scanned_papers), s AS (SELECT scan_id, list_distinct(list_concat(
      list_filter(regexp_extract_all(x, '\\([a-zA-Z]+)', 1), lambda c: c NOT IN ({_OPS})),
      list_transform(regexp_extract_all(x, '[A-Za-z]_(?:\{{[A-Za-z0-9,]+\}}|[A-Za-z0-9])'), lambda c: translate(c, '{{}}', '')),
      list_filter(regexp_extract_all(regexp_replace(regexp_replace(x, '\\[a-zA-Z]+', ' ', 'g'), '[A-Za-z]_(\{{[^}}]*\}}|[A-Za-z0-9])|\{{[A-Za-z]{{2,}}\}}|[A-Za-z]{{2,}}', ' ', 'g'), '[A-Za-z]'), lambda c: c NOT IN ('d', 'e', 'i')))) AS s FROM e WHERE x IS NOT NULL)
    SELECT symbol, count(*) AS n_equations, count(DISTINCT scan_id) AS n_papers FROM (SELECT scan_id, unnest(s) AS symbol FROM s) GROUP BY symbol""",
    extraction.equation_symbols, "scanned_papers",
)
_q(
    "ext_counts",
    """SELECT scan_id, len(list_filter(coalesce(equations, []), lambda x: x.display))::INT AS n_display, len(list_filter(coalesce(equations, []), lambda x: NOT x.display))::INT AS n_inline,
    len(list_filter(coalesce(equations, []), lambda x: coalesce(x.number, '') <> ''))::INT AS n_numbered, len(coalesce(ext_tables, []))::INT AS n_tables,
    coalesce(list_sum(list_transform(ext_tables, lambda x: coalesce(len(x.rows), 0))), 0)::INT AS n_rows FROM scanned_papers""",
    extraction.equation_counts, "scanned_papers",
)
_q(
    "ext_rows",
    """WITH t AS (SELECT scan_id, unnest(range(len(ext_tables)))::INT AS item, unnest(ext_tables) AS t FROM scanned_papers), r AS (SELECT scan_id, item, len(t.headers) AS w, unnest(range(len(t.rows)))::INT AS row_no, unnest(t.rows) AS r FROM t)
    SELECT scan_id, item, row_no, array_to_string(list_transform(range(w), lambda i: coalesce(r[i + 1], '')), '|') AS cells, len(r) <> w AS was_ragged FROM r WHERE w > 0""",
    extraction.padded_rows, "scanned_papers",
)
_q(
    "ext_tables",
    rf"""WITH {_L}, b AS (SELECT doc_id, n, trim(line) AS line, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM l WHERE regexp_matches(line, '^\s*\|.*\|\s*$')),
    g AS (SELECT doc_id, min(n) AS first_line, arg_min(line, n) AS header, min(CASE WHEN regexp_matches(line, '^\|[ :|-]+\|$') THEN n END) AS rule_at, count(*) AS k FROM b GROUP BY doc_id, run)
    SELECT doc_id, first_line, header, k - 2 AS n_rows FROM g WHERE rule_at = first_line + 1""",
    extraction.markdown_tables, "documents",
)
_q(
    "ext_captions",
    rf"""WITH {_L}, a AS (SELECT *, last_value(nullif(trim(line, ' '), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l),
    b AS (SELECT doc_id, n, trim(line) AS line, above, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM a WHERE regexp_matches(line, '^\s*\|.*\|\s*$')),
    g AS (SELECT doc_id, min(n) AS first_line, arg_min(coalesce(above, ''), n) AS above, min(CASE WHEN regexp_matches(line, '^\|[ :|-]+\|$') THEN n END) AS rule_at FROM b GROUP BY doc_id, run)
    SELECT doc_id, first_line, CASE WHEN regexp_matches(above, '(?i)^(\*\*)?table\s+\d') THEN trim(trim(above, '*'), ' ') WHEN length(above) < 200 AND NOT starts_with(above, '|') THEN above ELSE '' END AS caption
    FROM g WHERE rule_at = first_line + 1""",
    extraction.table_captions, "documents",
)
_REFS = rf"""r AS (SELECT doc_id, n, line, regexp_replace(regexp_extract(line, '(?:^|[#!/%;]\s*)REF:\s*(?:doi:)?(\S+)', 1), '[\s.,;:!?)\]}}>''"’”]+$', '') AS identifier FROM l),
    a AS (SELECT doc_id, n, identifier, CASE WHEN identifier LIKE '10.%' THEN 'doi' ELSE 'paper_id' END AS kind, trim(regexp_extract(line, 'REF:\s*\S+\s+(.*)$', 1), ' ') AS location FROM r WHERE identifier <> '')"""
_q("ext_refs", f"WITH {_L}, {_REFS} SELECT * FROM a", extraction.annotations, "documents")
_q("ext_ref_summary", f"WITH {_L}, {_REFS} SELECT kind, count(*) AS n_refs, count(DISTINCT doc_id) AS n_docs, count(DISTINCT identifier) AS n_identifiers FROM a GROUP BY kind", extraction.annotation_summary, "documents")
_ISDOI = r"regexp_matches(identifier, '(^|[/:\s])10\.[0-9]+/')"
for _n, _t in (("kb_resolved", "kb_refs"), ("code_resolved", "code_refs")):
    _q(
        _n,
        rf"""WITH r AS (SELECT DISTINCT ref_id, CASE WHEN {_ISDOI} THEN {_doi("identifier")} ELSE regexp_replace(regexp_replace(lower(identifier), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}.,;:!?)\]}}>''"’”]+$', '') END AS identifier, {_ISDOI} AS d FROM {_t} WHERE identifier IS NOT NULL),
        e AS (SELECT {_doi("doi")} AS k, true AS d, min(id) AS id FROM entries WHERE {_doi("doi")} IS NOT NULL GROUP BY 1 UNION ALL SELECT lower(id), false, id FROM entries)
        SELECT ref_id, identifier, e.id IS NOT NULL AS found, e.id AS entry_id FROM r LEFT JOIN e ON e.k = r.identifier AND e.d = r.d WHERE identifier <> ''""",
        extraction.resolved_refs, _t, "entries",
    )
_DEF = r"^\s*(?:pure |elemental |public |static )*(def|class|subroutine|function|void|double)\s+([A-Za-z_]\w*)"
_SIG = rf"s AS (SELECT doc_id, n, regexp_extract(line, '{_DEF}', 1) AS kind, regexp_extract(line, '{_DEF}', 2) AS name FROM l WHERE doc_kind = 'source_file' AND regexp_matches(line, '{_DEF}'))"
_q("code_signatures", f"WITH {_L}, {_SIG} SELECT * FROM s", extraction.code_signatures, "documents")
_q(
    "code_profile",
    rf"""WITH {_L} SELECT entry_id, count(DISTINCT doc_id) AS n_files, count(*) AS n_lines, count(*) FILTER (trim(line, ' ') = '') AS n_blank, count(*) FILTER (regexp_matches(line, '^\s*(#|!|//|%)')) AS n_comments,
    count(*) FILTER (regexp_matches(line, '^\s*(def|class|subroutine|function|void|double)\s+[A-Za-z_]')) AS n_definitions, count(*) FILTER (regexp_matches(line, 'REF:\s*\S')) AS n_refs
    FROM l WHERE doc_kind = 'source_file' AND entry_id IS NOT NULL GROUP BY entry_id""",
    extraction.codebase_profile, "documents",
)
_q(
    "code_concepts",
    rf"""WITH {_L}, {_SIG}, c AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')), '_')) AS concept FROM s)
    SELECT concept, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c WHERE length(concept) > 2 GROUP BY concept ORDER BY n DESC, concept LIMIT 50""",
    extraction.concepts, "documents",
)
# Patterns of pitfalls and their warnings.
PITFALLS = {r"max\([a-z_]+ - \d+e-3, 0\.0\)": "loss is clipped at zero", r"if \(?dt > \d+\)?": "time step is guarded", r"implicit none": "implicit typing is off", r"\bk=0\.\d+": "default coefficient"}
_q(
    "code_pitfalls",
    "SELECT doc_id, warning, n::INT AS n FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{w}' AS warning, len(regexp_extract_all(text, '(?i){p}')) AS n FROM documents WHERE doc_kind = 'source_file' AND text IS NOT NULL" for p, w in PITFALLS.items())
    + ") WHERE n > 0",
    lambda d: extraction.pitfalls(d, PITFALLS), "documents",
)
_API = rf"""p AS (SELECT doc_id, regexp_extract(text, '(?m)^# API: *(\S+)', 1) AS package, regexp_extract_all(text, '(?m)^### `([^`]+)`', 1) AS s FROM t WHERE doc_kind = 'api'),
    x AS (SELECT doc_id, package, unnest(range(len(s))) AS n, unnest(s) AS sig FROM p WHERE package <> ''),
    f AS (SELECT doc_id, package, regexp_extract(sig, '^([A-Za-z_][\w.]*)\(', 1) AS name, arg_min(regexp_replace(regexp_replace(regexp_extract(sig, '\(([^)]*)\)', 1), '\s*[:=][^,]*', '', 'g'), '\s*,\s*', ',', 'g'), n) AS params FROM x
      WHERE regexp_extract(sig, '^([A-Za-z_][\w.]*)\(', 1) <> '' GROUP BY ALL)"""
_q("api_functions", f"WITH {_T}, {_API} SELECT * FROM f", extraction.api_functions, "documents")
_q(
    "api_diff",
    f"""WITH {_T}, {_API}, g AS (SELECT package, min(doc_id) AS o, max(doc_id) AS w FROM f GROUP BY package HAVING min(doc_id) < max(doc_id)),
    a AS (SELECT f.* FROM f JOIN g ON g.package = f.package AND g.o = f.doc_id), b AS (SELECT f.* FROM f JOIN g ON g.package = f.package AND g.w = f.doc_id)
    SELECT package, name, CASE WHEN a.params IS NULL THEN 'added' WHEN b.params IS NULL THEN 'removed' WHEN a.params <> b.params THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (package, name)""",
    extraction.api_diff, "documents",
)
_q("cite_claims", None, extraction.claims, "documents")
_q(
    "cite_citations",
    r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+ \((?:19|20)\d\d\)')) AS c FROM documents WHERE text IS NOT NULL)
    SELECT split_part(c, ' ', 1) AS name, regexp_extract(c, '(\d{4})', 1)::INT AS year, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM c GROUP BY 1, 2""",
    extraction.citations, "documents",
)

_q(
    "rpt_topics",
    f"""WITH m AS (SELECT {_doi("doi")} AS doi, {_FIRST("abstract")}, {_FIRST("year")} FROM discovery_results WHERE {_doi("doi")} IS NOT NULL GROUP BY 1),
    p AS (SELECT coalesce(topic, '') AS topic, {_doi("doi")} AS doi FROM entries WHERE type = 'paper')
    SELECT topic, count(*) AS n, count(*) FILTER (p.doi IS NULL) AS n_missing_doi, count(*) FILTER (abstract IS NULL) AS n_missing_abstract,
      min(year) FILTER (year BETWEEN 1800 AND 2030) AS first_year, max(year) FILTER (year BETWEEN 1800 AND 2030) AS last_year FROM p LEFT JOIN m ON m.doi = p.doi GROUP BY topic""",
    lambda e, d: reports.topic_report(e, discovery.merged(d)), "entries", "discovery_results",
)
_q(
    "rpt_taxonomy", "SELECT tag, count(*) AS n, count(DISTINCT topic) AS n_topics FROM (SELECT coalesce(topic, '') AS topic, unnest(list_distinct(tags)) AS tag FROM entries) GROUP BY tag ORDER BY n DESC, tag LIMIT 30",
    reports.taxonomy, "entries",
)
_q(
    "rpt_inventory",
    """SELECT coalesce(kind, '(all)') AS kind, coalesce(lang, '(all)') AS lang, count(*) AS n, count(*) FILTER (size = 0) AS n_empty, sum(size)::BIGINT AS chars, max(size)::INT AS longest
    FROM (SELECT doc_kind AS kind, coalesce(lang, 'unknown') AS lang, length(coalesce(text, '')) AS size FROM documents) GROUP BY ROLLUP (kind, lang)""",
    reports.inventory, "documents",
)
_q(
    "pack_context",
    """WITH r AS (SELECT id, coalesce(topic, '') AS topic, length(coalesce(title, '')) + 1 AS size, row_number() OVER (PARTITION BY coalesce(topic, '') ORDER BY coalesce(added, '') DESC, id) AS rank FROM entries WHERE type = 'paper'),
    u AS (SELECT *, sum(size) OVER (PARTITION BY topic ORDER BY rank) AS used FROM r) SELECT topic, rank, id, used::BIGINT AS used FROM u WHERE used <= 2000""",
    reports.context_pack, "entries",
)
_q(
    "expl_lookup",
    """WITH q AS (SELECT lower(query_text) AS query_text, count(*) AS n FROM search_results WHERE query_text IS NOT NULL GROUP BY 1), g AS (SELECT DISTINCT unnest(tags) AS tag FROM entries),
    w AS (SELECT query_text, n, unnest(list_concat([query_text], string_split(query_text, ' '))) AS w FROM q), d AS (SELECT query_text, n, tag, levenshtein(w, tag) AS d, w FROM w JOIN g ON left(w, 1) = left(tag, 1)),
    k AS (SELECT query_text, n, tag, CASE WHEN d = 0 AND w = query_text THEN 0 WHEN d = 0 THEN 1 ELSE 1 + d END AS rank FROM d WHERE d <= 2)
    SELECT query_text, n, tag, ['equal', 'word', 'slip', 'slip'][rank + 1] AS how FROM (SELECT query_text, n, min(struct_pack(rank := rank, tag := tag)) AS b FROM k GROUP BY ALL) t, LATERAL (SELECT b.rank AS rank, b.tag AS tag)""",
    reports.lookup, "search_results", "entries",
)

_SLUG = lambda c: f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), '')"
_q(
    "ing_outcomes",
    rf"""WITH {_T}, b AS (SELECT doc_id, coalesce(nullif({_FRONT("title")}, ''), regexp_extract(text, '(?m)^#+ +([^\n]+)', 1)) AS title,
      regexp_extract(regexp_replace(text, '(?is)\n#{{0,3}} *(references|bibliography)\b.*$', ''), '10\.\d{{4,9}}/[^\s"<>]+', 0) AS raw FROM t WHERE regexp_matches(text, '(?s)^---\n.*?\n---')),
    m AS (SELECT doc_id, {_SLUG("title")} AS slug, {_doi("raw")} AS doi FROM b),
    r AS (SELECT doc_id, CASE WHEN slug IS NULL THEN 'no_title' WHEN doi IN (SELECT {_doi("doi")} FROM entries WHERE {_doi("doi")} IS NOT NULL) THEN 'doi_known'
      WHEN slug IN (SELECT {_SLUG("title")} FROM entries WHERE {_SLUG("title")} IS NOT NULL) THEN 'title_known' WHEN doc_id > min(doc_id) OVER (PARTITION BY slug) THEN 'repeated' ELSE '' END AS reason FROM m)
    SELECT doc_id, CASE reason WHEN '' THEN 'ingested' WHEN 'no_title' THEN 'failed' ELSE 'skipped' END AS outcome, reason FROM r""",
    ingest.outcomes, "documents", "entries",
)
QUERIES["ing_ids"] = lambda spark, d: ingest.new_ids(discovery.merged(table(spark, d, "discovery_results")))
_q(
    "cite_evidence", None, lambda d, e: ingest.evidence(extraction.claims(d), e), "documents", "entries"
)
_q(
    "eq_coverage",
    rf"""WITH v AS (SELECT DISTINCT lower(replace(v, '_', '')) AS v FROM (SELECT unnest(regexp_extract_all(text, '(?m)^\s*([A-Za-z_]\w*) = ', 1)) AS v FROM documents WHERE doc_kind = 'source_file' AND text IS NOT NULL)),
    e AS (SELECT x, count(DISTINCT scan_id) AS n_papers FROM (SELECT scan_id, unnest(equations).latex AS x FROM scanned_papers) WHERE x IS NOT NULL GROUP BY x), s AS (SELECT x, n_papers, unnest(list_distinct(list_concat(
      list_filter(regexp_extract_all(x, '\\([a-zA-Z]+)', 1), lambda c: c NOT IN ({_OPS})),
      list_transform(regexp_extract_all(x, '[A-Za-z]_(?:\{{[A-Za-z0-9,]+\}}|[A-Za-z0-9])'), lambda c: translate(c, '{{}}', '')),
      list_filter(regexp_extract_all(regexp_replace(regexp_replace(x, '\\[a-zA-Z]+', ' ', 'g'), '[A-Za-z]_(\{{[^}}]*\}}|[A-Za-z0-9])|\{{[A-Za-z]{{2,}}\}}|[A-Za-z]{{2,}}', ' ', 'g'), '[A-Za-z]'), lambda c: c NOT IN ('d', 'e', 'i'))))) AS s FROM e),
    c AS (SELECT x AS latex, n_papers, count(*) AS n_symbols, count(v.v) AS n_matched FROM s LEFT JOIN v ON v.v = lower(replace(s, '_', '')) GROUP BY x, n_papers)
    SELECT *, round(n_matched / n_symbols, 6) AS coverage, CASE WHEN round(n_matched / n_symbols, 6) >= 0.8 THEN 'good' WHEN round(n_matched / n_symbols, 6) >= 0.4 THEN 'partial' ELSE 'poor' END AS verdict FROM c""",
    ingest.equation_coverage, "scanned_papers", "documents",
)
_q(
    "ev_properties", "SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS n_with_k, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1",
    ingest.event_properties, "events",
)

# --- streams --------------------------------------------------------------------------------------------------------

QUERIES["stream_windows"] = logs.event_windows
SQL["stream_windows"] = """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
QUERIES["stream_sessions"] = logs.session_log
SQL["stream_sessions"] = """SELECT nullif(regexp_replace(regexp_replace(session_id, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', ''), '') AS session_id, count(DISTINCT rowid) AS n
    FROM session_entries s WHERE nullif(regexp_replace(regexp_replace(session_id, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', ''), '') IN (SELECT id FROM sessions WHERE NOT closed) GROUP BY 1"""
