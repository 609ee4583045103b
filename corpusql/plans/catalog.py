"""Queries over the catalogue, its audit, the recovery queue, sessions and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators import audit, catalog, recovery, sessions, sharing
from corpusql.plans.problems import _ADDED, _doi, _key, _sess
from corpusql.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(name: str, sql: str | None, *tables: str):
    """Registers a query that takes the named tables, with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, d: f(*(table(spark, d, t) for t in tables))
        if sql:
            SQL[name] = sql
        return f

    return register


_q("cat_show", "SELECT id, type, title, topic, coalesce(doi, '') AS doi FROM entries WHERE type = 'paper' AND topic = 'hydrology'", "entries")(
    lambda e: catalog.show(e, "paper", "hydrology")
)
_q(
    "cat_stats",
    """SELECT 'all' AS kind, '' AS name, count(*) AS n FROM entries UNION ALL SELECT 'type', type, count(*) FROM entries GROUP BY type
    UNION ALL SELECT 'topic', topic, count(*) FROM entries WHERE coalesce(topic, '') <> '' GROUP BY topic
    UNION ALL SELECT 'paper_topic', coalesce(topic, ''), count(*) FROM entries WHERE type = 'paper' GROUP BY ALL""",
    "entries",
)(catalog.stats)
_q(
    "cat_bibtex",
    r"""SELECT id, '@article{' || id || ', title = {' || regexp_replace(coalesce(title, ''), '([{}])', '\\\1', 'g') || '}, year = {' ||
    regexp_extract(coalesce(added, ''), '^(\d{4})', 1) || '}, doi = {' || trim(doi, ' ') || '}}' AS entry FROM entries WHERE type = 'paper' AND coalesce(trim(doi, ' '), '') <> ''""",
    "entries",
)(catalog.bibtex)
_q(
    "cat_page",
    """SELECT type, coalesce(topic, '') AS topic, count(*) AS n, max(coalesce(added, '')) AS newest,
    string_agg('- ' || coalesce(title, ''), chr(10) ORDER BY coalesce(added, '') DESC, id) AS lines FROM entries GROUP BY type, coalesce(topic, '')""",
    "entries",
)(catalog.rendered)


@_q(
    "cat_upsert",
    """SELECT e.id, CASE WHEN r.paper_id IS NULL THEN e.topic ELSE 'recovered' END AS topic FROM entries e LEFT JOIN (SELECT DISTINCT paper_id FROM recovery_state) r ON r.paper_id = e.id
    UNION ALL SELECT DISTINCT paper_id, 'recovered' FROM recovery_state WHERE paper_id NOT IN (SELECT id FROM entries)""",
    "entries", "recovery_state",
)
def _upsert(entries: DataFrame, state: DataFrame) -> DataFrame:
    back = state.select(F.col("paper_id").alias("id"), F.lit("recovered").alias("topic")).filter("id IS NOT NULL").distinct()
    return catalog.upsert(entries.select("id", "topic"), back)


_q("cat_delete", "SELECT id, title FROM entries WHERE id NOT IN (SELECT paper_id FROM recovery_state WHERE paper_id IS NOT NULL)", "entries", "recovery_state")(
    lambda e, r: catalog.without(e.select("id", "title"), r.select("paper_id").filter("paper_id IS NOT NULL"))
)


@_q(
    "cat_reingest",
    """SELECT d.entry_id AS id, coalesce(e.added, strftime(min(d.added_at), '%Y-%m-%d')) AS added,
    CASE WHEN e.added IS NOT NULL THEN strftime(max(d.added_at), '%Y-%m-%d') END AS updated
    FROM documents d LEFT JOIN entries e ON e.id = d.entry_id WHERE d.entry_id IS NOT NULL GROUP BY d.entry_id, e.added""",
    "documents", "entries",
)
def _reingest(documents: DataFrame, entries: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    seen = documents.filter("entry_id IS NOT NULL").groupBy(F.col("entry_id").alias("id")).agg(day(F.min("added_at")).alias("added"), day(F.max("added_at")).alias("updated"))
    return catalog.carried_over(seen, entries)


# --- audit -----------------------------------------------------------------------------------------------------------

_EMPTY = lambda c: f"coalesce(trim({c}, ' '), '') = ''"
_META = f"""SELECT id, severity, code, detail FROM (
  SELECT id, 'error' AS severity, 'invalid_type' AS code, coalesce(type, '') AS detail, coalesce(type, '') NOT IN ('paper', 'package', 'codebase') AS hit FROM entries
  UNION ALL SELECT id, 'error', 'missing_id', '', {_EMPTY("id")} FROM entries UNION ALL SELECT id, 'error', 'missing_title', '', {_EMPTY("title")} FROM entries
  UNION ALL SELECT id, 'warning', 'missing_topic', '', type = 'paper' AND {_EMPTY("topic")} FROM entries
  UNION ALL SELECT id, 'error', 'invalid_doi', doi, type = 'paper' AND NOT {_EMPTY("doi")} AND NOT regexp_matches(doi, '^10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+$') FROM entries
  UNION ALL SELECT id, 'info', 'missing_doi', '', type = 'paper' AND {_EMPTY("doi")} FROM entries
  UNION ALL SELECT id, 'error', 'invalid_added', added, NOT {_EMPTY("added")} AND ({_ADDED}) IS NULL FROM entries
  UNION ALL SELECT id, 'info', 'missing_added', '', {_EMPTY("added")} FROM entries
  UNION ALL SELECT id, 'warning', 'no_files', '', coalesce(len(files), 0) = 0 FROM entries) WHERE hit"""
_INTEGRITY = f"""{_META}
  UNION ALL SELECT min(id), 'error', 'duplicate_id', k || ' x ' || count(*) FROM (SELECT id, {_sess("id")} AS k FROM entries) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT min(id), 'error', 'duplicate_doi', k || ' x ' || count(*) FROM (SELECT id, {_doi("doi")} AS k FROM entries) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT id, 'info', 'missing_file', '' FROM entries WHERE type = 'paper' AND id NOT IN (SELECT entry_id FROM documents WHERE entry_id IS NOT NULL)
  UNION ALL SELECT DISTINCT entry_id, 'warning', 'unindexed_file', '' FROM documents WHERE entry_id IS NOT NULL AND entry_id NOT IN (SELECT id FROM entries)"""
_RANK = "CASE lower(trim(confidence, ' ')) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_DISTINCT = f"""SELECT path, field, coalesce({_sess('proposed_value')}, '') AS value, max({_RANK}) AS confidence,
  arg_max(action_id, struct_pack(a := {_RANK}, b := proposed_at, c := action_id)) AS action_id FROM repair_actions GROUP BY ALL"""
_PLAN = f"""SELECT path, field, value, rivals FROM (SELECT *, count(*) OVER (PARTITION BY path, field) AS rivals,
    count(*) OVER (PARTITION BY path, field, confidence) AS same, max(confidence) OVER (PARTITION BY path, field) AS top,
    lag(confidence, 1, 0) OVER (PARTITION BY path, field ORDER BY confidence) AS below
  FROM ({_DISTINCT}) WHERE value <> '') WHERE confidence = top AND same = 1 AND confidence - below >= 1"""

_q("aud_metadata", _META, "entries")(audit.metadata_findings)
_q("aud_integrity", _INTEGRITY, "entries", "documents")(audit.integrity)
_q("aud_severe", f"SELECT * FROM ({_INTEGRITY}) WHERE severity IN ('error', 'warning')", "entries", "documents")(lambda e, d: audit.at_least(audit.integrity(e, d), "warning"))
_q(
    "aud_counts",
    f"""SELECT coalesce(code, '') AS code, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
    count(*) FILTER (severity = 'info') AS infos, count(*) AS total FROM ({_INTEGRITY}) GROUP BY ROLLUP (code)""",
    "entries", "documents",
)(lambda e, d: audit.severity_counts(audit.integrity(e, d)))
_q(
    "aud_fresh",
    f"""WITH t AS (SELECT id, coalesce(nullif(trim(updated, ' '), ''), nullif(trim(added, ' '), '')) AS added FROM entries), u AS (SELECT id, added, {_ADDED} AS day FROM t)
    SELECT id, strftime(day, '%Y-%m-%d') AS checked, CASE WHEN added IS NULL THEN 'never' WHEN day IS NULL THEN 'bad_date'
      WHEN day < DATE '2025-01-01' - 90 THEN 'stale' ELSE 'fresh' END AS state FROM u""",
    "entries",
)(lambda e: audit.freshness(e, "2025-01-01", 90))
_q("aud_actions", _DISTINCT, "repair_actions")(audit.distinct_actions)
_q(
    "aud_confidence", f"SELECT {_RANK} AS confidence, field, count(*) AS n FROM repair_actions GROUP BY ALL", "repair_actions"
)(lambda r: r.groupBy(audit.confidence_rank(F.col("confidence")).alias("confidence"), "field").agg(F.count("*").alias("n")))
_q("aud_plan", _PLAN, "repair_actions")(audit.planned_repairs)
_q(
    "aud_apply",
    f"""WITH p AS ({_PLAN}), w AS (SELECT path, max(value) FILTER (field = 'title') AS t, max(value) FILTER (field = 'doi') AS d FROM p WHERE field IN ('title', 'doi') GROUP BY path)
    SELECT id, e.path, coalesce(t, title) AS new_title, coalesce(d, doi) AS new_doi,
      coalesce(t, title) IS DISTINCT FROM title OR coalesce(d, doi) IS DISTINCT FROM doi AS changed FROM entries e LEFT JOIN w ON w.path = e.path""",
    "entries", "repair_actions",
)(lambda e, r: audit.apply_repairs(e, audit.planned_repairs(r)))

_GAP = lambda c: f"len(list_filter(coalesce({c}, []), lambda x: {_EMPTY('x')})) > 0"
_q(
    "aud_results",
    f"""SELECT arrival, severity, code, detail FROM (SELECT arrival, 'error' AS severity, 'missing_title' AS code, '' AS detail, {_EMPTY("title")} AS hit FROM discovery_results
    UNION ALL SELECT arrival, 'error', 'invalid_doi', doi, NOT {_EMPTY("doi")} AND NOT regexp_matches(doi, '^10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+$') FROM discovery_results
    UNION ALL SELECT arrival, 'error', 'invalid_year', year::VARCHAR, year NOT BETWEEN 1900 AND 2100 FROM discovery_results
    UNION ALL SELECT arrival, 'info', 'missing_year', '', year IS NULL FROM discovery_results
    UNION ALL SELECT arrival, 'error', 'invalid_cites', '', {_GAP("cites")} FROM discovery_results
    UNION ALL SELECT arrival, 'error', 'invalid_cited_by', '', {_GAP("cited_by")} FROM discovery_results) WHERE hit""",
    "discovery_results",
)(audit.result_findings)

# --- recovery --------------------------------------------------------------------------------------------------------------

_REASON = "coalesce(nullif(trim(split_part(reason, ':', 1), ' '), ''), 'unknown')"
_SLUG = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_q(
    "rec_buckets",
    f"SELECT coalesce(bucket, '') AS bucket, coalesce(reason, '') AS reason, count(*) AS n, min(queue_pos) AS first_pos FROM (SELECT bucket, {_REASON} AS reason, queue_pos FROM recovery_state) GROUP BY ROLLUP (bucket, reason)",
    "recovery_state",
)(recovery.buckets)
_q(
    "rec_requeue",
    f"""WITH p AS (SELECT * FROM recovery_state WHERE bucket = 'pending') SELECT queue_pos, title, topic, path, 1 AS turn FROM p
    UNION ALL SELECT queue_pos, title, topic, path, 0 FROM recovery_state r WHERE bucket IN ('failed', 'skipped') AND {_REASON} IN ('ingest_failed', 'unknown')
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.title = r.title AND p.topic = r.topic AND p.path = r.path)""",
    "recovery_state",
)(lambda r: recovery.requeue(r, ["ingest_failed", "unknown"]))
_q(
    "rec_next",
    f"""SELECT queue_pos, CASE WHEN bucket = 'restored' THEN 'done' WHEN {_key("paper_id")} IN (SELECT {_key("id")} FROM entries) THEN 'already_there'
      WHEN {_doi("doi")} IN (SELECT {_doi("doi")} FROM entries WHERE {_doi("doi")} IS NOT NULL) THEN 'same_doi' WHEN nullif({_SLUG("title")}, '') IN (SELECT {_SLUG("title")} FROM entries WHERE title IS NOT NULL) THEN 'same_title'
      WHEN {_doi("doi")} IS NULL THEN 'search_by_title' WHEN bucket = 'failed' AND {_REASON} = 'ingest_failed' THEN 'retry' ELSE 'fetch' END AS step FROM recovery_state""",
    "recovery_state", "entries",
)(recovery.next_step)

# --- sessions ------------------------------------------------------------------------------------------------------------------

_LOG = f"(SELECT DISTINCT ON (rowid) * REPLACE ({_sess('session_id')} AS session_id) FROM session_entries ORDER BY rowid)"
_q(
    "sess_list",
    f"""SELECT s.id, any_value(name) AS name, any_value(closed) AS closed, count(l.rowid) AS n_entries, strftime(max(logged_at), '%Y-%m-%d %H:%M:%S') AS last_at
    FROM sessions s LEFT JOIN {_LOG} l ON l.session_id = s.id GROUP BY s.id""",
    "sessions", "session_entries",
)(sessions.listing)
_q("sess_tagged", f"SELECT rowid, session_id, agent, content FROM {_LOG} WHERE list_contains(tags, 'calibration')", "session_entries")(lambda e: sessions.tagged(e, "calibration"))
_q("sess_tags", f"SELECT tag, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM (SELECT session_id, unnest(tags) AS tag FROM {_LOG}) GROUP BY tag", "session_entries")(sessions.tag_counts)
_q(
    "sess_agents",
    f"SELECT coalesce(agent, 'unknown') AS agent, strftime(logged_at, '%Y-%m') AS month, count(*) AS n, count(DISTINCT session_id) AS n_sessions, sum(length(coalesce(content, '')))::BIGINT AS chars FROM {_LOG} GROUP BY ALL",
    "session_entries",
)(sessions.agents)
_q(
    "sess_rejected",
    f"""SELECT rowid, reason FROM (SELECT rowid, CASE WHEN l.session_id IS NULL THEN 'no_session' WHEN s.id IS NULL THEN 'unknown_session' WHEN s.closed THEN 'closed_session'
      WHEN logged_at < timezone('UTC', CAST(created AS TIMESTAMPTZ)) THEN 'before_creation' END AS reason FROM {_LOG} l LEFT JOIN sessions s ON s.id = l.session_id) WHERE reason IS NOT NULL""",
    "sessions", "session_entries",
)(sessions.rejected)

_q(
    "sess_state",
    f"""WITH l AS (SELECT {_sess("session_id")} AS id, max(logged_at) AS last FROM session_entries GROUP BY 1), k AS (SELECT * FROM l WHERE id IS NOT NULL)
    SELECT coalesce(s.id, k.id) AS id, coalesce(s.closed, false) OR coalesce(k.last < TIMESTAMP '2024-06-01 00:00:00', false) AS closed, s.id IS NULL AS is_new FROM sessions s FULL JOIN k ON k.id = s.id""",
    "sessions", "session_entries",
)(lambda s, e: sessions.opened_and_closed(s, e, "2024-06-01 00:00:00"))

# --- archives --------------------------------------------------------------------------------------------------------------------

_q(
    "shar_export",
    """SELECT type, count(*) AS n, sum(coalesce(len(files), 0))::BIGINT AS n_files, sum(coalesce(t.texts, 0))::BIGINT AS n_texts, sum(coalesce(t.chars, 0))::BIGINT AS n_chars
    FROM entries e LEFT JOIN (SELECT entry_id, count(*) AS texts, sum(coalesce(n_chars, 0)) AS chars FROM documents WHERE entry_id IS NOT NULL GROUP BY entry_id) t ON t.entry_id = e.id GROUP BY type""",
    "entries", "documents",
)(sharing.export_summary)
_q(
    "shar_import",
    f"""WITH r AS (SELECT arrival, {_doi("doi")} AS doi, lower(trim(title, ' ')) AS title FROM discovery_results WHERE coalesce(trim(title, ' '), '') <> ''),
    n AS (SELECT * FROM r WHERE (doi IS NULL OR doi NOT IN (SELECT {_doi("doi")} FROM entries WHERE {_doi("doi")} IS NOT NULL)) AND title NOT IN (SELECT lower(trim(title, ' ')) FROM entries WHERE title IS NOT NULL)),
    f AS (SELECT * FROM n WHERE doi IS NULL UNION ALL SELECT * FROM n WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY arrival) = 1)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY title ORDER BY arrival) = 1""",
    "discovery_results", "entries",
)(sharing.imported)
