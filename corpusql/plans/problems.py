"""Queries of the general training-data operators (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusql.operators.orphans import (
    find_orphans,
    knowledge_base_deleted,
    knowledge_base_parents,
    knowledge_base_refs,
    orphan_report,
)
from corpusql.session import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = lambda n: table(spark, d, n)
    refs = knowledge_base_refs(t("kb_refs"), t("code_refs"), t("discovery_results"), t("session_entries"))
    parents = knowledge_base_parents(t("entries"), t("discovery_results"), t("sessions"))
    return refs, parents, knowledge_base_deleted(t("recovery_state"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references: src, row_key, identifier, period, status."""
    return find_orphans(*_inputs(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans by table and month."""
    refs, parents, deleted = _inputs(spark, d)
    return orphan_report(refs, find_orphans(refs, parents, deleted))


_SP = r"[\s\p{Z}\x{200b}\x{feff}]"
_CL = r"[\s\p{Z}\x{200b}\x{feff}.,;:!?)\]}>''\"’”]"


def _doi(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_extract(lower({c}), '(?s)10\.[0-9].*', 0), '{_CL}+$', ''), '')"


def _key(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower({c}), '^{_SP}+', ''), '{_CL}+$', ''), '')"


def _sess(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({c}, '^{_SP}+', ''), '{_SP}+$', ''), '')"


_ADDED = """coalesce(CASE WHEN trim(added) ~ '^\\d{4}-\\d\\d-\\d\\d[T ].*(Z|[+-]\\d\\d:?\\d\\d)$'
      THEN CAST(timezone('UTC', try_cast(trim(added) AS TIMESTAMPTZ)) AS DATE) END,
    CAST(try_strptime(regexp_extract(trim(added), '^\\d{4}-\\d\\d-\\d\\d', 0), '%Y-%m-%d') AS DATE),
    CAST(try_strptime(regexp_extract(trim(added), '^\\d{4}/\\d\\d?/\\d\\d?', 0), '%Y/%m/%d') AS DATE),
    CAST(try_strptime(trim(added), '%d %b %Y') AS DATE))"""


def _refs_sql() -> str:
    def ids(t: str, ts: str) -> str:
        d = r"(coalesce(identifier_type = 'doi', false) OR regexp_matches(identifier, '(^|[/:\s])10\.[0-9]+/'))"
        return f"""SELECT '{t}' AS src, ref_id AS row_key, CASE WHEN {d} THEN 'doi' ELSE 'paper' END AS kind,
            CASE WHEN {d} THEN {_doi("identifier")} ELSE {_key("identifier")} END AS key,
            date_trunc('day', {ts})::TIMESTAMP AS at, coalesce(strftime({ts}, '%Y-%m'), '') AS period FROM {t}"""

    return f"""refs AS (SELECT DISTINCT * FROM ({ids("kb_refs", "noted_at")} UNION ALL {ids("code_refs", "scanned_at")}
      UNION ALL SELECT 'discovery_results', arrival, 'cite', {_doi("u")}, NULL, coalesce(strftime(found_at, '%Y-%m'), '')
        FROM (SELECT arrival, found_at, unnest(cites) AS u FROM discovery_results)
      UNION ALL SELECT 'session_entries', rowid, 'session', {_sess("session_id")}, logged_at, coalesce(strftime(logged_at, '%Y-%m'), '')
        FROM session_entries) WHERE key IS NOT NULL),
    parents AS (SELECT kind, key, min(coalesce(since, TIMESTAMP '0001-01-01')) AS since FROM (
      SELECT 'paper' AS kind, {_key("id")} AS key, {_ADDED}::TIMESTAMP AS since FROM entries
      UNION ALL SELECT 'doi', {_doi("doi")}, {_ADDED}::TIMESTAMP FROM entries
      UNION ALL SELECT 'cite', {_doi("doi")}, NULL FROM entries UNION ALL SELECT 'cite', {_doi("doi")}, NULL FROM discovery_results
      UNION ALL SELECT 'session', {_sess("id")}, timezone('UTC', CAST(created AS TIMESTAMPTZ)) FROM sessions)
      WHERE key IS NOT NULL GROUP BY ALL),
    gone AS (SELECT DISTINCT kind, key FROM (SELECT 'paper' AS kind, {_key("paper_id")} AS key FROM recovery_state
      UNION ALL SELECT 'doi', {_doi("doi")} FROM recovery_state UNION ALL SELECT 'cite', {_doi("doi")} FROM recovery_state)),
    found AS (SELECT DISTINCT src, row_key, r.key AS identifier, period,
      CASE WHEN p.key IS NOT NULL THEN 'late' WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status
      FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.key = r.key LEFT JOIN gone g ON g.kind = r.kind AND g.key = r.key
      WHERE p.key IS NULL OR p.since > r.at)"""


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": f"WITH {_refs_sql()} SELECT * FROM found",
    "p6_report": f"""WITH {_refs_sql()}, total AS (SELECT src, period, count(*) AS n_refs
        FROM (SELECT DISTINCT src, row_key, key, period FROM refs) GROUP BY ALL)
      SELECT t.src, t.period, any_value(n_refs) AS n_refs, count(CASE WHEN status = 'missing' THEN 1 END) AS n_missing,
        count(CASE WHEN status = 'deleted' THEN 1 END) AS n_deleted, count(CASE WHEN status = 'late' THEN 1 END) AS n_late
      FROM total t LEFT JOIN found f ON f.src = t.src AND f.period = t.period GROUP BY t.src, t.period""",
}
