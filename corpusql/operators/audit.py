"""Integrity, freshness and repair of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi, day_micros, strip

# Order of severities and confidences, and the form of a DOI.
SEVERITY = {"error": 0, "warning": 1, "info": 2}
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
DOI_FORM = r"^10\.\d{4,9}/[-._;()/:A-Za-z0-9]+$"


def _finding(when: Column, severity: str, code: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.coalesce(detail, F.lit("")).alias("detail")))


def metadata_findings(entries: DataFrame) -> DataFrame:
    """id, severity, code, detail: rules broken by an entry's own fields."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    paper = F.col("type") == "paper"
    rules = F.array(
        _finding(~F.coalesce(F.col("type").isin("paper", "package", "codebase"), F.lit(False)), "error", "invalid_type", F.col("type")),
        _finding(empty("id"), "error", "missing_id", F.lit("")),
        _finding(empty("title"), "error", "missing_title", F.lit("")),
        _finding(paper & empty("topic"), "warning", "missing_topic", F.lit("")),
        _finding(paper & ~empty("doi") & ~F.col("doi").rlike(DOI_FORM), "error", "invalid_doi", F.col("doi")),
        _finding(paper & empty("doi"), "info", "missing_doi", F.lit("")),
        _finding(~empty("added") & day_micros("added").isNull(), "error", "invalid_added", F.col("added")),
        _finding(empty("added"), "info", "missing_added", F.lit("")),
        _finding(F.size(F.coalesce("files", F.array())) == 0, "warning", "no_files", F.lit("")),
    )
    return entries.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("f")).select("id", "f.*")


def result_findings(discovery: DataFrame, first: int = 1900, last: int = 2100) -> DataFrame:
    """arrival, severity, code, detail: rules broken by a provider's result; lists of DOIs must not hold empty items."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    gap = lambda c: F.coalesce(F.exists(c, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), F.lit(False))
    year = F.col("year").cast("string")
    rules = F.array(
        _finding(empty("title"), "error", "missing_title", F.lit("")),
        _finding(~empty("doi") & ~F.col("doi").rlike(DOI_FORM), "error", "invalid_doi", F.col("doi")),
        _finding(~F.col("year").between(first, last), "error", "invalid_year", year),
        _finding(F.col("year").isNull(), "info", "missing_year", F.lit("")),
        _finding(gap("cites"), "error", "invalid_cites", F.lit("")),
        _finding(gap("cited_by"), "error", "invalid_cited_by", F.lit("")),
    )
    return discovery.select("arrival", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("f")).select("arrival", "f.*")


def duplicates(entries: DataFrame, key: str, code: str) -> DataFrame:
    """Findings for every key that more than one row has; the smallest id stands for the group."""
    k = bare_doi(key) if key == "doi" else F.nullif(strip(key), F.lit(""))
    groups = entries.select("id", k.alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return groups.filter("n > 1").select("id", F.lit("error").alias("severity"), F.lit(code).alias("code"), F.concat_ws(" x ", "k", F.col("n").cast("string")).alias("detail"))


def integrity(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """All findings: the rules, repeated ids and DOIs, papers without any document, documents without entry."""
    owners = documents.select(F.col("entry_id").alias("id")).filter("id IS NOT NULL").distinct()
    missing = entries.filter("type = 'paper'").select("id").join(owners, "id", "left_anti")
    unindexed = owners.join(entries.select("id"), "id", "left_anti")
    row = lambda df, severity, code: df.select("id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit("").alias("detail"))
    parts = [
        metadata_findings(entries), duplicates(entries, "id", "duplicate_id"), duplicates(entries, "doi", "duplicate_doi"),
        row(missing, "info", "missing_file"), row(unindexed, "warning", "unindexed_file"),
    ]
    return reduce(DataFrame.unionByName, parts)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings as severe as ``severity`` or more."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, r) for s, r in SEVERITY.items()), F.lit(9))
    return findings.filter(rank <= SEVERITY[severity])


def severity_counts(findings: DataFrame) -> DataFrame:
    """code, errors, warnings, infos, total; a row ``""`` for all codes."""
    count = lambda s, name: F.count_if(F.col("severity") == s).alias(name)
    return (
        findings.rollup("code").agg(count("error", "errors"), count("warning", "warnings"), count("info", "infos"), F.count("*").alias("total"))
        .withColumn("code", F.coalesce("code", F.lit("")))
    )


def freshness(entries: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """id, checked, state: ``never`` (no date), ``bad_date``, ``stale`` (older than ``days`` on ``as_of``) or ``fresh``."""
    text = F.coalesce(F.nullif(strip("updated"), F.lit("")), F.nullif(strip("added"), F.lit("")))
    day = day_micros(text)
    limit = F.unix_date(F.lit(as_of).cast("date")) * F.lit(86_400_000_000) - F.lit(days * 86_400_000_000)
    state = F.when(text.isNull(), "never").when(day.isNull(), "bad_date").when(day < limit, "stale").otherwise("fresh")
    return entries.select("id", F.date_format(F.timestamp_micros(day).cast("date"), "yyyy-MM-dd").alias("checked"), state.alias("state"))


def confidence_rank(c: Column) -> Column:
    level = F.lower(strip(c))
    return F.coalesce(*(F.when(level == k, v) for k, v in CONFIDENCE.items()), F.lit(0))


def distinct_actions(actions: DataFrame) -> DataFrame:
    """path, field, value, confidence, action_id: of equal proposals the most confident, then the latest."""
    value = F.coalesce(strip("proposed_value"), F.lit(""))
    best = F.max(F.struct(confidence_rank(F.col("confidence")).alias("rank"), "proposed_at", "action_id")).alias("b")
    return actions.groupBy("path", "field", value.alias("value")).agg(best).select("path", "field", "value", F.col("b.rank").alias("confidence"), F.col("b.action_id").alias("action_id"))


def planned_repairs(actions: DataFrame, gap: int = 1) -> DataFrame:
    """path, field, value, rivals: fields whose best proposal beats the second best value by ``gap`` ranks (no plan where they tie)."""
    best = distinct_actions(actions).filter("value <> ''")
    # Two largest ranks a field by aggregation alone; a field may have any number of proposals.
    ranks = best.groupBy("path", "field", "confidence").agg(F.count("*").alias("n"), F.max(F.struct("action_id", "value")).alias("v"))
    top = ranks.groupBy("path", "field").agg(F.max(F.struct("confidence", "n", "v")).alias("t"), F.sum("n").alias("rivals"))
    second = ranks.join(top.select("path", "field", F.col("t.confidence").alias("c1")), ["path", "field"]).filter("confidence < c1").groupBy("path", "field").agg(F.max("confidence").alias("c2"))
    out = top.filter("t.n = 1").join(second, ["path", "field"], "left")
    return out.filter(F.col("t.confidence") - F.coalesce("c2", F.lit(0)) >= gap).select("path", "field", F.col("t.v.value").alias("value"), "rivals")


def apply_repairs(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """id, path, new_title, new_doi, changed: entries with planned titles and DOIs put in; what is equal already is no change."""
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"plan_{f}")
    wide = plan.filter(F.col("field").isin("title", "doi")).groupBy("path").agg(of("title"), of("doi"))
    joined = entries.join(wide, "path", "left")
    title, doi = F.coalesce("plan_title", "title"), F.coalesce("plan_doi", "doi")
    return joined.select("id", "path", title.alias("new_title"), doi.alias("new_doi"), (~title.eqNullSafe(F.col("title")) | ~doi.eqNullSafe(F.col("doi"))).alias("changed"))
