"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined against the parent keys; only the few keys that have no
parent, or a parent younger than their first reference, are joined back to the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import DAY_US, bare_doi, clean_key, day_micros, instant_micros, micros, strip

#: A key may hold a third of all references; its rows are spread over so many tasks.
SALTS = 16
START = -(2**62)


def find_orphans(refs: DataFrame, parents: DataFrame, deleted: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of ``refs`` whose key has no parent, a deleted one or one that came later.

    refs: src, row_key, kind, key, at (microseconds, NULL: nothing is late), period. NULL keys are no references.
    parents: kind, key, since (microseconds, NULL: from the start). deleted: kind, key.
    Returns distinct src, row_key, identifier, period, status (``missing``, ``deleted`` or ``late``).
    Repeated references give one row; empty tables give no rows (empty parents: every reference is an orphan);
    further columns are ignored.
    """
    refs = refs.select("src", "row_key", "kind", "key", "at", "period").filter(F.col("key").isNotNull())
    keys = refs.groupBy("kind", "key").agg(F.min("at").alias("first_at"))
    parents = (
        parents.filter(F.col("key").isNotNull()).groupBy("kind", "key").agg(F.min(F.coalesce("since", F.lit(START))).alias("since"))
    )
    gone = deleted.filter(F.col("key").isNotNull()).select("kind", "key", F.lit("deleted").alias("was")).distinct()
    unknown = (
        keys.join(parents, ["kind", "key"], "left_anti")
        .join(gone, ["kind", "key"], "left")
        .select("kind", "key", F.coalesce("was", F.lit("missing")).alias("status"), F.lit(None).cast("long").alias("since"))
    )
    younger = (
        keys.join(parents, ["kind", "key"])
        .filter(F.col("since") > F.col("first_at"))
        .select("kind", "key", F.lit("late").alias("status"), "since")
    )
    bad = unknown.unionByName(younger).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = refs.withColumn("salt", F.pmod(F.xxhash64("src", "row_key"), F.lit(salts)).cast("int"))
    return (
        spread.join(bad, ["kind", "key", "salt"])
        .filter((F.col("status") != "late") | (F.col("since") > F.col("at")))
        .select("src", "row_key", F.col("key").alias("identifier"), "period", "status")
        .distinct()
    )


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans by table and period: src, period, n_refs, n_missing, n_deleted, n_late."""
    distinct = refs.filter(F.col("key").isNotNull()).select("src", "row_key", F.col("key").alias("identifier"), "period").distinct()
    total = distinct.groupBy("src", "period").agg(F.count("*").alias("n_refs"))
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    found = orphans.groupBy("src", "period").agg(count("missing"), count("deleted"), count("late"))
    return total.join(found, ["src", "period"], "left").na.fill(0, ["n_missing", "n_deleted", "n_late"])


def _period(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM"), F.lit(""))


def _day(ts: Column) -> Column:
    return (F.floor(micros(ts) / DAY_US) * DAY_US).cast("long")


def knowledge_base_refs(kb_refs: DataFrame, code_refs: DataFrame, discovery: DataFrame, entries: DataFrame) -> DataFrame:
    """All references of the knowledge base in one shape; untyped identifiers are told apart by their look."""

    def identifiers(df: DataFrame, src: str, ts: str) -> DataFrame:
        is_doi = F.coalesce(F.col("identifier_type") == "doi", F.lit(False)) | F.col("identifier").rlike(r"(^|[/:\s])10\.[0-9]+/")
        return df.select(
            F.lit(src).alias("src"),
            F.col("ref_id").cast("long").alias("row_key"),
            F.when(is_doi, "doi").otherwise("paper").alias("kind"),
            F.when(is_doi, bare_doi("identifier")).otherwise(clean_key("identifier")).alias("key"),
            _day(F.col(ts)).alias("at"),
            _period(F.col(ts)).alias("period"),
        )

    cites = (
        discovery.select("arrival", "found_at", F.explode("cites").alias("cited"))
        .select(
            F.lit("discovery_results").alias("src"),
            F.col("arrival").cast("long").alias("row_key"),
            F.lit("cite").alias("kind"),
            bare_doi("cited").alias("key"),
            F.lit(None).cast("long").alias("at"),
            _period(F.col("found_at")).alias("period"),
        )
    )
    sessions = entries.select(
        F.lit("session_entries").alias("src"),
        F.col("rowid").cast("long").alias("row_key"),
        F.lit("session").alias("kind"),
        F.nullif(strip("session_id"), F.lit("")).alias("key"),
        micros("logged_at").alias("at"),
        _period(F.col("logged_at")).alias("period"),
    )
    return (
        identifiers(kb_refs, "kb_refs", "noted_at")
        .unionByName(identifiers(code_refs, "code_refs", "scanned_at"))
        .unionByName(cites)
        .unionByName(sessions)
    )


def knowledge_base_parents(entries: DataFrame, discovery: DataFrame, sessions: DataFrame) -> DataFrame:
    """kind, key, since of everything a reference may point to."""
    row = lambda df, kind, key, since: df.select(F.lit(kind).alias("kind"), key.alias("key"), since.cast("long").alias("since"))
    added = day_micros("added")
    return (
        row(entries, "paper", clean_key("id"), added)
        .unionByName(row(entries, "doi", bare_doi("doi"), added))
        .unionByName(row(entries, "cite", bare_doi("doi"), F.lit(None)))
        .unionByName(row(discovery, "cite", bare_doi("doi"), F.lit(None)))
        .unionByName(row(sessions, "session", F.nullif(strip("id"), F.lit("")), instant_micros("created")))
    )


def knowledge_base_deleted(recovery: DataFrame) -> DataFrame:
    row = lambda kind, key: recovery.select(F.lit(kind).alias("kind"), key.alias("key"))
    return row("paper", clean_key("paper_id")).unionByName(row("doi", bare_doi("doi"))).unionByName(row("cite", bare_doi("doi")))
