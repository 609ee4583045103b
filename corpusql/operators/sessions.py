"""Append-only session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import instant_micros, micros, strip


def delivered_once(entries: DataFrame) -> DataFrame:
    """Log rows without those delivered twice (same rowid); session ids without outer white space, empty ones as NULL."""
    return entries.withColumn("session_id", F.nullif(strip("session_id"), F.lit(""))).dropDuplicates(["rowid"])


def listing(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """id, name, closed, n_entries, last_at of every session, also of those without entries. Entries are counted before they are joined."""
    log = delivered_once(entries).groupBy("session_id").agg(F.count("rowid").alias("n"), F.max("logged_at").alias("last_at"))
    return sessions.join(log, F.col("id") == F.col("session_id"), "left").select(
        "id", "name", "closed", F.coalesce("n", F.lit(0)).alias("n_entries"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at")
    )


def tagged(entries: DataFrame, tag: str) -> DataFrame:
    """rowid, session_id, agent, content of log rows that have a tag."""
    return delivered_once(entries.filter(F.array_contains("tags", tag))).select("rowid", "session_id", "agent", "content")


def tag_counts(entries: DataFrame) -> DataFrame:
    """tag, n, n_sessions over the log."""
    return delivered_once(entries).select("session_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"))


def agents(entries: DataFrame) -> DataFrame:
    """agent (NULL: unknown), month, n, n_sessions, chars."""
    e = delivered_once(entries)
    return e.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent"), F.date_format("logged_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars")
    )


def rejected(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """rowid, reason: log rows that an append would refuse: no session id, no such session, a closed one, or logged before it was created."""
    known = sessions.select(F.col("id").alias("session_id"), instant_micros("created").alias("born"), "closed", F.lit(True).alias("there"))
    e = delivered_once(entries).select("rowid", "session_id", micros("logged_at").alias("at")).join(known, "session_id", "left")
    reason = F.when(F.col("session_id").isNull(), "no_session").when(F.col("there").isNull(), "unknown_session").when(F.col("closed"), "closed_session").when(F.col("at") < F.col("born"), "before_creation")
    return e.select("rowid", reason.alias("reason")).filter("reason IS NOT NULL")


def opened_and_closed(sessions: DataFrame, entries: DataFrame, idle_since: str) -> DataFrame:
    """id, closed, is_new: sessions, with those that only the log names opened and those without a row since ``idle_since`` closed.

    A session without any dated row stays as it is; rows without a session id open none.
    """
    log = entries.groupBy(F.nullif(strip("session_id"), F.lit("")).alias("id")).agg(F.max(micros("logged_at")).alias("last")).filter("id IS NOT NULL")
    all_ = sessions.select("id", "closed", F.lit(True).alias("there")).join(log, "id", "full")
    idle = F.coalesce(F.col("last") < micros(F.lit(idle_since)), F.lit(False))
    return all_.select("id", (F.coalesce("closed", F.lit(False)) | idle).alias("closed"), F.col("there").isNull().alias("is_new"))
