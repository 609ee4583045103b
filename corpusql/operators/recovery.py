"""Queue of deleted papers: buckets, reasons, what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi, clean_key, slug_title


def reason_class(c: Column) -> Column:
    """``ingest_failed: timeout`` -> ``ingest_failed``; empty -> ``unknown``."""
    return F.coalesce(F.nullif(F.trim(F.split_part(c, F.lit(":"), F.lit(1))), F.lit("")), F.lit("unknown"))


def buckets(state: DataFrame) -> DataFrame:
    """bucket, reason, n, first_pos; rows with ``""`` hold the totals."""
    s = state.select("bucket", reason_class(F.col("reason")).alias("reason"), "queue_pos")
    return s.rollup("bucket", "reason").agg(F.count("*").alias("n"), F.min("queue_pos").alias("first_pos")).na.fill("", ["bucket", "reason"])


def requeue(state: DataFrame, reasons: list[str]) -> DataFrame:
    """queue_pos, title, topic, path, turn: the new pending queue; failed and skipped items of these reasons go first, unless pending already."""
    key = ["title", "topic", "path"]
    pending = state.filter("bucket = 'pending'")
    again = state.filter(F.col("bucket").isin("failed", "skipped") & reason_class(F.col("reason")).isin(reasons))
    again = again.join(pending.select(*key), key, "left_anti")
    out = again.select("queue_pos", *key, F.lit(0).alias("turn")).unionByName(pending.select("queue_pos", *key, F.lit(1).alias("turn")))
    return out.select("queue_pos", *key, "turn")


def next_step(state: DataFrame, entries: DataFrame) -> DataFrame:
    """queue_pos, step: what a recovery run does with each item, by id, DOI and title against the catalogue."""
    known = lambda k, c: entries.select(c.alias(k)).filter(F.col(k).isNotNull() & (F.col(k) != "")).distinct().withColumn(f"has_{k}", F.lit(True))
    s = state.select("queue_pos", "bucket", clean_key("paper_id").alias("k_id"), bare_doi("doi").alias("k_doi"), slug_title("title").alias("k_title"), reason_class(F.col("reason")).alias("reason"))
    s = s.join(known("k_id", clean_key("id")), "k_id", "left").join(known("k_doi", bare_doi("doi")), "k_doi", "left").join(known("k_title", slug_title("title")), "k_title", "left")
    step = (
        F.when(F.col("bucket") == "restored", "done")
        .when(F.col("has_k_id"), "already_there")
        .when(F.col("has_k_doi"), "same_doi")
        .when(F.col("has_k_title"), "same_title")
        .when(F.col("k_doi").isNull(), "search_by_title")
        .when((F.col("bucket") == "failed") & (F.col("reason") == "ingest_failed"), "retry")
        .otherwise("fetch")
    )
    return s.select("queue_pos", step.alias("step"))
