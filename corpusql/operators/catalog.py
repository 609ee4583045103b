"""The catalogue: listing, counting, exporting and changing entries. ``""`` and NULL both mean "no value"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def show(entries: DataFrame, type_: str | None = None, topic: str | None = None) -> DataFrame:
    """Entries of a type and topic; without either, all."""
    out = entries
    if type_:
        out = out.filter(F.col("type") == type_)
    if topic:
        out = out.filter(F.col("topic") == topic)
    return out.select("id", "type", "title", "topic", F.coalesce("doi", F.lit("")).alias("doi"))


def stats(entries: DataFrame) -> DataFrame:
    """kind, name, n: entries by type, by non-empty topic, papers by topic (empty ones too), and in all. One pass over the table."""
    topic = F.coalesce("topic", F.lit(""))
    group = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    groups = F.array(
        group("all", F.lit("")), group("type", F.col("type")),
        F.when(topic != "", group("topic", topic)), F.when(F.col("type") == "paper", group("paper_topic", topic)),
    )
    return entries.select(F.explode(groups).alias("g")).filter("g IS NOT NULL").groupBy("g.kind", "g.name").agg(F.count("*").alias("n"))


def bibtex(entries: DataFrame) -> DataFrame:
    """id, entry: a BibTeX record of each paper with a DOI; the year is that of ``added``; braces in titles are escaped."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"([{}])", r"\\$1")
    papers = entries.filter((F.col("type") == "paper") & (F.coalesce(F.trim("doi"), F.lit("")) != ""))
    year = F.regexp_extract(F.coalesce("added", F.lit("")), r"^(\d{4})", 1)
    return papers.select(
        "id", F.concat(F.lit("@article{"), "id", F.lit(", title = {"), title, F.lit("}, year = {"), year, F.lit("}, doi = {"), F.trim("doi"), F.lit("}}")).alias("entry")
    )


def rendered(entries: DataFrame) -> DataFrame:
    """type, topic, n, newest, lines: the catalogue page of each topic, titles by ``added`` (newest first), then id.

    A page holds a topic's titles, as the page of a rendered catalogue does; it is written by the task of its topic.
    """
    line = F.struct(F.coalesce("added", F.lit("")).alias("added"), "id", F.coalesce("title", F.lit("")).alias("title"))
    order = lambda a, b: F.when(a.added > b.added, -1).when(a.added < b.added, 1).when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0)
    pages = entries.groupBy("type", F.coalesce("topic", F.lit("")).alias("topic")).agg(F.count("*").alias("n"), F.max(F.coalesce("added", F.lit(""))).alias("newest"), F.collect_list(line).alias("lines"))
    return pages.select("type", "topic", "n", "newest", F.array_join(F.transform(F.array_sort("lines", order), lambda x: F.concat(F.lit("- "), x.title)), "\n").alias("lines"))


def upsert(entries: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """``entries`` with the rows of ``incoming`` added or put in the place of those with the same key."""
    return entries.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def without(entries: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``entries`` without the rows whose key is in ``keys``."""
    return entries.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")


def carried_over(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Re-ingested rows keep the day they were first ``added``; ``updated`` is set only for rows that were there before."""
    old = existing.select("id", F.col("added").alias("old_added"))
    return incoming.join(old, "id", "left").select(
        "id", F.coalesce("old_added", "added").alias("added"), F.when(F.col("old_added").isNotNull(), F.col("updated")).alias("updated")
    )
