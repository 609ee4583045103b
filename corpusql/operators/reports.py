"""Reports by topic, keyword taxonomy and context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi
from corpusql.operators.search import top


def topic_report(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """topic, n, n_missing_doi, n_missing_abstract, first_year, last_year of the papers; years and abstracts by DOI from discovery."""
    papers = entries.filter("type = 'paper'").select("id", F.coalesce("topic", F.lit("")).alias("topic"), bare_doi("doi").alias("doi"))
    known = merged.select("doi", "abstract", F.when(F.col("year").between(1800, 2030), F.col("year")).alias("year"))
    p = papers.join(known, "doi", "left")
    return p.groupBy("topic").agg(
        F.count("*").alias("n"), F.count_if(F.col("doi").isNull()).alias("n_missing_doi"), F.count_if(F.col("abstract").isNull()).alias("n_missing_abstract"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def taxonomy(entries: DataFrame, k: int = 30) -> DataFrame:
    """tag, n, n_topics: the most frequent tags, ties by name."""
    tags = entries.select(F.coalesce("topic", F.lit("")).alias("topic"), F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("topic").alias("n_topics")).orderBy(F.desc("n"), "tag").limit(k)


def context_pack(entries: DataFrame, characters: int = 2000) -> DataFrame:
    """topic, rank, id, used: papers of each topic, newest first, whose lines fit the budget, up to the first that doesn't.

    A line takes a character at least, so the budget bounds the rows that a topic needs; each task keeps no more.
    """
    day = F.coalesce("added", F.lit(""))
    rows = entries.filter("type = 'paper'").select("id", F.coalesce("topic", F.lit("")).alias("topic"), day.alias("day"), (F.length(F.coalesce("title", F.lit(""))) + 1).alias("size"))
    best = top(rows, "topic", [F.desc("day"), "id"], characters)
    used = F.sum("size").over(W.partitionBy("topic").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return best.withColumn("used", used).filter(F.col("used") <= characters).select("topic", "rank", "id", "used")


def inventory(documents: DataFrame) -> DataFrame:
    """kind, lang, n, n_empty, chars, longest of the corpus, with totals (``(all)``) of each kind and of everything."""
    d = documents.select(F.col("doc_kind").alias("kind"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return d.rollup("kind", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("size") == 0).alias("n_empty"), F.sum("size").alias("chars"), F.max("size").alias("longest")).na.fill("(all)", ["kind", "lang"])


def lookup(results: DataFrame, entries: DataFrame, most: int = 2) -> DataFrame:
    """query_text, n, tag, how: each distinct query explained by a tag: equal, within the query, or at most ``most`` slips away; the best one."""
    queries = results.filter("query_text IS NOT NULL").groupBy(F.lower("query_text").alias("query_text")).agg(F.count("*").alias("n"))
    tags = entries.select(F.explode("tags").alias("tag")).distinct()
    words = queries.select("query_text", "n", F.explode(F.concat(F.array("query_text"), F.split("query_text", " "))).alias("w"))
    # A slip may be anywhere but in the first letter, which both sides share.
    near = words.join(tags, F.left("w", F.lit(1)) == F.left("tag", F.lit(1))).withColumn("d", F.levenshtein("w", "tag", most)).filter("d >= 0")
    rank = F.when((F.col("d") == 0) & (F.col("w") == F.col("query_text")), 0).when(F.col("d") == 0, 1).otherwise(1 + F.col("d"))
    best = near.groupBy("query_text", "n").agg(F.min(F.struct(rank.alias("rank"), "tag")).alias("b"))
    return best.select("query_text", "n", F.col("b.tag").alias("tag"), F.element_at(F.array(F.lit("equal"), F.lit("word"), F.lit("slip"), F.lit("slip")), F.col("b.rank") + 1).alias("how"))
