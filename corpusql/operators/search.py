"""Keyword search, ranking, budgets and nearest vectors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that one token is taken to have.
CHARS_PER_TOKEN = 4


def expand(query: str, aliases: dict[str, list[str]]) -> list[str]:
    """Search terms of a query: its words and, for an alias or one of its values, all of the group; longest first."""
    terms = [query.lower(), *query.lower().split()]
    for key, values in aliases.items():
        group = [key.lower(), *(v.lower() for v in values)]
        if any(t in group for t in terms):
            terms += group
    return sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t))


def pattern(terms: list[str]) -> str:
    """One regular expression for all terms."""
    return "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)


def front_field(text: Column, field: str) -> Column:
    """A field of the front matter, without quotes; ``""`` if there is none."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---\r?\n(.*?)\n---", 1)
    return F.trim(F.regexp_extract(head, rf"(?m)^{field}:[ \t]*([^\r\n]*)", 1))


def keyword(documents: DataFrame, terms: list[str], limit: int = 50, year_from: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """doc_id, score, snippet: matches per kilobyte (at least a tenth of one), best first, then by doc_id; ``limit`` results.

    ``year_from`` drops only documents whose year is known and earlier. NULL and empty texts match nothing.
    """
    docs = documents.filter("text IS NOT NULL")
    if kinds:
        docs = docs.filter(F.col("doc_kind").isin(kinds))
    if year_from:
        year = F.col("year").try_cast("int")
        docs = docs.withColumn("year", front_field(F.col("text"), "year")).filter(year.isNull() | (year >= year_from))
    low, pat = F.lower("text"), F.lit(pattern(terms))
    n = F.regexp_count(low, pat)
    at = F.instr(low, F.regexp_extract(low, pattern(terms), 0))
    start = F.greatest(at - 100, F.lit(1))
    snippet = F.trim(F.regexp_replace(F.substring("text", start, F.lit(220)), r"\s+", " "))
    score = F.round(n / F.greatest(F.length("text") / F.lit(1024.0), F.lit(0.1)), 6)
    hits = docs.select("doc_id", score.alias("score"), snippet.alias("snippet"), n.alias("n")).filter("n > 0")
    return hits.orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", "score", "snippet")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))


def bm25(documents: DataFrame, terms: list[str], limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of the documents that match best; statistics over all documents, one narrow row a document."""
    tf = lambda t: F.size(F.filter("w", lambda x: x == t)).alias(f"tf{terms.index(t)}")
    docs = documents.filter("text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("len"), *map(tf, terms))
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    docs = docs.filter(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(stats))  # one row of statistics

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))

    score = F.round(sum(part(i) for i in range(len(terms))), 6)
    return docs.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def top(results: DataFrame, by: str, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank. Each task keeps k rows a group before anything is shuffled."""
    return results.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def enriched(results: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    """query_text, rank, path, id, topic, doi: the best results of each query with their catalogue entry (``""`` where there is none)."""
    best = top(results, "query_text", [F.desc("score"), "result_id"], k)
    one = entries.groupBy("path").agg(F.min(F.struct("id", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("doi", F.lit("")).alias("doi"))).alias("e"))
    value = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    return best.join(one, "path", "left").select("query_text", "rank", "path", value("id"), value("topic"), value("doi"))


def fused(results: DataFrame, k: int = 100, damping: int = 60) -> DataFrame:
    """query_text, result_id, fused: reciprocal rank fusion of the given score and of how often the snippet has the query's words."""
    hits = F.size(F.filter(F.split(F.lower(F.coalesce("snippet", F.lit(""))), r"[^\p{L}]+"), lambda w: F.array_contains(F.split(F.lower("query_text"), " "), w)))
    base = results.select("query_text", "result_id", "score", hits.alias("hits"))
    by_score = top(base, "query_text", [F.desc("score"), "result_id"], k)
    by_hits = top(base.filter("hits > 0"), "query_text", [F.desc("hits"), "result_id"], k)
    part = lambda df: df.select("query_text", "result_id", (1.0 / (damping + F.col("rank"))).alias("part"))
    return part(by_score).unionByName(part(by_hits)).groupBy("query_text", "result_id").agg(F.round(F.sum("part"), 9).alias("fused"))


def within_budget(results: DataFrame, tokens: int) -> DataFrame:
    """query_text, rank, result_id, used: results of each query, best first, until their snippets are longer than the budget.

    A result takes a character at least, so the budget bounds the rows a query needs.
    """
    most = tokens * CHARS_PER_TOKEN
    sized = top(results.withColumn("size", F.greatest(F.length(F.coalesce("snippet", F.lit(""))), F.lit(1))), "query_text", [F.desc("score"), "result_id"], most)
    used = F.sum("size").over(W.partitionBy("query_text").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return sized.withColumn("used", used).filter(F.col("used") <= most).select("query_text", "rank", "result_id", "used")


def detail(documents: DataFrame, tokens: int) -> DataFrame:
    """doc_id, text: texts cut at the budget, with a mark where they are cut."""
    most = tokens * CHARS_PER_TOKEN
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n[cut]"))).otherwise(text).alias("text"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query, vec_id, cosine: the k nearest vectors of each vector whose id is divisible by ``every``, against all vectors.

    Query vectors are read by every task in blocks; each task keeps k rows a query before the shuffle.
    """
    value = lambda e: F.transform(e, lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.filter("embedding IS NOT NULL").select("vec_id", value(F.col("embedding")).alias("v")).withColumn("v", F.transform("v", lambda x: x / norm(F.col("v"))))
    queries = unit.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = unit.join(queries, F.col("vec_id") != F.col("query")).select("query", "vec_id", F.round(dot, 6).alias("cosine"))
    return top(pairs, "query", [F.desc("cosine"), "vec_id"], k).select("query", "vec_id", "cosine")
