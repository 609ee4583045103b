"""Taking documents into the catalogue: outcome of each, new ids, and evidence for claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi, slug_title, strip_marks
from corpusql.operators import extraction
from corpusql.operators.search import top


def outcomes(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, outcome, reason of ingesting every section with front matter.

    ``failed``: no title; ``skipped``: its DOI or its title is in the catalogue, or an earlier document of the batch has
    the same title; else ``ingested``. Firsts are found by aggregation.
    """
    m = extraction.metadata(documents).filter("title IS NOT NULL").join(extraction.front_matter(documents).select("doc_id"), "doc_id")
    m = m.select("doc_id", F.nullif(slug_title("title"), F.lit("")).alias("slug"), bare_doi("doi").alias("doi"))
    by_doi = entries.select(bare_doi("doi").alias("doi")).filter("doi IS NOT NULL").distinct().withColumn("has_doi", F.lit(True))
    by_title = entries.select(F.nullif(slug_title("title"), F.lit("")).alias("slug")).filter("slug IS NOT NULL").distinct().withColumn("has_title", F.lit(True))
    first = m.filter("slug IS NOT NULL").groupBy("slug").agg(F.min("doc_id").alias("first_id"))
    m = m.join(by_doi, "doi", "left").join(by_title, "slug", "left").join(first, "slug", "left")
    reason = (
        F.when(F.col("slug").isNull(), "no_title").when(F.col("has_doi"), "doi_known").when(F.col("has_title"), "title_known").when(F.col("doc_id") > F.col("first_id"), "repeated").otherwise("")
    )
    outcome = F.when(reason == "", "ingested").when(reason == "no_title", "failed").otherwise("skipped")
    return m.select("doc_id", outcome.alias("outcome"), reason.alias("reason"))


def slug(c: Column | str) -> Column:
    """A title for use in paths: letters a-z and digits, words joined by hyphens, accents dropped."""
    return F.regexp_replace(slug_title(strip_marks(c)), " ", "-")


def new_ids(merged: DataFrame, words: int = 3) -> DataFrame:
    """doi, id: ``paper-<first words>-<year>``, with ``-2``, ``-3`` … where several papers would get the same id, by DOI.

    The numbering windows hold papers of one slug and year only.
    """
    year = F.coalesce(F.when(F.col("year").between(1800, 2030), F.col("year")).cast("string"), F.lit("nd"))
    base = F.concat_ws("-", F.lit("paper"), F.array_join(F.slice(F.split(slug("title"), "-"), 1, words), "-"), year)
    rows = merged.filter("title IS NOT NULL").select("doi", base.alias("base"))
    n = F.row_number().over(W.partitionBy("base").orderBy("doi"))
    return rows.withColumn("n", n).select("doi", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("id"))


def evidence(claims: DataFrame, entries: DataFrame, every: int = 100, k: int = 5, common: float = 0.05) -> DataFrame:
    """doc_id, claim, id, score, rank: for claims of the documents whose id is divisible by ``every``, the k entries whose titles share most of their rare words.

    Words of more than ``common`` of the titles say nothing and are left out. The score adds ln(n / df) of shared words.
    """
    title = entries.filter("title IS NOT NULL").select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    n = entries.filter("title IS NOT NULL").count()
    df = title.groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df") <= max(3.0, common * n))
    asked = claims.filter(F.col("doc_id") % every == 0).select("doc_id", "claim", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    hits = asked.join(df, "w").join(title, "w").groupBy("doc_id", "claim", "id").agg(F.round(F.sum(F.log(n / F.col("df"))), 6).alias("score"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "claim")
    return top(hits.withColumn("q", key), "q", [F.desc("score"), "id"], k).select("doc_id", "claim", "id", "score", "rank")


def equation_coverage(scanned: DataFrame, documents: DataFrame) -> DataFrame:
    """latex, n_papers, n_symbols, n_matched, coverage, verdict: how many of a formula's symbols are variables of the source files.

    A symbol is matched by a variable of the same name, case and underscores aside. Equal formulas are judged once.
    """
    flat = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    names = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*([A-Za-z_]\w*) = "), F.lit(1)))
    variables = documents.filter("doc_kind = 'source_file' AND text IS NOT NULL").select(names.alias("v")).select(flat(F.col("v")).alias("v")).distinct()
    formulas = scanned.select("scan_id", F.explode("equations").alias("e")).filter("e.latex IS NOT NULL").groupBy(F.col("e.latex").alias("latex")).agg(F.count_distinct("scan_id").alias("n_papers"))
    each = formulas.select("latex", "n_papers", F.explode(extraction.symbols(F.col("latex"))).alias("s")).withColumn("v", flat(F.col("s")))
    each = each.join(variables.withColumn("hit", F.lit(1)), "v", "left")
    sums = each.groupBy("latex", "n_papers").agg(F.count("*").alias("n_symbols"), F.count("hit").alias("n_matched"))
    coverage = F.round(F.col("n_matched") / F.col("n_symbols"), 6)
    return sums.withColumn("coverage", coverage).withColumn("verdict", F.when(coverage >= 0.8, "good").when(coverage >= 0.4, "partial").otherwise("poor"))


def event_properties(events: DataFrame) -> DataFrame:
    """event_type, n, n_with_k, sum_k: what the JSON properties of events hold; unreadable ones count as without."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_with_k"), F.sum(k).alias("sum_k"))
