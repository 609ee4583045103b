"""Results of several providers: merged, filled in, scored and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi, strip

# Words of academic titles.
ACADEMIC = r"\b(analysis|model|modelling|estimation|assessment|simulation|prediction|calibration|evaluation)\b"


def _first(c: str, order: str = "arrival") -> Column:
    """The first usable value by arrival."""
    value = F.col(c)
    there = value.isNotNull() & (F.trim(value.cast("string")) != "")
    return F.min(F.when(there, F.struct(order, value.alias("v")))).getField("v").alias(c)


def merged(discovery: DataFrame) -> DataFrame:
    """doi, n, first_arrival, title, abstract, pdf_url, venue, year, citations: a row a DOI, each field the first value that any provider gave."""
    rows = discovery.withColumn("doi", bare_doi("doi")).filter("doi IS NOT NULL")
    return rows.groupBy("doi").agg(
        F.count("*").alias("n"), F.min("arrival").alias("first_arrival"), *(_first(c) for c in ("title", "abstract", "pdf_url", "venue", "year")), F.max("citation_count").alias("citations")
    )


def quality(discovery: DataFrame) -> DataFrame:
    """arrival, score: +3 DOI, +3 PDF, +2 academic title, +1 open access, -3 preprint host."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    point = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    score = (
        point(bare_doi("doi").isNotNull(), 3) + point(has("pdf_url"), 3) + point(F.lower("title").rlike(ACADEMIC), 2) + point(F.col("is_open_access"), 1)
        - point(domain(F.col("pdf_url")).startswith("preprints."), 3)
    )
    return discovery.select("arrival", score.alias("score"))


def domain(url: Column) -> Column:
    """Host of a URL, in lower case, without ``www.``; ``""`` if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://(?:www\.)?([^/:]+)", 1))


def domains(discovery: DataFrame) -> DataFrame:
    return discovery.select(domain(F.col("pdf_url")).alias("domain")).filter("domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))


def filled_pdf(discovery: DataFrame) -> DataFrame:
    """arrival, pdf_url, was_filled: PDF addresses, missing ones from the first other row with the same DOI."""
    own = F.nullif(F.trim("pdf_url"), F.lit(""))
    rows = discovery.select("arrival", bare_doi("doi").alias("doi"), own.alias("own"))
    known = rows.filter("doi IS NOT NULL AND own IS NOT NULL").groupBy("doi").agg(F.min(F.struct("arrival", "own")).alias("k"))
    out = rows.join(known, "doi", "left")
    return out.select("arrival", F.coalesce("own", "k.own").alias("pdf_url"), (F.col("own").isNull() & F.col("k").isNotNull()).alias("was_filled"))


def open_access(discovery: DataFrame) -> DataFrame:
    """source, n_dois, n_open, n_closed: DOIs of each provider that any provider knows as open, and the rest."""
    rows = discovery.select(F.lower(strip("source")).alias("source"), bare_doi("doi").alias("doi"), "is_open_access").filter("doi IS NOT NULL")
    open_ = rows.filter("is_open_access").select("doi").distinct().withColumn("open", F.lit(True))
    each = rows.select("source", "doi").distinct().join(open_, "doi", "left")
    return each.groupBy("source").agg(F.count("*").alias("n_dois"), F.count_if(F.col("open")).alias("n_open"), F.count_if(F.col("open").isNull()).alias("n_closed"))


def rounds(discovery: DataFrame, target: int) -> DataFrame:
    """batch_no, n_new, n_all, needed: new DOIs of each discovery run and whether it is still needed to reach the target."""
    first = discovery.select(bare_doi("doi").alias("doi"), "batch_no").filter("doi IS NOT NULL").groupBy("doi").agg(F.min("batch_no").alias("batch_no"))
    new = first.groupBy("batch_no").agg(F.count("*").alias("n_new"))  # a row a run
    total = F.sum("n_new").over(W.orderBy("batch_no").rowsBetween(W.unboundedPreceding, 0))
    return new.withColumn("n_all", total).withColumn("needed", F.col("n_all") - F.col("n_new") < target)
