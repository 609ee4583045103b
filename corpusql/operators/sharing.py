"""Exporting the catalogue and importing archives without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi


def export_summary(entries: DataFrame, documents: DataFrame, topic: str | None = None) -> DataFrame:
    """type, n, n_files, n_texts, n_chars of what an export of the topic holds."""
    chosen = entries.filter(F.col("topic") == topic) if topic else entries
    texts = documents.filter("entry_id IS NOT NULL").groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("texts"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chosen.join(texts, "id", "left").groupBy("type").agg(
        F.count("*").alias("n"), F.sum(F.size(F.coalesce("files", F.array()))).cast("long").alias("n_files"), F.sum(zero("texts")).alias("n_texts"), F.sum(zero("chars")).alias("n_chars")
    )


def imported(archive: DataFrame, entries: DataFrame, order: str = "arrival") -> DataFrame:
    """order, doi, title of archive rows that the catalogue lacks by DOI and by lower-case title; of equal rows in the archive the first.

    Firsts are found per DOI and per title by aggregation, so that no group is collected.
    """
    rows = archive.select(F.col(order).alias("pos"), bare_doi("doi").alias("doi"), F.lower(F.trim("title")).alias("title")).filter("title IS NOT NULL AND title <> ''")
    have_doi = entries.select(bare_doi("doi").alias("doi")).filter("doi IS NOT NULL").distinct()
    have_title = entries.select(F.lower(F.trim("title")).alias("title")).filter("title IS NOT NULL").distinct()
    new = rows.join(have_doi, "doi", "left_anti").join(have_title, "title", "left_anti")
    first_doi = new.filter("doi IS NOT NULL").groupBy("doi").agg(F.min("pos").alias("pos"))
    new = new.filter("doi IS NULL").unionByName(new.join(first_doi, ["doi", "pos"], "left_semi").select(*new.columns))
    firsts = new.groupBy("title").agg(F.min("pos").alias("pos"))
    return new.join(firsts, ["title", "pos"], "left_semi").select(F.col("pos").alias(order), "doi", "title")
