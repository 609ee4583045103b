"""Provider answers: JSON-lines files of works, with abstracts as inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORKS = "doi string, title string, year int, is_open boolean, pdf_url string, abstract_index map<string, array<int>>"


def read_works(spark: SparkSession, folder: str) -> DataFrame:
    """Works with their abstracts as text. Unreadable lines give rows of NULLs, which are left out."""
    works = spark.read.schema(WORKS).option("pathGlobFilter", "*.jsonl").json(folder)
    return works.withColumn("abstract", inverted_text(F.col("abstract_index"))).drop("abstract_index").filter("coalesce(doi, title) IS NOT NULL")


def inverted_text(index: Column) -> Column:
    """Text of an inverted index: word -> places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x.w), " ")
