"""Catalogue files: tolerant JSON reading, Parquet and JSON writing, change sets, recovery and search caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators.catalog import upsert

#: Columns of a catalogue entry; other keys of the file are left out, missing ones become NULL.
ENTRY = "id string, type string, path string, title string, topic string, tags array<string>, added string, updated string, source_url string, doi string, files array<string>"
PAPER = "title string, authors array<string>, year int, doi string, abstract string, pdf_url string, source string, is_open_access boolean, venue string, citation_count int, cites array<string>, cited_by array<string>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file that holds a list of them."""
    return spark.read.schema(ENTRY).json(path, multiLine=True)


def write_catalogue(entries: DataFrame, path: str) -> None:
    """Entries as Parquet, a folder for each type."""
    entries.write.mode("overwrite").partitionBy("type").parquet(path)


def write_json(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines; empty and NULL values are left out."""
    tidy = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in entries.dtypes]
    entries.select(*tidy).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def merge_catalogue(spark: SparkSession, path: str, incoming: DataFrame, to: str) -> DataFrame:
    """The catalogue at ``path`` with rows added or replaced by id, written to ``to`` and read back."""
    write_catalogue(upsert(spark.read.parquet(path), incoming), to)
    return spark.read.parquet(to)


def changed(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """id, change (``added``, ``removed``, ``changed``) between two states of the catalogue, by the named columns."""
    key = F.xxhash64(*(F.to_json(F.struct(c)) for c in columns))
    a, b = old.select("id", key.alias("a")), new.select("id", key.alias("b"))
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "id", "full").select("id", what.alias("change")).filter("change IS NOT NULL")


def read_search_cache(spark: SparkSession, path: str) -> DataFrame:
    """pos, and the columns of a discovery result, from a cached search: a list, or an object with ``results``."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"results array<struct<{_struct(PAPER)}>>").getField("results")
    plain = F.from_json("value", f"array<struct<{_struct(PAPER)}>>")
    rows = text.select(F.posexplode(F.when(F.ltrim("value").startswith("["), plain).otherwise(wrapped)).alias("pos", "r"))
    return rows.select(F.col("pos") + 1, "r.*").toDF("pos", *(c.split(" ")[0] for c in PAPER.split(", ")))


def picked(results: DataFrame, ordinals: list[int] | None = None, open_only: bool = False) -> DataFrame:
    """Results with these 1-based places (those beyond the list are passed over), and open ones only if asked."""
    out = results.filter(F.col("pos").isin(ordinals)) if ordinals else results
    return out.filter("is_open_access") if open_only else out


def read_recovery(spark: SparkSession, path: str) -> DataFrame:
    """bucket, queue_pos, title, topic, path, reason from a recovery file with a list for each bucket; the topic comes from the path."""
    item = "array<struct<title: string, path: string, reason: string>>"
    state = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {item}>").alias("m"))
    rows = state.select(F.explode("m").alias("bucket", "items")).select("bucket", F.posexplode("items").alias("queue_pos", "i"))
    topic = F.coalesce(F.nullif(F.get(F.split("i.path", "/"), F.lit(1)), F.lit("")), F.lit("uncategorized"))
    return rows.select("bucket", "queue_pos", "i.title", topic.alias("topic"), "i.path", "i.reason")


def _struct(ddl: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in ddl.split(", "))
