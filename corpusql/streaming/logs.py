"""Streams: windows over events and the append-only session log."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.text import strip
from corpusql.session import shared_dir, table


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream, with the table's schema. A table is a file or a folder of files."""
    schema = table(spark, d, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    return reader.option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def _run(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there, keep each batch in a folder of its own and return the table they make.

    In complete mode the last batch is the result; in append mode all batches are.
    """
    spark = stream.sparkSession
    folder = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    last = {"id": -1}

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        last["id"] = batch_id

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if last["id"] < 0:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema).parquet(f"{folder}/batch={last['id']}" if mode == "complete" else f"{folder}/batch=*")
    return out


def event_windows(spark: SparkSession, d: str, delay: str = "40 days") -> DataFrame:
    """day, event_type, n, total: events in daily windows; events later than ``delay`` behind the newest are dropped."""
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    return _run(flat, "windows", "complete")


def session_log(spark: SparkSession, d: str) -> DataFrame:
    """session_id, n: log rows of open sessions, each delivered row taken once, by a stream joined with the table of sessions."""
    open_ = table(spark, d, "sessions").filter("NOT closed").select(F.col("id").alias("session_id"))
    log = _stream(spark, d, "session_entries").select("rowid", F.nullif(strip("session_id"), F.lit("")).alias("session_id"))
    once = log.dropDuplicates(["rowid"]).join(open_, "session_id")
    return _run(once, "log", "append").groupBy("session_id").agg(F.count("*").alias("n"))
