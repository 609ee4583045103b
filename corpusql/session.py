"""Session helpers: reading the tables and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
#: Spark removes a query's shuffle files at its end where this is set, not only when the driver collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary one in local mode (tests); on a cluster that is an error, since a folder on one
    machine would lose the rows that the others write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a Parquet table; the shuffle files of the query are removed when it has ended."""
    conf = df.sparkSession.conf
    before = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")
    try:
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    finally:
        conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)
    return path


def staged(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage; survives the loss of executors, since the files are not on their disks.
    """
    path = write_table(df, new_path(df.sparkSession, name), partition_by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables that ``staged`` or ``write_table`` wrote and that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table_ in tables:
        path = jvm.org.apache.hadoop.fs.Path(table_ if isinstance(table_, str) else table_._staged_at)
        path.getFileSystem(conf).delete(path, True)
