"""Session settings and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A single-process master may use a local one; any other must name it in
    ``spark.checkpoint.dir``, since executors would each write to their own disk.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-tickloom-")
        sc.setCheckpointDir(path)
    return path


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tickloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with the application's tables."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read it back.

    Worth it where a deep plan is read by several later branches. The table
    survives lost executors, keeps column pruning, and gives the planner true
    sizes for its join choices. ``release`` removes an application's tables.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for ``discard``
    return out


def stored_at(df: DataFrame) -> str:
    """The folder of a table that ``materialize`` returned."""
    return df._stored_at


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once all that reads them is written."""
    for df in tables:
        _delete(df.sparkSession, stored_at(df))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table this application has materialized."""
    _delete(spark, _folder(spark))
