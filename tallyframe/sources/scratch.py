"""Tables that cut lineage: written to the folder that all executors share, so they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a session on one machine (tests) may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyframe/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table that ``saved`` returned and that nothing lazy still reads."""
    delete(table.sparkSession, table.saved_at)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote here, for the time when none of its lazy results is read any more."""
    delete(spark, _own(spark))


def delete(spark: SparkSession, at: str) -> None:
    """Deletes a path of this folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
