"""Tables of the catalog: checked scans, writers, properties, extracts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if missing := missing_columns(df, columns):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"create database if not exists `{name}`")


def read_table(spark: SparkSession, name: str, columns: Iterable[str] = ()) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    return require_columns(spark.table(name), columns)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", file_format: str = "parquet", partition_by: Iterable[str] = ()) -> None:
    """Overwrites a table with its schema, or appends to it by column name."""
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(name):
        have = spark.table(name).schema
        known = {f.name for f in have}
        if new := [f for f in df.schema if f.name not in known]:
            spark.sql(f"alter table {name} add columns ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        columns = [f for f in spark.table(name).schema]
        df = df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns))
        df.write.insertInto(name)
        return
    writer = df.write.mode(mode).format(file_format)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def set_properties(spark: SparkSession, name: str, properties: dict[str, str]) -> None:
    spark.sql(f"alter table {name} set tblproperties ({', '.join(f"'{k}' = '{v}'" for k, v in properties.items())})")


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    return {r.key: r.value for r in spark.sql(f"show tblproperties {name}").collect()}.get(key)


def publish_features(df: DataFrame, name: str, version: str, source: str, producer: str, grain: str = "bene_id-year", key: str = "bene_id,year") -> None:
    """Writes the feature table by year, with properties that consumers check."""
    write_table(df, name, partition_by=["year"])
    set_properties(df.sparkSession, name, {"feature_version": version, "grain": grain, "key": key, "source": source, "producer": producer})


def failure_record(spark: SparkSession, run_id: str, status: str, reason: str | None) -> DataFrame:
    return spark.createDataFrame([(run_id, status, reason)], "run_id string, status string, reason string").withColumn("processed_at_utc", F.current_timestamp())


def publish_with_audit(spark: SparkSession, run_id: str, build: Callable[[], DataFrame], check: Callable[[DataFrame], str | None], publish: Callable[[DataFrame], None], audit: Callable[[DataFrame], None]) -> str:
    """Builds, checks and publishes a table, and leaves one audit row in any case; returns the row's status.

    'succeeded'; 'failed_qc' where ``check`` gives a reason (nothing is published); 'failed_runtime' where building,
    checking or publishing breaks; 'published_audit_failed' where the table is out and its audit row could not be written (a second
    try writes that). All but the first raise.
    """
    def leave(status: str, reason: str | None) -> None:
        audit(failure_record(spark, run_id, status, reason))

    try:
        df = build()
        reason = check(df)
        if reason is None:
            publish(df)
    except Exception as error:
        leave("failed_runtime", f"{type(error).__name__}: {error}"[:1_000])
        raise
    if reason is not None:
        leave("failed_qc", reason)
        raise ValueError(f"not published: {reason}")
    try:
        leave("succeeded", None)
    except Exception as error:
        leave("published_audit_failed", f"{type(error).__name__}: {error}"[:1_000])
        raise
    return "succeeded"


def extract(df: DataFrame, order: list, path: str, file_format: str = "json") -> None:
    """Ordered rows as JSON or CSV files; ranges of the order become files."""
    df.orderBy(*order).write.mode("overwrite").format(file_format).option("header", True).save(path)
