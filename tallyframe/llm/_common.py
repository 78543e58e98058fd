"""Helpers that the operators of this subpackage share: scratch tables, Arrow blocks, local components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts of this subpackage define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a session on one machine (tests) may leave it unset: it gets a
    folder there. On a cluster no folder of one machine would do, so a missing setting is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The file system and path object of ``path``, on whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tallyframe/{what}-{uuid.uuid4().hex}"
        self.saved: list[tuple[DataFrame, str]] = []
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.root}/{self.count}", self.count + 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.saved.append((table, path))
        return table

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing lazy still reads."""
        for table, path in [x for x in self.saved if x[0] is df]:
            delete(self.spark, path)
            self.saved = [x for x in self.saved if x[1] != path]


def one_of_each(docs: DataFrame, classed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each class of ``classed`` (id, doc: xxhash64 of the text, class): the one of the smallest id.

    An id with texts of several classes may keep several rows. Rows with a null id stay.
    """
    key = next(c for c in (f"_doc{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    first = classed.where(F.col(id_col).isNotNull()).groupBy("class").agg(F.min(F.struct(F.col(id_col).alias("id"), F.col("doc").alias("doc"))).alias("f"))
    first = first.select(F.col("f.id").alias(id_col), F.col("f.doc").alias(key))
    named = docs.where(F.col(id_col).isNotNull()).withColumn(key, F.xxhash64(text_col))
    kept = named.join(first, [id_col, key], "left_semi").dropDuplicates([id_col, key]).drop(key)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def uniform(*columns: Column | str, seed: str = "") -> Column:
    """A number in (0, 1) that depends on the values only; DuckDB can repeat it from md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def byte_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets of a binary or string array, without copying; a null has no bytes."""
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64) if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together (one row, where it alone has more)."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        high = min(high, n)
        yield low, high
        low = high


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a partition sorted by ``keys``, cut so that no run of equal keys is divided.

    A table has fewer than ``rows`` rows more than its last run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        got = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(got.num_rows, bool)
        for k in keys:
            column = got.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts, low = np.flatnonzero(new), 0
        while (at := np.searchsorted(starts, low + rows)) < len(starts):
            yield got.slice(low, starts[at] - low)
            low = int(starts[at])
        held = got.slice(low).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            return root
