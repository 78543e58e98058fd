"""Sharding by size-tiered compaction: small immutable shards, merged by tiers, under versioned manifests.

A store is a folder: ``data/<version>/...`` holds Parquet files that are never changed, ``manifests/<id>`` the
shards of one version as a table, ``versions/<number>`` a pointer to a manifest. A version becomes visible by one
rename that fails where the number is taken; what a broken or beaten run has written is never referred to.

Rows, sizes and plans stay in Spark. A reader names its files to Spark, as any read does, so a read of a version holds
a list of its files in the driver; a round of merging names PLANNED of them at most.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm._common import delete, hadoop_path

TARGET = 64 << 20
#: Sizes within one tier differ by this factor at most; so many shards of a tier are merged at a time.
FANOUT = 4
SMALLEST = 1 << 16
#: Shards that one window orders, and that one round merges at most; tiers with more are planned in several parts.
PLANNED = 50_000
#: Seconds for which a folder that no version uses is kept: an append may have written it and not committed yet.
GRACE = 7 * 24 * 3600
#: Tasks of one merge; more runs than that share tasks in turn.
TASKS = 20_000
MANIFEST = "path string, shard string, bytes long, rows long, added int"


def plain_path(path: Column) -> Column:
    """One spelling of local paths, which listings and readers write differently."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_path() -> Column:
    """The file that a row was read from, spelled as listings spell it: readers encode spaces and the like."""
    return plain_path(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target

    def version(self) -> int:
        """The last committed version; 0 for a store without any."""
        fs, folder = hadoop_path(self.spark, f"{self.root}/versions")
        if not fs.exists(folder):
            return 0
        return max([int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, shard (a name that reruns repeat), bytes, rows and added (the version it came with) of each shard."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        pointer = self.spark.read.text(f"{self.root}/versions/{version:08d}").first()
        return self.spark.read.schema(MANIFEST).parquet(pointer[0])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(*paths)

    def commit(self, shards: DataFrame, base: int) -> int:
        """Makes ``shards`` version base + 1, or raises Conflict and leaves the store as it was."""
        name = uuid.uuid4().hex
        table = f"{self.root}/manifests/{name}"
        shards.select("path", "shard", "bytes", "rows", "added").write.parquet(table)
        jvm = self.spark.sparkContext._jvm
        fs, draft = hadoop_path(self.spark, f"{self.root}/drafts/{name}")
        out = fs.create(draft, False)
        out.write(bytearray(table.encode()))
        out.close()
        _, final = hadoop_path(self.spark, f"{self.root}/versions/{base + 1:08d}")
        fs.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Exception as error:
            delete(self.spark, table)
            if fs.exists(final):
                raise Conflict(f"version {base + 1} is there already") from error
            raise
        return base + 1

    def _written(self, folder: str, version: int, name) -> DataFrame:
        """Manifest rows of the files under a folder: sizes from a listing, rows from the files' metadata."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(read_path().alias("path")).agg(F.count("*").alias("rows"))
        return files.withColumn("path", plain_path(F.col("path"))).join(rows, "path").select("path", name(F.col("path")).alias("shard"), "bytes", "rows", F.lit(version).alias("added"))

    def append(self, arrivals: DataFrame) -> int:
        """Writes the rows as small shards, one for each of their partitions, and commits them beside what is there."""
        base = self.version()
        folder = f"{self.root}/data/{base + 1:08d}-{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(folder)
        name = lambda path: F.concat(F.lit(f"v{base + 1:08d}/part-"), F.regexp_extract(path, r"part-(\d+)", 1), F.lit("-"), F.regexp_extract(path, r"-c(\d+)[^/-]*$", 1))
        added = self._written(folder, base + 1, name)
        return self.commit(self.manifest(base).unionByName(added), base)

    def plan(self, shards: DataFrame) -> DataFrame:
        """(path, tier, lot, run_no): the shards to merge and into which file.

        The tier of a shard is the power of FANOUT in its size. Shards near the target size stay. A lot (a tier, or a part
        of PLANNED shards of one) with FANOUT shards or more, or with enough bytes for a file, is cut by
        running size into files of about the target size; a file that one shard would make alone stays that shard.
        """
        small = shards.where(F.col("bytes") * 4 < self.target * 3).withColumn("tier", F.floor(F.log(float(FANOUT), F.greatest(F.col("bytes"), F.lit(SMALLEST)) / SMALLEST)))
        parts = F.broadcast(small.groupBy("tier").agg(F.ceil(F.count("*") / PLANNED).cast("int").alias("lots")))  # one row for each tier
        small = small.join(parts, "tier").withColumn("lot", F.pmod(F.xxhash64("shard"), F.col("lots")).cast("int"))
        lot = W.partitionBy("tier", "lot")
        run = F.sum("bytes").over(lot.orderBy("shard", "path").rowsBetween(W.unboundedPreceding, 0))
        small = small.withColumns({"of_lot": F.count("*").over(lot), "in_lot": F.sum("bytes").over(lot), "run_no": F.floor((run - F.col("bytes") / 2) / self.target).cast("int")})
        small = small.where((F.col("of_lot") >= FANOUT) | (F.col("in_lot") >= self.target))
        small = small.withColumn("of_run", F.count("*").over(W.partitionBy("tier", "lot", "run_no"))).where("of_run > 1")
        return small.select("path", "tier", "lot", "run_no")

    def compact(self) -> int:
        """Merges tier by tier until no tier has enough shards; each round is one job and one committed version.

        Each run has a task of its own, and a run is bounded by the target size, so tasks are even at any size.
        """
        while True:
            base = self.version()
            shards = self.manifest(base)
            plan = self.plan(shards)
            lots = {(r.tier, r.lot): (r.runs, r.n) for r in plan.groupBy("tier", "lot").agg((F.max("run_no") + 1).alias("runs"), F.count("*").alias("n")).orderBy("tier", "lot").collect()}
            chosen, first, files = {}, 0, 0
            for key, (runs, n) in lots.items():  # a round takes whole lots
                if chosen and files + n > PLANNED:
                    break
                chosen[key], first, files = first, first + runs, files + n
            if not chosen:
                return base
            offset = F.create_map(*(x for (tier, lot), at in chosen.items() for x in (F.lit(f"{tier}/{lot}"), F.lit(at))))
            plan = plan.withColumn("no", F.element_at(offset, F.concat_ws("/", "tier", "lot"))).where("no is not null")
            plan = plan.select("path", F.concat_ws("-", "tier", "lot", "run_no").alias("run"), (F.col("no") + F.col("run_no")).alias("no"))
            rows = self.spark.read.parquet(*[r.path for r in plan.select("path").toLocalIterator()])
            run, at, no = (next(c for c in (f"_{what}{i}" for i in range(len(rows.columns) + 1)) if c not in rows.columns) for what in ("run", "path", "no"))
            tasks = min(first, TASKS)
            rows = rows.withColumn(at, read_path())
            rows = rows.join(plan.withColumnsRenamed({"path": at, "run": run, "no": no}), at)
            folder = f"{self.root}/data/{base + 1:08d}-{uuid.uuid4().hex}"
            rows.repartitionById(tasks, F.col(no) % tasks).drop(at, no).write.partitionBy(run).option("compression", "zstd").parquet(folder)
            name = lambda path: F.concat(F.lit(f"v{base + 1:08d}/"), F.regexp_extract(path, r"=([^/=]+)/[^/]*$", 1))  # noqa: B023,E731
            merged = self._written(folder, base + 1, name)
            self.commit(shards.join(plan, "path", "left_anti").unionByName(merged), base)

    def vacuum(self, versions: int = 1, grace: float = GRACE) -> list[str]:
        """Deletes the data folders of which none of the last ``versions`` versions uses a file, and that are older than
        ``grace`` seconds, so that no append is hit that is still to be committed; returns their names.

        Readers of older versions lose them. Nothing calls this by itself.
        """
        fs, folder = hadoop_path(self.spark, f"{self.root}/data")
        if not fs.exists(folder):
            return []
        home = re.sub("^file:/+", "file:/", fs.makeQualified(folder).toString()) + "/"
        last, used = self.version(), set()
        for version in range(max(1, last - versions + 1), last + 1):
            inside = F.when(F.startswith("path", F.lit(home)), F.substring_index(F.substr("path", F.lit(len(home) + 1)), "/", 1))
            used |= {r.f for r in self.manifest(version).select(inside.alias("f")).distinct().toLocalIterator()}
        if None in used:
            raise ValueError(f"a version refers to files outside of {home}; nothing was deleted")
        gone, now = [], time.time() * 1000
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name not in used and now - status.getModificationTime() > grace * 1000:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return gone

    def members(self, columns: list[str]) -> DataFrame:
        """The given columns of all rows, with the shard that holds them: shard, shard_rows, shard_bytes, added."""
        shards = self.manifest()
        paths = [r.path for r in shards.select("path").toLocalIterator()]
        rows = self.spark.read.parquet(*paths).select(*columns, read_path().alias("_path"))
        named = shards.select(F.col("path").alias("_path"), "shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "added")
        return rows.join(named, "_path").drop("_path")


def shard(docs: DataFrame, root: str, id_col: str = "doc_id", target: int = TARGET) -> DataFrame:
    """Appends ``docs`` to the store at ``root``, compacts it, and returns (id, shard, shard_rows, added) of each row in it.

    Rows are neither changed nor told apart, so nulls, repeated rows and any other columns are kept as they are.
    An empty table adds a version without rows and gives an empty result. What merging supersedes stays for readers of
    older versions until ``vacuum``.
    """
    store = ShardStore(docs.sparkSession, root, target)
    store.append(docs)
    store.compact()
    if store.manifest().isEmpty():
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {dict(docs.dtypes)[id_col]}, shard string, shard_rows long, added int")
    return store.members([id_col]).select(id_col, "shard", "shard_rows", "added")
