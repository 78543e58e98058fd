"""Raw files: the inventory that describes them, scans with lineage, manifests and exceptions."""

from __future__ import annotations

import csv
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.scratch import saved

#: Files whose years are broadcast; those of more files are joined by a shuffle.
BROADCAST = 1_000_000
#: Entities whose files are of one year each.
YEARLY = ("beneficiary_summary",)


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file that a JSON document lists under ``files``, with its position there."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("files").alias("position", "f")).select("position", "f.*")


def grouped_entries(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(*sorted(set(inventory.columns) - {"entity"})))).alias("entries"))


def entry_year(columns: list[str]) -> Column:
    """The first 20xx in the first of the columns that holds one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.col(c), r"(20\d{2})", 1), F.lit("")) for c in columns)).cast("int")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, size): files under a folder; none where the folder does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, file_name string, size long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"))


def file_years(spark: SparkSession, paths: list[str], entity: str, inventory: DataFrame, yearly: tuple[str, ...] = YEARLY) -> DataFrame:
    """(file, year): for each file of a yearly entity the year of the last entry whose name its own name contains.

    Files of other entities, and files that no entry names, have no row. A file meets entries by the parts of its name
    that are as long as some entry's name, so no file is compared with all entries.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    position = F.col("position") if "position" in inventory.columns else F.lit(0)
    named = inventory.where((F.col("entity") == entity) & F.lit(entity in yearly)).select("file_name", F.col("year").cast("int").alias("year"), position.alias("position"))
    lengths = named.agg(F.collect_set(F.length("file_name")).alias("lengths"))  # one row; a name's length has a limit
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("file") - n + 1), lambda i: F.substring(F.col("file"), i, n))
    fitting = F.filter("lengths", lambda n: n <= F.length("file"))
    cut = files.distinct().crossJoin(F.broadcast(lengths)).select("file", F.explode(F.array_distinct(F.flatten(F.transform(fitting, parts)))).alias("file_name"))
    return cut.join(named, "file_name").groupBy("file").agg(F.max_by("year", F.struct("position", "file_name")).alias("year"))


def of_files(paths: DataFrame, name: str, of: Callable[[pyarrow.fs.FileSystem, str], str]) -> DataFrame:
    """``paths`` (path and more) with a string column that ``of`` makes of each file, opened where the row is: local files and
    the stores that Arrow knows (hdfs, s3, gcs, abfs)."""
    fields = ", ".join(f"`{c}` {t}" for c, t in paths.dtypes)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(*pyarrow.fs.FileSystem.from_uri(quote(p, safe=":/@"))) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    return paths.mapInArrow(made, f"{fields}, {name} string")


def _first_line(fs: pyarrow.fs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as stream:
        line = b""
        while b"\n" not in line and (more := stream.read(1 << 14)):
            line += more
    return line.split(b"\n", 1)[0].removesuffix(b"\r").removeprefix(b"\xef\xbb\xbf").decode()


def read_by_header(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """CSV files as strings, columns by their names: files are grouped by header, each group is one scan, and columns that
    a group lacks are null. A header's sides and quotes are CSV's; empty files have no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length").where("length > 0 and not startswith(element_at(split(path, '/'), -1), '_')")
    groups = defaultdict(list)
    for r in of_files(files, "header", _first_line).select("path", "header").collect():  # one row for each file, as the scan names them all
        groups[r.header].append(r.path)
    if not groups:
        raise ValueError("no rows in any file")
    scans = []
    for header in sorted(groups):
        names = next(csv.reader([header], delimiter=sep))
        scan = spark.read.option("header", True).option("sep", sep).csv(groups[header])
        scans.append(scan.toDF(*names) if len(set(names)) == len(names) == len(scan.columns) else scan)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_bronze_source_file")) for x in scans])


def read_raw(spark: SparkSession, paths: list[str], entity: str, inventory: DataFrame | None = None, key: str | None = None, file_format: str = "csv", sep: str = ",", yearly: tuple[str, ...] = YEARLY) -> DataFrame:
    """All files of an entity as strings (see ``read_by_header``), with lineage: entity, load time, file, year (see ``file_years``; else null) and key."""
    if not paths:
        raise ValueError(f"no files for {entity}")
    if file_format != "csv":
        raise ValueError(f"{entity}: only csv is read, not {file_format}")
    raw = read_by_header(spark, paths, sep)
    raw = raw.withColumns({"_bronze_entity": F.lit(entity), "_bronze_loaded_at_utc": F.current_timestamp(), "_expected_join_key": F.lit(key).cast("string")})
    if inventory is None or entity not in yearly:
        return raw.withColumn("_bronze_source_year", F.lit(None).cast("int"))
    years = file_years(spark, paths, entity, inventory, yearly).withColumnsRenamed({"file": "_bronze_source_file", "year": "_bronze_source_year"})
    years = saved(years, "file-years")  # one row for each file of the entity
    return raw.join(F.broadcast(years) if years.count() <= BROADCAST else years, "_bronze_source_file", "left")


#: Files up to this size are read as one value for the checksum of their bytes, larger ones as a stream.
WHOLE = 1 << 26


def _sha256(fs: pyarrow.fs.FileSystem, path: str) -> str:
    found = hashlib.sha256()
    with fs.open_input_stream(path) as stream:
        while block := stream.read(1 << 23):
            found.update(block)
    return found.hexdigest()


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, file_name, size, sha256) of the files under a folder, of any size.

    A digest can't be put together from parts, so each file has one task's time; a file above ``whole`` bytes is read as a
    stream of 8 MB blocks and takes no more memory than that. Spark's scans leave out empty files, so these have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    small = files.where(F.col("length") <= whole).select("path", name, F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", name, F.col("length").alias("size"))
    return small.unionByName(of_files(large, "sha256", _sha256))


def manifest(spark: SparkSession, path: str, inventory: DataFrame) -> DataFrame:
    """Listed files that are there, with size, SHA-256 of their bytes and expected rows. Sizes come from the listing."""
    return inventory.join(file_digests(spark, path).drop("path"), "file_name")


def content_checksums(df: DataFrame) -> DataFrame:
    """(file_name, row_count, checksum) of the files that ``df`` is read from: a sum over hashes of rows, in any order, read in splits."""
    rows = df.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), F.xxhash64(*df.columns).alias("h"))
    return rows.groupBy("file_name").agg(F.count("*").alias("row_count"), F.hex(F.pmod(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")).alias("checksum"))


def exceptions(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that did not arrive."""
    return inventory.join(files, "file_name", "left_anti").withColumn("reason", F.lit("missing"))


def audit_rows(entries: DataFrame, validation: DataFrame) -> DataFrame:
    """One row for each file of an entity with the entity's validation counts.

    entries: entity, raw_names and extracted_names (arrays); the names are paired in order, the shorter side filled up with null.
    """
    pairs = entries.select("entity", F.explode_outer(F.arrays_zip("raw_names", "extracted_names")).alias("p")).select("entity", F.col("p.raw_names").alias("raw_name"), F.col("p.extracted_names").alias("extracted_name"))
    return pairs.join(validation, "entity", "left")
