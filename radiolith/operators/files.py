"""File inventories in shards, and the choice of shards."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import blake2b_shard, stable_shard
from ..functions.scratch import materialize
from ..sources import ranged


def parse_shards(text: str, shards: int) -> list[int]:
    """'all', or numbers and ranges such as '0,3,5-10'; what is outside 0..shards-1 is a ValueError."""
    if text.strip().lower() == "all":
        return list(range(shards))
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        try:
            first, last = int(low), int(high or low)
        except ValueError:
            raise ValueError(f"{part!r} is no shard or range") from None
        if not 0 <= first <= last < shards:
            raise ValueError(f"shard {part!r} is outside 0..{shards - 1}")
        out.update(range(first, last + 1))
    return sorted(out)


def list_files(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """relative_path, size_bytes and mtime_us of every file below ``root``, whatever its extension, empty ones too; file contents are not read.

    Names that begin with a dot or an underscore, and what lies in such folders, are left out unless ``include_hidden``.  Folders are listed level by level,
    each by the tasks that hold their names.  Where Arrow doesn't reach the file system Spark's own listing is used, which knows no empty files, or, for hidden
    ones, the driver's.
    """
    base = _qualified(spark, root)
    if ranged.reaches(base):
        return _listed(spark, base, include_hidden)
    if include_hidden:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        rows, files = [], path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            rows.append((f.getPath().toString()[len(base) + 1 :], f.getLen(), f.getModificationTime() * 1000))
        return spark.createDataFrame(rows, "relative_path string, size_bytes long, mtime_us long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    relative = F.expr(f"substr(path, {len(base) + 2})")
    return found.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime_us"))


def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def _listed(spark: SparkSession, base: str, include_hidden: bool) -> DataFrame:
    found, folders = [], spark.createDataFrame([("",)], "relative_path string")
    while True:
        level = ranged.children(folders, base)
        if not include_hidden:
            level = level.where(~F.col("relative_path").rlike("(^|/)[._][^/]*$"))
        level = materialize(level, "listing")
        found.append(level.where("not is_folder").drop("is_folder"))
        folders = level.where("is_folder").select("relative_path")
        count = folders.count()
        if not count:
            return reduce(DataFrame.unionByName, found)
        folders = folders.repartition(min(max(1, count // 8), 4 * spark.sparkContext.defaultParallelism))


def file_index(files: DataFrame, shards: int, byte_compatible: bool = False) -> DataFrame:
    """Files with their shard, by MD5 prefix or, for indexes made that way, by BLAKE2b."""
    shard = blake2b_shard if byte_compatible else stable_shard
    return files.withColumn("shard", shard("relative_path", shards))


def index_totals(index: DataFrame) -> DataFrame:
    """Files and bytes of each shard."""
    return index.groupBy("shard").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def write_index(index: DataFrame, path: str, root: str, shards: int, force: bool = False) -> bool:
    """Write an index partitioned by shard with a note of what it is of; False if it is there already.

    An index of another root or number of shards is a ValueError unless ``force``.
    """
    spark = index.sparkSession
    note = read_note(spark, path)
    if note is not None and not force:
        if note != {"root": root, "shards": shards}:
            raise ValueError(f"{path} is an index of {note}, not of root {root!r} in {shards} shards")
        return False
    index.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/files")
    spark.createDataFrame([(json.dumps({"root": root, "shards": shards}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_note(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, f"{path}/note"):
        return None
    return json.loads(spark.read.text(f"{path}/note").first()[0])


def read_index(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """An index, only the partitions of ``shards`` if given."""
    if read_note(spark, path) is None:
        raise FileNotFoundError(f"there is no index at {path}; run the index stage first")
    files = spark.read.parquet(f"{path}/files")
    return files if shards is None else files.where(F.col("shard").isin(shards))
