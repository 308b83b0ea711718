"""Tables in the shared folder that cut lineage: written as Parquet, read back, deleted when nothing reads them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all of Spark is this process, as in tests, a temporary one.

    On a cluster every executor would write to a folder of its own and the tables come back in part, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="radiolith-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a materialized table."""
    path = getattr(df, "_scratch_path", None)
    if path:
        session = df.sparkSession
        target = session._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
