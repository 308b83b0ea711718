"""Pieces the text and embedding operators share: written tables, small Arrow batches, remainders, components.

Intermediate results are written as Parquet below the folder in ``spark.checkpoint.dir`` (shared by all executors on a
cluster) and read back, so a lost executor costs a re-read and never a re-run of the whole lineage.
"""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.joins import heavy_keys, spread_join
from ..functions.scratch import discard, scratch_root
from ..operators.graph import components

#: Rows and bytes that go to a Python worker at a time; documents can be long.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Tables that operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def release_memory(keep: dict | None = None) -> None:
    """Forget what other operators keep in this Python worker and give freed memory back to the system.

    A worker lives on after its task and serves the stages that follow, and would hold their predecessors' tables and peak beside its own."""
    for kept in KEPT:
        if kept is not keep:
            kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, which cuts its lineage."""
    bound_batches(df.sparkSession)
    return scratch.materialize(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per_part: int) -> int:
    """How many parts of at most about ``per_part`` rows ``rows`` make."""
    return max(1, math.ceil(rows / per_part))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder_of_crc32(column: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an integer column, modulo ``modulus``."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest vertex reachable, for every vertex that has an edge to another.

    ``edges`` has long columns ``a`` and ``b``; null ends are ignored and an empty table gives an empty result.
    """
    return components(edges.where("a <> b"), "a", "b", shuffle=False)


__all__ = ["KEPT", "bound_batches", "connected_components", "discard", "heavy_keys", "materialize", "parts_for", "release_memory", "remainder_of_crc32", "scratch_root", "shuffle_width", "spread_join", "table"]
