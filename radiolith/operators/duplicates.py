"""Exact duplicates at file, pixel and series level, and the studies they tie together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import PER_SALT, heavy_keys, spread_join


def duplicate_groups(df: DataFrame, key: str, member: str, level: str) -> DataFrame:
    """Keys that several rows share: level, key, size and the least member, which stands for the group."""
    groups = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("size"), F.min(member).alias("first_member"))
    return groups.where("size > 1").select(F.lit(level).alias("level"), "key", "size", "first_member")


def duplicate_members(df: DataFrame, key: str, member: str, level: str, per_salt: int = PER_SALT) -> DataFrame:
    """A row for each member of a group of :func:`duplicate_groups`: level, key, member, and whether it stands for the group.

    A group can be any share of the table, so its members are rows, not a list, and a large group's are split over tasks.
    """
    groups = duplicate_groups(df, key, member, level)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(member).alias("member"))
    heavy = heavy_keys(groups.select("key", F.col("size").alias("n")), "n", rows.count(), per_salt)
    found = spread_join(rows, groups, ["key"], heavy, F.xxhash64("member"), "inner", shuffle=True)
    return found.select("level", "key", "member", (F.col("member") == F.col("first_member")).alias("stands"))


def slice_order() -> list[Column]:
    """Order of slices: by position, then instance number, those without last, then path."""
    return [F.asc_nulls_last("position_scalar"), F.asc_nulls_last("instance_number"), F.asc("relative_path")]


def series_signatures(slices: DataFrame, keys: list[str], content: str, order: list[Column] | None = None) -> DataFrame:
    """Content of the first, middle and last slice of each series joined by '|' (places that coincide count once), and its length.

    Only slices with content count.  Three picks are three aggregates over row numbers, so no series is gathered in one array.
    """
    w = Window.partitionBy(*keys)
    placed = slices.where(F.col(content).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(*(order or slice_order()))) - 1).withColumn("_n", F.count("*").over(w))
    pick = placed.where("_i = 0 or _i = _n div 2 or _i = _n - 1")
    return pick.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(content).alias("c")))), lambda s: s["c"]), "|").alias("signature"), F.max("_n").alias("slice_count"))


def cross_study_edges(members: DataFrame, key: str, study: str, per_salt: int = PER_SALT) -> DataFrame:
    """Of every key that several studies share, links from the least of them to each other: study_a, study_b, distinct.

    The least study comes from an aggregate and a join, so a key that very many studies share is never gathered in a list, and its studies are split over tasks (a blank slice).
    """
    distinct = members.where(F.col(key).isNotNull() & F.col(study).isNotNull()).select(F.col(key).alias("_k"), F.col(study).alias("study_b")).distinct()
    least = distinct.groupBy("_k").agg(F.min("study_b").alias("study_a"), F.count("*").alias("_n")).where("_n > 1")
    heavy = heavy_keys(least.select("_k", "_n"), "_n", distinct.count(), per_salt)
    return spread_join(distinct, least.drop("_n"), ["_k"], heavy, F.xxhash64("study_b"), "inner", shuffle=True).where("study_a < study_b").select("study_a", "study_b").distinct()


def level_counts(groups: DataFrame) -> DataFrame:
    """Groups and members at each level."""
    return groups.groupBy("level").agg(F.count("*").alias("groups"), F.sum("size").alias("members"))


def hashed_slices(headers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Readable headers with the pixel hash of their file."""
    hashes = pixels.where("status = 'ok' and pixel_sha256 is not null").select("relative_path", "pixel_sha256")
    return headers.where("status = 'ok'").join(hashes, "relative_path")


def find_duplicates(headers: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicate groups of all levels, their members, and the links between studies that the pixel and series levels give."""
    good = headers.where("status = 'ok'")
    hashed = hashed_slices(headers, pixels)
    by_file = pixels.where("status = 'ok'")
    named = hashed.withColumnsRenamed({"StudyInstanceUID": "study_uid", "SeriesInstanceUID": "series_uid"})
    signed = series_signatures(named, ["study_uid", "series_uid"], "pixel_sha256")
    levels = [(good, "SOPInstanceUID", "relative_path", "sop"), (by_file, "pixel_sha256", "relative_path", "pixel"), (signed, "signature", "series_uid", "series_signature")]
    groups, members = (reduce(DataFrame.unionByName, [make(*level) for level in levels]) for make in (duplicate_groups, duplicate_members))
    sop = cross_study_edges(good, "SOPInstanceUID", "StudyInstanceUID")
    edges = sop.unionByName(cross_study_edges(named, "pixel_sha256", "study_uid")).unionByName(cross_study_edges(signed, "signature", "study_uid")).distinct()
    return groups, members, edges
