"""Series and study inventories, slice spacing and order, geometry issues, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_filled, path_part
from .stats import average_rank, correlation, first_mode

KEY = ["study_uid", "series_uid"]


def with_identity(headers: DataFrame) -> DataFrame:
    """Study and series of each record: the header's, else those of its path, else the empty text."""
    study = first_filled("StudyInstanceUID", path_part("relative_path", 0))
    series = first_filled("SeriesInstanceUID", path_part("relative_path", 1))
    return headers.withColumns({"study_uid": study, "series_uid": series})


def identified(records: DataFrame) -> DataFrame:
    """Records that belong to a series: those without study or series stay out of grouped results only."""
    return records.where("study_uid <> '' and series_uid <> ''")


def encounter_order() -> Column:
    """A total order of records that doesn't depend on partitions."""
    return F.col("relative_path")


def spacing(records: DataFrame) -> DataFrame:
    """Median distance of neighbouring slices and its variation (population deviation over mean), for each series."""
    order = Window.partitionBy(*KEY).orderBy("position_scalar")
    gaps = records.where("position_scalar is not null").select(*KEY, (F.col("position_scalar") - F.lag("position_scalar").over(order)).alias("gap"))
    mean = F.avg("gap")
    return gaps.groupBy(*KEY).agg(F.percentile("gap", F.lit(0.5)).alias("spacing_median"), F.when(mean > 1e-8, F.stddev_pop("gap") / mean).alias("spacing_cv"))


def order_agreement(records: DataFrame) -> DataFrame:
    """Spearman correlation of position and instance number over records that have both, with the number of them."""
    pairs = records.where("position_scalar is not null and instance_number is not null")
    ranked = pairs.select(*KEY, average_rank(KEY, "position_scalar").alias("_p"), average_rank(KEY, "instance_number").alias("_i"))
    return ranked.groupBy(*KEY).agg(correlation("_p", "_i").alias("order_spearman"), F.count("*").alias("order_pairs"))


def last_row_wins(metadata: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return metadata.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def series_inventory(records: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row for each series: counts, bytes, errors, modes, spacing, slice order; ``metadata`` (series_uid, plane, ...) joined by series.

    Takes study_uid, series_uid, relative_path, status, size_bytes, position_scalar, instance_number, derived_plane, manufacturer,
    rows, columns, patient_hash.  Records with errors count, and their missing sizes are zero.

    Everything is made over one dealing of the records by series: windows that only add to the series in their partition keys
    need no other, and the aggregate none either, so the records are read and shuffled once.
    """
    by = lambda *more: Window.partitionBy(*KEY, *more)
    order = encounter_order()
    both = F.col("position_scalar").isNotNull() & F.col("instance_number").isNotNull()
    rows = identified(records).withColumn("_both", both).withColumns(
        {
            "_gap": F.col("position_scalar") - F.lag("position_scalar").over(by().orderBy(F.asc_nulls_last("position_scalar"))),
            "_p": F.when(both, average_rank([*KEY, "_both"], "position_scalar")),
            "_i": F.when(both, average_rank([*KEY, "_both"], "instance_number")),
            "_planes": F.count("*").over(by("derived_plane")), "_plane_at": F.min(order).over(by("derived_plane")),
            "_vendors": F.count("*").over(by("manufacturer")), "_vendor_at": F.min(order).over(by("manufacturer")),
        }
    )
    mode = lambda value, n, at: F.min_by(value, F.when(F.length(value) > 0, F.struct((-F.col(n)).alias("n"), F.col(at).alias("at"))))
    mean = F.avg("_gap")
    out = rows.groupBy(*KEY).agg(
        F.count("*").alias("file_count"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"), F.count_if(F.col("status") != "ok").alias("error_count"),
        F.count("position_scalar").alias("position_count"), (F.count("position_scalar") - F.size(F.collect_set("position_scalar"))).alias("duplicate_positions"),
        F.size(F.collect_set("rows")).cast("long").alias("distinct_rows"), F.size(F.collect_set("columns")).cast("long").alias("distinct_columns"),
        F.min_by("patient_hash", F.when(F.length("patient_hash") > 0, order)).alias("patient_hash"),
        mode("derived_plane", "_planes", "_plane_at").alias("plane_mode"), mode("manufacturer", "_vendors", "_vendor_at").alias("vendor_mode"),
        F.percentile("_gap", F.lit(0.5)).alias("spacing_median"), F.when(mean > 1e-8, F.stddev_pop("_gap") / mean).alias("spacing_cv"),
        correlation("_p", "_i").alias("order_spearman"), F.count("_p").alias("order_pairs"),
    )
    return out if metadata is None else out.join(metadata, "series_uid", "left")


def plane_conflict(metadata_plane: str = "metadata_plane", derived: str = "plane_mode", missing_conflicts: bool = False) -> Column:
    """Whether a series' stated plane differs from the derived one; ``missing_conflicts`` counts a missing statement as one."""
    stated, found = F.col(metadata_plane), F.col(derived)
    return F.coalesce(stated != found, F.lit(missing_conflicts) if missing_conflicts else F.lit(False)) | (stated.isNotNull() & (stated != "") & found.isNull())


def geometry_issues(inventory: DataFrame, least_agreement: float = 0.9, least_pairs: int = 3) -> DataFrame:
    """Series with a plane conflict, duplicated positions or slices out of order, their issues joined by ';'."""
    issues = F.array_compact(
        F.array(
            F.when(plane_conflict(), F.lit("plane_conflict")),
            F.when(F.col("duplicate_positions") > 0, F.lit("duplicate_position")),
            F.when((F.col("order_pairs") >= least_pairs) & (F.abs(F.round("order_spearman", 9)) < least_agreement), F.lit("order_disagreement")),
        )
    )
    return inventory.withColumn("issues", F.concat_ws(";", issues)).where("issues <> ''")


def study_inventory(records: DataFrame) -> DataFrame:
    """One row for each study: series, files, bytes."""
    return identified(records).groupBy("study_uid").agg(F.count_distinct("series_uid").alias("series_count"), F.count("*").alias("file_count"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"))


def failures(records: DataFrame, stage: str) -> DataFrame:
    """Records that a stage could not read."""
    return records.where("status <> 'ok' or status is null").select(F.lit(stage).alias("stage"), "relative_path", "error_type", F.substring("error_message", 1, 1000).alias("error_message"))


def quarantine(headers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Failures of both stages."""
    return failures(headers, "header").unionByName(failures(pixels, "pixel"))


def without_quarantined(records: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Records that aren't in quarantine."""
    return records.join(quarantined.select("relative_path").distinct(), "relative_path", "left_anti")


def upsert(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of records with one key the last by ``order``."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) for o in order)))).where("_n = 1").drop("_n")


def shard_tally(records: DataFrame, shard: str = "shard") -> DataFrame:
    """Files, read and failed, of each shard."""
    return records.groupBy(shard).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("errors"))


def dataset_levels(records: DataFrame) -> DataFrame:
    """Files, distinct series and distinct studies of the corpus in one row."""
    return records.agg(F.count("*").alias("files"), F.count_distinct("series_uid").alias("series"), F.count_distinct("study_uid").alias("studies"))
