"""Study manifests: ordered slices, neighbour windows, labels, and montage slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamped_neighbours, uniform_indices


def slice_order() -> list[Column]:
    """By position (missing last), instance number (missing first), path."""
    return [F.asc_nulls_last("position_scalar"), F.asc_nulls_first("instance_number"), F.asc("relative_path")]


def ordered_slices(slices: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Slices with their place ``i`` in the series, from 0, and the series' length ``n``."""
    w = Window.partitionBy(*keys)
    return slices.withColumn("i", F.row_number().over(w.orderBy(*(order or slice_order()))) - 1).withColumn("n", F.count("*").over(w).cast("int"))


def neighbour_windows(slices: DataFrame, keys: list[str], item: str, max_windows: int = 0, offsets=(-1, 0, 1), order: list[Column] | None = None, plane: str | None = None) -> DataFrame:
    """Windows of each series: evenly spread centers, the items around each (clamped at the ends), place and length.

    A series is gathered in an array of its items, which is bounded by what a scan has.
    """
    placed = ordered_slices(slices, keys, order)
    fields = [F.col("i"), F.col(item).alias("item"), (F.col(plane) if plane else F.lit(None).cast("string")).alias("plane")]
    series = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
    series = series.select(*keys, F.col("_s.item").alias("items"), F.get(F.col("_s.plane"), F.floor(F.size("_s") / 2).cast("int")).alias("middle_plane"))
    series = series.withColumn("series_length", F.size("items")).withColumn("center", F.explode(uniform_indices("series_length", max_windows)))
    position = F.col("center") / F.greatest(F.lit(1), F.col("series_length") - 1)
    return series.select(*keys, F.col("center").alias("center_index"), clamped_neighbours("items", "center", offsets).alias("paths"), position.alias("relative_position"), "series_length", "middle_plane")


def study_manifest(windows: DataFrame, series_meta: DataFrame | None, labels: DataFrame | None, patients: DataFrame | None = None, study: str = "study_uid", series: str = "series_uid") -> DataFrame:
    """One row for each study: its windows in order of series and center, its labels (NULL if unknown) and patient hash.

    ``series_meta`` has the series, plane and fluid_sensitive; a missing plane is that of the middle slice.  ``labels`` has the study
    and an array; ``patients`` the study and a hash.
    """
    if series_meta is not None:
        windows = windows.join(series_meta.select(series, F.col("plane").alias("_plane"), F.col("fluid_sensitive").cast("double").alias("_fluid")), series, "left")
    else:
        windows = windows.withColumns({"_plane": F.lit(None).cast("string"), "_fluid": F.lit(None).cast("double")})
    window = F.struct(F.col(series).alias("series_id"), "center_index", "paths", F.coalesce("_plane", "middle_plane", F.lit("Unknown")).alias("plane"), F.col("_fluid").alias("fluid_sensitive"), "relative_position", "series_length", F.lit(None).cast("array<double>").alias("evidence_targets"))
    out = windows.groupBy(F.col(study).alias("study_id")).agg(F.array_sort(F.collect_list(window)).alias("windows"))
    for side, name in ((labels, "labels"), (patients, "patient_hash")):
        if side is not None:
            out = out.join(side.withColumnRenamed(study, "study_id"), "study_id", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("array<double>" if name == "labels" else "string"))
    return out.select("study_id", "patient_hash", "labels", "windows")


def first_patient(slices: DataFrame, study: str = "study_uid", series: str = "series_uid") -> DataFrame:
    """Patient hash of the first slice of a study's first series, NULL if that has none."""
    first = F.struct(F.col(series), F.coalesce("position_scalar", F.lit(float("inf"))), F.coalesce("instance_number", F.lit(float("-inf"))), F.col("relative_path"))
    return slices.groupBy(study).agg(F.min_by("patient_hash", first).alias("patient_hash"))


def label_arrays(table: DataFrame, study: str, columns: list[str]) -> DataFrame:
    """Study and array of its labels; columns that a table doesn't have are NULL elements."""
    from ..functions.exprs import finite

    return table.select(study, F.array(*(finite(c) if c in table.columns else F.lit(None).cast("double") for c in columns)).alias("labels"))


def windows_of(manifest: DataFrame) -> DataFrame:
    """A manifest with one row for each window."""
    return manifest.select("study_id", "patient_hash", "labels", F.posexplode("windows").alias("window_index", "w")).select("study_id", "patient_hash", "labels", "window_index", "w.*")


def without_windows(manifest: DataFrame) -> DataFrame:
    """Studies that can't be used because they have no window."""
    return manifest.where("windows is null or size(windows) = 0").select("study_id")


def montage_slots(windows: DataFrame, per_slot: int = 9) -> DataFrame:
    """Up to ``per_slot`` evenly spread windows of each study, plane and fluid sensitivity, by the path in their middle."""
    keys = ["study_id", "plane", "fluid_sensitive"]
    w = Window.partitionBy(*keys)
    placed = windows.withColumn("_i", F.row_number().over(w.orderBy("window_index")) - 1).withColumn("_n", F.count("*").over(w))
    step = (F.col("_n") - 1) / F.lit(float(max(per_slot - 1, 1)))
    # Item _i is chosen if some of the evenly spread places rounds to it.
    chosen = F.exists(F.sequence(F.lit(0), F.lit(per_slot - 1)), lambda s: F.bround(s * step, 0) == F.col("_i"))
    return placed.where((F.col("_n") <= per_slot) | chosen).select(*keys, F.col("_i").alias("slot_index"), F.get("paths", F.floor(F.size("paths") / 2).cast("int")).alias("path"))


def shuffled_sample(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` rows in an order that only depends on the seed and the key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(count)
