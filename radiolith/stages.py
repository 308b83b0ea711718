"""The audit's stages over a folder: each reads what its predecessors wrote and can be run for some shards or again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.constants import LABELS
from .operators import duplicates, files, labels, manifest, series, split, stats
from .sources import dicom, tables


def index(spark: SparkSession, dicom_root: str, audit_root: str, shards: int = 128, include_hidden: bool = False, force: bool = False) -> DataFrame:
    """List the files once and deal them to shards; returns files and bytes of each."""
    found = files.file_index(files.list_files(spark, dicom_root, include_hidden), shards)
    files.write_index(found, f"{audit_root}/index", dicom_root, shards, force)
    return files.index_totals(files.read_index(spark, f"{audit_root}/index"))


def _by_shard(spark: SparkSession, audit_root: str, stage: str, shards: str, force: bool, read: Callable[[str, list[int]], DataFrame]) -> DataFrame:
    """Run a reader (of the corpus' root and shards) over the chosen shards that aren't done (or all, with ``force``), writing a partition for each."""
    note = files.read_note(spark, f"{audit_root}/index")
    if note is None:
        raise FileNotFoundError("the index stage comes first")
    wanted = files.parse_shards(shards, note["shards"])
    out = f"{audit_root}/{stage}"
    if not force and files.exists(spark, out):
        done = {r[0] for r in spark.read.parquet(out).select("shard").distinct().collect()}
        wanted = [s for s in wanted if s not in done]
    if wanted:
        index_ = files.read_index(spark, f"{audit_root}/index", wanted).select("relative_path", F.col("shard").cast("int").alias("shard"))
        rows = read(note["root"], wanted).join(index_, "relative_path")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out)
    return series.shard_tally(spark.read.parquet(out).where(F.col("shard").isin(files.parse_shards(shards, note["shards"]))))


def headers(spark: SparkSession, audit_root: str, salt_file: str, shards: str = "all", force: bool = False) -> DataFrame:
    salt = tables.get_or_create_salt(salt_file)
    return _by_shard(spark, audit_root, "headers", shards, force, lambda root, wanted: dicom.read_headers(spark, root, salt, index=f"{audit_root}/index/files", shards=wanted))


def pixels(spark: SparkSession, audit_root: str, deep_rate: float = 0.01, shards: str = "all", force: bool = False) -> DataFrame:
    return _by_shard(spark, audit_root, "pixels", shards, force, lambda root, wanted: dicom.read_pixels(spark, root, deep_rate, True, files.read_index(spark, f"{audit_root}/index", wanted)))


def _table(spark: SparkSession, audit_root: str, stage: str, schema) -> DataFrame:
    if not files.exists(spark, f"{audit_root}/{stage}"):
        raise FileNotFoundError(f"the {stage} stage comes first")
    return tables.read_parquet_or_empty(spark, f"{audit_root}/{stage}", schema)


def records_of(header_rows: DataFrame) -> DataFrame:
    """Header rows under the names that the inventories use."""
    named = {"InstanceNumber": "instance_number", "Manufacturer": "manufacturer", "Rows": "rows", "Columns": "columns", "file_size_bytes": "size_bytes"}
    return series.with_identity(header_rows).withColumnsRenamed(named)


def summarize(spark: SparkSession, audit_root: str, series_csv: str | None = None, labels_csv: str | None = None) -> dict:
    """Inventories, issues, failures and label audits as tables below the audit's folder, and a report of them."""
    head = _table(spark, audit_root, "headers", tables.HEADER)
    records = records_of(head)
    meta = None
    if series_csv:
        meta = tables.read_series(spark, series_csv).select(F.col("SeriesInstanceUID").alias("series_uid"), F.col("Anatomical_Plane").alias("metadata_plane"), F.col("Fluid_Sensitive").alias("fluid_sensitive"))
    inventory = series.series_inventory(records, meta)
    if meta is None:
        inventory = inventory.withColumn("metadata_plane", F.lit(None).cast("string"))
    out = f"{audit_root}/summary"
    tables.write_parquet(inventory, f"{out}/series_inventory")
    inventory = spark.read.parquet(f"{out}/series_inventory")
    tables.write_parquet(series.study_inventory(records), f"{out}/study_inventory")
    tables.write_csv(series.geometry_issues(inventory), f"{out}/geometry_issues")
    pixel_rows = tables.read_parquet_or_empty(spark, f"{audit_root}/pixels", tables.PIXELS)
    tables.write_csv(series.quarantine(head, pixel_rows), f"{out}/quarantine")
    rows = lambda df: [r.asDict() for r in df.collect()]
    summary = {
        "levels": rows(series.dataset_levels(records))[0],
        "frequencies": rows(stats.frequencies(head.withColumns({"status": F.col("status"), "derived_plane": F.coalesce("derived_plane", F.lit("Unknown"))}), ["status", "error_type", "derived_plane", "TransferSyntaxUID", "Manufacturer", "ManufacturerModelName"]).orderBy("field", F.desc("n"), "value").limit(500)),
        "numbers": rows(stats.numeric_summary(head, ["header_seconds", "file_size_bytes", "MagneticFieldStrength"])),
        "pixels": rows(stats.numeric_summary(pixel_rows, ["decode_seconds"])),
        "series": rows(stats.numeric_summary(inventory, ["file_count", "spacing_median", "spacing_cv", "order_spearman"])),
    }
    if labels_csv:
        table = tables.read_labels(spark, labels_csv)
        have = [c for c in LABELS if c in table.columns]
        # Plain column names: expressions and pivots don't need to quote them.
        plain = table.toDF("StudyInstanceUID", *(c.replace(" ", "_").replace("'", "") for c in have))
        names = plain.columns[1:]
        vendor = stats.first_mode(series.identified(records), ["study_uid"], "manufacturer", series.encounter_order(), "vendor").withColumnRenamed("study_uid", "StudyInstanceUID")
        with_vendor = plain.join(vendor, "StudyInstanceUID", "left")
        tables.write_parquet(labels.label_inventory(plain, names).join(labels.prevalence_intervals(plain.where(labels.gold_numeric(names)), names), "label", "left"), f"{out}/label_inventory")
        tables.write_csv(labels.as_matrix(labels.correlations(plain, names), names, "correlation"), f"{out}/label_correlation")
        pairs = labels.co_occurrence(plain, names)
        tables.write_csv(labels.as_matrix(pairs, names, "together"), f"{out}/label_cooccurrence")
        tables.write_csv(labels.as_matrix(pairs, names, "jaccard"), f"{out}/label_jaccard")
        tables.write_csv(labels.label_domains(with_vendor, names, "vendor"), f"{out}/label_domains")
        summary["labels"] = rows(labels.label_inventory(plain, names).orderBy("label"))
        summary["positives per study"] = rows(labels.positives_histogram(plain, names).orderBy("positives"))
    return summary


def coverage(spark: SparkSession, audit_root: str, labels_csv: str) -> DataFrame:
    """How much of the label table is on disk."""
    found = files.read_index(spark, f"{audit_root}/index")
    disk = found.select(F.get(F.split("relative_path", "/"), F.lit(0)).alias("study_uid")).distinct()
    table = tables.read_labels(spark, labels_csv).withColumnRenamed("StudyInstanceUID", "study_uid")
    return labels.coverage(table, disk, labels.gold_raw([f"`{c}`" for c in LABELS]))


def find_duplicates(spark: SparkSession, audit_root: str) -> DataFrame:
    """Duplicate groups, their members and links between studies as tables; returns groups and members of each level."""
    groups, members, edges = duplicates.find_duplicates(_table(spark, audit_root, "headers", tables.HEADER).withColumnRenamed("InstanceNumber", "instance_number"), _table(spark, audit_root, "pixels", tables.PIXELS))
    tables.write_parquet(groups, f"{audit_root}/duplicates/groups")
    tables.write_parquet(members, f"{audit_root}/duplicates/members")
    tables.write_csv(edges, f"{audit_root}/duplicates/edges", ["study_a", "study_b"])
    return duplicates.level_counts(spark.read.parquet(f"{audit_root}/duplicates/groups"))


def build_manifest(spark: SparkSession, audit_root: str, out: str, series_csv: str | None = None, labels_csv: str | None = None, max_windows: int = 0, offsets=(-1, 0, 1)) -> DataFrame:
    """One row for each study with its windows, labels and patient; returns studies, series and windows."""
    head = records_of(_table(spark, audit_root, "headers", tables.HEADER).where("status = 'ok'"))
    slices = series.upsert(series.identified(head), "relative_path", ["relative_path"])
    windows = manifest.neighbour_windows(slices, series.KEY, "relative_path", max_windows, offsets, plane="derived_plane")
    meta = None
    if series_csv:
        meta = tables.read_series(spark, series_csv).select(F.col("SeriesInstanceUID").alias("series_uid"), F.col("Anatomical_Plane").alias("plane"), F.col("Fluid_Sensitive").alias("fluid_sensitive"))
    labelled = None
    if labels_csv:
        labelled = manifest.label_arrays(tables.read_labels(spark, labels_csv).withColumnRenamed("StudyInstanceUID", "study_uid"), "study_uid", LABELS)
    built = manifest.study_manifest(windows, meta, labelled, manifest.first_patient(slices))
    tables.write_manifest(built, out)
    exploded = manifest.windows_of(spark.read.parquet(out))
    return exploded.agg(F.count_distinct("study_id").alias("studies"), F.count_distinct("study_id", "series_id").alias("series"), F.count("*").alias("windows"))


def split_folds(spark: SparkSession, manifest_path: str, out: str, folds: int = 5, seed: int = 2026, edges_csv: str | None = None) -> DataFrame:
    """Assign folds, write them, and fail if anything leaks; returns the diagnostics."""
    table = tables.read_manifest(spark, manifest_path)
    edges = tables.read_edges(spark, edges_csv) if edges_csv else None
    assigned = split.assign_folds(table, folds, seed, edges)
    tables.write_folds(table, assigned, out)
    written = tables.read_csv(spark, f"{out}/assignments").join(table.select("study_id", "patient_hash"), "study_id")
    split.require_disjoint(written, ["study_id", "patient_hash"])
    return split.fold_diagnostics(assigned.join(table.select("study_id", "labels"), "study_id"), "labels", len(LABELS))
