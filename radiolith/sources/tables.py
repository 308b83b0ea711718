"""Readers and writers of the audit's files: JSON lines, CSV, Parquet folders, manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LABELS
from ..functions.scratch import discard, materialize
from ..operators.files import exists
from ..operators.series import last_row_wins

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


HEADER = _struct(
    relative_path=_S, status=_S, error_type=_S, error_message=_S, StudyInstanceUID=_S, SeriesInstanceUID=_S, SOPInstanceUID=_S, path_study_uid=_S, path_series_uid=_S,
    derived_plane=_S, slice_normal=T.ArrayType(_D), position_scalar=_D, InstanceNumber=_D, Manufacturer=_S, ManufacturerModelName=_S, TransferSyntaxUID=_S, MagneticFieldStrength=_D, Rows=_L, Columns=_L,
    ImageOrientationPatient=T.ArrayType(_D), ImagePositionPatient=T.ArrayType(_D), PixelSpacing=T.ArrayType(_D), SliceThickness=_D, SpacingBetweenSlices=_D, BitsAllocated=_L, BitsStored=_L, HighBit=_L,
    PixelRepresentation=_L, PhotometricInterpretation=_S, RescaleSlope=_D, RescaleIntercept=_D, WindowCenter=T.ArrayType(_S), WindowWidth=T.ArrayType(_S), SeriesDescription=_S, ProtocolName=_S, SequenceName=_S,
    ScanningSequence=T.ArrayType(_S), SequenceVariant=T.ArrayType(_S), ScanOptions=T.ArrayType(_S), SoftwareVersions=T.ArrayType(_S), MRAcquisitionType=_S, RepetitionTime=_D, EchoTime=_D, EchoTrainLength=_D, FlipAngle=_D,
    PatientSex=_S, PatientAge=_S, ImageLaterality=_S, Laterality=_S, patient_hash=_S, file_size_bytes=_L, header_seconds=_D,
)
PIXELS = _struct(
    relative_path=_S, status=_S, error_type=_S, error_message=_S, deep_statistics=T.BooleanType(), pixel_count=_L, minimum=_D, maximum=_D, mean=_D, deviation=_D, zero_fraction=_D, finite_fraction=_D,
    pixel_sha256=_S, p0_1=_D, p1=_D, p5=_D, p25=_D, p50=_D, p75=_D, p95=_D, p99=_D, p99_9=_D, mad=_D, entropy=_D, decode_seconds=_D, decoder=_S, decoders_tried=T.ArrayType(_S),
)
WINDOW = _struct(series_id=_S, center_index=_I, paths=T.ArrayType(_S), plane=_S, fluid_sensitive=_D, relative_position=_D, series_length=_I, evidence_targets=T.ArrayType(_D))
MANIFEST = _struct(study_id=_S, patient_hash=_S, labels=T.ArrayType(_D), windows=T.ArrayType(WINDOW))
EDGES = _struct(study_a=_S, study_b=_S)
SERIES_CSV = _struct(StudyInstanceUID=_S, SeriesInstanceUID=_S, Anatomical_Plane=_S, Fluid_Sensitive=_S, Fat_Suppression=_S)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are typed NULLs."""
    return df.select(*((F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Raise where a table lacks a column that what follows needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank ones are skipped, a malformed one fails the read.

    A malformed line fails when it is read, with the file and the line's text in the error.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON lines that keep NULL fields."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Only the schema's columns of a Parquet folder; an empty table where there is no folder."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return conform(spark.read.parquet(path), schema)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column text (identifiers stay as written), quotes doubled, line breaks inside quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def read_labels(spark: SparkSession, path: str, labels: list[str] = LABELS) -> DataFrame:
    """Label table: StudyInstanceUID and at least one label column; those it lacks are NULL."""
    raw = require(read_csv(spark, path), "StudyInstanceUID")
    if not any(c in raw.columns for c in labels):
        raise KeyError("no label column")
    return raw.select("StudyInstanceUID", *((F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in labels))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Series metadata, one row for each SeriesInstanceUID: the last in the file.

    A row's place is that of its file by name and its number in it; a multi-line CSV is read whole by one task, in order, so a long table
    comes in several files, as :func:`write_csv` makes them.
    """
    rows = conform(require(read_csv(spark, path), "SeriesInstanceUID"), SERIES_CSV)
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    return last_row_wins(rows.withColumn("_place", place), "SeriesInstanceUID", "_place").drop("_place")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Links between studies; an empty table where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], EDGES)
    return conform(read_csv(spark, path), EDGES)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest, JSON lines or Parquet by what the folder holds; fields that it lacks, those of a window too, are NULL."""
    return read_jsonl(spark, path, MANIFEST) if path.endswith(".jsonl") or path.endswith(".json") else spark.read.schema(MANIFEST).parquet(path)


def study(manifest: DataFrame, study_id: str) -> DataFrame:
    """One study's record; of a manifest by :func:`write_manifest` the filter reaches the scan and all other row groups are skipped."""
    return manifest.where(F.col("study_id") == study_id)


#: Rows of a CSV export that go to one file, and bytes of their values: a multi-line CSV is read by one task.
ONE_FILE = 1_000_000
ONE_FILE_BYTES = 64 << 20


def write_csv(df: DataFrame, path: str, order_by: list[str] = (), one_file: int = ONE_FILE, one_file_bytes: int = ONE_FILE_BYTES) -> None:
    """A CSV folder, header even if there is no row: one file for up to ``one_file`` rows of ``one_file_bytes`` bytes, else as many as that takes, in order of ``order_by`` from file to file."""
    rows = materialize(df, "export")
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in rows.columns), F.lit(0))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).collect()[0]
    parts = max(1, -(-n // one_file), -(-size // one_file_bytes))
    placed = rows.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by) if order_by else rows.coalesce(1) if parts == 1 else rows.repartition(parts)
    placed.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    discard(rows)


def write_manifest(manifest: DataFrame, path: str, files: int | None = None, studies_each: int = 1024) -> None:
    """A manifest sorted by study over ``files`` files in row groups of few studies, so that :func:`study` reads one row group of one file."""
    n = files or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest.repartitionByRange(n, "study_id").sortWithinPartitions("study_id")
    placed.write.mode("overwrite").option("parquet.block.row.count.limit", studies_each).parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_folds(manifest: DataFrame, assigned: DataFrame, path: str) -> None:
    """The manifest once, partitioned by fold, and the assignments; a fold's training view is all other partitions."""
    joined = manifest.join(assigned.select("study_id", "fold"), "study_id")
    write_parquet(joined, f"{path}/manifest", ["fold"])
    write_csv(assigned.select("study_id", "fold"), f"{path}/assignments", ["study_id"])


def append_metrics(df: DataFrame, path: str) -> None:
    """Metrics of an epoch appended to the table of a run."""
    df.write.mode("append").parquet(path)


def write_text_atomically(text: str, path: str) -> None:
    """A small local file that is there whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def get_or_create_salt(path: str) -> str:
    """The salt of identity hashes, made once, readable by its owner only."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        try:
            handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError:
            pass
        else:
            with os.fdopen(handle, "w") as f:
                f.write(os.urandom(32).hex())
    with open(path, encoding="utf-8") as f:
        return f.read().strip()


def write_report(summary: dict, path: str) -> None:
    """A summary as JSON and as Markdown."""
    write_text_atomically(json.dumps(summary, indent=1, ensure_ascii=False, default=str), f"{path}.json")
    lines = ["# Audit report", ""]
    for part, values in summary.items():
        lines += [f"## {part}", ""]
        if isinstance(values, dict):
            lines += [f"- {k}: {v}" for k, v in values.items()]
        elif isinstance(values, list) and values and isinstance(values[0], dict):
            keys = list(values[0])
            lines += ["| " + " | ".join(keys) + " |", "|" + "-|" * len(keys), *("| " + " | ".join(str(r.get(k)) for k in keys) + " |" for r in values)]
        else:
            lines.append(str(values))
        lines.append("")
    write_text_atomically("\n".join(lines), f"{path}.md")
