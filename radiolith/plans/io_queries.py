"""Queries through files: tables written to the shared folder by the sinks and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions.constants import LABELS
from ..functions.scratch import scratch_root
from ..operators import duplicates, labels, manifest, series
from ..sources import tables
from . import roles as R
from .catalog import query


def _new(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXTS = _schema(doc_id=T.LongType(), text=T.StringType(), lang=T.StringType(), source=T.StringType())


@query("SELECT doc_id, md5(coalesce(text, '-')) AS text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, source FROM documents")
def jsonl_round_trip(spark, sf):
    path = _new(spark, "jsonl")
    tables.write_jsonl(R.table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), "source"), path)
    return tables.read_jsonl(spark, path, _TEXTS).withColumn("text", F.md5(F.coalesce("text", F.lit("-"))))


@query("SELECT doc_id::VARCHAR AS doc_id, md5('\"' || text || '\",' || chr(10) || source) AS quoted FROM documents WHERE text IS NOT NULL")
def csv_round_trip(spark, sf):
    path = _new(spark, "csv")
    quoted = F.concat(F.lit('"'), "text", F.lit('",\n'), "source")
    tables.write_csv(R.table(spark, sf, "documents").where("text is not null").select("doc_id", quoted.alias("quoted")), path)
    return tables.read_csv(spark, path).withColumn("quoted", F.md5("quoted"))


@query("SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE source = 'src3' OR source LIKE '%1' GROUP BY 1")
def pruned_partitions(spark, sf):
    path = _new(spark, "parts")
    tables.write_parquet(R.table(spark, sf, "documents").select("doc_id", "text", "source"), path, ["source"])
    read = tables.read_parquet_or_empty(spark, path, _schema(doc_id=T.LongType(), source=T.StringType()))
    return read.where("source = 'src3' or source like '%1'").groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, NULL::DOUBLE AS not_there FROM labels")
def parts_or_nothing(spark, sf):
    schema = _schema(doc_id=T.LongType(), not_there=T.DoubleType())
    path = _new(spark, "labels")
    tables.write_parquet(R.table(spark, sf, "labels"), path)
    return tables.read_parquet_or_empty(spark, path, schema).unionByName(tables.read_parquet_or_empty(spark, _new(spark, "nowhere"), schema))


@query("SELECT doc_id::VARCHAR AS study, quality::DOUBLE AS acl, toxic::DOUBLE AS mcl, NULL::DOUBLE AS fracture FROM labels")
def label_csv(spark, sf):
    path = _new(spark, "label-csv")
    tables.write_csv(R.table(spark, sf, "labels").select(F.col("doc_id").alias("StudyInstanceUID"), F.col("quality").alias("ACL"), F.col("toxic").alias("MCL")), path)
    read = tables.read_labels(spark, path)
    return read.select(F.col("StudyInstanceUID").alias("study"), X.finite("ACL").alias("acl"), X.finite("MCL").alias("mcl"), X.finite(LABELS[-1]).alias("fracture"))


@query("SELECT user_id::VARCHAR AS series, arg_max(event_type, event_id) AS plane, arg_max(event_id, event_id)::VARCHAR AS fluid FROM events GROUP BY 1")
def series_csv_last_row(spark, sf):
    path = _new(spark, "series-csv")
    e = R.table(spark, sf, "events").select(F.col("user_id").alias("SeriesInstanceUID"), F.col("event_type").alias("Anatomical_Plane"), F.col("event_id").alias("Fluid_Sensitive"))
    tables.write_csv(e, path, ["Fluid_Sensitive"])
    return tables.read_series(spark, path).select(F.col("SeriesInstanceUID").alias("series"), F.col("Anatomical_Plane").alias("plane"), F.col("Fluid_Sensitive").alias("fluid"))


@query("SELECT DISTINCT least(o_custkey, o_orderkey)::VARCHAR AS study_a, greatest(o_custkey, o_orderkey)::VARCHAR AS study_b FROM orders WHERE o_orderkey % 10 = 0")
def edge_list(spark, sf):
    path = _new(spark, "edges")
    o = R.table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.least("o_custkey", "o_orderkey").alias("study_a"), F.greatest("o_custkey", "o_orderkey").alias("study_b")).distinct()
    tables.write_csv(o, path)
    return tables.read_edges(spark, path).unionByName(tables.read_edges(spark, _new(spark, "no-edges")))


def _written_manifest(spark, sf, kind: str) -> str:
    path = _new(spark, "manifest") + kind
    turns = R.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("center_index"), F.col("role").alias("plane")))).alias("w"))
    window = F.transform("w", lambda x: F.struct(F.lit("s").alias("series_id"), x["center_index"].alias("center_index"), F.array(x["plane"]).alias("paths"), x["plane"].alias("plane")))
    rows = turns.select(F.concat(F.lit("c"), "conv_id").alias("study_id"), F.lit(None).cast("string").alias("patient_hash"), F.when(F.col("conv_id") % 5 != 0, window).alias("windows"))
    tables.write_jsonl(rows, path) if kind else tables.write_parquet(rows, path)
    return path


_MANIFEST = "SELECT 'c' || conv_id AS study_id, turn::INT AS center_index, role AS plane FROM conversations WHERE conv_id % 5 <> 0"


@query(f"SELECT study_id, center_index, plane FROM ({_MANIFEST})")
def manifest_jsonl(spark, sf):
    read = tables.read_manifest(spark, _written_manifest(spark, sf, ".jsonl"))
    return manifest.windows_of(read).select("study_id", "center_index", "plane")


@query(f"SELECT study_id, count(*)::INT AS windows FROM ({_MANIFEST}) WHERE study_id = 'c3' GROUP BY 1")
def manifest_study(spark, sf):
    return tables.study(tables.read_manifest(spark, _written_manifest(spark, sf, "")), "c3").select("study_id", F.size("windows").alias("windows"))


@query("SELECT DISTINCT 'c' || conv_id AS study_id FROM conversations WHERE conv_id % 5 = 0")
def studies_without_windows(spark, sf):
    return manifest.without_windows(tables.read_manifest(spark, _written_manifest(spark, sf, "")))


_HASH_FOLD = "(concat('0x', substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INT"


@query(f"SELECT fold, count(*) AS studies, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, {_HASH_FOLD} AS fold FROM documents) WHERE fold <> 2 GROUP BY 1")
def fold_files(spark, sf):
    path = _new(spark, "folds")
    studies = R.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("study_id"), "doc_id")
    tables.write_folds(studies, studies.withColumn("fold", X.stable_shard("study_id", 5)), path)
    training = spark.read.parquet(f"{path}/manifest").where("fold <> 2").join(tables.read_csv(spark, f"{path}/assignments").select("study_id"), "study_id")
    return training.groupBy("fold").agg(F.count("*").alias("studies"), F.sum("doc_id").alias("ids"))


@query("SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def metrics_sink(spark, sf):
    path = _new(spark, "metrics")
    e = R.table(spark, sf, "events")
    for epoch in range(3):
        tables.append_metrics(e.where(F.col("event_id") % 3 == epoch).select(F.lit(epoch).alias("epoch"), F.col("event_type").alias("metric"), "value"), path)
    return spark.read.parquet(path).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || ';' || event_id WHEN 2 THEN event_id::VARCHAR END AS items FROM events")
def mixed_lists(spark, sf):
    e = R.table(spark, sf, "events")
    name, number = F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("event_id").cast("string")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("["), name, F.lit(', "'), number, F.lit('"]'))).when(kind == 2, number).otherwise(F.lit("null"))
    return e.select("event_id", F.parse_json(raw).alias("v")).select("event_id", F.array_join(X.as_list("v"), ";").alias("items"))


@query(f"SELECT l.relative_path, md5(l.relative_path) AS pixel_sha256 FROM ({R.LINES}) l WHERE status = 'ok' AND l_orderkey % 3 = 0")
def hashed_slices(spark, sf):
    heads = R.lines(spark, sf).select("relative_path", "status", "l_orderkey")
    pixels = heads.select("relative_path", F.when(F.col("l_orderkey") % 3 == 0, "ok").otherwise("error").alias("status"), F.md5("relative_path").alias("pixel_sha256"))
    return duplicates.hashed_slices(heads, pixels).select("relative_path", "pixel_sha256")


@query("SELECT doc_id, any_value(quality) AS quality FROM labels WHERE doc_id % 4 <> 0 GROUP BY 1")
def quarantined_out(spark, sf):
    rows = R.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("relative_path"), "doc_id", "quality", F.when(F.col("doc_id") % 4 == 0, "error").otherwise("ok").alias("status"))
    bad = series.failures(rows.withColumns({"error_type": F.lit("E"), "error_message": F.lit("m")}), "header")
    return series.without_quarantined(rows, bad).select("doc_id", "quality")


# The bootstrap of a 0/1 mean has the binomial law, so its bounds lie where that of the normal law are, to a tenth of a deviation.
_BOUND = " UNION ALL ".join(f"SELECT '{c}' AS label, count({c}) AS n, true AS low_fits, true AS high_fits FROM labels" for c in R.LABEL_NAMES)


@query(_BOUND)
def label_bootstrap_bounds(spark, sf):
    table = R.table(spark, sf, "labels")
    means = labels.long_labels(table, [], R.LABEL_NAMES).where("value is not null").groupBy("label").agg(F.avg("value").alias("p"), F.count("*").alias("m"))
    both = labels.prevalence_intervals(table, R.LABEL_NAMES).join(means, "label")
    deviation = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("m"))
    fits = lambda bound, z: F.abs(F.col(bound) - F.col("p") - z * deviation) < 0.25 * deviation + 1 / F.col("m")
    return both.select("label", "n", fits("ci_low", -1.96).alias("low_fits"), fits("ci_high", 1.96).alias("high_fits"))
