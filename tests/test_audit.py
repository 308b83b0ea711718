import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith.functions.constants import LABELS
from radiolith.operators import duplicates, labels, series, stats
from radiolith.operators.files import parse_shards

RECORD = "study_uid string, series_uid string, relative_path string, status string, size_bytes long, position_scalar double, instance_number double, derived_plane string, manufacturer string, rows long, columns long, patient_hash string"


def slices(spark, series_uid, planes, positions, instances, vendor):
    return [("S", series_uid, f"{series_uid}/{i}", "ok", 10, float(p), float(n), plane, vendor, 8, 8, "h") for i, (plane, p, n) in enumerate(zip(planes, positions, instances))]


def test_geometry_flags(spark):
    rows = slices(spark, "clean", ["Sagittal"] * 3, [0, 10, 20], [1, 2, 3], "SIEMENS") + slices(spark, "badorder", ["Sagittal"] * 3, [0, 10, 20], [1, 3, 2], "Philips") + slices(spark, "conflict", ["Axial"] * 3, [0, 0, 20], [1, 2, 3], "Philips")
    meta = spark.createDataFrame([(s, "Sagittal", 1) for s in ("clean", "badorder", "conflict")], "series_uid string, metadata_plane string, fluid int")
    inventory = series.series_inventory(spark.createDataFrame(rows, RECORD), meta)
    issues = {r["series_uid"]: r["issues"] for r in series.geometry_issues(inventory).collect()}
    assert set(issues) == {"badorder", "conflict"}
    assert "order_disagreement" in issues["badorder"]
    assert {"plane_conflict", "duplicate_position"} <= set(issues["conflict"].split(";"))
    assert inventory.where("order_spearman is not null").count() == 3


def test_missing_metadata_plane(spark):
    df = spark.createDataFrame([(None, "Axial"), ("Axial", "Axial"), ("Sagittal", None)], "metadata_plane string, plane_mode string")
    assert [r[0] for r in df.select(series.plane_conflict()).collect()] == [False, False, True]
    assert [r[0] for r in df.select(series.plane_conflict(missing_conflicts=True)).collect()] == [True, False, True]


def test_records_with_errors_count(spark):
    rows = [("S", "E", "a", "error", None, None, None, None, None, None, None, None), ("S", "E", "b", "ok", 5, 1.0, 1.0, "Axial", "X", 8, 8, "p"), ("", "E", "c", "ok", 5, 1.0, 1.0, "Axial", "X", 8, 8, "p")]
    got = series.series_inventory(spark.createDataFrame(rows, RECORD)).first()
    assert (got["file_count"], got["total_bytes"], got["error_count"], got["position_count"], got["patient_hash"], got["plane_mode"]) == (2, 5, 1, 1, "p", "Axial")


def test_mode_takes_first_of_equals(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, "b"), ("k", 5, "")], "k string, i int, v string")
    assert stats.first_mode(df, ["k"], "v", F.col("i"), "m").first()["m"] == "b"


def test_numeric_summary(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, None, None), (4.0, None, None)], "a double, b double, c double")
    got = {r["metric"]: r for r in stats.numeric_summary(df, ["a", "b", "c"]).collect()}
    assert got["a"]["deviation"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert got["a"]["p25"] == pytest.approx(np.percentile([1, 2, 4], 25))
    assert (got["b"]["n"], got["b"]["deviation"]) == (1, 0.0)
    assert (got["c"]["n"], got["c"]["mean"], got["c"]["deviation"]) == (0, None, None)


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(stats.correlation("a", "b").alias("r")).first()["r"] is None


@pytest.fixture
def label_table(spark):
    zeros = dict.fromkeys(LABELS, 0.0)
    rows = [("G1", *(zeros | {"ACL": 1.0, "MCL": 1.0}).values()), ("G2", *(zeros | {"ACL": 1.0}).values()), ("G3", *zeros.values()), ("N1", *[None] * 12)]
    plain = [c.replace(" ", "_").replace("'", "") for c in LABELS]
    return spark.createDataFrame(rows, "study_uid string, " + ", ".join(f"{c} double" for c in plain)), plain


def test_label_audit(label_table):
    df, names = label_table
    acl = {r["label"]: r for r in labels.label_inventory(df, names).collect()}["ACL"]
    assert (acl["positive"], acl["negative"], acl["missing"], acl["prevalence"]) == (2, 1, 1, pytest.approx(2 / 3))
    pairs = {(r["label_a"], r["label_b"]): r for r in labels.co_occurrence(df, names).collect()}
    assert (pairs["ACL", "MCL"]["together"], pairs["ACL", "ACL"]["together"], pairs["ACL", "MCL"]["jaccard"]) == (1, 2, 0.5)
    assert pairs["Fracture", "Fracture"]["jaccard"] == 0.0
    assert {r["positives"]: r["n"] for r in labels.positives_histogram(df, names).collect()} == {0: 1, 1: 1, 2: 1}
    ci = {r["label"]: r for r in labels.prevalence_intervals(df, names).collect()}["ACL"]
    assert ci["ci_low"] <= 2 / 3 <= ci["ci_high"]


def test_bootstrap():
    assert labels.bootstrap_interval(np.array([])) is None
    low, high = labels.bootstrap_interval(np.array([0, 1, 1, 0, 1.0]))
    assert low <= 0.6 <= high
    assert labels.bootstrap_interval(np.array([0, 1, 1, 0, 1.0])) == (low, high)


def test_label_domains(spark):
    df = spark.createDataFrame([("S1", 1.0, 0.0, "SIEMENS"), ("S2", 0.0, 1.0, "Philips Healthcare")], "study_uid string, ACL double, MCL double, vendor string")
    got = {(r["label"], r["family"]): (r["n"], r["positive"], r["prevalence"]) for r in labels.label_domains(df, ["ACL", "MCL"], "vendor").collect()}
    assert {f for _, f in got} == {"Siemens", "Philips"}
    assert got["ACL", "Siemens"] == (1, 1, 1.0)


def test_gold_differs_by_definition(spark):
    df = spark.createDataFrame([("x",), ("1",), (None,)], "a string")
    assert [r[0] for r in df.select(labels.gold_raw(["a"])).collect()] == [True, True, False]
    assert [r[0] for r in df.select(labels.gold_numeric(["a"])).collect()] == [False, True, False]


def test_coverage(spark):
    studies = spark.createDataFrame([("S1", 0.0), ("S2", 0.0), ("S3", None)], "study_uid string, a double")
    disk = spark.createDataFrame([("S1",), ("S3",), ("index",)], "study_uid string")
    got = labels.coverage(studies, disk, labels.gold_numeric(["a"])).first()
    assert (got["studies"], got["gold"], got["on_disk"], got["covered"], got["gold_covered"], got["gold_missing"], got["unrecognized"]) == (3, 2, 3, 2, 1, 1, 1)
    assert got["gold_share"] == 0.5
    assert [r[0] for r in labels.missing_gold(studies, disk, labels.gold_numeric(["a"])).collect()] == ["S2"]
    meta = spark.createDataFrame([("S1", "Sagittal", 1), ("S2", "Coronal", 0), ("S3", "Axial", 1)], "study_uid string, p string, f int")
    assert {r["bucket"] for r in labels.buckets(labels.of_studies_on_disk(meta, disk), "p", "f").collect()} == {"Sagittal/fluid=1", "Axial/fluid=1"}
    empty = labels.coverage(studies.limit(0), disk.limit(0), labels.gold_numeric(["a"])).first()
    assert (empty["studies"], empty["gold_share"]) == (0, None)


def test_duplicates(spark):
    head = "StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, relative_path string, position_scalar double, instance_number double, status string"
    rows = [("S1", "A", "o1", "p1", 0.0, 1.0, "ok"), ("S1", "A", "o2", "p2", 1.0, 2.0, "ok"), ("S1", "A", "o3", "p3", 2.0, 3.0, "ok"), ("S2", "B", "o4", "p4", 0.0, 1.0, "ok"), ("S2", "B", "o5", "p5", 1.0, 2.0, "ok"), ("S2", "B", "o6", "p6", 2.0, 3.0, "ok"), ("S3", "C", "o1", "p7", 0.0, 1.0, "ok")]
    hashes = [("p1", "x"), ("p2", "y"), ("p3", "z"), ("p4", "x"), ("p5", "y"), ("p6", "z"), ("p7", "q")]
    pixels = spark.createDataFrame([(p, h, "ok") for p, h in hashes], "relative_path string, pixel_sha256 string, status string")
    groups, members, edges = duplicates.find_duplicates(spark.createDataFrame(rows, head), pixels)
    assert {r["level"]: r["groups"] for r in duplicates.level_counts(groups).collect()} == {"sop": 1, "pixel": 3, "series_signature": 1}
    assert {tuple(r) for r in edges.collect()} == {("S1", "S2"), ("S1", "S3")}


def test_signature_of_one_slice(spark):
    df = spark.createDataFrame([("s", "h", 0.0, 1.0, "p")], "k string, h string, position_scalar double, instance_number double, relative_path string")
    assert tuple(duplicates.series_signatures(df, ["k"], "h").first()) == ("s", "h", 1)


@pytest.mark.parametrize("text, want", [("all", [0, 1, 2, 3]), ("0,2-3", [0, 2, 3]), ("1", [1]), ("3, 1", [1, 3])])
def test_parse_shards(text, want):
    assert parse_shards(text, 4) == want


@pytest.mark.parametrize("text", ["4", "2-1", "0-9", "x", "-1"])
def test_parse_shards_rejects(text):
    with pytest.raises(ValueError):
        parse_shards(text, 4)


def test_upsert_and_quarantine(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, i int, v string")
    assert {(r["k"], r["v"]) for r in series.upsert(df, "k", ["i"]).collect()} == {("a", "y"), ("b", "z")}
    bad = spark.createDataFrame([("p", "error", "E", "m" * 2000), ("q", "ok", None, None)], "relative_path string, status string, error_type string, error_message string")
    rows = series.quarantine(bad, bad).collect()
    assert [(r["stage"], r["relative_path"], len(r["error_message"])) for r in rows] == [("header", "p", 1000), ("pixel", "p", 1000)]


def test_slices_are_dealt_once_for_each_join(spark):
    from radiolith.plans import audit_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = audit_queries.series_inventory(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 5 and not any("study_uid" in line for line in dealt)  # both sides of two joins, and the stated planes
