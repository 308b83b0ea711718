import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith import cli, stages
from radiolith.config import fingerprint, load_config, merge, set_path
from radiolith.functions.registry import Registry, resolve
from radiolith.operators import files
from radiolith.sources import dicom, tables
from radiolith.sweep import combinations, write_sweep


def dicom_bytes(study="S1", series="E1", sop="o1", position=2.5, instance=1, offset=0, explicit=True, **more):
    values = {
        "SOPInstanceUID": sop, "StudyInstanceUID": study, "SeriesInstanceUID": series, "PatientID": "secret", "InstanceNumber": instance, "Manufacturer": "SIEMENS",
        "ImageOrientationPatient": [1, 0, 0, 0, 1, 0], "ImagePositionPatient": [0, 0, position], "Rows": 8, "Columns": 8, "BitsAllocated": 16, "BitsStored": 16, "HighBit": 15, "PixelRepresentation": 0,
        "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "ScanningSequence": "SE",
    } | more
    return dicom.encode(values, (np.arange(64, dtype=np.uint16) + offset).reshape(8, 8), explicit)


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "dicom"
    for study, series, n in (("S1", "E1", 3), ("S2", "E2", 2)):
        folder = root / study / series
        folder.mkdir(parents=True)
        for i in range(n):
            (folder / f"{i}.dcm").write_bytes(dicom_bytes(study, series, f"{series}.{i}", float(i), i + 1, ScanningSequence=["SE", "IR"] if i else "SE"))
    (root / "S2" / "E2" / "bad.dcm").write_bytes(b"not dicom at all")
    (root / ".hidden").write_bytes(b"x")
    return root


@pytest.mark.parametrize("explicit", [True, False])
def test_header_of_own_file(explicit):
    got = dicom.header_record(dicom_bytes(explicit=explicit))
    assert got["status"] == "ok" and got["Rows"] == 8 and got["InstanceNumber"] == 1.0 and got["ImagePositionPatient"] == [0.0, 0.0, 2.5] and got["ScanningSequence"] == ["SE"]


def test_pixels_of_own_file():
    got = dicom.pixel_record(dicom_bytes(), deep=True)
    assert (got["status"], got["minimum"], got["maximum"], got["pixel_count"], got["p50"]) == ("ok", 0, 63, 64, 31.5)
    assert got["pixel_sha256"] == dicom.pixel_record(dicom_bytes(sop="other"), deep=False)["pixel_sha256"]
    assert dicom.pixel_record(dicom_bytes(RescaleSlope=2, RescaleIntercept=1), deep=False)["maximum"] == 127


@pytest.mark.parametrize("data", [b"", b"DICM", b"\0" * 128 + b"DICM", dicom_bytes()[:200], dicom_bytes()[:-100], b"x" * 500])
def test_errors_are_rows(data):
    assert dicom.pixel_record(data, deep=False)["status"] == "error"
    assert dicom.header_record(data)["status"] in ("ok", "error")


def test_undefined_length_sequences_are_skipped():
    import struct

    data = dicom_bytes()
    at = data.index(struct.pack("<HH", 0x10, 0x20))
    nested = struct.pack("<HH", 0x08, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + struct.pack("<HH", 0x08, 0x0016) + b"UI" + struct.pack("<H", 4) + b"1.2\0" + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert dicom.header_record(data[:at] + nested + data[at:])["StudyInstanceUID"] == "S1"


def test_audit_end_to_end(spark, corpus, tmp_path):
    audit = str(tmp_path / "audit")
    totals = stages.index(spark, str(corpus), audit, 2).collect()
    assert sum(r["files"] for r in totals) == 6
    with pytest.raises(ValueError):
        stages.index(spark, str(corpus), audit, 3)
    salt = str(tmp_path / "salt")
    tally = stages.headers(spark, audit, salt).collect()
    assert (sum(r["ok"] for r in tally), sum(r["errors"] for r in tally)) == (5, 1)
    head = spark.read.parquet(f"{audit}/headers")
    assert "PatientID" not in head.columns and head.where("patient_hash is not null").count() == 5
    first = head.where("relative_path = 'S1/E1/0.dcm'").first()
    assert (first["derived_plane"], first["position_scalar"], first["ScanningSequence"], first["path_study_uid"]) == ("Axial", 0.0, ["SE"], "S1")
    assert head.where("relative_path = 'S1/E1/1.dcm'").first()["ScanningSequence"] == ["SE", "IR"]
    stages.headers(spark, audit, salt, shards="0")  # done already
    assert spark.read.parquet(f"{audit}/headers").count() == 6
    stages.pixels(spark, audit, deep_rate=1.0).collect()
    assert spark.read.parquet(f"{audit}/pixels").where("entropy is not null").count() == 5
    (tmp_path / "series.csv").write_text("StudyInstanceUID,SeriesInstanceUID,Anatomical_Plane,Fluid_Sensitive\nS1,E1,Axial,1\nS2,E2,Sagittal,0\n")
    (tmp_path / "labels.csv").write_text('StudyInstanceUID,Report,ACL,MCL,Baker\'s\nS1,"two\nlines",1,0,1\nS2,"said ""no""",0,,0\n')
    summary = stages.summarize(spark, audit, str(tmp_path / "series.csv"), str(tmp_path / "labels.csv"))
    assert summary["levels"] == {"files": 6, "series": 2, "studies": 2}
    issues = tables.read_csv(spark, f"{audit}/summary/geometry_issues").collect()
    assert [(r["series_uid"], r["issues"]) for r in issues] == [("E2", "plane_conflict")]
    assert tables.read_csv(spark, f"{audit}/summary/quarantine").count() == 2
    tables.write_report(summary, str(tmp_path / "report"))
    assert "# Audit report" in (tmp_path / "report.md").read_text()
    cover = stages.coverage(spark, audit, str(tmp_path / "labels.csv")).first()
    assert (cover["studies"], cover["on_disk"], cover["covered"]) == (2, 2, 2)
    levels = {r["level"]: r["groups"] for r in stages.find_duplicates(spark, audit).collect()}
    assert levels["pixel"] == 1
    out = str(tmp_path / "manifest")
    assert tuple(stages.build_manifest(spark, audit, out, str(tmp_path / "series.csv"), str(tmp_path / "labels.csv")).first()) == (2, 2, 5)
    row = spark.read.parquet(out).where("study_id = 'S1'").first()
    assert row["labels"][0] == 1.0 and row["labels"][2] is None and row["windows"][1]["paths"] == [f"S1/E1/{i}.dcm" for i in range(3)]
    # Both studies are one patient's, so they share a fold.
    stages.split_folds(spark, out, str(tmp_path / "folds"), folds=2)
    assert spark.read.parquet(str(tmp_path / "folds/manifest")).select("fold").distinct().count() == 1


def test_stage_order(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stages.headers(spark, str(tmp_path / "none"), str(tmp_path / "salt"))
    with pytest.raises(FileNotFoundError):
        stages.summarize(spark, str(tmp_path / "none"))


def test_hidden_files(spark, corpus):
    assert files.list_files(spark, str(corpus)).count() == 6
    assert files.list_files(spark, str(corpus), include_hidden=True).count() == 7


def test_cli(spark, corpus, tmp_path, capsys):
    assert cli.main(["index", "--dicom-root", str(corpus), "--audit-root", str(tmp_path / "a"), "--num-shards", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 6


def test_jsonl(spark, tmp_path):
    schema = tables._struct(a=tables._L, b=tables._S)
    df = spark.createDataFrame([(1, None), (2, "é")], schema)
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert {tuple(r) for r in tables.read_jsonl(spark, str(tmp_path / "j"), schema).collect()} == {(1, None), (2, "é")}
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n{"a":\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_empty_reads(spark, tmp_path):
    assert tables.read_parquet_or_empty(spark, str(tmp_path / "no"), tables.PIXELS).columns == [f.name for f in tables.PIXELS.fields]
    assert tables.read_edges(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "l.csv").write_text("StudyInstanceUID,Report\nS,x\n")
    with pytest.raises(KeyError):
        tables.read_labels(spark, str(tmp_path / "l.csv"))
    tables.write_csv(spark.createDataFrame([], "a string, b string"), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*")).read_text().strip() == "a,b"


def test_salt_is_kept(tmp_path):
    a = tables.get_or_create_salt(str(tmp_path / "x" / "salt"))
    assert a == tables.get_or_create_salt(str(tmp_path / "x" / "salt")) and len(a) == 64
    assert (tmp_path / "x" / "salt").stat().st_mode & 0o77 == 0


def test_merge_and_overrides(tmp_path):
    base = {"a": {"x": 1, "y": [1, 2]}, "m": {"name": "p", "params": {"k": 1, "l": 2}}}
    assert merge(base, {"a": {"y": [3]}, "m": {"params": {"k": 9}}}) == {"a": {"x": 1, "y": [3]}, "m": {"name": "p", "params": {"k": 9, "l": 2}}}
    assert merge(base, {"m": {"name": "q", "params": {"z": 1}}})["m"] == {"name": "q", "params": {"z": 1}}
    set_path(base, "a.b.c", 3)
    assert base["a"]["b"]["c"] == 3
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"train": {"lr": 1}}))
    assert load_config([str(path)], ["train.lr=0.5", "train.on=true", "name=x"]) == {"train": {"lr": 0.5, "on": True}, "name": "x"}
    with pytest.raises(ValueError):
        load_config([str(path)], ["broken"])
    path.write_text("[1]")
    with pytest.raises(TypeError):
        load_config([str(path)])
    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1}) and len(fingerprint({})) == 12


def test_sweep(tmp_path):
    assert combinations({"a": [1, 2], "b": ["x", "y"]}) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    base = tmp_path / "base.json"
    base.write_text("{}")
    paths = write_sweep([str(base)], {"model.k": [1, 2]}, str(tmp_path / "out"))
    assert [json.load(open(p))["model"]["k"] for p in paths] == [1, 2]


def test_dotted_paths():
    r = Registry("counter")
    assert r.create({"target": "collections:Counter", "params": {"a": 2}})["a"] == 2 and resolve("os.path.join") is os.path.join
    for bad, error in (("nothing", ValueError), ("os:no_such", AttributeError), ("no_such_module:x", ImportError)):
        with pytest.raises(error):
            resolve(bad)


def test_registry():
    r = Registry("thing")
    r.register("a")(lambda x=1: x)
    assert r.create({"name": "a", "params": {"x": 3}}) == 3
    with pytest.raises(KeyError):
        r.register("a")(int)
    with pytest.raises(KeyError):
        r["b"]
    with pytest.raises(KeyError):
        r.create({})


def test_streaming(spark, tmp_path):
    from radiolith.streaming import incremental

    src = str(tmp_path / "in")
    spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit("ok").alias("status")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for extra in (0, 2):
        if extra:
            spark.range(extra).select(F.col("id").cast("string").alias("k"), F.lit("error").alias("status")).write.mode("append").parquet(src)
        incremental.append_new(incremental.stream_parquet(spark, src, schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3 + extra
    seen = {}
    q = incremental.upsert_batches(incremental.stream_parquet(spark, src, schema), "k", "status", lambda f, n: seen.update({r["k"]: r["status"] for r in f.collect()}), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert len(seen) == 3


def test_queries_have_unique_names_and_plans(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert entry.entry(spark).columns[:2] == ["study_uid", "series_uid"]


def test_exports_of_several_files_keep_their_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit('a "b"').alias("t"))
    tables.write_csv(df, str(tmp_path / "many"), ["id"], one_file=300)
    parts = sorted((tmp_path / "many").glob("part-*"))
    ids = [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) == 4 and ids == list(range(1000))
    tables.write_csv(df, str(tmp_path / "one"), ["id"])
    assert len(list((tmp_path / "one").glob("part-*"))) == 1 and tables.read_csv(spark, str(tmp_path / "one")).count() == 1000


def test_exports_of_long_rows_take_several_files(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 != 0, F.concat(F.repeat(F.lit("é\n\""), 30_000), F.col("id").cast("string"))).alias("t"))
    for order in ([], ["id"]):
        path = tmp_path / f"long{len(order)}"
        tables.write_csv(df, str(path), order, one_file_bytes=1 << 20)
        sizes = [p.stat().st_size for p in path.glob("part-*")]
        assert len(sizes) > 2 and max(sizes) < 3 << 20
        got = tables.read_csv(spark, str(path)).select(F.col("id").cast("long").alias("id"), "t")
        assert got.count() == 40 and got.exceptAll(df).isEmpty()


def test_series_are_written_in_several_files_and_the_last_row_wins(spark, tmp_path, monkeypatch):
    from radiolith.plans import io_queries

    events = spark.range(2000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 50).alias("user_id"), F.concat(F.lit("t"), F.col("id") % 9).alias("event_type")).repartition(5)
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(tables.write_csv, "__defaults__", ((), 300, 1 << 20))
    monkeypatch.setattr(io_queries, "_new", lambda spark, name: str(tmp_path / name))
    got = {r["series"]: (r["plane"], r["fluid"]) for r in io_queries.series_csv_last_row(spark, str(tmp_path)).collect()}
    last = {}
    for i in range(2000):
        last[str(i * 7 % 50)] = (f"t{i % 9}", str(i))
    assert got == last and len(list((tmp_path / "series-csv").glob("part-*"))) == 7


def test_one_study_is_one_row_group(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(500).select(F.concat(F.lit("s"), F.lpad((F.col("id") * 37 % 500).cast("string"), 4, "0")).alias("study_id"))
    manifest = tables.conform(rows, tables.MANIFEST)
    tables.write_manifest(manifest, str(tmp_path / "m"), files=4, studies_each=20)
    groups = [pq.ParquetFile(p).metadata.row_group(k) for p in (tmp_path / "m").glob("part-*") for k in range(pq.ParquetFile(p).metadata.num_row_groups)]
    spans = [(g.column(0).statistics.min, g.column(0).statistics.max) for g in groups]
    assert len(spans) >= 20 and sum(a <= "s0123" <= b for a, b in spans) == 1
    found = tables.study(tables.read_manifest(spark, str(tmp_path / "m")), "s0123")
    assert found.count() == 1 and "EqualTo(study_id,s0123)" in found._jdf.queryExecution().toString()
