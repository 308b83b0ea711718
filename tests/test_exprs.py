import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from radiolith.functions import exprs as X


def one(spark, column, **values):
    types = {int: "long", float: "double", str: "string", list: "array<double>", bool: "boolean"}
    schema = ", ".join(f"{k} {types[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def plain_geometry(orientation, position):
    """Plane and position from a plain cross product."""
    row, column = np.array(orientation[:3]), np.array(orientation[3:])
    normal = np.cross(row, column)
    size = np.linalg.norm(normal)
    if size < 1e-8:
        return "Unknown", None
    normal = normal / size
    return ("Sagittal", "Coronal", "Axial")[int(np.argmax(np.abs(normal)))], float(normal @ position)


def turned(angles, flip=1.0):
    """Row and column directions of a slice turned about the three axes."""
    m = np.eye(3)
    for axis, angle in enumerate(angles):
        i, j = [(1, 2), (0, 2), (0, 1)][axis]
        r = np.eye(3)
        r[[i, i, j, j], [i, j, i, j]] = np.cos(angle), -np.sin(angle), np.sin(angle), np.cos(angle)
        m = r @ m
    return [*m[0].tolist(), *(flip * m[1]).tolist()]


@pytest.mark.parametrize("angles", [(0.2, 0.1, 0.7), (1.3, 0.2, -0.4), (0.1, -1.2, 0.3), (2.8, 0.4, 1.1), (-0.6, 2.2, 0.0)])
@pytest.mark.parametrize("flip", [1.0, -1.0])
def test_slice_geometry(spark, angles, flip):
    orientation, position = turned(angles, flip), [12.5, -31.0, 4.25]
    plane, scalar = plain_geometry(orientation, position)
    g = one(spark, X.slice_geometry("o", "p"), o=orientation, p=position)
    assert g["plane"] == plane and g["position"] == pytest.approx(scalar)


def test_slice_geometry_of_many(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=3).tolist()) for i in range(200)]
    rows += [(200, [0.6, 0.8, 0.0, 1.2, 1.6, 0.0], [1.0, 2.0, 3.0]), (201, [1.0] * 5, [0.0] * 3), (202, [], [0.0] * 3)]
    got = {r["i"]: r["g"] for r in spark.createDataFrame(rows, "i int, o array<double>, p array<double>").select("i", X.slice_geometry("o", "p").alias("g")).collect()}
    for i, o, p in rows:
        plane, scalar = plain_geometry(o, p) if len(o) == 6 else ("Unknown", None)
        assert got[i]["plane"] == plane
        assert got[i]["position"] == (None if scalar is None else pytest.approx(scalar))


def test_slice_geometry_without_origin(spark):
    g = one(spark, X.slice_geometry("o", F.lit(None).cast("array<double>")), o=[1.0, 0.0, 0.0, 0.0, 1.0, 0.0])
    assert (g["plane"], g["normal"], g["position"]) == ("Axial", [0.0, 0.0, 1.0], None)


@pytest.mark.parametrize("text, value", [("1.5", 1.5), ("nan", None), ("inf", None), ("-inf", None), ("many", None), ("", None)])
def test_finite(spark, text, value):
    assert one(spark, X.finite("s"), s=text) == value


def test_hashes(spark):
    path = "a/b/c.dcm"
    digest = hashlib.blake2b(path.encode(), digest_size=8).digest()
    assert one(spark, X.blake2b_shard("s", 128), s=path) == int.from_bytes(digest, "little") % 128
    assert one(spark, X.blake2b_fraction("s"), s=path) == int.from_bytes(digest, "little") / (2**64 - 1)
    assert one(spark, X.identity_hash("s", "salt"), s="p1") == hashlib.sha256(b"salt\0p1").hexdigest()
    assert one(spark, X.identity_hash("s", "salt"), s="") is None
    assert one(spark, X.stable_shard("s", 16), s=path) == int(hashlib.md5(path.encode()).hexdigest()[:8], 16) % 16


@pytest.mark.parametrize("raw, family", [("SIEMENS", "Siemens"), ("Siemens Healthineers", "Siemens"), ("GE MEDICAL SYSTEMS", "GE"), ("FUJIFILM", "Fujifilm/Hitachi"), ("Esaote", "Esaote"), ("", "Unknown"), (None, "Unknown")])
def test_vendor_family(spark, raw, family):
    assert one(spark, X.vendor_family("s"), s=raw) == family


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 200), st.integers(-1, 20))
def test_uniform_indices(n, k):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = spark.range(1).select(X.uniform_indices(F.lit(n), k).alias("r")).first()["r"]
    want = list(range(n)) if k <= 0 or n <= k else sorted({int(round(x)) for x in np.linspace(0, n - 1, k)})
    assert got == want


def test_uniform_session(spark):
    assert one(spark, X.uniform_indices("n", 3), n=5) == [0, 2, 4]


def test_neighbours_clamp(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],)], "p array<string>").select(*(X.clamped_neighbours("p", F.lit(c)).alias(str(c)) for c in range(3))).first()
    assert list(rows) == [["a", "a", "b"], ["a", "b", "c"], ["b", "c", "c"]]


def test_metadata_and_standardize(spark):
    assert one(spark, X.window_metadata(F.lit(None).cast("double"), F.lit("1"), F.lit("Coronal"))) == [0.5, 1, 0, 1, 0]
    assert one(spark, X.standardized("v", [1.0, 2.0], [2.0, 0.0]), v=[3.0, 2.0]) == [1.0, 0.0]
    with pytest.raises(ValueError):
        X.standardized("v", [1.0], [1.0, 2.0])


def test_softplus_is_stable(spark):
    assert one(spark, X.softplus(F.lit(1000.0))) == 1000.0
    assert one(spark, X.softplus(F.lit(0.0))) == pytest.approx(math.log(2))


def test_list_from_scalar_or_list(spark):
    rows = spark.createDataFrame([('"SE"',), ('["SE","IR"]',), ("null",)], "s string").select(X.as_list(F.parse_json("s")).alias("v")).collect()
    assert [r["v"] for r in rows] == [["SE"], ["SE", "IR"], None]


def test_path_parts_and_fallback(spark):
    rows = spark.createDataFrame([("a/b/c", ""), ("x", "H")], "p string, h string").select(X.first_filled("h", X.path_part("p", 0)).alias("s"), X.path_part("p", 1).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("a", "b"), ("H", None)]
