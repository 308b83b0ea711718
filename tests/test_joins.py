import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith.functions import scratch
from radiolith.functions.joins import heavy_keys, spread_join
from radiolith.operators import duplicates, graph, pixels


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_keys_join_the_same(spark, how):
    rows = [(i, None if i % 50 == 0 else 0 if i % 3 else i % 17) for i in range(600)]
    left = spark.createDataFrame(rows, "i int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 17, 2)], "k int, v string")
    counts = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, "n", 600, per_salt=20)
    assert {r["k"]: r["_rl_salts"] for r in heavy.collect()}[0] > 10
    got = spread_join(left, right, ["k"], heavy, F.xxhash64("i"), how).select("i", "k", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).select("i", "k", "v").collect()))
    assert heavy_keys(counts, "n", 600, per_salt=1000) is None


def test_components_with_hubs(spark):
    rng = np.random.default_rng(3)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))] + [(None, 5)]
    want = {}
    for a, b in edges:
        if a is not None:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), per_salt=10).collect()}
    assert got == want


def test_duplicate_members(spark):
    df = spark.createDataFrame([(f"m{i:03}", "x" if i % 2 else f"k{i}") for i in range(60)] + [("m100", None)], "m string, k string")
    got = duplicates.duplicate_members(df, "k", "m", "pixel", per_salt=5).collect()
    assert {r["member"] for r in got} == {f"m{i:03}" for i in range(1, 60, 2)} and [r["member"] for r in got if r["stands"]] == ["m001"]
    assert [tuple(r) for r in duplicates.duplicate_groups(df, "k", "m", "pixel").collect()] == [("pixel", "x", 30, "m001")]


def test_whole_images(spark):
    """Rows of 512 x 512 values; null and non-finite ones don't count."""
    rng = np.random.default_rng(2)
    images = [1e6 + rng.normal(size=512 * 512) * 3, np.where(rng.random(512 * 512) < 0.2, 0.0, rng.random(512 * 512))]
    rows = [(i, [None, float("nan"), float("inf"), *x.tolist()]) for i, x in enumerate(images)] + [(2, None), (3, []), (4, [float("nan")])]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(2)
    got = {r["i"]: r for r in df.select("i", *pixels.pixel_stats("v")).collect()}
    for i, x in enumerate(images):
        r = got[i]
        assert (r["pixel_count"], r["minimum"], r["maximum"]) == (len(x), x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["deviation"] == pytest.approx(x.std(), rel=1e-9)
        assert r["zero_fraction"] == pytest.approx((x == 0).mean()) and r["finite_fraction"] == pytest.approx(len(x) / (len(x) + 3))
    assert (got[2]["pixel_count"], got[3]["pixel_count"], got[4]["pixel_count"], got[4]["mean"]) == (None, 0, 0, None)
    deep = {r["i"]: r for r in pixels.deep_stats(df, "i", "v", most=10**6).collect()}
    assert set(deep) == {0, 1} and deep[1]["p50"] == pytest.approx(np.percentile(images[1], 50)) and deep[0]["mad"] == pytest.approx(np.median(np.abs(images[0] - np.median(images[0]))))
    z = pixels.normalized(df.where("i < 2"), ["i"], "v", "zscore").groupBy("i").agg(F.avg("x").alias("a"), F.max("x").alias("m"), F.count("*").alias("n")).collect()
    assert all(abs(r["a"]) < 1e-3 and r["m"] <= 5.0 and r["n"] == 512 * 512 + 3 for r in z)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())
