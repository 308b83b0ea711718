"""Ranges, percentiles, sketches, levels, samples, folds by class and perceptual duplicates against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith.config import set_path
from radiolith.operators import duplicates, metrics, perceptual, ranges, selection, split, stats


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(rng.integers(0, 9))) for k in ("a", "b", None) for v in rng.permutation(300)[:200]] + [("one", 1.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = ranges.running_sums(df, ["k"], "v", ["n"], parts=7, following="next").collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted((v, n) for k, v, n in rows if k == r["k"])
        assert r["before_n"] == sum(n for v, n in own if v < r["v"])
        assert r["next"] == min((v for v, _ in own if v > r["v"]), default=None)
    assert ranges.running_sums(df.limit(0), ["k"], "v", ["n"]).count() == 0


def test_one_label_fills_several_tasks(spark):
    df = spark.range(20_000).select(F.lit("l").alias("label"), (F.col("id") * 7919 % 20_000).cast("double").alias("s"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    ranked = ranges.running_sums(df.groupBy("label", "s").agg(F.count("*").alias("n")), ["label"], "s", ["n"], parts=10)
    tasks = [r[0] for r in ranked.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert ranked.where("before_n <> s").isEmpty() and max(tasks) < 12_000
    placed = df.repartitionByRange(10, "label", "s").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert placed < 4_000
    few, many = (metrics.auc(df, "label", "s", "y", parts=p).first()["auc"] for p in (1, 10))
    assert few == pytest.approx(many, abs=1e-12)


def test_cumulative_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 5.0), ("a", None)], "k string, v double")
    assert {tuple(r) for r in ranges.ecdf(df, ["k"], "v", 3).collect()} == {("a", 1.0, 2, 2 / 3), ("a", 3.0, 1, 1.0), ("b", 2.0, 1, 1.0), (None, 5.0, 1, 1.0)}


def test_domain_shift_against_plain_distributions(spark):
    rng = np.random.default_rng(2)
    groups = rng.choice(["x", "y", "z"], 600, p=[0.5, 0.3, 0.2])
    values = np.round(rng.normal(size=600) + (groups == "y") * 0.7, 1)
    rows = [(str(g), float(v), 1.0) for g, v in zip(groups, values)] + [("x", None, None), (None, float("nan"), 1.0), ("x", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, same double")
    got = {(r["metric"], r["group"]): r for r in ranges.domain_shift(df, "g", ["x", "y", "none"], ["v", "same"], bins=8, parts=5).collect()}
    at = np.unique(values)
    for g in ("x", "y"):
        a, b = values[groups == g], values[groups != g]
        fa, fb = (np.searchsorted(np.sort(x), at, side="right") / len(x) for x in (a, b))
        r = got["v", g]
        assert (r["n"], r["n_rest"], r["ks"]) == (len(a), len(b), pytest.approx(np.abs(fa - fb).max()))
        assert r["wasserstein"] == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(at)))
        p, q = (np.histogram(x, 8, (at[0], at[-1]))[0] / len(x) for x in (a, b))
        m = (p + q) / 2
        kl = lambda u: sum(x * np.log2(x / y) for x, y in zip(u, m) if x > 0)
        assert r["jensen_shannon"] == pytest.approx((kl(p) + kl(q)) / 2)
    assert got["v", "none"]["ks"] is None and got["same", "x"]["ks"] == 0 and got["same", "x"]["jensen_shannon"] == 0


@pytest.mark.parametrize("few, sketch", [(100_000, 10_000), (40, 20)])
def test_percentiles_by_narrowing(spark, few, sketch):
    rng = np.random.default_rng(3)
    columns = {"normal": rng.normal(size=3000), "heavy": np.exp(rng.normal(size=3000) * 20), "ties": np.round(rng.normal(size=3000)), "one": np.full(3000, 7.0)}
    rows = [[float(x) for x in row] for row in zip(*columns.values())]
    rows = [(*r, None, 3.5 if i == 0 else None, float("nan") if i < 100 else float(i)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*columns, "empty", "single", "nans"))).repartition(5)
    got = {r["metric"]: r for r in stats.numeric_summary(df, [*columns, "empty", "single", "nans"], few=few, sketch=sketch).collect()}
    for name, values in columns.items():
        for p in stats.PERCENTILES:
            assert got[name][f"p{p}"] == pytest.approx(np.percentile(values, p), rel=1e-12)
        assert got[name]["deviation"] == pytest.approx(np.std(values, ddof=1), rel=1e-9, abs=1e-12)
    assert got["empty"]["n"] == 0 and got["empty"]["p50"] is None and got["single"]["p99"] == 3.5 and got["single"]["deviation"] == 0.0
    assert got["nans"]["p50"] == pytest.approx(100 + 0.5 * 2999) and np.isnan(got["nans"]["p99"]) and got["nans"]["n"] == 3000
    loose = {r["metric"]: r for r in stats.numeric_summary(df, ["normal"], exact=False).collect()}
    assert abs(loose["normal"]["p50"] - np.median(columns["normal"])) < 0.05


def test_sketches_merge_within_their_rank_error(spark):
    rng = np.random.default_rng(4)
    values = rng.exponential(size=20_000)
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(values)] + [(1, None), (2, float("nan"))], "shard int, v double")
    parts = [stats.shard_sketches(df.where(c), "shard", ["v"]) for c in ("shard < 3", "shard >= 3")]
    got = stats.merged_summary(parts[0].unionByName(parts[1])).first()
    assert (got["n"], got["mean"], got["minimum"]) == (20_000, pytest.approx(values.mean()), values.min())
    for p in stats.PERCENTILES:
        assert abs((values <= got[f"p{p}"]).mean() - p / 100) < 0.03


def test_levels_tell_missing_keys_from_left_out_ones(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, None), ("b", "x", 3.0), ("b", "x", 3.0)], "k string, m string, v double")
    got = {(r["level"], r["k"], r["m"]): r for r in stats.by_levels(df, ["k", "m"], [["k", "m"], ["k"], []], ["v"]).collect()}
    assert len(got) == 6 and (got[0, "a", None]["rows"], got[1, "a", None]["rows"], got[3, None, None]["rows"]) == (1, 2, 4)
    assert (got[3, None, None]["missing"], got[3, None, None]["unique"], got[1, "b", None]["mean"]) == (1, 2, 3.0)


def test_samples_are_the_same_however_the_table_lies(spark):
    rows = [(i, "big" if i % 10 else "small", None if i % 100 == 0 else "v") for i in range(2000)] + [(5000, "rare", "v"), (5001, "rare", "v")]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    draw = lambda d, **k: {tuple(r) for r in stats.stratified_sample(d, ["s", "t"], "id", 15, 7, F.col("id") == 3, **k).collect()}
    got = draw(df.repartition(2), parts=2)
    assert got == draw(df.repartition(9, "id"), parts=13)
    count = {k: sum(1 for r in got if (r[1], r[2]) == k and r[4] == "stratum") for k in {(r[1], r[2]) for r in got}}
    assert count == {("big", "v"): 15, ("small", "v"): 15, ("small", None): 15, ("rare", "v"): 2} and {r[0] for r in got if r[4] == "always"} == {3}
    more = draw(df.unionByName(spark.createDataFrame([(9000 + i, "big", "v") for i in range(500)], df.schema)))
    assert {r[0] for r in more if r[1] == "big" and r[4] == "stratum" and r[0] < 9000} <= {r[0] for r in got}


def test_classes_are_dealt_evenly():
    rng = np.random.default_rng(5)
    classes = sorted({"".join(rng.choice(["0", "1"], 6, p=[0.7, 0.3])) for _ in range(40)} - {"000000"})
    counts = [(c, int(rng.integers(1, 30))) for c in classes]
    plan = split.deal_classes(counts, 5)
    per_fold = np.zeros((5, 6))
    sizes = np.zeros(5, dtype=int)
    for c, n in counts:
        base, extra = plan[c]
        assert base * 5 + len(extra) == n and len(set(extra)) == len(extra)
        for f in range(5):
            m = base + (f in extra)
            sizes[f] += m
            per_fold[f] += m * np.array([int(d) for d in c])
    assert sizes.max() - sizes.min() <= 1 and (per_fold.max(axis=0) - per_fold.min(axis=0)).max() <= 4
    assert split.deal_classes([], 5) == {}


def test_a_patient_and_a_hash_of_half_the_studies(spark):
    studies = spark.createDataFrame([(f"s{i:04d}", "default" if i % 2 else f"p{i}") for i in range(600)], "study_id string, patient_hash string")
    groups = split.study_groups(studies, per_salt=20).groupBy("group").count().collect()
    assert sorted(r["count"] for r in groups)[-1] == 300 and len(groups) == 301
    members = studies.select("study_id", F.when(F.col("patient_hash") == "default", "blank").otherwise(F.col("patient_hash")).alias("h"))
    edges = {tuple(r) for r in duplicates.cross_study_edges(members, "h", "study_id", per_salt=20).collect()}
    assert edges == {("s0001", f"s{i:04d}") for i in range(3, 600, 2)}


def test_frequency_bits_hold_under_brightness_and_size():
    rng = np.random.default_rng(6)
    small = rng.normal(size=(1, 8, 8))
    image = np.kron(small, np.ones((1, 4, 4)))
    bits = lambda x: int(perceptual.frequency_bits(x).view(np.uint64)[0])
    assert bits(image) == bits(3 * image + 10) and (bits(image) ^ bits(image + rng.normal(size=image.shape) * 0.02)).bit_count() <= 4
    assert (bits(image) ^ bits(np.kron(small, np.ones((1, 6, 6))))).bit_count() <= 4
    k = np.arange(8)
    plain = [[sum(small[0, x, y] * np.cos(np.pi * (2 * x + 1) * u / 16) * np.cos(np.pi * (2 * y + 1) * v / 16) for x in k for y in k) for v in k] for u in k]
    flat = np.array(plain).ravel()
    assert bits(small) == sum(1 << i for i in range(64) if flat[i] > np.median(flat))


@pytest.mark.parametrize("most, segments, block", [(8, 4, 2048), (8, 4, 5), (3, 4, 7), (10, 2, 30)])
def test_hamming_links_equal_brute_force(spark, most, segments, block):
    rng = np.random.default_rng(most + block)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    rows = []
    for i in range(260):
        h = int(base[i % 12])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            h ^= 1 << int(b)
        if i % 9 == 0:  # hashes that share segments but not more
            h = (h & 0xFFFFFFFF) | (int(rng.integers(0, 2**32)) << 32)
        rows.append((i, h - (1 << 64) if h >= 1 << 63 else h))
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, 0), (2002, -1)]
    df = spark.createDataFrame(rows, "id long, h long").repartition(3)
    got = {r["id"]: (r["n_links"], r["component"]) for r in perceptual.near_duplicates(df, "id", "h", most, segments, block).collect()}
    near = {i: {j for j, g in rows if j != i and h is not None and g is not None and ((h ^ g) & (2**64 - 1)).bit_count() <= most} for i, h in rows}
    component = {i: i for i in near}
    while True:
        new = {i: min([component[i], *(component[j] for j in near[i])]) for i in near}
        if new == component:
            break
        component = new
    assert got == {i: (len(near[i]), component[i]) for i in near} and max(n for n, _ in got.values()) > 40


def test_hash_of_bad_images_is_null(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [1.0] * 63), (4, [float("nan")] * 64), (5, [float(i) for i in range(64)])], "id long, e array<double>")
    got = {r["id"]: r["h"] for r in df.select("id", perceptual.perceptual_hash("e", 8, 8).alias("h")).collect()}
    assert [got[i] is None for i in range(1, 6)] == [False, True, True, True, False]
    assert perceptual.near_duplicates(df.limit(0).select("id", F.lit(1).cast("long").alias("h")), "id", "h").count() == 0


def test_overrides_through_scalars_are_refused():
    config = {"a": {"x": 1}}
    with pytest.raises(ValueError, match="holds no mapping"):
        set_path(config, "a.x.y", 2)
    set_path(config, "a.b.c", 2)
    assert config == {"a": {"x": 1, "b": {"c": 2}}}


def test_most_covered_equals_enumeration():
    from itertools import combinations

    rng = np.random.default_rng(7)
    for trial in range(60):
        masks = [int(sum(1 << b for b in rng.choice(12, rng.integers(0, 5), replace=False))) for _ in range(15)]
        for k in (1, 2, 3, 5, 15):
            best = 0
            for chosen in combinations(masks, k):
                together = 0
                for m in chosen:
                    together |= m
                best = max(best, together.bit_count())
            assert selection.most_covered(masks, k) == best
    assert selection.most_covered([], 3) == 0 and selection.most_covered([0], 3) == 0


def test_regret_of_selectors(spark):
    rows = [("s", 0, [2.0, 2.0, 0.0, 0.0]), ("s", 1, [2.0, 0.0, 0.0, 0.0]), ("s", 2, [0.0, 0.0, 1.6, 1.7]), ("t", 0, [0.0, 0.0, 0.0, None])]
    df = spark.createDataFrame(rows, "study string, window int, scores array<double>")
    got = {r["study"]: r for r in selection.regret(df, "study", "window", 2, 1.5, {"first": df.where("window < 2"), "none": df.limit(0)}).collect()}
    assert (got["s"]["evidence"], got["s"]["oracle"], got["s"]["first"], got["s"]["first_regret"], got["s"]["none_regret"]) == (4, 4, 2, 2, 4)
    assert (got["t"]["evidence"], got["t"]["oracle"], got["t"]["first_regret"]) == (0, 0, 0)


def test_moments_merge_to_those_of_all_values(spark):
    from radiolith.operators import proxies

    rng = np.random.default_rng(8)
    images = [("a", rng.exponential(size=n) + 1e6 * (n == 7)) for n in (50, 7, 200)] + [("b", np.full(9, 4.0)), (None, rng.normal(size=30))]
    rows = [(k, [float(x) for x in v]) for k, v in images] + [("a", None), ("a", []), ("a", [float("nan"), None])]
    df = spark.createDataFrame(rows, "k string, v array<double>").select("k", proxies.image_moments("v").alias("m"))
    got = {r["k"]: r for r in proxies.merged_moments(df, ["k"], "m").collect()}
    for k in ("a", None):
        x = np.concatenate([v for key, v in images if key == k])
        d = x - x.mean()
        assert (got[k]["n"], got[k]["mean"], got[k]["deviation"]) == (len(x), pytest.approx(x.mean()), pytest.approx(x.std()))
        assert (got[k]["skewness"], got[k]["kurtosis"]) == (pytest.approx((d**3).mean() / x.std() ** 3), pytest.approx((d**4).mean() / x.std() ** 4))
    assert got["b"]["deviation"] == 0 and got["b"]["skewness"] is None


def test_largest_component_against_flood_fill():
    from radiolith.operators.proxies import largest_component

    rng = np.random.default_rng(9)
    for density in (0.0, 0.3, 0.5, 0.6, 0.8, 1.0):
        for shape in ((13, 17), (1, 9), (9, 1), (16, 16)):
            mask = rng.random(shape) < density
            seen, best = np.zeros(shape, dtype=bool), set()
            for start in zip(*np.nonzero(mask)):
                if seen[start]:
                    continue
                part, todo = set(), [start]
                seen[start] = True
                while todo:
                    y, x = todo.pop()
                    part.add((y, x))
                    for at in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= at[0] < shape[0] and 0 <= at[1] < shape[1] and mask[at] and not seen[at]:
                            seen[at] = True
                            todo.append(at)
                if len(part) > len(best):
                    best = part
            assert set(zip(*np.nonzero(largest_component(mask)))) == best
    spiral = np.ones((15, 15), dtype=bool)
    spiral[1:-1, 1:-1] = False
    spiral[7, 1:10] = True
    assert largest_component(spiral).sum() == spiral.sum()


def test_proxies_against_plain_loops(spark):
    from radiolith.operators import proxies

    rng = np.random.default_rng(10)
    image = rng.random((12, 10)) * 0.3
    image[2:7, 4:9] += 1.0
    image[10, 0] = 1.2
    df = spark.createDataFrame([(1, image.ravel().tolist()), (2, [5.0] * 120), (3, [1.0]), (4, None), (5, [float("nan")] * 120)], "id long, v array<double>")
    got = {r["id"]: r["p"] for r in df.select("id", proxies.image_proxies("v", 12, 10).alias("p")).collect()}
    x = (image - image.min()) / (image.max() - image.min())
    laplacian = [4 * x[i, j] - x[i - 1, j] - x[i + 1, j] - x[i, j - 1] - x[i, j + 1] for i in range(1, 11) for j in range(1, 9)]
    assert got[1]["box_share"] == pytest.approx(25 / 120) and got[1]["laplacian"] == pytest.approx(np.var(laplacian))
    assert got[1]["centre_offset"] == pytest.approx(np.hypot((4 - 5.5) / 12, (6 - 4.5) / 10))
    y, total, high = x - x.mean(), 0.0, 0.0
    for u in range(12):
        for v in range(10):
            f = sum(y[i, j] * np.exp(-2j * np.pi * (u * i / 12 + v * j / 10)) for i in range(12) for j in range(10))
            fu, fv = (u if u < 6 else u - 12) / 12, (v if v < 5 else v - 10) / 10
            total += abs(f) ** 2
            high += abs(f) ** 2 * (np.hypot(fu, fv) > 0.25)
    assert got[1]["high_band"] == pytest.approx(high / total)
    assert got[2]["box_share"] == 0 and got[2]["centre_offset"] is None and got[3]["laplacian"] is None and got[4]["laplacian"] is None and got[5]["laplacian"] is None


def test_likeness_of_neighbours(spark):
    from radiolith.operators import proxies

    rng = np.random.default_rng(11)
    a, b = rng.normal(size=20), rng.normal(size=20)
    rows = [("s", 1, a.tolist()), ("s", 2, b.tolist()), ("s", 3, (2 * b + 1).tolist()), ("s", 4, [1.0] * 20), ("s", 5, [1.0]), ("t", 1, a.tolist())]
    df = spark.createDataFrame(rows, "k string, i int, v array<double>")
    got = {(r["k"], r["i"]): r["likeness"] for r in proxies.neighbour_likeness(df, ["k"], [F.col("i")], "v").collect()}
    assert got["s", 2] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["s", 3] == pytest.approx(1) and [got[k] for k in (("s", 1), ("s", 4), ("s", 5), ("t", 1))] == [None] * 4
