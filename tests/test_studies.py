import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolith.operators import graph, losses, manifest, metrics, pixels, pooling, selection, split


def test_windows_follow_position(spark):
    rows = [("S", "E", "slice-0", 2.0, 0.0, "Axial"), ("S", "E", "slice-1", 0.0, 1.0, "Axial"), ("S", "E", "slice-2", 1.0, 2.0, "Axial")]
    df = spark.createDataFrame(rows, "study_uid string, series_uid string, relative_path string, position_scalar double, instance_number double, plane string")
    got = manifest.neighbour_windows(df, ["study_uid", "series_uid"], "relative_path", plane="plane").orderBy("center_index").collect()
    assert got[1]["paths"] == ["slice-1", "slice-2", "slice-0"]
    assert got[0]["paths"] == ["slice-1", "slice-1", "slice-2"]
    assert [r["relative_position"] for r in got] == [0, 0.5, 1]
    labels = spark.createDataFrame([("S", 1.0)], "study_uid string, ACL double")
    built = manifest.study_manifest(manifest.neighbour_windows(df, ["study_uid", "series_uid"], "relative_path", plane="plane"), None, manifest.label_arrays(labels, "study_uid", ["ACL", "MCL"]))
    row = built.first()
    assert (row["study_id"], row["labels"], len(row["windows"]), row["windows"][0]["plane"]) == ("S", [1.0, None], 3, "Axial")


def test_slice_order_of_missing_values(spark):
    rows = [("k", "a", None, 1.0), ("k", "b", 1.0, 2.0), ("k", "c", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, relative_path string, position_scalar double, instance_number double")
    assert [r["relative_path"] for r in manifest.ordered_slices(df, ["k"]).orderBy("i").collect()] == ["c", "b", "a"]


def test_one_slice_one_window(spark):
    df = spark.createDataFrame([("S", "E", "p", 0.0, 0.0)], "study_uid string, series_uid string, relative_path string, position_scalar double, instance_number double")
    got = manifest.neighbour_windows(df, ["study_uid", "series_uid"], "relative_path", max_windows=1).collect()
    assert [(r["paths"], r["series_length"]) for r in got] == [(["p"] * 3, 1)]


def test_montage_and_sample(spark):
    df = spark.createDataFrame([("s", "Axial", 1.0, i, [f"a{i}", f"b{i}", f"c{i}"]) for i in range(20)], "study_id string, plane string, fluid_sensitive double, window_index int, paths array<string>")
    got = manifest.montage_slots(df).orderBy("slot_index").collect()
    assert len(got) == 9 and got[0]["path"] == "b0" and got[-1]["path"] == "b19"
    a, b = (manifest.shuffled_sample(df, "window_index", 5, seed=3).collect() for _ in range(2))
    assert a == b and len(a) == 5


@pytest.fixture
def windows(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(s, w, rng.normal(size=4).tolist()) for s in range(3) for w in range(9)], "study int, window int, scores array<double>")


def test_top_k(windows):
    rows = windows.collect()
    got = {(r["study"], r["window"]) for r in selection.top_k_utility(windows, "study", "window", 3).collect()}
    for s in range(3):
        best = sorted((-max(r["scores"]), r["window"]) for r in rows if r["study"] == s)[:3]
        assert {w for x, w in got if x == s} == {w for _, w in best}


def test_recall_safe_keeps_every_labels_best(windows):
    rows = windows.collect()
    got = {(r["study"], r["window"]) for r in selection.top_k_recall_safe(windows, "study", "window", 4).collect()}
    for s in range(3):
        for label in range(4):
            best = max((r["scores"][label], -r["window"]) for r in rows if r["study"] == s)
            assert (s, -best[1]) in got


def test_central_and_uniform(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(12)], "g int, i int, ok boolean")
    assert sorted(r["i"] for r in selection.central(df, "g", "i", 2, F.col("ok")).collect()) == [4, 6]
    assert sorted(r["i"] for r in selection.uniform(df, "g", "i", 3, F.col("ok")).collect()) == [0, 4, 10]
    assert selection.central(df, "g", "i", 50).count() == 12


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[90] == got[80] == 80
    assert graph.components(edges.limit(0)).count() == 0


def folds_of(spark, studies, edges=None, folds=3, n_labels=12):
    df = spark.createDataFrame(studies, "study_id string, patient_hash string, labels array<double>")
    links = None if edges is None else spark.createDataFrame(edges, "study_a string, study_b string")
    return {r["study_id"]: r["fold"] for r in split.assign_folds(df, folds, 7, links, n_labels).collect()}


def hot(i):
    return [1.0 if j == i else 0.0 for j in range(12)]


def test_patients_stay_together(spark):
    studies = [(f"study-{i}", f"patient-{i // 2}", hot(i % 3)) for i in range(10)]
    got = folds_of(spark, studies)
    assert all(got[f"study-{2 * i}"] == got[f"study-{2 * i + 1}"] for i in range(5))


def test_duplicates_stay_together(spark):
    studies = [(f"study-{i}", f"patient-{i}", hot(i % 3)) for i in range(10)]
    got = folds_of(spark, studies, [("study-0", "study-9"), ("study-1", "stranger")])
    assert got["study-0"] == got["study-9"]


def test_folds_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    for module in (graph, split):
        def noted(df, name, write=module.materialize):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, name)

        monkeypatch.setattr(module, "materialize", noted)
    studies = [(f"study-{i}", f"p{i // 3}", [float(i % 2)] * 12) for i in range(60)]
    df = spark.createDataFrame(studies, "study_id string, patient_hash string, labels array<double>")
    links = spark.createDataFrame([("study-0", "study-9")], "study_a string, study_b string")
    out = split.assign_folds(df, 3, 7, links)
    plans.append(("folds", out._jdf.queryExecution().executedPlan().toString()))
    assert {"edges", "labels", "groups"} <= {name for name, _ in plans}
    for name, plan in plans:
        # Only what a row for each class, bucket or range says may be broadcast.
        assert plan.count("BroadcastHashJoin") <= {"placed": 2, "folds": 1}.get(name, 0), (name, plan)
    assert out.count() == 60


@pytest.mark.parametrize("seed, folds", [(1, 3), (2, 7)])
def test_generated_studies_keep_the_invariants(spark, seed, folds):
    rng = np.random.default_rng(seed)
    n = 900
    labelled = rng.random(n) < 0.08
    studies = [(f"s{i:04}", f"p{rng.integers(0, 700)}" if rng.random() < 0.5 else None, hot(int(rng.integers(0, 12))) if labelled[i] else None) for i in range(n)]
    edges = [(f"s{rng.integers(0, n):04}", f"s{rng.integers(0, n):04}") for _ in range(60)]
    got = folds_of(spark, studies, edges, folds=folds)
    assert len(got) == n and set(got.values()) <= set(range(folds))
    assert all(got[a] == got[b] for a, b in edges)
    by_patient = {}
    for s, p, _ in studies:
        if p:
            assert by_patient.setdefault(p, got[s]) == got[s]
    # Groups by a plain search; those with a label are level to one, and sizes as level as the largest group allows.
    group = {s: s for s, _, _ in studies}
    ties = [*edges, *((s, t) for (s, p, _), (t, q, _) in zip(sorted(studies, key=lambda x: x[1] or ""), sorted(studies, key=lambda x: x[1] or "")[1:]) if p and p == q)]
    for _ in range(n):
        before = dict(group)
        for a, b in ties:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    marked = {group[s] for s, _, y in studies if y}
    level = np.bincount([got[g] for g in marked], minlength=folds)
    sizes = np.bincount(list(got.values()), minlength=folds)
    assert level.max() - level.min() <= 1 and sizes.max() - sizes.min() <= 2 * max(np.unique(list(group.values()), return_counts=True)[1])


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("study-a", "patient-1", 0), ("study-b", "patient-1", 1)], "study_id string, patient_hash string, fold int")
    assert [tuple(r) for r in split.leaks(df, "patient_hash").collect()] == [("patient_hash", "patient-1", 2)]
    with pytest.raises(ValueError, match="patient_hash"):
        split.require_disjoint(df, ["study_id", "patient_hash"])
    split.require_disjoint(df, ["study_id"])


def test_fill_evenly():
    assert split.fill_evenly(np.array([5, 1, 1]), 8).tolist() == [0, 4, 4]
    assert split.fill_evenly(np.array([5, 0]), 2).tolist() == [0, 2]
    assert split.fill_evenly(np.array([0, 0]), 0).tolist() == [0, 0]


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [("l", float(rng.integers(0, 6)), float(rng.integers(0, 2))) for _ in range(60)] + [("one", 1.0, 1.0), ("l", None, 1.0)]
    df = spark.createDataFrame(rows, "label string, s double, y double")
    got = {r["label"]: r["auc"] for r in metrics.auc(df, "label", "s", "y").collect()}
    pos = [s for la, s, y in rows if la == "l" and y == 1 and s is not None]
    neg = [s for la, s, y in rows if la == "l" and y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got["l"] == pytest.approx(want) and got["one"] is None
    assert tuple(metrics.macro_auc(metrics.auc(df, "label", "s", "y")).first()) == (pytest.approx(want), 1)


def test_bce_and_ranking(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", -1.0, 0.0), ("a", 0.5, None), ("b", 1.0, 1.0)], "label string, z double, y double")
    sp = lambda x: np.log1p(np.exp(x))
    assert losses.masked_bce(df, "z", "y").first()["loss"] == pytest.approx(np.mean([sp(-2), sp(-1), sp(-1)]))
    assert losses.masked_bce(df.where("y is null"), "z", "y").first()["loss"] == 0.0
    assert [(r["label"], r["loss"]) for r in losses.pairwise_ranking(df, "label", "z", "y").collect()] == [("a", pytest.approx(sp(-3)))]


def test_softmax_pool_and_masked_pool(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0])], "g int, w int, f array<double>")
    weights = np.exp([3.0, 2.0]) / np.exp([3.0, 2.0]).sum()
    got = {r["dim"]: r["pooled"] for r in pooling.attention(df, "g", "f", [3.0, 1.0]).collect()}
    assert got[0] == pytest.approx(weights[0]) and got[1] == pytest.approx(2 * weights[1])
    none = pooling.mean_max(df, "g", "f", F.lit(False)).collect()
    assert {(r["mean"], r["maximum"]) for r in none} == {(0.0, 0.0)}


def test_coverage_loss_matches_arithmetic(spark):
    scores = [(0, w, 0, s, e) for w, (s, e) in enumerate([(1.0, 0.9), (0.2, 0.5), (-1.0, 0.8)])]
    df = spark.createDataFrame(scores, "study int, window int, label int, score double, evidence double")
    lab = spark.createDataFrame([(0, 0, 1.0)], "study int, label int, value double")
    gate = 1 / (1 + np.exp(-(np.array([1.0, 0.2, -1.0]) - 0.2) / 0.2))
    want = 1 - np.prod(1 - np.minimum(gate * [0.9, 0.5, 0.8], 1 - 1e-6))
    got = losses.coverage_loss(df, lab, k=2).first()
    assert got["coverage"] == pytest.approx(want) and got["loss"] == pytest.approx(-np.log(want))


def test_pixels(spark):
    x = [float(i) for i in range(64)]
    df = spark.createDataFrame([(1, x), (2, [5.0] * 4), (3, [float("nan")] * 3)], "k int, v array<double>")
    s = {r["k"]: r for r in df.select("k", *pixels.pixel_stats("v"), pixels.pixel_status("v").alias("status")).collect()}
    assert (s[1]["minimum"], s[1]["maximum"], s[1]["mean"], s[1]["status"]) == (0, 63, 31.5, "ok")
    assert s[1]["deviation"] == pytest.approx(np.std(x)) and s[3]["status"] == "error" and s[3]["finite_fraction"] == 0
    d = {r["k"]: r for r in pixels.deep_stats(df, "k", "v").collect()}
    share = np.histogram(x, 128)[0] / 64
    assert d[1]["entropy"] == pytest.approx(-(share[share > 0] * np.log2(share[share > 0])).sum())
    assert d[1]["p25"] == pytest.approx(np.percentile(x, 25)) and d[1]["mad"] == pytest.approx(16.0) and d[2]["entropy"] == 0
    z = [r["x"] for r in pixels.normalized(df, ["k"], "v", "zscore").where("k = 1").orderBy("place").collect()]
    assert np.allclose(z, (np.array(x) - 31.5) / np.std(x))
    assert {r["x"] for r in pixels.normalized(df, ["k"], "v", "per_slice_robust").where("k = 3").collect()} == {0.0}
    with pytest.raises(KeyError):
        pixels.normalized(df, ["k"], "v", "other")


def test_resize():
    image = np.arange(16.0).reshape(4, 4)
    assert np.allclose(pixels.resize_bilinear(image, 4, 4), image)
    assert np.allclose(pixels.resize_bilinear(image, 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert pixels.resize_bilinear(np.ones((3, 5)), 7, 2).shape == (7, 2)
