import numpy as np
import pytest

from radiolith.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, block int, chunk int, bucket long, rep long"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA).repartition(3)


def vectors(seed, n=240, d=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = base[i % 12] + rng.normal(size=d) * rng.choice([0.01, 0.05, 0.4]) if i % 2 else rng.normal(size=d)
        rows.append((i, [float(np.float32(x)) for x in v], i % 12 % 3))
    rows += [(1000, rows[1][1], rows[1][2]), (1001, rows[1][1], rows[1][2]), (1002, [2 * x for x in rows[1][1]], rows[1][2]), (1003, rows[1][1], 7), (1004, rows[1][1], None)]
    rows += [(1100, None, 1), (1101, [0.0] * d, 1), (1102, [float("nan")] * d, 1), (1103, [float("inf")] + [0.0] * (d - 1), 1), (1104, [None] + [1.0] * (d - 1), 1), (1105, [], 1), (1106, rows[1][1][:7], rows[1][2])]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


@pytest.mark.parametrize("home_part, hashes", [(1024, None), (4, 2), (1024, 3)])
def test_links_equal_brute_force(spark, home_part, hashes):
    rows = vectors(1)
    links = {i: set() for i, _, _ in rows}
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    component = {i: i for i in links}
    for _ in links:
        component = {i: min([component[i], *(component[j] for j in links[i])]) for i in links}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(table(spark, rows), home_part=home_part, hashes=hashes, tables=5 if hashes != 3 else 7).collect()}
    assert got == {i: (len(links[i]), component[i], component[i] == i) for i in links}
    assert max(n for n, _, _ in got.values()) > 3


@pytest.mark.parametrize("hashes, tables", [(2, 5), (3, 7)])
def test_recall_at_the_threshold(hashes, tables):
    """Pairs at a cosine of 0.98 exactly: they meet in some table, and their sketches let them pass."""
    rng = np.random.default_rng(6)
    for d in (64, 100):
        u = rng.normal(size=(1500, d))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = 0.98 * u + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        a, s = embed_dedup.codes_and_sketches(u, tables, hashes, embed_dedup.PROBES)
        b, t = embed_dedup.codes_and_sketches(v, tables, hashes, embed_dedup.PROBES)
        assert embed_dedup._meet(a, b).any(axis=1).mean() >= 0.998
        bits = np.bitwise_count(s ^ t).sum(axis=1)
        assert (bits <= embed_dedup.most_bits(0.98, d, tables, hashes)).all() and embed_dedup.most_bits(0.98, d, tables, hashes) < 64


def test_crowded_bucket_of_distinct_near_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    x = (base + rng.normal(size=(2500, 24)) * 0.06).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), home_part=300).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert near.sum() > 1_000_000 and (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    assert all(got[i]["component_id"] == 0 for i in np.flatnonzero(near[0]).tolist())


def test_rows_without_id_and_repeated_rows(spark):
    v = [1.0, 2.0, 3.0]
    got = embed_dedup.near_duplicates(table(spark, [(None, v, 1), (2, v, 1), (2, v, 1), (3, v, 1)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"]) == [(2, 2, 2), (2, 2, 2), (3, 2, 2)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, None)]
    assert embed_dedup.near_duplicates(table(spark, [])).count() == 0


def test_hadamard_is_orthogonal():
    h = embed_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_codes_probe_distinct_buckets():
    x = np.random.default_rng(2).normal(size=(50, 20))
    codes = embed_dedup.codes_of(x, 3, 2, 3)
    assert codes.shape == (50, 3, 4) and all(len(set(c)) == 4 for row in codes for c in row)
    assert (codes == embed_dedup.codes_of(x * 7.5, 3, 2, 3)).all()


def test_chi_square():
    assert ann.chi_square_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))
    assert ann.chi_square_cdf(ann.chi_square_quantile(0.95, 8), 8) == pytest.approx(0.95)
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_tree_bounds_hold():
    points = np.random.default_rng(3).normal(size=(500, 4))
    points[100:200] = points[0]
    tree = ann.KdTree(points, leaf=16)
    assert sorted(tree.order) == list(range(500)) and sum(b - a for a, b in tree.leaves) == 500
    near = tree.distances(points[:5])
    for q in range(5):
        for (a, b), bound in zip(tree.leaves, near[q]):
            assert (((points[tree.order[a:b]] - points[q]) ** 2).sum(axis=1) >= bound - 1e-9).all()


def exact(rows, k):
    use = [(i, np.array(v)) for i, v, _ in rows if usable(v)]
    out = {}
    for i, v in use:
        if i % 20 == 0:
            s = sorted(((-(v * w).sum(), j) for j, w in use if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


@pytest.mark.parametrize("setting", [{}, {"cell_rows": 40, "first_rows": 90}])
def test_nearest_rows(spark, setting):
    rows = vectors(4, 600)
    rows += [(2000 + i, [100 * x for x in rows[i][1]], 1) for i in range(1, 8)] + [(3000 + i, [0.001 * x for x in rows[i][1]], 1) for i in range(20)]  # norms of other bands
    want = exact(rows, 20)
    got = {}
    for r in ann.nearest(table(spark, rows + [rows[3]]), lambda c: c % 20 == 0, **setting).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, len(want[q]) + 1))
        scores = [ranks[i] for i in sorted(ranks)]
        assert scores == sorted(scores, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("clusters, most", [(40, 0.25), (0, 0.75)])
def test_search_prunes(spark, clusters, most):
    """Clustered vectors, and vectors without any structure: what is verified, and what is found."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))] + 0.25 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]
    setting = {"cell_rows": 100, "first_rows": 200}
    frame = table(spark, rows).cache()
    assert 0 < ann.share_verified(frame, lambda c: c % 20 == 0, **setting) < most
    want, got = exact(rows, 20), {}
    for r in ann.nearest(frame, lambda c: c % 20 == 0, **setting).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({j for j, _ in want[q]} & got[q]) for q in want) >= 0.9 * 20 * len(want)


def test_repeated_ids_have_a_stated_vector(spark):
    rows = [(5, [0.0, 1.0], 0), (5, [1.0, 0.0], 0), (7, [2.0, 1.0], 0), (20, [1.0, 0.0], 0)]
    for _ in range(2):
        got = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.nearest(table(spark, rows), lambda c: c == 20).orderBy("rank").collect()]
        assert got == [(20, 7, 2.0), (20, 5, 0.0)]


def test_cells_deal_all_points():
    rng = np.random.default_rng(13)
    points = np.concatenate([rng.normal(size=(500, 3)), np.ones((200, 3))])
    tree = ann.CellTree(points, 20)
    cell = tree.assign(points)
    assert cell.min() == 0 and cell.max() == tree.leaves - 1 and len(set(cell[500:])) == 1 and np.bincount(cell[:500]).max() < 80


def test_nearest_ties_and_few(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(30)]
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(table(spark, rows), lambda c: c == 5).orderBy("rank").collect()]
    assert got == [(k + 1, i) for k, i in enumerate([i for i in range(30) if i != 5][:20])]
    few = ann.nearest(table(spark, rows[:3]), lambda c: c == 1).collect()
    assert sorted(r["vec_id"] for r in few) == [0, 2]
    assert ann.nearest(table(spark, rows[:1]), lambda c: c == 0).count() == 0
    assert ann.nearest(table(spark, []), lambda c: c == 0).count() == 0


def test_block_search_recall():
    rng = np.random.default_rng(5)
    points, queries = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    top = float((points * points).sum(axis=1).max())
    q, ids, s, verified = ann.search(points, np.arange(3000), queries, np.full(40, -1), 20, top)
    hits = 0
    for k in range(40):
        truth = np.argsort(-(points @ queries[k]), kind="stable")[:20]
        hits += len(set(truth) & set(ids[q == k]))
    assert hits >= 0.9 * 800 and 0 < verified < 0.8 * points.shape[0] * len(queries)
