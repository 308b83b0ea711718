"""Approximate nearest neighbours by inner product: stable projections in a kd-tree, with a chi-square stopping test.

Largest inner product is nearest distance once every vector has one more component that brings it to the greatest norm (of its
band: norms within a factor of two in the square) and queries have zero there.  The vectors are projected to a few dimensions by a Gaussian
(2-stable) matrix, so the squared projected distance over the squared true one follows the chi-square law.  The component more is the same for all queries, so it isn't
projected but kept as an exact axis.  A point as near as a query's k-th best has, with probability ``CONFIDENCE``, a squared projected distance, over the
law's quantile, that with the square of its exact axis is within the square of that best distance: beyond it nothing is verified.

Cells.  A kd-tree on the projections of a bounded sample (``SAMPLE`` rows) deals all rows to at most ``MOST_CELLS`` cells a band, whose boxes
are those of all their rows.  A query first goes to the cells nearest to its projection, until they hold ``FIRST_ROWS`` rows, and with the k-th best score
from there only to those other cells that the test leaves open.  A vector is never copied to all queries, nor a query to all cells.

Within a part of a cell a kd-tree gives its leaves by projected distance, and points are verified on the original vectors until the test holds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release_memory
from .vectors import matrix, squared_norm, takes_part

DIMENSIONS = 24
CONFIDENCE = 0.95
LEAF = 256
#: Rows that the cells are fitted on, rows that a cell should have, and most cells.
SAMPLE = 65_536
CELL_ROWS = 1024
MOST_CELLS = 4096
#: Rows that a query's first cells hold at least, rows in a part of a cell, and queries of a cell in one task.
FIRST_ROWS = 4096
PART = 4096
CHUNK = 65_536
SEED = 7


def chi_square_cdf(x: float, dimensions: int) -> float:
    """Of an even number of dimensions."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dimensions // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


@lru_cache(maxsize=64)
def chi_square_quantile(p: float, dimensions: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dimensions) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dimensions) < p else (low, middle)
    return high


def projection(length: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dimensions))


def placed(points: np.ndarray, top: float | None, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Projections over the root of the law's quantile, and the component that brings the squared norm to ``top`` (0 for queries, whose ``top`` is None).

    What is within a distance has, with probability ``confidence``, its place within that distance of the query's."""
    near = points @ projection(points.shape[1], dimensions) / math.sqrt(chi_square_quantile(confidence, dimensions))
    more = np.zeros(len(points)) if top is None else np.sqrt(np.maximum(top - (points * points).sum(axis=1), 0.0))
    return np.column_stack([near, more])


class CellTree:
    """Splits of a kd-tree fitted on a sample, to deal any points to its leaves."""

    def __init__(self, points: np.ndarray, leaf: float):
        self.axis, self.at, self.child = [0], [0.0], [[-1, -1]]
        self.leaves = 0
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            axis = int(np.argmax(np.ptp(points[own], axis=0))) if len(own) else 0
            values = np.sort(points[own, axis])
            middle = values[len(values) // 2] if len(own) else 0.0
            below = points[own, axis] < middle
            if len(own) < 2 * leaf or not below.any():
                self.child[node] = [-1, self.leaves]
                self.leaves += 1
                continue
            self.axis[node], self.at[node] = axis, float(middle)
            for side, part in enumerate((own[below], own[~below])):
                self.child[node][side] = len(self.axis)
                self.axis.append(0)
                self.at.append(0.0)
                self.child.append([-1, -1])
                stack.append((self.child[node][side], part))

    def assign(self, points: np.ndarray) -> np.ndarray:
        axis, at, child = np.array(self.axis), np.array(self.at), np.array(self.child)
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(child[node, 0] >= 0)
            if not len(inner):
                return child[node, 1]
            n = node[inner]
            node[inner] = child[n, (points[inner, axis[n]] >= at[n]).astype(np.int64)]


class KdTree:
    """Leaves of a kd-tree: order of the points, where leaves begin, and their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            stack += [(a + middle, b), (a, a + middle)]
        self.leaves = bounds
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in bounds])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in bounds])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of every query to every leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[:, d] - q, q - self.high[:, d]), 0.0)
            out += gap * gap
        return out


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, top_norm: float, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's row, id, inner product) of up to ``k`` best points for each query, and how many points were verified in all.

    ``known`` has each query's k-th best score from elsewhere; what is worse isn't returned.  Scores are sums in double precision over
    one row at a time, so equal vectors score equally; ties go to smaller ids.
    """
    return Part(points, ids, top_norm, confidence, dimensions).search(queries, query_ids, k, known)


class Part:
    """Points with a kd-tree on their projections."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, top_norm: float, confidence: float, dimensions: int):
        by_id = np.argsort(ids, kind="stable")
        points, ids = points[by_id], ids[by_id]
        self.top, self.setting = top_norm, (confidence, dimensions)
        near = placed(points, top_norm, *self.setting)
        self.tree = KdTree(near)
        self.points, self.ids, self.near = points[self.tree.order], ids[self.tree.order], near[self.tree.order]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        tree, ids = self.tree, self.ids
        near = placed(queries, None, *self.setting)
        distance = tree.distances(near)
        visits = np.argsort(distance, axis=1, kind="stable")
        reach = (queries * queries).sum(axis=1) + self.top  # squared distance is this less twice the product
        n = len(queries)
        worst = np.full(n, -np.inf) if known is None else known.astype(np.float64).copy()  # the k-th best score so far
        best_q, best_p, best_s = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        active, verified = np.arange(n), 0
        for turn in range(len(tree.leaves)):
            leaf = visits[active, turn]
            limit = np.maximum(reach[active] - 2 * worst[active], 0.0)
            going = ~(distance[active, leaf] > limit)  # also while there aren't k yet
            active, leaf, limit = active[going], leaf[going], limit[going]
            if not len(active):
                break
            new_q, new_p, new_s = [best_q], [best_p], [best_s]
            for at in np.unique(leaf):
                a, b = tree.leaves[at]
                mine = leaf == at
                who = active[mine]
                block, own, q = self.points[a:b], self.near[a:b], near[who]
                apart = (q * q).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None, :] - 2 * (q @ own.T)
                slack = 1e-9 * (1.0 + np.abs(worst[who]))
                slack[~np.isfinite(slack)] = 0.0
                least = worst[who] - slack
                open_ = apart <= (limit[mine] * (1 + 1e-9) + 1e-9)[:, None]
                count = int(np.count_nonzero(open_))
                verified += count
                if count > open_.size // 8:  # one product for all is cheaper than picking these out
                    open_ &= queries[who] @ block.T >= least[:, None]
                i, j = np.nonzero(open_)
                score = (queries[who[i]] * block[j]).sum(axis=1)
                ok = (score >= least[i]) & (ids[a + j] != query_ids[who[i]])
                new_q.append(who[i[ok]])
                new_p.append(a + j[ok])
                new_s.append(score[ok])
            q, p, s = np.concatenate(new_q), np.concatenate(new_p), np.concatenate(new_s)
            if not len(q):
                continue
            order = np.lexsort((ids[p], -s, q))
            q, p, s = q[order], p[order], s[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            full = rank == k - 1
            worst[q[full]] = np.maximum(worst[q[full]], s[full])
            keep = rank < k
            best_q, best_p, best_s = q[keep], p[keep], s[keep]
        return best_q, ids[best_p], best_s, verified


# --- over the table ------------------------------------------------------------------------------------------------


class Cells:
    """All cells: length and band of their vectors, greatest squared norm of the band, rows, and boxes of the projections."""

    def __init__(self, trees: dict, tops: dict, offsets: dict, confidence: float, dimensions: int):
        self.trees, self.tops, self.offsets, self.setting = trees, tops, offsets, (confidence, dimensions)
        self.size = sum(t.leaves for t in trees.values())
        self.dim, self.top = np.zeros(self.size, dtype=np.int64), np.zeros(self.size)
        for key, tree in trees.items():
            span = slice(offsets[key], offsets[key] + tree.leaves)
            self.dim[span], self.top[span] = key[0], tops[key]
        self.rows = np.zeros(self.size, dtype=np.int64)
        self.low, self.high = np.zeros((self.size, dimensions + 1)), np.zeros((self.size, dimensions + 1))

    def parts(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // PART))

    def visits(self, dim: int, queries: np.ndarray, worst: np.ndarray | None, first_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's row, cell) of the first cells, or, with the k-th best scores, of the other cells that are still open."""
        cells = np.flatnonzero((self.dim == dim) & (self.rows > 0))
        if not len(cells) or not len(queries):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        near = placed(queries, None, *self.setting)
        apart = np.zeros((len(queries), len(cells)))
        for d in range(near.shape[1]):
            q = near[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[cells, d] - q, q - self.high[cells, d]), 0.0)
            apart += gap * gap
        # Open while apart <= |q|^2 + top - 2 worst: by this order what is open comes before what is not, whatever the score.
        value = apart - self.top[cells]
        order = np.argsort(value, axis=1, kind="stable")
        before = np.cumsum(self.rows[cells][order], axis=1) - self.rows[cells][order]
        taken = np.zeros(value.shape, dtype=bool)
        np.put_along_axis(taken, order, before < first_rows, axis=1)
        if worst is not None:
            bound = (queries * queries).sum(axis=1) - 2 * worst
            taken = ~taken & (value <= (bound + 1e-9 * (1 + np.abs(bound)))[:, None])
        i, j = np.nonzero(taken)
        return i, cells[j]


def _band(norm: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(norm)).astype(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a list column by length: the length, their places, and the matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, matrix(column.take(pa.array(at)))


def _sampled(batches: Iterator[pa.RecordBatch], tops: dict, confidence: float, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, _, x in _by_length(batch.column(0)):
            band = _band((x * x).sum(axis=1))
            for b in np.unique(band).tolist():
                own = placed(x[band == b], tops[dim, b], confidence, dimensions)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, b), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in own], pa.binary())], ["dim", "band", "near"])


def _dealt(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Every vector with its cell; at the end, rows and box of each cell so far."""
    rows: dict[int, int] = defaultdict(int)
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    kind = None
    for batch in batches:
        kind = batch.column(1).type
        cell = np.empty(len(batch), dtype=np.int32)
        for dim, at, x in _by_length(batch.column(1)):
            band = _band((x * x).sum(axis=1))
            for b in np.unique(band).tolist():
                own = at[band == b]
                near = placed(x[band == b], cells.tops[dim, b], *cells.setting)
                cell[own] = cells.offsets[dim, b] + (found := cells.trees[dim, b].assign(near))
                for c in np.unique(found).tolist():
                    mine, c = near[found == c], cells.offsets[dim, b] + c
                    rows[c] += len(mine)
                    low[c] = mine.min(axis=0) if c not in low else np.minimum(low[c], mine.min(axis=0))
                    high[c] = mine.max(axis=0) if c not in high else np.maximum(high[c], mine.max(axis=0))
        n = len(batch)
        none = pa.nulls(n, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), pa.nulls(n, pa.int64()), none, none], ["cell", "vec_id", "embedding", "n", "low", "high"])
    if rows:
        names, n = list(rows), len(rows)
        boxes = [pa.array([v[c].tolist() for c in names], pa.list_(pa.float64())) for v in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.array([rows[c] for c in names], pa.int64()), *boxes], ["cell", "vec_id", "embedding", "n", "low", "high"])


def _count_visits(batches: Iterator[pa.RecordBatch], cells: Cells, again: bool, first_rows: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(cells.size, dtype=np.int64)
    for batch in batches:
        worst = batch.column(2).to_numpy(zero_copy_only=False)
        for dim, at, x in _by_length(batch.column(1)):
            _, cell = cells.visits(dim, x, worst[at] if again else None, first_rows)
            total += np.bincount(cell, minlength=cells.size)
    on = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on])], ["cell", "visits"])


def _visit(batches: Iterator[pa.RecordBatch], cells: Cells, again: bool, first_rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        worst = batch.column(2).to_numpy(zero_copy_only=False)
        for dim, at, x in _by_length(batch.column(1)):
            row, cell = cells.visits(dim, x, worst[at] if again else None, first_rows)
            for a in range(0, len(row), 4096):
                own, to = pa.array(at[row[a : a + 4096]]), pa.array(cell[a : a + 4096], pa.int32())
                yield pa.RecordBatch.from_arrays([to, *(batch.column(k).take(own) for k in range(3))], ["cell", "vec_id", "embedding", "worst"])


def _search_parts(batches: Iterator[pa.RecordBatch], k: int, tops: np.ndarray, confidence: float, dimensions: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by part, its vectors before its queries: a part's tree is built when the first query comes.  A row without vec_id
    tells how many points were verified."""
    key, held, part = None, [], None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)]
        new = np.zeros(len(batch), dtype=bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), np.append(first[1:], len(batch)).tolist()):
            if tuple(int(c[a]) for c in cols[:3]) != key:
                key, held, part = tuple(int(c[a]) for c in cols[:3]), [], None
            own = batch.slice(a, b - a)
            ids, vectors = own.column(4).to_numpy(zero_copy_only=False), matrix(own.column(5))
            if cols[3][a] == 0:
                held.append((vectors, ids))
                continue
            if part is None and held:
                part = Part(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), float(tops[key[0]]), confidence, dimensions)
                held = []
            if part is None:
                continue
            q, found, scores, verified = part.search(vectors, ids, k, own.column(6).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[q], -1)), pa.array([*found.tolist(), None], pa.int64()), pa.array(np.append(scores, float(verified)))], ["query_id", "vec_id", "score"])
    release_memory()


def _best(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def _found(vectors: DataFrame, is_query, k: int, confidence: float, dimensions: int, cell_rows: int, first_rows: int) -> tuple[DataFrame, DataFrame, int, int] | None:
    """Scores found, work done, rows and queries."""
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & takes_part())
    repeated = materialize(named.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if not repeated.isEmpty():
        once = named.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        named = named.join(repeated, "vec_id", "left_anti").unionByName(once)
    rows = materialize(named, "vectors")
    norm = squared_norm()
    bands = rows.groupBy(F.size("embedding").alias("dim"), F.floor(F.log2(norm)).cast("int").alias("band")).agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("asked"), F.max(norm).alias("top")).collect()
    n, asked = sum(r["n"] for r in bands), sum(r["asked"] for r in bands)
    if not n or not asked:
        return None
    # The logarithm's last digit may put a norm at a band's edge on either side, so each band's top counts for its neighbours.
    tops: dict = {}
    for r in bands:
        for b in (r["band"] - 1, r["band"], r["band"] + 1):
            tops[r["dim"], b] = max(tops.get((r["dim"], b), 0.0), min(r["top"], 2.0 ** (b + 1) * (1 + 1e-12)))
    every = max(1, -(-n // SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(every)) == 0).select("embedding").mapInArrow(partial(_sampled, tops=tops, confidence=confidence, dimensions=dimensions), "dim int, band int, near binary").toArrow()
    points = defaultdict(list)
    for d, b, near in zip(*(sample.column(c).to_pylist() for c in range(3))):
        points[d, b].append(np.frombuffer(near, dtype="<f4"))
    leaf = max(1.0, max(cell_rows, n / MOST_CELLS) / every)
    trees = {key: CellTree(np.array(points[key], dtype=np.float64).reshape(-1, dimensions + 1), leaf) for key in tops}
    offsets, at = {}, 0
    for key, tree in trees.items():
        offsets[key], at = at, at + tree.leaves
    cells = Cells(trees, tops, offsets, confidence, dimensions)
    kind = vectors.schema["embedding"].dataType.simpleString()
    dealt = materialize(rows.mapInArrow(partial(_dealt, cells=cells), f"cell int, vec_id long, embedding {kind}, n long, low array<double>, high array<double>"), "cells")
    box = [f(F.get(c, F.lit(d))).alias(f"{c}{d}") for c, f in (("low", F.min), ("high", F.max)) for d in range(dimensions + 1)]
    for r in dealt.where("n is not null").groupBy("cell").agg(F.sum("n").alias("n"), *box).collect():
        cells.rows[r["cell"]] = r["n"]
        cells.low[r["cell"]], cells.high[r["cell"]] = ([r[f"{c}{d}"] for d in range(dimensions + 1)] for c in ("low", "high"))
    discard(rows)
    discard(repeated)
    corpus = dealt.where("vec_id is not null").select("cell", "vec_id", "embedding")
    queries = corpus.where(is_query(F.col("vec_id"))).select("vec_id", "embedding", F.lit(float("-inf")).alias("worst"))
    visited = f"cell int, vec_id long, embedding {kind}, worst double"

    def round_of(asking: DataFrame, again: bool, name: str) -> DataFrame:
        setting = dict(cells=cells, again=again, first_rows=first_rows)
        visits = np.zeros(cells.size, dtype=np.int64)
        for r in asking.mapInArrow(partial(_count_visits, **setting), "cell int, visits long").groupBy("cell").agg(F.sum("visits")).collect():
            visits[r[0]] = r[1]
        on = np.flatnonzero(visits)
        plan = spark.createDataFrame([(int(c), int(cells.parts()[c]), int(-(-visits[c] // CHUNK))) for c in on], "cell int, parts int, chunks int")
        upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        deal = lambda column, count, seed: F.pmod(F.xxhash64(column, F.lit(seed)), F.col(count)).cast("int")
        held = corpus.join(F.broadcast(plan), "cell").withColumn("part", deal("vec_id", "parts", 2)).withColumn("chunk", upto("chunks"))  # the plan has a row for each cell
        held = held.select("cell", "part", "chunk", F.lit(0).alias("side"), "vec_id", "embedding", F.lit(None).cast("double").alias("worst"))
        come = asking.mapInArrow(partial(_visit, **setting), visited).join(F.broadcast(plan), "cell").withColumn("chunk", deal("vec_id", "chunks", 3)).withColumn("part", upto("parts"))
        come = come.select("cell", "part", "chunk", F.lit(1).alias("side"), "vec_id", "embedding", "worst")
        keyed = held.unionByName(come).repartition("cell", "part", "chunk").sortWithinPartitions("cell", "part", "chunk", "side")
        return materialize(keyed.mapInArrow(partial(_search_parts, k=k, tops=cells.top, confidence=confidence, dimensions=dimensions), "query_id long, vec_id long, score double"), name)

    first = round_of(queries, False, "first-found")
    best = _best(first.where("vec_id is not null"), k)
    worst = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    queries = queries.drop("worst").join(worst, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "embedding", F.coalesce("kth", F.lit(float("-inf"))).alias("worst"))
    queries = materialize(queries, "queries")
    second = round_of(queries, True, "then-found")
    discard(queries)
    both = first.unionByName(second)
    return both.where("vec_id is not null"), both.where("vec_id is null").select(F.col("score").alias("verified")), n, asked


def nearest(vectors: DataFrame, is_query, k: int = 20, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS, cell_rows: int = CELL_ROWS, first_rows: int = FIRST_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found to each row of ``vectors`` for which ``is_query`` holds.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without vec_id, take no part;
    vectors of different lengths aren't compared.  Of rows that repeat a vec_id the least vector takes part, compared component by
    component.  Fewer candidates give fewer ranks, an empty table none.  Other columns are not read.
    """
    found = _found(vectors, is_query, k, confidence, dimensions, cell_rows, first_rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _best(found[0], k).select("query_id", "rank", "vec_id", "score")


def share_verified(vectors: DataFrame, is_query, k: int = 20, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS, cell_rows: int = CELL_ROWS, first_rows: int = FIRST_ROWS) -> float:
    """Of all pairs of a query and a vector, the share that a search verifies on the original vectors."""
    found = _found(vectors, is_query, k, confidence, dimensions, cell_rows, first_rows)
    return 0.0 if found is None else float((found[1].agg(F.sum("verified")).collect()[0][0] or 0.0) / (found[2] * found[3]))
