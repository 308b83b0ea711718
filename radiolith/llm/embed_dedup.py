"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the largest
coordinate with its sign, one of 2 d values.  A table's bucket is ``hashes`` of these from independent rotations.
Vectors live in their own bucket and also visit the next likeliest ones (multiprobe).  Whoever lives in a bucket is
compared with all that live there or visit, in double precision.

Only bucket, name and a sketch of signs (``SKETCH`` bits of the first rotations) travel to the buckets.  There sketches tell who can be
near anyone at all, with a margin of ``MARGIN`` deviations, and only those have their vectors fetched, once for each part of a bucket.

Equal vectors are one class with a weight and never expanded.  A pair met in several tables counts in the first, which
both sides' codes tell, so link counts need no list of pairs; parts of buckets give counts and spanning links only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, discard, heavy_keys, materialize, spread_join
from .vectors import matrix, takes_part

SIMILARITY = 0.98
TABLES = 5
PROBES = 3
#: Most vectors that live in one part of a bucket.
HOME_PART = 1024
#: Most bits of a sketch, and by how many deviations more bits than expected a pair at the similarity may differ.
SKETCH = 256
MARGIN = 8.0
SEED = 20_260


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes_of(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Bucket codes of the rows of ``x``: (rows, tables, 1 + probes), the own bucket first, then by likelihood."""
    return codes_and_sketches(x, tables, hashes, probes, seed)[0]


def codes_and_sketches(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Bucket codes, and the signs of the first rotations' coordinates as whole 64-bit words."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    unit = np.zeros((n, width))
    unit[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    top = min(3, width)
    rows = np.arange(n)[:, None]
    signs: list[np.ndarray] = []
    for t in range(tables):
        rng = np.random.default_rng([seed, t, width])
        code, cost = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            y = unit
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width))
            if len(signs) * width < SKETCH:
                signs.append(y < 0)
            size = np.abs(y)
            best = np.argpartition(-size, top - 1, axis=1)[:, :top]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable"), 1)
            value = 2 * best + (y[rows, best] < 0)
            loss = (size[rows, best[:, :1]] - size[rows, best]) ** 2
            code = (code[:, :, None] * (2 * width) + value[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + loss[:, None, :]).reshape(n, -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = np.take_along_axis(code, order, 1)
    packed = np.packbits(np.concatenate(signs, axis=1), axis=1)[:, : SKETCH // 8]
    whole = np.zeros((n, -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    whole[:, : packed.shape[1]] = packed
    return out, whole.view("<u8")


def most_bits(similarity: float, dim: int, tables: int, hashes: int) -> int:
    """How many bits the sketches of two vectors of the similarity can differ in; all, where coordinates are too few to go by."""
    width = 1 << max(1, (dim - 1).bit_length())
    bits = min(SKETCH, width * tables * hashes)
    if width < 16:
        return bits
    p = math.acos(max(-1.0, min(1.0, similarity))) / math.pi
    return min(bits, math.ceil(bits * p + MARGIN * math.sqrt(bits * p * (1 - p))) + 1)


_THIN = "label long, dim int, tab int, bucket long, home boolean, rep long, sketch binary"


def _code_type(dim: int, hashes: int) -> type:
    """The least integer type for bucket codes of vectors of length ``dim``."""
    return np.int32 if (2 << max(1, (dim - 1).bit_length())) ** hashes <= 1 << 31 else np.int64


def _spread(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            n = len(own)
            codes, sketches = codes_and_sketches(matrix(own.column(3)), tables, hashes, probes)
            blobs = pa.array([x.tobytes() for x in sketches], pa.binary())
            for t in range(tables):
                for p in range(1 + probes):
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(n, t), pa.int32()), pa.array(codes[:, t, p]), pa.array(np.full(n, p == 0)), own.column(2), blobs], ["label", "dim", "tab", "bucket", "home", "rep", "sketch"])


def _coded(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Of classes (rep, weight, embedding) the codes and vectors as bytes."""
    for batch in batches:
        lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            own = batch.filter(pa.array(lengths == dim))
            x = matrix(own.column(2))
            codes = codes_of(x, tables, hashes, probes).astype(_code_type(dim, hashes))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], ["rep", "weight", "codes", "vector"])


def _groups(batch: pa.RecordBatch, keys: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Key columns of a sorted batch, and where its groups begin and end."""
    cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)]
    new = np.zeros(len(batch), dtype=bool)
    new[:1] = True
    for k in cols:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return cols, first, np.append(first[1:], len(batch))


_MARKED = "label long, dim int, tab int, bucket long, hp int, rp int, home boolean, lives boolean, rep long"


def _mark(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Who can be near anyone in a part, by sketches.  Rows are ordered by part, those that live there first; guests stream by in blocks.
    A host is marked again with each batch that has a guest near it; repeats are dropped afterwards."""
    part, hosts = None, []
    for batch in batches:
        keys, first, last = _groups(batch, 6)
        home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
        rep = batch.column("rep").to_numpy(zero_copy_only=False).astype(np.int64)
        n_host = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
        edge = (np.arange(len(first)) == 0) | (np.arange(len(first)) == len(first) - 1)
        words = [np.frombuffer(x, dtype="<u8") for x in batch.column("sketch").to_pylist()]
        marked, again = np.zeros(len(batch), dtype=bool), []
        for g in np.flatnonzero(edge | ((n_host > 0) & (last - first > n_host))).tolist():
            a, b, h = int(first[g]), int(last[g]), int(n_host[g])
            key = tuple(int(k[a]) for k in keys)
            if key != part:
                part, hosts = key, []
            if h:
                hosts.append((rep[a : a + h], np.stack(words[a : a + h]), a))
            if not hosts or b - a == h:
                continue
            most = most_bits(similarity, key[1], tables, hashes)
            guests = np.stack(words[a + h : b])
            for host_rep, host_words, at in hosts:
                for c in range(0, len(guests), 2048):
                    bits = np.bitwise_count(host_words[:, None] ^ guests[None, c : c + 2048]).sum(axis=2, dtype=np.int32)
                    near = (bits <= most) & (host_rep[:, None] != rep[None, a + h + c : a + h + c + bits.shape[1]])
                    marked[a + h + c : a + h + c + bits.shape[1]] |= near.any(axis=0)
                    seen = near.any(axis=1)
                    if at is not None:
                        marked[at : at + len(seen)] |= seen
                    elif seen.any():
                        again.append((key, host_rep[seen]))
        hosts = [(r, w, None) for r, w, _ in hosts]  # the next batch can't mark rows of this one
        if marked.any():
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(9)], batch.schema.names[:9]).filter(pa.array(marked))
        for key, reps in again:
            n = len(reps)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k), t) for k, t in zip(key, kinds)), pa.array(np.ones(n, dtype=bool)), pa.array(np.ones(n, dtype=bool)), pa.array(reps)], batch.schema.names[:9])


class _Side:
    """Rows of a part: representatives, weights, whether they live here, codes and unit vectors."""

    def __init__(self, batch: pa.RecordBatch, tables: int, hashes: int, kind: str):
        self.rep = batch.column("rep").to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = batch.column("weight").to_numpy(zero_copy_only=False).astype(np.int64)
        self.lives = batch.column("lives").to_numpy(zero_copy_only=False).astype(bool)
        n = len(batch)
        x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=kind).reshape(n, -1).astype(np.float64)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=_code_type(x.shape[1], hashes)).reshape(n, tables, -1)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of codes of pairs (pairs, tables, 1 + probes): in which tables they come together at all."""
    return (u[:, :, :1] == v).any(axis=2) | (v[:, :, :1] == u).any(axis=2)


def _pairs_in(host: _Side, guest: _Side, table: int, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Links that this part is the first to see: (rep, count) contributions, and spanning links."""
    reps, counts, edges = [], [], []
    for a in range(0, len(guest.rep), 2048):
        close = host.unit @ guest.unit[a : a + 2048].T >= similarity
        i, j = np.nonzero(close)
        j = j + a
        on = host.rep[i] != guest.rep[j]
        i, j = i[on], j[on]
        for b in range(0, len(i), 1 << 16):
            h, g = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            cu, cv = host.codes[h], guest.codes[g]
            new = ~_meet(cu[:, :table], cv[:, :table]).any(axis=1) if table else np.ones(len(h), dtype=bool)
            both_live = guest.lives[g]
            visited_back = (cu[:, table, 1:] == cv[:, table, :1]).any(axis=1)
            new &= both_live | ~visited_back | (host.rep[h] < guest.rep[g])
            h, g, both_live = h[new], g[new], both_live[new]
            reps += [host.rep[h], guest.rep[g[~both_live]]]  # two that live here see each other from both sides
            counts += [guest.weight[g], host.weight[h[~both_live]]]
        if len(i):
            edges.append(_spanning(host.rep, guest.rep, i, j))
    return reps, counts, np.concatenate(edges) if edges else np.empty((0, 2), dtype=np.int64)


def _spanning(host_rep, guest_rep, i, j) -> np.ndarray:
    """Links that connect what (i, j) connect: each guest to its first host, and hosts of one guest in a chain."""
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    first = np.append(True, j[1:] != j[:-1])
    star = np.stack([host_rep[i[first]], guest_rep[j[first]]], axis=1)
    chain = np.flatnonzero(~first)
    links = np.unique(np.stack([i[chain - 1], i[chain]], axis=1), axis=0) if len(chain) else np.empty((0, 2), dtype=np.int64)
    # Chains over hosts: at most one link to the host before is needed for each host once those are joined.
    root = np.arange(len(host_rep))
    kept = []
    for a, b in links.tolist():
        while root[a] != a:
            root[a] = root[root[a]]
            a = int(root[a])
        while root[b] != b:
            root[b] = root[root[b]]
            b = int(root[b])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((host_rep[a], host_rep[b]))
    return np.concatenate([star, np.array(kept, dtype=np.int64).reshape(-1, 2)])


def _compare(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, similarity: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows ordered by part, those that live there (hosts) first; guests stream by in blocks."""
    part, hosts = None, []
    for batch in batches:
        keys, first, last = _groups(batch, 6)
        host = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
        n_host = np.add.reduceat(host.astype(np.int64), first) if len(first) else first
        n_guest = (last - first) - n_host
        edge = (np.arange(len(first)) == 0) | (np.arange(len(first)) == len(first) - 1)
        reps, counts, links = [], [], []
        for g in np.flatnonzero(edge | ((n_host > 0) & (n_guest > 0))).tolist():
            a, b = int(first[g]), int(last[g])
            key = tuple(int(k[a]) for k in keys)
            if key != part:
                part, hosts = key, []
            if n_host[g]:
                hosts.append(batch.slice(a, int(n_host[g])))
            if n_guest[g] and hosts:
                home = _Side(pa.Table.from_batches(hosts).combine_chunks().to_batches()[0], tables, hashes, kind)
                r, c, e = _pairs_in(home, _Side(batch.slice(a + int(n_host[g]), int(n_guest[g])), tables, hashes, kind), key[2], similarity)
                reps += r
                counts += c
                links.append(e)
        if reps:
            ids, at = np.unique(np.concatenate(reps), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts), minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(total, pa.int64())], ["a", "b", "n"])
        if links and len(pairs := np.unique(np.concatenate(links), axis=0)):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "n"])


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, probes: int = PROBES, hashes: int | None = None, home_part: int = HOME_PART) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their lengths are equal and their cosine is at least ``similarity``.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without label or vec_id, link with
    nothing and are their own component.  Rows that repeat a vector are links of each other.  Other columns are not read.
    ``hashes`` per table grow with the rows (2 up to 2 million) so that buckets stay small, and tables with them.
    """
    pair = [F.xxhash64("embedding").alias("_rl_h1"), F.xxhash64(F.lit(1), "embedding").alias("_rl_h2")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"), takes_part().alias("_rl_on"))
    on = rows.where("_rl_on and label is not null and vec_id is not null")
    classes = materialize(on.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    total = rows.count()
    if hashes is None:
        n = classes.count()
        hashes = 2 + max(0, math.ceil(math.log(max(n, 1) / 2e6) / math.log(128)))
        tables += 2 * (hashes - 2)
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "f8"  # as exact as they came
    setting = dict(tables=tables, hashes=hashes)
    spread = materialize(classes.select("label", F.size("embedding").alias("dim"), "rep", "embedding").mapInArrow(partial(_spread, probes=probes, **setting), _THIN), "buckets")
    key = ["label", "dim", "tab", "bucket"]
    # A bucket with one class has no pair; of the others the home rows decide on parts.
    sized = spread.groupBy(key).agg(F.count_if("home").alias("n"), F.count("*").alias("all")).where("n > 0 and all > 1")
    sized = materialize(sized.withColumn("parts", F.ceil(F.col("n") / home_part).cast("int")), "sized")
    heavy = heavy_keys(sized.select(*key, "all"), "all", spread.count())
    dealt = spread_join(spread, sized.select(*key, "parts"), key, heavy, F.xxhash64("rep"), "inner").withColumn("lives", F.col("home"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    others = F.expr("sequence(0, parts - 1)")
    hosts = dealt.where("home").withColumn("hp", own).withColumn("rp", F.explode(others))
    guests = dealt.withColumn("home", F.lit(False)).withColumn("hp", F.explode(others)).withColumn("rp", own)
    cell = [*key, "hp", "rp"]
    grid = hosts.unionByName(guests).select(*cell, "home", "lives", "rep", "sketch").repartition(*cell).sortWithinPartitions(*cell, F.desc("home"))
    marked = grid.mapInArrow(partial(_mark, similarity=similarity, **setting), _MARKED)
    marked = materialize(marked.distinct(), "marked")
    discard(spread)
    discard(sized)
    wanted = classes.join(marked.select("rep").distinct(), "rep", "left_semi").select("rep", "weight", "embedding")
    coded = materialize(wanted.mapInArrow(partial(_coded, probes=probes, kind=kind, **setting), "rep long, weight long, codes binary, vector binary"), "coded")
    near = marked.join(coded, "rep").select(*cell, "home", "lives", "rep", "weight", "codes", "vector")
    keyed = near.repartition(*cell).sortWithinPartitions(*cell, F.desc("home"))
    found = materialize(keyed.mapInArrow(partial(_compare, similarity=similarity, kind=kind, **setting), "a long, b long, n long"), "found")
    discard(marked)
    discard(coded)
    components = connected_components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    settled = classes.join(linked, F.col("rep") == F.col("a"), "left").join(components, F.col("rep") == F.col("node"), "left")
    # 128 bits of hash name a vector here, so that rows need not carry theirs; two vectors that share them would share a result.
    settled = settled.select(F.col("label").alias("_rl_label"), *pair, "weight", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    settled = materialize(settled.where("weight > 1 or n_links > 0"), "settled")
    name = ["_rl_label", "_rl_h1", "_rl_h2"]
    many = heavy_keys(settled.select(*name, "weight"), "weight", total)
    named = rows.select("vec_id", F.when(F.col("_rl_on") & F.col("vec_id").isNotNull(), F.col("label")).alias("_rl_label"), *pair)
    whole = spread_join(named, settled.drop("weight"), name, many, F.xxhash64("vec_id"))
    out = whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
