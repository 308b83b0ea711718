"""SimHash near-duplicates by anchor-point covering.

Two fingerprints at 3 or fewer differing bits differ in at most one bit in one of their 32-bit halves.
On a half the anchors are a covering code: the perfect Hamming code on 31 bits, times the last bit as it is,
so every half lies within covering radius 1 of an anchor.  A fingerprint is at home at the anchor nearest to
each half and is replicated to every anchor within radius plus threshold, 1 + 1, which a syndrome
gives directly (2 or 17 anchors).  Whoever is at home at an anchor is compared with all that came to it, so
no pair within the threshold is missed.  Equal fingerprints are one class from the start, anchors with
many at home are dealt over a grid of parts, and parts give a spanning set of links, never all pairs.

Copies by similarity (``one_of_each_similar``) may differ in far more bits than anchors can cover.  Sets of shingles
with a Jaccard similarity of t share one of the first n - ceil(t n) + 1 shingles of each under any order of the shingles, and in an
order by hash the first k of two sets share none with a probability of (1 - t)^k only, so the first few are the keys that
candidates meet at (``MISSED`` bounds that probability).  There a wide SimHash settles who is worth
comparing, and the sets themselves who is similar.  Common shingles come last in the order, so that few documents meet at them; what they take
from the similarity of the others is allowed for in k.

``one_of_each_near`` takes both for copies: fingerprints within the threshold, which meet at anchors, and similar sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, heavy_keys, materialize, release_memory, shuffle_width, spread_join

THRESHOLD = 3
SHINGLE = 3
#: Least Jaccard similarity, over so many words a shingle, of the documents that ``one_of_each_similar`` takes for near copies.
SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: 64-bit words of the wide fingerprint that candidates are compared by; bits that a pair at the similarity may differ in
#: (78 are expected with a deviation of 8, so 116 is nearly 5 deviations).
WIDE_WORDS = 8
WIDE = 116
#: Probability with which a pair at the similarity may share no key, and the share of common shingles in a set from which on its
#: common ones are keys too.
MISSED = 1e-6
MOSTLY = 0.7
#: Keys with at most so many members have all their pairs compared at once; most members in a part of the others.
FEW = 8
KEY_PART = 1024
#: Shingles in a part, so that a part of long documents has fewer of them.
PART_SHINGLES = 1 << 20
#: Shingles that the product of both, 2048, or more of all documents hold are common: they come last in the order of the keys; most of them (the
#: order decides what a search costs, not what it finds, so those beyond are keys like any other).
COMMON_SAMPLE = 64
COMMON_LEAST = 32
MOST_COMMON = 100_000
#: First bits of a shingle's hash that make the groups they are counted in, and shingles that a task holds before it deals them.
COUNT_BITS = 10
COUNT_HELD = 1 << 21
#: Most fingerprints that are at home in one part of an anchor.
HOME_PART = 1024


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` lower-case words of a text, in order; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_of(b" ".join(words), 42)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - shingle + 1
    return np.fromiter((hash_of(joined[a:b], 42) for a, b in zip(starts[:count].tolist(), ends[shingle - 1 :].tolist())), dtype=np.uint64, count=count)


def _majority(hashes: np.ndarray) -> np.uint64:
    """The 64 bits that more than half of the hashes have set."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; None and texts without words give zero."""
    return int(_majority(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a signed long) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the exclusive or of the positions (1 to 31) of their set bits."""
    out = np.zeros(len(words), dtype=np.int64)
    for k, mask in enumerate((0x55555555, 0x66666666, 0x78787878, 0x7F807F80, 0x7FFF8000)):
        out |= (np.bitwise_count(words & np.int64(mask)).astype(np.int64) & 1) << k
    return out


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchor of 32-bit halves, and the anchors within distance 2 of each (-1 where there are fewer)."""
    word, free = half & 0x7FFFFFFF, half & 0x80000000
    s = _syndrome(word)
    flip = lambda at: np.where(at > 0, np.int64(1) << np.maximum(at - 1, 0), 0)
    nearest = word ^ flip(s)
    reached = [nearest | free, nearest | (free ^ 0x80000000)]
    for i in range(1, 32):
        j = s ^ i
        reached.append(np.where((s > 0) & (j > i), (word ^ flip(np.full_like(s, i)) ^ flip(j)) | free, -1))
    return nearest | free, reached


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for which in (0, 1):
            half = (fp >> np.int64(32 * which)) & np.int64(0xFFFFFFFF)
            home, reached = anchors_of(half)
            for anchor in reached:
                on = anchor >= 0
                yield pa.RecordBatch.from_arrays([pa.array(anchor[on] | (np.int64(which) << 32)), pa.array(anchor[on] == home[on]), pa.array(fp[on]), pa.array(doc[on])], ["anchor", "home", "fp", "doc"])


def _links_of(home_fp: np.ndarray, home_doc: np.ndarray, fp: np.ndarray, doc: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning links between those at home and those that came, by breadth-first search of the bipartite links."""
    close = np.bitwise_count(home_fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= threshold  # unsigned: bits are counted, not those of absolute values
    out, left_home, left = [], close.sum(axis=1) > 0, np.ones(len(fp), dtype=bool)
    for start in np.flatnonzero(left_home):
        if not left_home[start]:
            continue
        left_home[start] = False
        root, frontier = int(home_doc[start]), np.array([start])
        while len(frontier):
            came = np.flatnonzero(close[frontier].any(axis=0) & left)
            left[came] = False
            out += [(root, d) for d in doc[came].tolist() if d != root]
            frontier = np.flatnonzero(close[:, came].any(axis=1) & left_home) if len(came) else came
            left_home[frontier] = False
            out += [(root, d) for d in home_doc[frontier].tolist() if d != root]
    return out


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part, those at home first: a part's home is held, what came streams by in blocks."""
    part, homes = None, []
    for batch in batches:
        anchor, hp, rp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        home = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        rows = np.stack([batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)]).astype(np.int64)
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (hp[1:] != hp[:-1]) | (rp[1:] != rp[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor))
        n_home = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
        edges: list[tuple[int, int]] = []
        # Only parts with someone at home and a second row can link; the batch's last part may go on in the next.
        alive = np.flatnonzero(((n_home > 0) & (last - first > 1)) | (np.arange(len(first)) == 0) | (np.arange(len(first)) == len(first) - 1))
        for g in alive.tolist():
            a, b = int(first[g]), int(last[g])
            key = (int(anchor[a]), int(hp[a]), int(rp[a]))
            if key != part:
                part, homes = key, []
            here = rows[:, a:b]
            if n_home[g]:
                homes.append(here[:, home[a:b]])
            if homes:
                at_home = np.concatenate(homes, axis=1)
                edges += _links_of(at_home[0], at_home[1], np.ascontiguousarray(here[0]), here[1], threshold)
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def near_links(classes: DataFrame, threshold: int = THRESHOLD, home_part: int = HOME_PART) -> DataFrame:
    """Spanning links ``a``, ``b`` between the documents ``doc`` of distinct fingerprints ``fp`` at most ``threshold`` (3) bits apart."""
    if threshold > 3:
        raise ValueError("two halves with one differing bit each cover thresholds up to 3")
    spread = materialize(classes.select("fp", "doc").mapInArrow(_replicate, "anchor long, home boolean, fp long, doc long"), "anchors")
    crowded = spread.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > home_part).select("anchor", F.ceil(F.col("n") / home_part).cast("int").alias("parts"))
    crowded = materialize(crowded, "crowded")  # as a written table its size is known: the planner broadcasts it only if it is small
    dealt = spread.join(crowded, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.expr("sequence(0, parts - 1)")
    one = F.array(F.lit(0))
    dealt = dealt.withColumn("hp", F.when(F.col("parts").isNull(), one).when(F.col("home"), F.array(own)).otherwise(others))
    dealt = dealt.withColumn("rp", F.when(F.col("parts").isNull(), one).otherwise(F.array(own)))
    # One at home is also compared with the others at home, so it goes to the parts as a visitor too.
    visitors = dealt.where("home and parts is not null").withColumn("hp", others).withColumn("rp", F.array(own)).withColumn("home", F.lit(False))
    hosts = dealt.withColumn("rp", F.when(F.col("home") & F.col("parts").isNotNull(), others).otherwise(F.col("rp")))
    grid = hosts.unionByName(visitors).withColumn("hp", F.explode("hp")).withColumn("rp", F.explode("rp")).select("anchor", "hp", "rp", "home", "fp", "doc")
    keyed = grid.repartition("anchor", "hp", "rp").sortWithinPartitions("anchor", "hp", "rp", F.desc("home"))
    links = materialize(keyed.mapInArrow(partial(_compare, threshold=threshold), "a long, b long"), "links")
    discard(spread)
    return links


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, home_part: int = HOME_PART) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest doc_id reachable over links) of every row.

    Null and wordless texts have fingerprint zero and link like any other.  A row whose doc_id is null has its
    fingerprint; its component is that of other documents with that fingerprint, else null.  Repeated
    rows give repeated results, other columns are not read, an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows")).where("doc is not null"), "classes")
    components = connected_components(near_links(classes, threshold, home_part))
    settled = classes.join(components, classes["doc"] == components["node"], "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    heavy = heavy_keys(classes.select("fp", "rows"), "rows", fps.count())  # zero, and large groups of copies
    return spread_join(fps, settled, ["fp"], heavy, F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its group's smallest; rows that repeat a doc_id count once.

    A doc_id whose rows have different texts stays if one of them does.  Rows with a null doc_id can't be named and are kept.
    Whatever is not to stay is the shorter list, so it is that which the texts are joined with.
    """
    return _less_copies(docs, near_duplicates(docs, threshold, shingle))


def _less_copies(docs: DataFrame, groups: DataFrame) -> DataFrame:
    least = F.col("doc_id") == F.col("component_id")
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count_if(least).alias("n"))
    odd = materialize(ids.where("n <> 1"), "removed")
    out = docs.join(odd.where("n = 0").select("doc_id"), "doc_id", "left_anti")
    repeated = odd.where("n > 1").select("doc_id")
    if repeated.limit(1).count():
        out = out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles, for word ``k`` of a wide fingerprint."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _set_name(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def shingle_sets(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """``node`` (hash of the set) and ``shingles`` (the least 32 bits of the hashes of a row's distinct shingles) of every row.

    Two shingles of a pair of sets are taken for one with a probability of 2 to the -32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(0)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).astype(np.uint32).view(np.int32) if sets else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_set_name, sets)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["node", "shingles"])
        release_memory()

    return docs.select("text").mapInArrow(run, "node long, shingles array<int>")


def set_marks(docs: DataFrame, common: np.ndarray, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, printed: int | None = None) -> DataFrame:
    """``doc_id``, ``node``, ``n`` (shingles in the set), ``wide`` (its 512-bit SimHash), ``keys`` (see ``_first_keys``) and ``fp`` of every row: its
    ``fingerprint`` over ``printed`` words a shingle, null without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            nodes, sizes, wide, keys, fps = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                x = np.unique(shingle_hashes(text, shingle))
                fps.append(None if printed is None else int(_majority(shingle_hashes(text, printed)).view(np.int64)))
                nodes.append(_set_name(x))
                sizes.append(len(x))
                wide.append(b"".join(_majority(_mixed(x, k)).tobytes() for k in range(WIDE_WORDS)))
                keys.append(_first_keys(x, ~_among(x, common), similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(wide, pa.binary()), lists, pa.array(fps, pa.int64())], ["doc_id", "node", "n", "wide", "keys", "fp"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, n int, wide binary, keys array<long>, fp long")


def _deal_shingles(batches: Iterator[pa.RecordBatch], shingle: int, most: int) -> Iterator[pa.RecordBatch]:
    """Shingles by group: their hashes, and how many rows hold each."""
    held, size = [], 0

    def deal():
        own = np.sort(np.concatenate(held))
        held.clear()
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
        n, own = np.diff(np.append(head, len(own))).astype("u4"), own[head]
        group = (own >> np.uint64(64 - COUNT_BITS)).astype(np.int32)
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(own) else head
        pieces = list(zip(cuts.tolist(), np.append(cuts[1:], len(own)).tolist()))
        for at in range(0, len(pieces), 64):
            some = pieces[at : at + 64]
            blobs = ([x[i:j].tobytes() for i, j in some] for x in (own, n))
            yield pa.RecordBatch.from_arrays([pa.array([int(group[i]) for i, _ in some], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["group", "hashes", "counts"])

    release_memory()
    for batch in batches:
        for text in batch.column(0):
            held.append(np.unique(shingle_hashes(text.as_py(), shingle)))
            size += len(held[-1])
            if size >= most:
                yield from deal()
                size = 0
    if held:
        yield from deal()
    release_memory()


def _held_by(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_deal_shingles`` come ordered by group: the hashes whose counts sum to ``least`` or more, with the sums."""
    last, hashes, counts = None, [], []

    def sift():
        own, n = np.frombuffer(b"".join(hashes), dtype="u8"), np.frombuffer(b"".join(counts), dtype="u4")
        hashes.clear()
        counts.clear()
        order = np.argsort(own)
        own, n = own[order], n[order].astype(np.int64)
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total = np.add.reduceat(n, head)
        many = total >= least
        yield pa.RecordBatch.from_arrays([pa.array(own[head[many]].view(np.int64)), pa.array(total[many])], ["key", "n"])

    for batch in batches:
        for group, own, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if group != last and hashes:
                yield from sift()
            last = group
            hashes.append(own.as_py())
            counts.append(n.as_py())
    if hashes:
        yield from sift()
    release_memory()


def common_shingles(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Hashes, in order, of the shingles that ``COMMON_SAMPLE`` times ``COMMON_LEAST`` or more of all rows have, the commonest ``MOST_COMMON`` at most.

    Every shingle of every row is counted: tasks deal theirs by the first bits of their hashes, and a group's are summed at once.
    """
    dealt = docs.select("text").mapInArrow(partial(_deal_shingles, shingle=shingle, most=COUNT_HELD), "group int, hashes binary, counts binary")
    placed = dealt.repartitionById(min(shuffle_width(docs.sparkSession), 1 << COUNT_BITS), F.col("group")).sortWithinPartitions("group")
    counts = materialize(placed.mapInArrow(partial(_held_by, least=COMMON_SAMPLE * COMMON_LEAST), "key long, n long"), "common")
    out = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow().column(0).to_numpy()
    discard(counts)
    return np.sort(out.view(np.uint64))


def _among(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of ``own`` the sorted ``common`` has."""
    if not len(common):
        return np.zeros(len(own), dtype=bool)
    return common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own


def _first(n: int, similarity: float) -> int:
    """How many of the first of ``n`` shingles two similar sets must share one of."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _enough(similarity: float) -> int:
    """How many first shingles by hash two sets of that similarity need to share one but for ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log1p(-min(similarity, 1 - 1e-9)))


def _first_keys(own: np.ndarray, rare: np.ndarray, similarity: float) -> np.ndarray:
    """The keys of a set, sorted by hash: rare shingles first, then common ones, as many as a similar set can't but share one of."""
    n = len(own)
    first = _first(n, similarity)
    common = 1.0 - np.count_nonzero(rare) / n if n else 0.0
    if common == 0:
        return own[: min(first, _enough(similarity))]
    ordered = np.concatenate((own[rare], own[~rare]))
    if common < MOSTLY:
        # The others have this similarity at least, if the common ones are all shared.
        left = (similarity - common - 0.02) / (1.0 - common - 0.02)
        return ordered[: min(first, _enough(left))]
    # Either the rare shingles or the common ones have the similarity by themselves.
    some = _enough(similarity)
    return ordered[:first] if first <= 2 * some else np.concatenate((own[rare][:some], own[~rare][:some]))


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _pairs_of_few(batches: Iterator[pa.RecordBatch], similarity: float, few: int) -> Iterator[pa.RecordBatch]:
    """Pairs worth comparing among rows that come ordered by key, of keys with at most ``few`` members."""
    held = None

    def pairs_of(cols):
        key, node, n, wide = cols
        found = []
        for step in range(1, min(few, len(key))):
            a = np.flatnonzero(key[:-step] == key[step:])
            if not len(a):
                break
            b = a + step
            near = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
            a, b = a[near], b[near]
            ok = _bits(wide[a], wide[b]) <= WIDE
            found.append(np.stack([node[a[ok]], node[b[ok]]], axis=1))
        edges = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        cols.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u8").reshape(-1, WIDE_WORDS))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if len(cols[0]):
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            held = [x[last:] for x in cols]
            if last:
                yield pairs_of([x[:last] for x in cols])
    if held is not None:
        yield pairs_of(held)
    release_memory()


def shared_counts(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """How many shingles every two sets share: those in few sets by their pairs, the others by products of 0/1 matrices."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    values = np.concatenate(sets) if m else np.zeros(0, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(head, len(values)))
    out = np.zeros(m * m, dtype=np.float32)
    for c in range(2, 9):
        at = head[counts == c]
        for i in range(c):
            for j in range(i + 1, c):
                out += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m) if len(at) else 0
    out = out.reshape(m, m)
    out += out.T
    many = np.flatnonzero(counts > 8)
    for a in range(0, len(many), block):
        chosen = many[a : a + block]
        x = np.zeros((m, len(chosen)), dtype=np.float32)
        sizes = counts[chosen]
        column = np.repeat(np.arange(len(chosen)), sizes)
        place = np.repeat(head[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        x[owner[place], column] = 1.0
        out += x @ x.T
    return out


def spanning_links(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs among the sets connect."""
    n = np.array([len(x) for x in sets], dtype=np.float32)
    both = shared_counts(sets)
    similar = both >= np.float32(similarity - 1e-6) * (n[:, None] + n[None, :] - both)
    out, left = [], np.ones(len(node), dtype=bool)
    for root in range(len(node)):
        if not left[root]:
            continue
        left[root], frontier = False, np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(similar[frontier].any(axis=0) & left)
            left[frontier] = False
            out += [(int(node[root]), x) for x in node[frontier].tolist()]
    return out


def _links_of_many(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of keys with many members; rows (key, cell, node, shingles) come ordered by key, cell and node."""
    at, node, sets = None, [], []

    def links():
        edges = spanning_links(np.array(node, dtype=np.int64), sets, similarity) if len(node) > 1 else []
        node.clear()
        sets.clear()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    for batch in batches:
        values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *batch.column(3).value_lengths().to_pylist()])
        for i, (key, cell, name) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
            if (key, cell) != at:
                yield from links()
                at = (key, cell)
            node.append(name)
            sets.append(values[ends[i] : ends[i + 1]].copy())
    yield from links()
    release_memory()


def _similar(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have the similarity."""
    pairs = materialize(pairs.where("a <> b").distinct(), "candidates")
    left = own.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = own.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # The root of a tree is an end of very many pairs.
    heavy = heavy_keys(pairs.groupBy("a").agg(F.count("*").alias("k")), "k", pairs.count())
    met = spread_join(pairs.join(right, "b"), left, ["a"], heavy, F.xxhash64("b"), "inner")
    links = materialize(met.where(both >= F.lit(similarity - 1e-9) * (F.size("x") + F.size("y") - both)).select("a", "b"), "similar")
    discard(pairs)
    return links


def similar_links(docs: DataFrame, marks: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, few: int = FEW, key_part: int = KEY_PART) -> DataFrame:
    """Links ``a``, ``b`` between the nodes of ``set_marks`` that connect whatever pairs of at least the similarity connect.

    Keys that few meet at give all their pairs, which are compared once each.  Of a key that many meet at the members are dealt into
    parts, every two parts meet in a cell, and a cell gives a spanning set of its similar pairs, never the pairs.  Only documents that share
    a key have their sets made again and shuffled.
    """
    keys = materialize(marks.select(F.explode("keys").alias("key"), "node", "n").distinct(), "keys")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).where("m > 1"), "shared-keys")
    heavy = heavy_keys(shared.select("key", "m"), "m", keys.count())
    met = materialize(spread_join(keys, shared, ["key"], heavy, F.xxhash64("node"), "inner"), "met")
    discard(keys)
    discard(shared)
    named = met.select("node").distinct()
    known = materialize(marks.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("wide").alias("wide")).join(named, "node", "left_semi"), "known")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    own = materialize(shingle_sets(texts.dropDuplicates(["doc_id", "text"]), shingle), "compared")
    pairs = met.where(F.col("m") <= few).select("key", "node", "n").join(known.select("node", "wide"), "node").repartition("key").sortWithinPartitions("key", "node")
    pairs = pairs.select("key", "node", "n", "wide").mapInArrow(partial(_pairs_of_few, similarity=similarity, few=few), "a long, b long")
    links = _similar(pairs, own, similarity)

    parts = F.ceil(F.greatest(F.col("m") / key_part, F.col("shingles") / PART_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = F.transform(F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != mine), lambda j: F.least(mine, j).cast("long") * parts + F.greatest(mine, j))
    many = met.where(F.col("m") > few).withColumn("cell", F.explode(F.when(parts > 1, cells).otherwise(F.array(F.lit(0).cast("long")))))
    many = many.select("key", "cell", "node").join(own.select("node", "shingles"), "node").select("key", "cell", "node", "shingles")
    many = many.repartition("key", "cell").sortWithinPartitions("key", "cell", "node").mapInArrow(partial(_links_of_many, similarity=similarity), "a long, b long")
    many = materialize(many, "links-of-many")
    discard(met)
    discard(own)
    discard(known)
    return links.unionByName(many)


def fingerprint_links(marks: DataFrame, threshold: int = THRESHOLD, home_part: int = HOME_PART) -> DataFrame:
    """Links ``a``, ``b`` between the nodes of ``set_marks`` that connect whatever rows have fingerprints at most ``threshold`` bits apart."""
    named = materialize(marks.groupBy("fp", "node").agg(F.count("*").alias("rows")).select("fp", "node"), "fingerprints")
    classes = materialize(named.groupBy("fp").agg(F.min("node").alias("doc"), F.count("*").alias("nodes")), "classes")
    near = near_links(classes, threshold, home_part)
    several = classes.where("nodes > 1")
    heavy = heavy_keys(several.select("fp", "nodes"), "nodes", named.count())
    equal = spread_join(named, several.select("fp", "doc"), ["fp"], heavy, F.xxhash64("node"), "inner").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    equal = materialize(equal.where("a <> b"), "equal")
    discard(named)
    discard(classes)
    return near.unionByName(equal)


def one_of_each_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, few: int = FEW, key_part: int = KEY_PART) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, linked by Jaccard similarity of word shingles.

    Texts without words are alike, rows that repeat a doc_id or have none are treated as by ``one_of_each_group``.
    """
    rows = docs.where("doc_id is not null")
    marks = materialize(set_marks(rows, common_shingles(rows, shingle), shingle, similarity), "marks")
    return _one_of_each(docs, marks, similar_links(rows, marks, shingle, similarity, few, key_part))


def one_of_each_near(docs: DataFrame, threshold: int = THRESHOLD, printed: int = SHINGLE, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, few: int = FEW, key_part: int = KEY_PART, home_part: int = HOME_PART) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, linked by fingerprints as in ``near_duplicates`` (``printed`` words a shingle) and by
    Jaccard similarity as in ``one_of_each_similar``, with rows that repeat a doc_id or have none treated as there."""
    rows = docs.where("doc_id is not null")
    marks = materialize(set_marks(rows, common_shingles(rows, shingle), shingle, similarity, printed), "marks")
    near = fingerprint_links(marks, threshold, home_part)
    return _one_of_each(docs, marks, near.unionByName(similar_links(rows, marks, shingle, similarity, few, key_part)))


def _one_of_each(docs: DataFrame, marks: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, by links between the nodes of their marks, which are used up."""
    components = connected_components(links)
    least = marks.groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows")).join(components, "node", "left").select("node", "doc", "rows", F.coalesce("component", "node").alias("group"))
    least = materialize(least, "similar-classes")
    heads = least.groupBy("group").agg(F.min("doc").alias("component_id"), F.count("*").alias("nodes"))
    total = marks.count()
    settled = spread_join(least, heads.drop("nodes"), ["group"], heavy_keys(heads.select("group", "nodes"), "nodes", total), F.xxhash64("node"), "inner")
    many = heavy_keys(least.select("node", "rows"), "rows", total)  # large groups of exact copies
    named = materialize(spread_join(marks.select("doc_id", "node"), settled.select("node", "component_id"), ["node"], many, F.xxhash64("doc_id"), "inner").select("doc_id", "component_id"), "similar-groups")
    discard(marks)
    return _less_copies(docs, named)
