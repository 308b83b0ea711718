"""Exact removal of long repeated byte strings, by per-shard suffix arrays over candidate spans.

Every ``length``-byte window of a text belongs to the least hash among its k-grams, so equal windows anywhere in the
corpus share that hash.  Consecutive windows with one hash are a run, its bytes a span.

1.  Where documents are read, runs are found with rolling hashes in numpy, and runs equal to an earlier one of the same
    task are settled (copies are not expanded).
2.  Per hash, runs whose whole span equals that of an earlier run are settled as repeats.  Spans are equal if 128 bits of BLAKE2b of their bytes are;
    the rolling hash only groups.  Spans that differ from all earlier ones but share a hash with another span, or may repeat inside themselves, are candidates.
3.  Candidates' bytes are dealt to shards by hash.  A shard builds a suffix array by Larsson-Sadakane refinement, takes
    common prefixes of neighbours by Kasai's rule, and windows in one group of neighbours with ``length`` or more in
    common are one string, of which the earliest stays.
4.  A hash with very many differing spans is split over several shards.  What each of them keeps comes sorted to a merge,
    where shard after shard is looked up in those before it by binary search.

Only span bytes of candidates are ever sorted.  No text reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, heavy_keys, materialize, parts_for, release_memory, shuffle_width

LENGTH = 100
#: Runs that a task settles at a time, windows of a text hashed at a time, bytes of spans in a shard.
BUFFER = 1 << 18
STRETCH = 1 << 19
SHARD_BYTES = 1 << 20
#: Bytes of runs that leave a task at a time.
BATCH = 1 << 20
#: Spans with one hash in one shard.
CROWD = 2048
#: Bytes of runs (44 each) of a shard that one task judges.
CROWDED_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SELF = np.uint32(1 << 31)

MARKS = "shard int, doc_id long, start long, end long, f long, runs binary"


class _Rolling:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of any substring from prefix sums."""

    def __init__(self):
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        while len(self.up) <= n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, m, 1 << 64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, op, fill: int) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, in three passes."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(fill))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def _names_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each span's bytes, as two columns."""
    raw, name = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return np.frombuffer(b"".join([name(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]), dtype=np.uint64).reshape(-1, 2)


def runs_of(data: np.ndarray, length: int, rolling: _Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a text's windows: hash, both halves of the span's name, first window, number of windows, may repeat inside itself."""
    gram = max(1, length * 36 // 100)
    width = length - gram + 1
    found = []
    for at in range(0, len(data) - length + 1, STRETCH):
        part = data[at : at + STRETCH + length - 1]
        prefix = rolling.prefix(part)
        i = np.arange(len(part) - gram + 1)
        h = rolling.between(prefix, i, i + gram)
        least = _sliding(h, width, np.minimum, _MASK)
        start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        count = np.diff(np.append(start, len(least)))
        # A k-gram was chosen if it equals the greatest of the least hashes of the windows around it.
        padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
        chosen = np.flatnonzero(h == _sliding(padded, width, np.maximum, 0))
        twice = chosen[1:][h[chosen[1:]] == h[chosen[:-1]]]
        inside = count > width
        if len(twice):
            # The runs of the windows around the second of two equal k-grams hold both.
            a = np.maximum(np.searchsorted(start, np.maximum(twice - width + 1, 0), side="right") - 1, 0)
            b = np.searchsorted(start, twice, side="right")
            depth = np.bincount(a, minlength=len(start) + 1) - np.bincount(np.minimum(b, len(start)), minlength=len(start) + 1)
            inside |= np.cumsum(depth)[: len(start)] > 0
        names = _names_of(part, start, start + count + length - 1)
        found.append((least[start], names[:, 0], names[:, 1], start + at, count, inside))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _settle(f, span, rest, doc, start):
    """Of runs: the order by class and place, who is first of its class, and who repeats an earlier run of its class."""
    order = np.lexsort((start, doc, rest, span, f))
    f, span, rest, doc, start = f[order], span[order], rest[order], doc[order], start[order]
    first = np.append(True, (f[1:] != f[:-1]) | (span[1:] != span[:-1]) | (rest[1:] != rest[:-1]))
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (doc != doc[head]) | (start != start[head])


def _find_runs(batches: Iterator[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    release_memory()
    rolling, held, rows = _Rolling(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        f, span, rest, doc, start, size = (np.concatenate(x) for x in zip(*held))
        order, first, repeats = _settle(f, span, rest, doc, start)
        f, span, rest, doc, start, size = (x[order] for x in (f, span, rest, doc, start, size))
        begin, count = start[repeats], (size[repeats] & ~_SELF).astype(np.int64)
        yield from _mark_rows(doc[repeats], begin, begin + count + length - 1)
        f, span, rest, doc, start, size = (x[first] for x in (f, span, rest, doc, start, size))
        shard = (f % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((start, doc, shard))
        f, span, rest, doc, start, size, shard = (x[order] for x in (f, span, rest, doc, start, size, shard))
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        ids, blobs, held_bytes = [], [], 0
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(shard)).tolist()):
            ids.append(int(shard[a]))
            blobs.append(b"".join(x[a:b].tobytes() for x in (f, span, rest, doc, start, size)))
            held_bytes += len(blobs[-1])
            if held_bytes >= BATCH:
                yield _run_rows(ids, blobs)
                ids, blobs, held_bytes = [], [], 0
        if ids:
            yield _run_rows(ids, blobs)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = np.frombuffer((text.as_py() or "").encode("utf-8"), dtype=np.uint8)
            if doc is None or len(data) < length:
                continue
            f, span, rest, start, count, inside = runs_of(data, length, rolling)
            held.append((f, span, rest, np.full(len(f), doc, dtype=np.int64), start.astype(np.int64), count.astype(np.uint32) | np.where(inside, _SELF, np.uint32(0))))
            rows += len(f)
            if rows >= BUFFER:
                yield from flush()
                held, rows = [], 0
    if held:
        yield from flush()
    held.clear()
    release_memory()


def _run_rows(ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    n = len(ids)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), none, none, none, none, pa.array(blobs, pa.binary())], ["shard", "doc_id", "start", "end", "f", "runs"])


def _mark_rows(doc, start, end, f=None, rows: int = 16384) -> Iterator[pa.RecordBatch]:
    """Marks: repeats to remove where ``f`` is null, else candidate spans."""
    for a in range(0, len(doc), rows):
        s = slice(a, a + rows)
        n = len(doc[s])
        key = pa.nulls(n, pa.int64()) if f is None else pa.array(f[s].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(doc[s]), pa.array(start[s].astype(np.int64)), pa.array(end[s].astype(np.int64)), key, pa.nulls(n, pa.binary())], ["shard", "doc_id", "start", "end", "f", "runs"])


_KINDS = ("u8", "u8", "u8", "i8", "i8", "u4")
_RUN_BYTES = sum(np.dtype(kind).itemsize for kind in _KINDS)


def _unpacked(batches: Iterator[pa.RecordBatch], column: int = 0) -> list[np.ndarray] | None:
    """Runs of all blobs: hash, both halves of the span's name, document, first window, number of windows and mark."""
    parts: list[list[np.ndarray]] = [[] for _ in _KINDS]
    for batch in batches:
        for blob in batch.column(column):
            raw = blob.as_py()
            n, at = len(raw) // _RUN_BYTES, 0
            for held, kind in zip(parts, _KINDS):
                held.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
                at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in parts] if parts[0] else None


def _packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(x).astype(kind).tobytes() for x, kind in zip(columns, _KINDS))


def _judge_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All runs of a shard's hashes: later copies of a span are repeats, differing spans of one hash candidates.

    A run without windows only tells that its hash has other spans, which were judged before.
    """
    runs = _unpacked(batches)
    if runs is None:
        return
    f, size = runs[0], runs[5]
    # Most hashes occur once: only the others, and runs that may repeat inside, go on.
    sorted_f = np.sort(f)
    again = np.unique(sorted_f[1:][sorted_f[1:] == sorted_f[:-1]])
    at = np.minimum(np.searchsorted(again, f), max(len(again) - 1, 0))
    use = (size >= _SELF) | (again[at] == f if len(again) else False)
    f, span, rest, doc, start, size = (x[use] for x in runs)
    if not len(f):
        return
    order, first, repeats = _settle(f, span, rest, doc, start)
    f, doc, start, size = f[order], doc[order], start[order], size[order]
    end = start + (size & ~_SELF).astype(np.int64) + length - 1
    yield from _mark_rows(doc[repeats], start[repeats], end[repeats])
    candidate = first & (size > 0) & ((_classes(f, first) > 1) | (size >= _SELF))
    yield from _mark_rows(doc[candidate], start[candidate], end[candidate], f[candidate])
    del runs, f, span, rest, doc, start, size
    release_memory()


def _classes(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of runs ordered by hash: how many spans their hash has."""
    new_f = np.append(True, f[1:] != f[:-1])
    return np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_f))[np.cumsum(new_f) - 1]


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of crowded shards, dealt by span."""
    for batch in batches:
        for shard, subs, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            runs = _unpacked([pa.RecordBatch.from_arrays([pa.array([blob.as_py()], pa.binary())], ["runs"])])
            sub = (runs[1] % np.uint64(subs)).astype(np.int64)
            names = np.unique(sub).tolist()
            blobs = [_packed([x[sub == k] for x in runs]) for k in names]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "sub", "runs"])


def _judge_part(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Parts of crowded shards, rows (shard, sub, runs) ordered by part: repeats, candidates among hashes that have several spans here, and
    as runs again what only the whole shard can tell: the others, and for each hash with several spans a run without windows."""

    def judge(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        f, span, more, doc, start, size = _unpacked([pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["runs"])])
        order, first, repeats = _settle(f, span, more, doc, start)
        f, span, more, doc, start, size = (x[order] for x in (f, span, more, doc, start, size))
        end = start + (size & ~_SELF).astype(np.int64) + length - 1
        yield from _mark_rows(doc[repeats], start[repeats], end[repeats])
        several = _classes(f, first) > 1
        candidate = first & several
        yield from _mark_rows(doc[candidate], start[candidate], end[candidate], f[candidate])
        lonely = first & ~several
        witness = np.flatnonzero(several & np.append(True, f[1:] != f[:-1]))
        rest = [np.concatenate([x[lonely], x[witness]]) for x in (f, span, more, doc, start)]
        yield _run_rows([shard], [_packed([*rest, np.concatenate([size[lonely], np.zeros(len(witness), dtype=np.uint32)])])])

    last, held = None, []
    for batch in batches:
        for shard, sub, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, sub) != last and held:
                yield from judge(last[0], held)
                held = []
            last = (shard, sub)
            held.append(blob)
    if held:
        yield from judge(last[0], held)
    held.clear()
    release_memory()


def _judged(found: DataFrame, length: int, crowded_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Marks from the runs of all shards, and tables to discard after their last use.

    A hash that a large share of the documents have (a common line in ever other surroundings) fills a shard: shards over ``crowded_bytes`` are
    judged in parts dealt by span, and only what the parts can't tell comes together.
    """
    runs = found.where("shard is not null").select("shard", "runs")
    sizes = runs.groupBy("shard").agg(F.sum(F.length("runs")).cast("long").alias("n"))
    total = sizes.agg(F.sum("n")).collect()[0][0] or 0
    crowded = heavy_keys(sizes, "n", total, crowded_bytes)  # at most 65,536
    if crowded is not None:
        crowded = materialize(crowded, "crowded-shards")
        crowded = None if crowded.isEmpty() else crowded
    whole = lambda rows: rows.repartition("shard").select("runs").mapInArrow(partial(_judge_runs, length=length), MARKS).drop("shard", "runs")
    if crowded is None:
        return materialize(whole(runs), "judged"), []
    split = runs.join(F.broadcast(crowded), "shard").select("shard", "_rl_salts", "runs").mapInArrow(_split_runs, "shard int, sub int, runs binary")
    parts = materialize(split.repartition("shard", "sub").sortWithinPartitions("shard", "sub").mapInArrow(partial(_judge_part, length=length), MARKS), "parts")
    rest = runs.join(F.broadcast(crowded), "shard", "left_anti").unionByName(parts.where("shard is not null").select("shard", "runs"))
    return materialize(whole(rest).unionByName(parts.where("shard is null").drop("shard", "runs")), "judged"), [parts]


def merged(intervals: np.ndarray) -> np.ndarray:
    """Union of half-open intervals (rows of start, end) as maximal runs, in order."""
    if not len(intervals):
        return np.empty((0, 2), dtype=np.int64)
    x = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    first = np.append(True, x[1:, 0] > reach[:-1])
    at = np.flatnonzero(first)
    return np.stack([x[at, 0], reach[np.append(at[1:], len(x)) - 1]], axis=1)


def without(data: bytes, runs: np.ndarray) -> bytes:
    """``data`` less the bytes in ``runs``."""
    at, kept = 0, []
    for a, b in runs.tolist():
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


# --- suffix arrays -------------------------------------------------------------------------------------------------


def _words(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(pad + 8, dtype=np.uint8)])
    n = len(text) + pad
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out |= padded[k : n + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_array(words: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the ``n`` suffixes by their first ``reached`` >= ``depth`` bytes, each one's group, and ``reached``.

    Larsson-Sadakane: suffixes are first sorted by eight bytes; then only those in groups of two and more are sorted
    by the group of the suffix as far ahead as is sorted already, which doubles each time.
    """
    order = np.argsort(words[:n], kind="stable")
    keys = words[order]
    head = np.append(True, keys[1:] != keys[:-1])
    group = np.empty(n + 1, dtype=np.int64)
    group[n] = -1
    group[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    reached = 8
    while reached < depth:
        last = np.append(head[1:], True)
        open_at = np.flatnonzero(~(head & last))
        if not len(open_at):
            break
        s = order[open_at]
        key = group[s].astype(np.uint64) * np.uint64(n + 2) + (group[np.minimum(s + reached, n)] + 1).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        s, key = s[by], key[by]
        order[open_at] = s
        new = np.append(True, key[1:] != key[:-1])
        head[open_at] = new
        group[s] = open_at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        reached *= 2
    return order, group[:n], max(reached, depth)


def common_prefixes(words: np.ndarray, order: np.ndarray, group: np.ndarray, cap: int, lanes: int = 1 << 14) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, up to ``cap``, by Kasai's rule.

    The text is cut into lanes that advance together: going one byte on, a suffix shares at most one byte less with its
    neighbour than before, so comparison resumes there, eight bytes at a time.  Suffixes in one group share ``cap``
    bytes already and end a chain, since their order is only settled up to that depth.
    """
    n = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int32)
    step = max(1, -(-n // lanes))
    starts = np.arange(0, n, step)
    shared = np.zeros(len(starts), dtype=np.int64)
    for t in range(step):
        i = starts[starts + t < n] + t
        shared = shared[: len(i)]
        r = place[i]
        j = order[np.maximum(r - 1, 0)]
        tied = (r > 0) & (group[i] == group[j])
        active = np.flatnonzero((r > 0) & ~tied)
        while len(active):
            h = shared[active]
            x = words[i[active] + h] ^ words[j[active] + h]
            equal = np.full(len(x), 8, dtype=np.int64)
            for k in range(8):
                equal -= x >= np.uint64(1 << (8 * k))
            shared[active] = h + equal
            active = active[(equal == 8) & (h + 8 < cap)]
        out[r] = np.where(r > 0, np.where(tied, cap, np.minimum(shared, cap)), 0)
        shared = np.where((r > 0) & ~tied, np.maximum(np.minimum(shared, cap) - 1, 0), 0)
    return out


def repeated_windows(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of spans in order of place: their concatenation's suffix order of whole windows, the group each of them is in, the
    place in the concatenation of each group's earliest window, and where the spans begin."""
    sizes = np.array([len(s) for s in spans], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(spans), dtype=np.uint8)
    n = len(text)
    words = _words(text, length + 8)
    order, group, _ = suffix_array(words, n, length)
    prefix = common_prefixes(words, order, group, length)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # bytes up to the span's end
    string = np.cumsum(prefix < length) - 1
    whole = left[order] >= length
    order, string = order[whole], string[whole]
    at = np.flatnonzero(np.append(True, string[1:] != string[:-1])) if len(string) else np.empty(0, dtype=np.int64)
    earliest = np.minimum.reduceat(order, at) if len(at) else at
    return order, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(string)))), earliest, begin


def _shard_repeats(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by hash: whole hashes gather up to ``shard_bytes``, then one suffix array settles them."""
    held: list[tuple[int, int, bytes, bool, int]] = []
    size = 0

    def settle(rows) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0], r[1]))
        order, group, earliest, begin = repeated_windows([r[2] for r in rows], length)
        later = np.sort(order[order != earliest[group]]) if len(order) else order
        owner = np.searchsorted(begin, later, side="right") - 1
        doc = np.array([r[0] for r in rows], dtype=np.int64)
        start = np.array([r[1] for r in rows], dtype=np.int64)
        where = start[owner] + later - begin[owner]
        head_owner = np.searchsorted(begin, earliest, side="right") - 1
        head_start = start[head_owner] + earliest - begin[head_owner] if len(earliest) else earliest
        # A row of the same document and place (a repeated row) is the same string, not an earlier one.
        same = np.zeros(len(later), dtype=bool)
        if len(later):
            first_of = np.empty(int(order.max()) + 1, dtype=np.int64)
            first_of[order] = group
            g = first_of[later]
            same = (doc[head_owner[g]] == doc[owner]) & (head_start[g] == where)
        later, owner, where = later[~same], owner[~same], where[~same]
        if len(later):
            new = np.append(True, (where[1:] != where[:-1] + 1) | (owner[1:] != owner[:-1]))
            at = np.flatnonzero(new)
            yield from _shard_rows(doc[owner[at]], where[at], where[np.append(at[1:], len(where)) - 1] + length)
        split = np.array([r[3] for r in rows], dtype=bool)
        for a in range(0, len(earliest), 8192):
            e, o, s = earliest[a : a + 8192], head_owner[a : a + 8192], head_start[a : a + 8192]
            keep = np.flatnonzero(split[o])
            if len(keep):
                strings = [rows[o[k]][2][e[k] - begin[o[k]] : e[k] - begin[o[k]] + length] for k in keep.tolist()]
                yield from _shard_rows(doc[o[keep]], s[keep], s[keep] + length, strings, np.array([rows[o[k]][4] for k in keep.tolist()], dtype=np.int64))

    last = None
    for batch in batches:
        for f, salt, parts, doc, start, span in zip(*(c.to_pylist() for c in batch.columns)):
            if (f, salt) != last and size >= shard_bytes:
                yield from settle(held)
                held, size = [], 0
            last = (f, salt)
            held.append((doc, start, span, parts is not None, salt))
            size += len(span)
    if held:
        yield from settle(held)
    held.clear()
    release_memory()


def _shard_rows(doc, start, end, strings=None, salt=None, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Repeats to remove, or, with ``strings``, windows that a part of a crowded hash keeps."""
    for a in range(0, len(doc), rows):
        s = slice(a, a + rows)
        n = len(doc[s])
        text = pa.nulls(n, pa.binary()) if strings is None else pa.array(strings[s], pa.binary())
        part = pa.nulls(n, pa.int32()) if salt is None else pa.array(salt[s], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(start[s]), pa.array(end[s]), text, part], ["doc_id", "start", "end", "string", "salt"])


def _merge_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by slice, shard and string: each shard's strings are looked up in those of the shards before it."""

    def merge(rows: list[tuple[int, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        known, owner = np.empty(0, dtype="S1"), np.empty((0, 2), dtype=np.int64)
        lost: list[tuple[int, int]] = []
        by_shard: dict[int, list] = {}
        for r in rows:
            by_shard.setdefault(r[0], []).append(r)
        for group in by_shard.values():
            strings = np.array([r[1].hex().encode() for r in group])  # hex keeps the order and any zero byte
            places = np.array([(r[2], r[3]) for r in group], dtype=np.int64)
            if not len(known):
                known, owner = strings, places
                continue
            at = np.searchsorted(known, strings)
            hit = known[np.minimum(at, len(known) - 1)] == strings
            for k, h in zip(np.flatnonzero(hit).tolist(), np.minimum(at, len(known) - 1)[hit].tolist()):
                mine, theirs = tuple(places[k].tolist()), tuple(owner[h].tolist())
                if mine < theirs:
                    owner[h] = mine
                if mine != theirs:
                    lost.append(max(mine, theirs))
            known, owner = np.insert(known, at[~hit], strings[~hit]), np.insert(owner, at[~hit], places[~hit], axis=0)
        if lost:
            x = np.array(lost, dtype=np.int64)
            yield from _shard_rows(x[:, 0], x[:, 1], x[:, 1] + length)

    held, last = [], None
    for batch in batches:
        for piece, salt, string, doc, start in zip(*(c.to_pylist() for c in batch.columns)):
            if piece != last and held:
                yield from merge(held)
                held = []
            last = piece
            held.append((salt, string, doc, start))
    if held:
        yield from merge(held)


# --- the operator --------------------------------------------------------------------------------------------------

_INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _grouped(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "f")).alias("_rl_marks")).withColumnRenamed("doc_id", "_rl_doc")


def _finish(data: bytes, runs: np.ndarray):
    kept = without(data, runs)
    return kept, (len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest())


def _pairs(values) -> np.ndarray:
    return np.array([(v["start"], v["end"]) for v in values or ()], dtype=np.int64).reshape(-1, 2)


def _readable(kept: bytes) -> str:
    """Kept bytes as text; what removal left of a cut character goes too."""
    return kept.decode("utf-8", errors="ignore")


_DIGEST = [("_rl_n_bytes", "long"), ("_rl_n_removed", "long"), ("_rl_n_spans", "long"), ("_rl_sha", "string")]
_STATE = [("_rl_text", "string"), ("_rl_open", "boolean"), ("_rl_cut", "array<struct<start:long,end:long>>"), ("_rl_spans", "array<struct<f:long,start:long,span:binary>>")]
_ARROW = {"_rl_n_bytes": pa.int64(), "_rl_n_removed": pa.int64(), "_rl_n_spans": pa.int64(), "_rl_sha": pa.string(), "_rl_text": pa.string(), "_rl_open": pa.bool_(), "_rl_cut": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "_rl_spans": pa.list_(pa.struct([("f", pa.int64()), ("start", pa.int64()), ("span", pa.binary())]))}


def _resolve(batches: Iterator[pa.RecordBatch], carried: int, want_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents with their marks: done where no candidate span is left, else with text, cuts so far and span bytes."""
    names = [n for n, _ in _DIGEST + _STATE]
    for batch in batches:
        rows = []
        for text, marks in zip(batch.column(carried), batch.column(carried + 1)):
            text, marks = text.as_py() or "", marks.as_py() or []
            data = text.encode("utf-8")
            cut = merged(_pairs([m for m in marks if m["f"] is None]))
            spans = [{"f": m["f"], "start": m["start"], "span": data[m["start"] : m["end"]]} for m in marks if m["f"] is not None]
            if spans:
                rows.append((None, None, None, None, text, True, [{"start": a, "end": b} for a, b in cut.tolist()], spans))
            else:
                kept, digest = _finish(data, cut)
                rows.append((*digest, (text if not len(cut) else _readable(kept)) if want_text else None, False, [], []))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *(pa.array(c, _ARROW[n]) for c, n in zip(columns, names))], [*batch.schema.names[:carried], *names])


def _close(batches: Iterator[pa.RecordBatch], carried: int, want_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents that had candidate spans, with what the shards removed from them."""
    names = [n for n, _ in _DIGEST] + ["_rl_text"]
    for batch in batches:
        rows = []
        for text, cut, more in zip(*(batch.column(carried + k) for k in range(3))):
            data = text.as_py().encode("utf-8")
            runs = merged(np.concatenate([_pairs(cut.as_py()), _pairs(more.as_py())]))
            kept, digest = _finish(data, runs)
            rows.append((*digest, (text.as_py() if not len(runs) else _readable(kept)) if want_text else None))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *(pa.array(c, _ARROW[n]) for c, n in zip(columns, names))], [*batch.schema.names[:carried], *names])


def _schema(frame: DataFrame, fields: list[tuple[str, str]]) -> T.StructType:
    more = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in fields))
    return T.StructType([*frame.schema.fields, *more.fields])


def _remove(docs: DataFrame, length: int, want_text: bool, crowd: int, shard_bytes: int, crowded_bytes: int) -> DataFrame:
    """``docs`` less its text (and, without ``want_text``, less all but doc_id), with the digest columns and ``_rl_text``."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    shards = 2 * max(width, docs.rdd.getNumPartitions())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(source.mapInArrow(partial(_find_runs, length=length, shards=shards), MARKS), "runs")
    judged, used = _judged(found, length, crowded_bytes)
    local = materialize(found.where("shard is null").select("doc_id", "start", "end", "f"), "local")
    for done in (found, *used):
        discard(done)

    carried = [c for c in docs.columns if c != "text"] if want_text else ["doc_id"]
    frame = docs.select(*carried, "text").join(_grouped(judged.unionByName(local)), F.col("doc_id").cast("long") == F.col("_rl_doc"), "left")
    frame = frame.select(*carried, "text", "_rl_marks")
    shape = docs.select(*carried)
    half = materialize(frame.mapInArrow(partial(_resolve, carried=len(carried), want_text=want_text), _schema(shape, _DIGEST + _STATE)), "half")
    discard(local)

    spans = half.where("_rl_open").select(F.col("doc_id").cast("long").alias("doc_id"), F.inline("_rl_spans")).select("f", "doc_id", "start", "span")
    sized = judged.where("f is not null").agg(F.sum(F.col("end") - F.col("start"))).collect()[0][0] or 0
    many = judged.where("f is not null").groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("f", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    many = materialize(many, "crowded")  # as a written table its size is known: the planner broadcasts it only if it is small
    dealt = spans.join(many, "f", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int"), F.lit(0)))
    shard_count = max(width, parts_for(sized, shard_bytes))
    settled = materialize(
        dealt.select("f", "salt", "parts", "doc_id", "start", "span").repartition(shard_count, "f", "salt").sortWithinPartitions("f", "salt").mapInArrow(partial(_shard_repeats, length=length, shard_bytes=shard_bytes), "doc_id long, start long, end long, string binary, salt int"),
        "settled",
    )
    kept = settled.where("string is not null").withColumn("piece", F.pmod(F.xxhash64("string"), F.lit(1 << 20)))
    crossed = kept.repartition("piece").sortWithinPartitions("piece", "salt", "string").select("piece", "salt", "string", "doc_id", "start").mapInArrow(partial(_merge_shards, length=length), "doc_id long, start long, end long, string binary, salt int")
    more = settled.where("string is null").unionByName(crossed).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_rl_more")).withColumnRenamed("doc_id", "_rl_doc")
    opened = half.where("_rl_open").select(*carried, "_rl_text", "_rl_cut").join(more, F.col("doc_id").cast("long") == F.col("_rl_doc"), "left")
    opened = opened.select(*carried, "_rl_text", "_rl_cut", "_rl_more")
    out = [*_DIGEST, ("_rl_text", "string")]
    closed = opened.mapInArrow(partial(_close, carried=len(carried), want_text=want_text), _schema(shape, out))
    return half.where("not _rl_open").select(*carried, *(n for n, _ in out)).unionByName(closed)


def repeat_digests(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, crowded_bytes: int = CROWDED_BYTES) -> DataFrame:
    """What removing every byte covered by a ``length``-byte string that starts earlier leaves of each document.

    Columns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.  Order is that of doc_id, then of the
    start.  A null or short text loses nothing.  Rows that repeat a doc_id are the same document: each is judged as it
    stands, and equal strings at the same place do not remove each other.  A row without doc_id has no place in the
    order: it loses nothing and makes nothing else a repeat.  An empty table gives an empty result.
    """
    out = _remove(docs, length, False, crowd, shard_bytes, crowded_bytes)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(a).alias(b) for a, b in zip([n for n, _ in _DIGEST], ("n_bytes", "n_removed", "n_spans", "kept_sha256"))))


def without_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, crowded_bytes: int = CROWDED_BYTES) -> DataFrame:
    """``docs`` with its columns, the text less its repeats; ``n_chars``, where there is one, follows the text.

    Every row stays, with an empty text where all of it was repeated; a null text becomes empty.
    """
    safe = [c if c in ("doc_id", "text", "n_chars") else f"_rl_c{i}" for i, c in enumerate(docs.columns)]
    out = _remove(docs.toDF(*safe), length, True, crowd, shard_bytes, crowded_bytes).withColumnRenamed("_rl_text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*safe).toDF(*docs.columns)
