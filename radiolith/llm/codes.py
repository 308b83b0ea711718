"""Vector code compression: product codes by Lloyd rounds over integers, whose sums are kept up by differences.

Vectors are held in blocks of rows with their parts' assignments of the round before.  The codebooks (entries x length numbers) go to every
task; each round a task assigns its blocks, and gives for every part whose assignment changed a minus to the entry it left and a plus to the one it
joined, already summed over the task.  Only those sums are shuffled; the running sums and counts of all entries, a few numbers for each entry, are the same as those over all rows.  A round's blocks
are a written table with the new assignments, so a lost executor costs a re-read of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_keys, materialize, release_memory, spread_join

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components saturate here (at 16,384 before scaling), so that no sum of squares passes 64 bits below a million components.
LARGEST = 1 << 26
#: Largest component for which products are exact in doubles.
_DOUBLE = 1 << 20
_NONE = 255

BLOCKS = "vec_ids array<bigint>, labels array<string>, size int, wide boolean, numbers binary, codes binary"
SUMS = "part int, entry int, n long, sums array<bigint>"


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def usable(vector: str = "embedding"):
    """Not null, not empty, and no component null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, in double precision."""
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, rows by entries, of whole numbers; exact."""
    kind = np.float64 if max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)) < _DOUBLE and parts.shape[1] < 1 << 10 else np.int64
    x, c = parts.astype(kind), book.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def nearest_entries(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of rows and books (part, entry, place): each part's nearest entry, ties to the lower one, and the row's summed distance."""
    width = books.shape[2]
    codes, error = np.empty((len(block), len(books)), dtype=np.uint8), np.zeros(len(block), dtype=np.int64)
    for p, book in enumerate(books):
        d = distances(block[:, p * width : (p + 1) * width], book)
        codes[:, p] = d.argmin(axis=1)
        error += d[np.arange(len(block)), codes[:, p]]
    return codes, error


def changes(block: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (part, entry) and sums (part, entry, place) that parts with a new assignment bring to the entry they join and take from the one they left."""
    parts = after.shape[1]
    width = block.shape[1] // parts
    counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
    for p in range(parts):
        moved = np.flatnonzero(before[:, p] != after[:, p])
        if len(moved):
            step = (after[moved, p][:, None] == np.arange(entries)).astype(np.int8) - (before[moved, p][:, None] == np.arange(entries))
            counts[p] = step.sum(axis=0, dtype=np.int64)
            # A block's sums are under 2 ** 53, so products in doubles are exact.
            sums[p] = (step.T.astype(np.float64) @ block[moved, p * width : (p + 1) * width].astype(np.float64)).astype(np.int64)
    return counts, sums


def moved_means(books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries replaced by floor(sum / count); unused entries stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _pack(batches: Iterator[pa.RecordBatch], scale: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of vec_id, label and vector as blocks of whole numbers, two bytes each where they fit; a batch is a block."""
    for batch in batches:
        if not len(batch):
            continue
        block = whole_numbers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), scale)
        wide = bool(np.abs(block).max(initial=0) > 32767)
        raw = block.astype(np.int32 if wide else np.int16).tobytes()
        codes = np.full((len(batch), parts), _NONE, dtype=np.uint8).tobytes()
        ids, labels = (pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(k)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array([len(batch)], pa.int32()), pa.array([wide]), pa.array([raw], pa.binary()), pa.array([codes], pa.binary())], _names(BLOCKS))


def _matrix(size: int, wide: bool, numbers: bytes) -> np.ndarray:
    return np.frombuffer(numbers, dtype=np.int32 if wide else np.int16).reshape(size, -1).astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks with the round's assignments; and, with the last, the task's changes."""
    parts, entries, width = books.shape
    counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
    fields = [*_names(BLOCKS), *_names(SUMS)]
    for batch in batches:
        new = []
        for size, wide, numbers, codes in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            block, before = _matrix(size, wide, numbers), np.frombuffer(codes, dtype=np.uint8).reshape(size, parts)
            after, _ = nearest_entries(block, books)
            n, s = changes(block, before, after, entries)
            counts += n
            sums += s
            new.append(after.tobytes())
        none = [pa.nulls(len(batch), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary()), *none], fields)
    p, e = np.nonzero((counts != 0) | (sums != 0).any(axis=2))
    if len(p):
        none = [pa.nulls(len(p), k) for k in (pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], fields)
    release_memory()


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (size, wide, numbers) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
            codes, error = nearest_entries(_matrix(size, wide, numbers), books)
            digits, step = codes.tobytes().hex(), 2 * codes.shape[1]
            ids, labels = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts (part, entry, place) of the vectors of the ``entries`` smallest vec_ids, ascending; of rows with one vec_id, by their components."""
    rows = kept.where("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).select("embedding").collect()
    numbers = whole_numbers(np.array([r[0] for r in rows], dtype=np.float64), scale)
    return np.stack(np.split(numbers, parts, axis=1)) if rows else np.empty((parts, 0, 0), dtype=np.int64)


def train_codebooks(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over ``blocks``.

    Each round leaves the assignments as a written table beside the vectors; only sums of changes are shuffled, at most one row an entry and task.
    """
    counts, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
    state, before = blocks, None
    for _ in range(rounds):
        after = materialize(state.mapInArrow(partial(_assign, books=books), f"{BLOCKS}, {SUMS}"), "codes")
        places = after.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
        changed = places.groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # a row for each number of the codebooks at most
        for r in changed:
            sums[r["part"], r["entry"], r["place"]] += r["s"]
            if r["place"] == 0:
                counts[r["part"], r["entry"]] += r["n"]
        discard(before)
        before, state = after, after.where("part is null").select(*_names(BLOCKS))
        if not changed:  # the entries stay as they are in every later round
            break
        books = moved_means(books, counts, sums)
    discard(before)
    return books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector of ``vectors`` (vec_id, embedding, label; other columns are not read).

    Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are those whose length isn't that of the vector
    of smallest vec_id among lengths that ``parts`` divides.  Components beyond 16,384 in size saturate there.  Rows that repeat a vec_id are
    vectors of their own; a row without vec_id is encoded but starts no entry.  With fewer than ``entries`` vectors the codebooks are
    as many entries long.  Equal distances go to the lower entry.  Labels are equal if their texts are, nulls together.  An empty table gives an empty result.
    """
    if entries > _NONE:
        raise ValueError("an entry's number has two hex digits, of which ff marks a part without one")
    given = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    first = given.where((F.size("embedding") % parts == 0) & F.col("vec_id").isNotNull()).orderBy("vec_id", "embedding").select(F.size("embedding")).first()
    given = given.where(F.size("embedding") == (first[0] if first else 0))
    books = first_books(given, parts, entries, scale)
    if not books.size:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks = materialize(given.mapInArrow(partial(_pack, scale=scale, parts=parts), BLOCKS), "blocks")
    books = train_codebooks(blocks, books, rounds)
    coded = materialize(blocks.mapInArrow(partial(_encode, books=books), "vec_id long, label string, code string, error long"), "coded")
    discard(blocks)
    key = ["_label", "_none"]
    coded = coded.withColumns({"_label": F.coalesce("label", F.lit("")), "_none": F.col("label").isNull()})
    sums = materialize(coded.groupBy(*key).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    total = sums.agg(F.sum("_n")).collect()[0][0]
    out = spread_join(coded, sums.drop("_n"), key, heavy_keys(sums.select(*key, "_n"), "_n", total), F.xxhash64("vec_id"), "inner")
    return out.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
