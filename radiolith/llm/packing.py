"""Best-fit packing of tokenized documents into fixed-length sequences, by hierarchical residual packing.

Documents are cut into pieces where they are read.  Every partition packs its pieces best-fit in
decreasing order and emits full and nearly full bins; the underfull bins of several partitions then
meet as items of their own in the next, smaller set of partitions, and so on up a tree.  A bin carries its
members (1024 at most), so only underfull bins travel, and no later join is needed.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _LOADED, load_bpe
from .common import materialize, release_memory

CAPACITY = 1024
END_ID = 2
#: A bin with at most so many free tokens goes out at once.
SLACK = 8
#: Partitions whose underfull bins meet in one, and the most items that one task packs at a time.
FAN_IN = 8
CHUNK = 100_000

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    bpe, end = load_bpe(vocabulary), end_id.to_bytes(4, "little")
    for batch in batches:
        doc, piece, start, length, crc = [], [], array("q"), array("q"), array("q")
        for i, packed in zip(batch.column(0).to_pylist(), bpe.encode_packed(batch.column(1).to_pylist())):
            ids = packed + end
            n = len(ids) // 4
            at, number, take = 0, 0, n % capacity or min(capacity, n)
            while at < n:
                doc.append(i)
                piece.append(number)
                start.append(at)
                length.append(take)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + take)]))
                at, number, take = at + take, number + 1, capacity
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    release_memory(_LOADED)


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: its ids and ``end_id`` (a null text has only that), cut if over ``capacity``; the first piece is the shorter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_cut, vocabulary=vocabulary, capacity=capacity, end_id=end_id), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins: best fit, largest first; bins are looked up by free space."""
    where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    holds = 0  # bit f is set while some bin has f free
    bins = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = holds >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                holds ^= 1 << room
        else:
            room, at, bins = capacity, bins, bins + 1
        where[item], offset[item] = at, capacity - room
        if room > size:
            free[room - size].append(at)
            holds |= 1 << (room - size)
    return where, offset, bins


def _bins_of(members: pa.StructArray, ends: np.ndarray, sizes: np.ndarray, capacity: int, first_bin: int) -> pa.RecordBatch:
    """Pack items, each a run of ``members``; a row for each bin with the members' new offsets."""
    where, offset, bins = best_fit(sizes, capacity)
    order = np.lexsort((offset, where))
    starts = ends - np.diff(ends, prepend=0)
    counts = (ends - starts)[order]
    total = int(counts.sum())
    take = np.repeat(starts[order] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    moved = members.take(pa.array(take))
    old = moved.field("offset").to_numpy(zero_copy_only=False)
    fields = [moved.field(i) for i in range(5)] + [pa.array(old + np.repeat(offset[order], counts), pa.int64())]
    per_bin = np.zeros(bins + 1, dtype=np.int64)
    np.add.at(per_bin, where + 1, ends - starts)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(per_bin), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(MEMBER)))
    fill = np.bincount(where, weights=sizes, minlength=bins).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(first_bin + np.arange(bins)), pa.array(fill), lists], ["bin", "fill", "members"])


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, level: int, chunk: int) -> Iterator[pa.RecordBatch]:
    made = (level << 56) | (TaskContext.get().partitionId() << 32)
    held: list[pa.RecordBatch] = []

    def pack() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        if level:
            column = whole.column("members").chunk(0)
            members, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = whole.column("fill").to_numpy()
        else:
            n = len(whole)
            fields = [whole.column(i).chunk(0) for i in range(5)] + [pa.array(np.zeros(n, dtype=np.int64))]
            members, ends, sizes = pa.StructArray.from_arrays(fields, fields=list(MEMBER)), np.arange(1, n + 1), whole.column("length").to_numpy()
        return _bins_of(members, ends, sizes.astype(np.int64), capacity, made)

    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= chunk:
            out = pack()
            made += len(out)
            held, rows = [], 0
            yield from _slices(out)
    if held:
        yield from _slices(pack())
    release_memory()


def _slices(batch: pa.RecordBatch, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, chunk: int = CHUNK) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece of at most ``capacity`` tokens.

    ``pieces`` has doc_id, piece, start, length and ids_crc32 and should be a written table, since its
    partitions are those of the first level.  An empty table gives an empty result.
    """
    width = max(1, pieces.rdd.getNumPartitions())
    bins = materialize(pieces.mapInArrow(partial(_pack, capacity=capacity, level=0, chunk=chunk), BINS), "bins")
    out, level = [], 0
    while True:
        under = bins.where(F.col("fill") < capacity - slack)
        left = under.count()
        if width == 1 or left < 2:
            out.append(bins)
            break
        width = max(1, -(-width // fan_in), -(-left // chunk))
        level += 1
        packed = materialize(under.repartition(width).mapInArrow(partial(_pack, capacity=capacity, level=level, chunk=chunk), BINS), "bins")
        out.append(bins.where(F.col("fill") >= capacity - slack))
        bins = packed
        if width > 1 and -(-left // chunk) >= width and packed.count() > 0.98 * left:
            out.append(bins)  # merging no longer makes fewer bins
            break
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("bin").alias("sequence_id"), F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is one piece holding only the end id.  Rows that repeat a document are packed once
    each; a null doc_id stays null.  Other columns are not read.
    """
    pieces = materialize(cut_documents(docs, vocabulary, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity, slack)


__all__ = ["best_fit", "cut_documents", "pack_documents", "pack_pieces"]
