"""Near-duplicate images by a hash of their low cosine frequencies, and an exact join of hashes that differ in few bits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import heavy_keys, spread_join
from ..functions.scratch import materialize
from .graph import components

SIDE = 8
MOST_BITS = 8
SEGMENTS = 4
#: Hashes of a bucket on either side of a block that one task compares.
BLOCK = 2048


def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(SIDE), 2 * np.arange(n) + 1) / (2 * n))


def frequency_bits(images: np.ndarray) -> np.ndarray:
    """64 bits of each image (image, row, column): which of its 8 x 8 lowest cosine frequencies are above their median; bit 8 u + v is that of frequency u down and v across."""
    low = np.einsum("ux,nxy,vy->nuv", _cosines(images.shape[1]), images, _cosines(images.shape[2])).reshape(-1, SIDE * SIDE)
    bits = low > np.median(low, axis=1, keepdims=True)
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def perceptual_hash(image: str, rows: int, columns: int):
    """The hash of an array of ``rows * columns`` numbers by rows; NULL for another length, nulls, or values that aren't finite.

    It doesn't change with brightness or contrast, and little with noise or a change of size.
    """

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        good = values.map(lambda v: v is not None and len(v) == rows * columns and bool(np.isfinite(np.asarray(v, dtype=float)).all()))
        out = pd.Series([None] * len(values), dtype="Int64")
        at = np.flatnonzero(good.to_numpy(dtype=bool))
        if len(at):
            x = np.stack([np.asarray(v, dtype=float) for v in values.iloc[at]]).reshape(-1, rows, columns)
            out.iloc[at] = frequency_bits(x)
        return out

    return hashed(F.col(image))


def _masks(width: int, radius: int) -> list[int]:
    """Numbers of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def _met(homes: np.ndarray, visitors: np.ndarray, weight: np.ndarray, segment: int, segments: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hashes of homes and the weight of the visitors that each links to, of pairs that meet in no segment before this one; and links that span what is linked."""
    apart = np.bitwise_count(homes[:, None] ^ visitors[None, :])
    i, j = np.nonzero((apart <= most) & (apart > 0))
    if not len(i):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.uint64),) * 2
    both = homes[i] ^ visitors[j]
    width = 64 // segments
    first = np.ones(len(i), dtype=bool)
    for s in range(segment):
        first &= np.bitwise_count((both >> np.uint64(s * width)) & np.uint64((1 << width) - 1)) > most // segments
    links = np.bincount(i[first], weights=weight[j[first]], minlength=len(homes))
    nodes, place = np.unique(np.concatenate([homes[i], visitors[j]]), return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    spans = label != np.arange(len(nodes))
    on = np.flatnonzero(links)
    return homes[on], links[on].astype(np.int64), nodes[spans], nodes[label[spans]]


def _compare(batches: Iterator[pa.RecordBatch], segments: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (segment, value, i, j, visits, hash, n) ordered by all but the last two: links of each block."""
    names = ["hash", "links", "other"]

    def judged(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        segment, value, i, j, visits, hashes, n = columns
        new = np.append(True, (segment[1:] != segment[:-1]) | (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(segment))
        homes = np.add.reduceat(1 - visits, start)
        for a, b, h in zip(start.tolist(), end.tolist(), homes.tolist()):
            if not h or b - a - h < 2 and hashes[a] == hashes[b - 1]:  # nobody at home, or only itself came
                continue
            x = hashes[a:b].view(np.uint64)
            home, links, one, other = _met(x[:h], x[h:], n[a + h : b], int(segment[a]), segments, most)
            if len(home):
                yield pa.RecordBatch.from_arrays([pa.array(home.view(np.int64)), pa.array(links), pa.nulls(len(home), pa.int64())], names)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.nulls(len(one), pa.int64()), pa.array(other.view(np.int64))], names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        last = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)))[-1]  # the last block may go on
        if last:
            yield from judged([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if held is not None:
        yield from judged(held)


def hamming_links(classes: DataFrame, most_bits: int = MOST_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Of distinct hashes (``hash`` long, ``n`` rows): rows (hash, links) with the summed ``n`` of other hashes at most ``most_bits`` away, and rows (hash, other) that span what is linked.

    Two such hashes differ in at most ``most_bits // segments`` bits of some segment, so every hash waits at its own segments' values and visits all values that near: no link is missed.
    A pair counts in the first segment where it meets.  Values where many wait or come are cut into blocks of both; their list has at most ``segments * 2 ** (64 // segments)`` rows.
    """
    width, radius = 64 // segments, most_bits // segments
    spark = classes.sparkSession
    parts = F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("hash", s * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for s in range(segments))))
    home = classes.select("hash", "n", parts.alias("p")).select("p.segment", "p.value", "hash", "n")
    masks = spark.createDataFrame([(m,) for m in _masks(width, radius)], "mask long")
    visit = home.crossJoin(F.broadcast(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask") if radius else home  # as many masks as a segment has near values
    sizes = home.groupBy("segment", "value").agg(F.count("*").alias("h"))
    come = visit.groupBy("segment", "value").agg(F.count("*").alias("v"))
    plan = sizes.join(come, ["segment", "value"]).where((F.col("h") > block) | (F.col("v") > block)).select("segment", "value", F.ceil(F.col("h") / block).cast("int").alias("hp"), F.ceil(F.col("v") / block).cast("int").alias("vp"))
    plan = F.broadcast(materialize(plan, "crowded-values"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    deal = lambda c: F.pmod(F.xxhash64("hash"), one(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    waits = home.join(plan, ["segment", "value"], "left").withColumn("i", deal("hp")).withColumn("j", every("vp")).withColumn("visits", F.lit(0))
    comes = visit.join(plan, ["segment", "value"], "left").withColumn("j", deal("vp")).withColumn("i", every("hp")).withColumn("visits", F.lit(1))
    columns = ["segment", "value", "i", "j", "visits", "hash", "n"]
    met = waits.select(*columns).unionByName(comes.select(*columns)).repartition("segment", "value", "i", "j").sortWithinPartitions("segment", "value", "i", "j", "visits")
    return met.mapInArrow(partial(_compare, segments=segments, most=most_bits), "hash long, links long, other long")


def near_duplicates(rows: DataFrame, key: str, hashed: str, most_bits: int = MOST_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """key, hash, n_links and component of each row: how many other rows have a hash at most ``most_bits`` away, and the least key that such links reach.

    Equal hashes are one from the start, however many (blank slices).  A row without hash links with nothing.  Keys are unique.
    """
    named = materialize(rows.select(F.col(key).alias("key"), F.col(hashed).alias("hash")), "hashes")
    classes = materialize(named.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("first")), "classes")
    found = materialize(hamming_links(classes.select("hash", "n"), most_bits, segments, block), "met")
    links = found.where("links is not null").groupBy("hash").agg(F.sum("links").alias("links"))
    reach = components(found.where("other is not null").select(F.col("hash").alias("a"), F.col("other").alias("b")))
    led = classes.join(reach, F.col("hash") == F.col("node"), "left").withColumn("lead", F.coalesce("component", "hash"))
    least = led.groupBy("lead").agg(F.min("first").alias("least"))
    known = led.join(least, "lead").join(links, "hash", "left").select("hash", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("least").alias("component"))
    heavy = heavy_keys(classes.select("hash", "n"), "n", named.count())
    out = spread_join(named, known, ["hash"], heavy, F.xxhash64("key"), shuffle=True)
    return out.select(F.col("key").alias(key), "hash", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component"))
