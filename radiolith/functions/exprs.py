"""Column builders: safe numbers, hashes, geometry, arrays and the scalar mathematics of losses."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import VENDOR_FAMILIES

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: C) -> Column:
    """A value as a double; NULL where it is no number, NaN or infinite."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite_vector(c: C, length: int) -> Column:
    """An array of ``length`` finite doubles, else NULL."""
    v = F.transform(col(c), lambda x: finite(x))
    return F.when((F.size(v) == length) & F.forall(v, lambda x: x.isNotNull()), v)


def known(c: C) -> Column:
    """Text with 'Unknown' for NULL."""
    return F.coalesce(col(c).cast("string"), F.lit("Unknown"))


def path_part(path: C, i: int) -> Column:
    """The ``i``-th part of a /-separated path, NULL where it has fewer or the part is empty."""
    return F.nullif(F.get(F.split(col(path), "/"), F.lit(i)), F.lit(""))


def first_filled(*cs: C) -> Column:
    """The first value that is neither NULL nor the empty text, else the empty text."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(""))


def vendor_family(manufacturer: C) -> Column:
    """The vendor family that a raw manufacturer name belongs to; the name itself if none, 'Unknown' if empty."""
    raw = col(manufacturer)
    out = F.when(raw.isNull() | (raw == ""), "Unknown")
    for part, family in VENDOR_FAMILIES:
        out = out.when(F.contains(F.lower(raw), F.lit(part)), family)
    return out.otherwise(raw)


def identity_hash(value: C, salt: str) -> Column:
    """Salted SHA-256 of an identifier; NULL for NULL and empty ones."""
    v = col(value).cast("string")
    return F.when(F.length(v) > 0, F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), v), 256))


def _md5_head(value: C) -> Column:
    return F.conv(F.substring(F.md5(col(value).cast("binary")), 1, 8), 16, 10).cast("long")


def stable_shard(value: C, shards: int) -> Column:
    """Shard number of a text, the same in every engine: first 32 bits of its MD5 modulo ``shards``."""
    return F.pmod(_md5_head(value), F.lit(shards)).cast("int")


def stable_fraction(value: C) -> Column:
    """A text's place in [0, 1] by the first 32 bits of its MD5; for sampling that repeats."""
    return _md5_head(value) / F.lit(4294967295.0)


def blake2b_number(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8"), digest_size=8).digest(), "little")


def blake2b_shard(value: C, shards: int) -> Column:
    """Shard number by BLAKE2b-64 (little-endian), for files already sharded that way; an Arrow UDF since Spark has none."""
    @F.pandas_udf("int")
    def shard(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blake2b_number(t) % shards).astype("Int32")

    return shard(col(value))


def blake2b_fraction(value: C) -> Column:
    """Place in [0, 1] by the same digest."""
    @F.pandas_udf("double")
    def fraction(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blake2b_number(t) / ((1 << 64) - 1))

    return fraction(col(value))


# --- geometry ------------------------------------------------------------------------------------------------------


def slice_geometry(orientation: C, position: C) -> Column:
    """Plane, unit slice normal and position along it, of an image's direction cosines and origin.

    The plane is the axis on which the normal is largest (the first of equals among sagittal, coronal, axial).  A missing or
    degenerate orientation gives 'Unknown' and NULLs; a missing origin only a NULL position.
    """
    o, p = finite_vector(orientation, 6), finite_vector(position, 3)
    at = lambda v, i: F.get(v, F.lit(i))
    cross = [at(o, 1) * at(o, 5) - at(o, 2) * at(o, 4), at(o, 2) * at(o, 3) - at(o, 0) * at(o, 5), at(o, 0) * at(o, 4) - at(o, 1) * at(o, 3)]
    size = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    sound = o.isNotNull() & (size > 1e-8)
    x, y, z = (F.try_divide(c, size) for c in cross)
    plane = F.when(~F.coalesce(sound, F.lit(False)), "Unknown").when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), "Sagittal").when(F.abs(y) >= F.abs(z), "Coronal").otherwise("Axial")
    along = x * at(p, 0) + y * at(p, 1) + z * at(p, 2)
    return F.struct(plane.alias("plane"), F.when(sound, F.array(x, y, z)).alias("normal"), F.when(sound & p.isNotNull(), along).alias("position"))


# --- arrays --------------------------------------------------------------------------------------------------------


def uniform_indices(length: C, count: int) -> Column:
    """Places of ``count`` of ``length`` evenly spread items, rounded half to even; all if count is not positive or not less."""
    n = col(length).cast("int")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if count <= 0:
        return every
    if count == 1:
        return F.when(n <= 1, every).otherwise(F.array(F.lit(0)))
    step = (n - F.lit(1.0)) / F.lit(float(count - 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(i == count - 1, n - 1).otherwise(F.bround(i * step, 0).cast("int")))
    return F.when(n <= count, every).otherwise(F.array_sort(F.array_distinct(spread)))


def clamped_neighbours(items: C, center: C, offsets=(-1, 0, 1)) -> Column:
    """Items at offsets from a center, the first or last standing in beyond the ends."""
    array, c = col(items), col(center)
    return F.transform(F.array(*(F.lit(o) for o in offsets)), lambda o: F.get(array, F.least(F.greatest(c + o, F.lit(0)), F.size(array) - 1)))


def rescaled(values: C, slope: C, intercept: C) -> Column:
    """value * slope + intercept; slopes and intercepts that aren't finite numbers count as 1 and 0."""
    s, i = F.coalesce(finite(slope), F.lit(1.0)), F.coalesce(finite(intercept), F.lit(0.0))
    return F.transform(col(values), lambda x: x.cast("double") * s + i)


def standardized(values: C, means, deviations, floor: float = 1e-6) -> Column:
    """Channel by channel (x - mean) / max(deviation, floor)."""
    if len(means) != len(deviations):
        raise ValueError("means and deviations must be of one length")
    scale = F.array(*(F.lit(float(max(d, floor))) for d in deviations))
    shift = F.array(*(F.lit(float(m)) for m in means))
    return F.zip_with(F.zip_with(col(values), shift, lambda x, m: x - m), scale, lambda x, d: x / d)


def window_metadata(position: C, fluid: C, plane: C) -> Column:
    """Relative position (0.5 if missing), fluid sensitivity (-1 if missing) and the plane one-hot."""
    hot = [F.when(col(plane) == p, 1.0).otherwise(0.0) for p in ("Sagittal", "Coronal", "Axial")]
    return F.array(F.coalesce(finite(position), F.lit(0.5)), F.coalesce(finite(fluid), F.lit(-1.0)), *hot)


def label_vector(labels: C, length: int) -> Column:
    """Labels for splitting: NULL elements and a NULL array count as zero."""
    return F.coalesce(F.transform(col(labels), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), length))


def as_list(value: C) -> Column:
    """A VARIANT that holds a value or a list of values as an array of texts."""
    v = col(value)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(v.isNotNull() & ~F.is_variant_null(v), F.array(F.try_variant_get(v, "$", "string")))


# --- scalar mathematics --------------------------------------------------------------------------------------------


def softplus(x: C) -> Column:
    v = col(x)
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


def sigmoid(x: C) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def bce_with_logits(logit: C, target: C, positive_weight: C | float = 1.0) -> Column:
    """Binary cross-entropy from a logit, positives weighed."""
    z, y = col(logit), col(target)
    w = F.lit(float(positive_weight)) if isinstance(positive_weight, (int, float)) else col(positive_weight)
    return w * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)


def learning_rate(step: C, warmup: int, total: int) -> Column:
    """Factor of the learning rate: linear warm-up, then a half cosine."""
    s = col(step)
    progress = F.least(F.lit(1.0), (s - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(s < warmup, (s + 1) / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def is_update_step(batch: C, accumulation: int, batches: C) -> Column:
    """Whether gradients are applied after a batch (counted from 1): every ``accumulation`` batches and at the last."""
    return (col(batch) % accumulation == 0) | (col(batch) == col(batches))
