"""Proxies of image quality: moments that merge over images, foreground box, sharpness and band energies, likeness of neighbouring slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image_moments(image: str) -> Column:
    """Count, mean and sums of second to fourth powers of deviations of an array's finite values: n, mean, m2, m3, m4."""
    values = F.filter(F.transform(image, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.struct(values.alias("v"), F.aggregate(values, F.lit(0.0), lambda s, x: s + x).alias("s"))
    power = lambda h, p: F.aggregate(h["v"], F.lit(0.0), lambda s, x: s + F.pow(x - h["s"] / F.size(h["v"]), F.lit(p)))
    # A one-element array carries what is computed once into the places that use it.
    made = F.transform(F.array(held), lambda h: F.struct(F.size(h["v"]).cast("long").alias("n"), F.try_divide(h["s"], F.size(h["v"])).alias("mean"), power(h, 2.0).alias("m2"), power(h, 3.0).alias("m3"), power(h, 4.0).alias("m4")))
    return F.get(made, F.lit(0))


def merged_moments(df: DataFrame, keys: list[str], moments: str) -> DataFrame:
    """keys, n, mean, deviation, skewness, kurtosis (3 for a normal law) over all values of a key's images, from their moments alone.

    The key's mean comes first; about it each image's sums are moved, and then they add.  So images of any number and size meet as five numbers each.  NULL without values, shape NULL without spread.
    """
    rows = df.select(*keys, F.col(f"{moments}.*")).where("n > 0")
    means = rows.groupBy(*keys).agg(F.sum("n").alias("_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean")).select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), "_all", "_mean")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    d = F.col("mean") - F.col("_mean")
    n, m2, m3, m4 = (F.col(c) for c in ("n", "m2", "m3", "m4"))
    moved = rows.join(means, same).groupBy(*keys, "_all", "_mean").agg(
        F.sum(m2 + n * d * d).alias("s2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("s3"), F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * F.pow(d, F.lit(4.0))).alias("s4")
    )
    all_, s2 = F.col("_all"), F.nullif(F.col("s2"), F.lit(0.0))
    return moved.select(*keys, all_.alias("n"), F.col("_mean").alias("mean"), F.sqrt(F.col("s2") / all_).alias("deviation"), (F.sqrt(all_) * F.col("s3") / F.pow(s2, F.lit(1.5))).alias("skewness"), (all_ * F.col("s4") / (s2 * s2)).alias("kurtosis"))


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The pixels of a mask's largest 4-connected part, of equals the one whose first pixel by rows comes first."""
    rows, columns = mask.shape
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # each pixel takes the least label of its run along rows, then along columns
        before = label
        for axis in (1, 0):
            line = label if axis == 1 else label.T
            flat = line.ravel()
            run = np.cumsum(np.append(True, (flat[1:] > 0) != (flat[:-1] > 0)) | (np.arange(flat.size) % line.shape[1] == 0)) - 1
            least = np.minimum.reduceat(flat, np.flatnonzero(np.append(True, run[1:] != run[:-1])))
            line = least[run].reshape(line.shape)
            label = line if axis == 1 else line.T
        if (label == before).all():
            break
    names, counts = np.unique(label[label > 0], return_counts=True)
    return label == names[np.argmax(counts)] if len(names) else np.zeros(mask.shape, dtype=bool)


def proxies_of(image: np.ndarray) -> tuple:
    """Share of the box of the largest part above the middle of the range, its centre's distance from the image's in image sides, variance of the Laplacian and share of energy above a quarter of
    the sampling rate (mean left out), both of values scaled to 0..1, and relative spread of the quarters' means."""
    low, high = image.min(), image.max()
    if high <= low:
        return 0.0, None, 0.0, None, None
    x = (image - low) / (high - low)
    part = largest_component(x > 0.5)
    down, across = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
    box = (down[-1] - down[0] + 1) * (across[-1] - across[0] + 1) / x.size
    centre = float(np.hypot(((down[0] + down[-1]) / 2 - (x.shape[0] - 1) / 2) / x.shape[0], ((across[0] + across[-1]) / 2 - (x.shape[1] - 1) / 2) / x.shape[1]))
    inner = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    power = np.abs(np.fft.fft2(x - x.mean())) ** 2
    radius = np.hypot(np.fft.fftfreq(x.shape[0])[:, None], np.fft.fftfreq(x.shape[1])[None, :])
    total = power.sum()
    half = [h for rows in np.array_split(x, 2) for h in np.array_split(rows, 2, axis=1)]
    means = np.array([h.mean() for h in half if h.size])
    return float(box), centre, float(inner.var()) if inner.size else 0.0, float(power[radius > 0.25].sum() / total) if total > 0 else None, float(means.std() / means.mean()) if means.mean() else None


def image_proxies(image: str, rows: int, columns: int) -> Column:
    """box_share, centre_offset, laplacian, high_band, unevenness of an array of ``rows * columns`` values; NULL for another length or values that aren't finite."""

    @F.pandas_udf("box_share double, centre_offset double, laplacian double, high_band double, unevenness double")
    def judged(images: pd.Series) -> pd.DataFrame:
        out = []
        for v in images:
            x = None if v is None or len(v) != rows * columns else np.asarray(v, dtype=float)
            out.append(proxies_of(x.reshape(rows, columns)) if x is not None and np.isfinite(x).all() else (None,) * 5)
        return pd.DataFrame(out, columns=["box_share", "centre_offset", "laplacian", "high_band", "unevenness"], dtype=float)

    return judged(F.col(image))


def neighbour_likeness(df: DataFrame, keys: list[str], order: list[Column], image: str) -> DataFrame:
    """``df`` with ``likeness``: correlation of each image with the one before it in its series; NULL for the first, other sizes, or an image without spread."""
    before = F.lag(image).over(Window.partitionBy(*keys).orderBy(*order))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    pair = F.struct(wide(F.col(image)).alias("a"), wide(F.col("_before")).alias("b"))
    centred = F.transform(F.array(pair), lambda p: F.struct(F.transform(p["a"], lambda x: x - total(p["a"]) / F.size(p["a"])).alias("a"), F.transform(p["b"], lambda x: x - total(p["b"]) / F.size(p["b"])).alias("b")))
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    value = F.get(F.transform(centred, lambda p: F.try_divide(dot(p["a"], p["b"]), F.sqrt(dot(p["a"], p["a"]) * dot(p["b"], p["b"])))), F.lit(0))
    return df.withColumn("_before", before).withColumn("likeness", F.when(F.size(image) == F.size("_before"), value)).drop("_before")
