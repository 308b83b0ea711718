"""Pixel statistics and normalization of arrays, an array at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite

DEEP_PERCENTILES = (0.1, 1, 5, 25, 50, 75, 95, 99, 99.9)


def pixel_stats(values: Column | str) -> list[Column]:
    """Count, min, max, mean, population deviation, share of zeros (of finite values) and of finite values, as columns.

    One fold over the array; squares are summed about the first finite value, so a large offset costs no digits.
    """
    raw = F.col(values) if isinstance(values, str) else values
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("n"), none.alias("first"), zero.alias("s"), zero.alias("q"), none.alias("lo"), none.alias("hi"), F.lit(0).alias("zeros"))

    def add(state: Column, x: Column) -> Column:
        first = F.coalesce(state["first"], x)
        d = x - first
        more = F.struct(
            (state["n"] + 1).alias("n"), first.alias("first"), (state["s"] + d).alias("s"), (state["q"] + d * d).alias("q"),
            F.least(state["lo"], x).alias("lo"), F.greatest(state["hi"], x).alias("hi"), (state["zeros"] + (x == 0).cast("int")).alias("zeros"),
        )
        return F.when(x.isNull(), state).otherwise(more)

    fold = F.aggregate(F.transform(raw, lambda x: finite(x)), start, add, lambda t: F.when(t["n"] > 0, t))
    n = F.coalesce(fold["n"], F.when(raw.isNotNull(), F.lit(0)))
    mean = fold["s"] / fold["n"]
    variance = F.greatest(fold["q"] / fold["n"] - mean * mean, F.lit(0.0))
    share = lambda k, of: F.try_divide(k, of)
    return [n.alias("pixel_count"), fold["lo"].alias("minimum"), fold["hi"].alias("maximum"), (fold["first"] + mean).alias("mean"), F.sqrt(variance).alias("deviation"), share(fold["zeros"], n).alias("zero_fraction"), share(n, F.size(raw)).alias("finite_fraction")]


def pixel_status(values: Column | str) -> Column:
    """'ok', or 'error' where no value is finite."""
    raw = F.col(values) if isinstance(values, str) else values
    return F.when(F.exists(raw, lambda x: finite(x).isNotNull()), "ok").otherwise("error")


def _finite(values) -> np.ndarray:
    x = np.asarray(values, dtype=np.float64)
    return x[np.isfinite(x)]


def deep_values(values, bins: int, most: int, percentiles) -> tuple | None:
    """Percentiles, median absolute deviation and histogram entropy (bits) of the finite ones of at most ``most`` values, evenly strided."""
    if values is None:
        return None
    x = _finite(values[:: max(1, -(-len(values) // most))])
    if not len(x):
        return None
    points = np.percentile(x, percentiles)
    mad = np.median(np.abs(x - np.median(x)))
    low, width = x.min(), x.max() - x.min()
    place = np.minimum((x - low) / width * bins, bins - 1).astype(np.int64) if width > 0 else np.full(len(x), bins // 2)
    share = np.bincount(place) / len(x)
    share = share[share > 0]
    return (*points.tolist(), float(mad), float(-(share * np.log2(share)).sum()))


def deep_stats(df: DataFrame, key: str, values: str, bins: int = 128, most: int = 65536, percentiles=DEEP_PERCENTILES) -> DataFrame:
    """Percentiles, median absolute deviation and histogram entropy of each row's array; rows without a finite value give none.

    Sorting an array has no built-in that keeps codegen, so arrays go to Arrow batches whole: one pass, no shuffle.
    """
    names = [*(f"p{str(p).replace('.', '_')}" for p in percentiles), "mad", "entropy"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(arrays: pd.Series) -> pd.DataFrame:
        empty = (None,) * len(names)
        return pd.DataFrame([deep_values(v, bins, most, percentiles) or empty for v in arrays], columns=names, dtype="float64")

    out = df.select(key, run(F.transform(values, lambda x: x.cast("double"))).alias("_deep"))
    return out.select(key, "_deep.*").where(F.col("entropy").isNotNull())


def normalize_values(values, method: str) -> np.ndarray:
    """An array normalized: 'per_slice_robust', 'zscore' or 'none'; what isn't finite is 0 afterwards."""
    x = np.asarray(values, dtype=np.float64)
    ok = np.isfinite(x)
    good = x[ok]
    if len(good) and method == "zscore":
        good = np.clip((good - good.mean()) / max(float(good.std()), 1e-6), -5.0, 5.0)
    elif len(good) and method == "per_slice_robust":
        low, high = np.percentile(good, (1, 99))
        good = np.clip((good - low) / max(float(high - low), 1e-6), 0.0, 1.0)
    out = np.zeros(len(x))
    out[ok] = good
    return out


def normalized(df: DataFrame, keys: list[str], values: str, method: str) -> DataFrame:
    """Each row's array normalized, one row for each value (keys, place, x): 'per_slice_robust', 'zscore' or 'none'.

    Robust: 1st to 99th percentile to 0..1, clipped, the range at least 1e-6.  zscore: population deviation at least 1e-6, clipped to 5.
    Values that aren't finite are 0 afterwards, and so are arrays without any that is.  Arrays are normalized whole, in Arrow batches,
    without a shuffle.
    """
    if method not in ("per_slice_robust", "zscore", "none"):
        raise KeyError(f"unknown normalization {method!r}")

    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda v: normalize_values(v, method), na_action="ignore")

    return df.select(*keys, F.posexplode(run(F.transform(values, lambda x: x.cast("double")))).alias("place", "x"))


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centers at halves (edges repeat beyond)."""
    rows, columns = image.shape

    def axis(n: int, out: int):
        at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(rows, height)
    x0, x1, fx = axis(columns, width)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    bottom = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + bottom * fy[:, None]


def resized(df: DataFrame, values: str, rows: int, columns: int, height: int, width: int, name: str = "resized") -> DataFrame:
    """Arrays that hold images row by row, resized, by an Arrow UDF."""
    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        return images.map(lambda v: resize_bilinear(np.asarray(v, dtype=np.float64).reshape(rows, columns), height, width).ravel())

    return df.withColumn(name, run(F.transform(values, lambda x: x.cast("double"))))
