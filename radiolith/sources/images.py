"""Pixels of windows: each slice decoded once, windows as channels, dense batches, montages.

Decoded images stay between the decoding task and the join that needs them; everything wide is made from file paths, so a
plan that only needs statistics never carries pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pixels import resize_bilinear
from .dicom import contents_of, pixel_array


def normalize(image: np.ndarray, method: str) -> np.ndarray:
    """One decoded image to float32: 'per_slice_robust', 'zscore' or 'none'; values that aren't finite are 0."""
    x = np.where(np.isfinite(image), image, np.nan).astype(np.float64)
    if method not in ("per_slice_robust", "zscore", "none"):
        raise KeyError(f"unknown normalization {method!r}")
    if np.isnan(x).all():
        return np.zeros(image.shape, dtype=np.float32)
    if method == "per_slice_robust":
        low, high = np.nanpercentile(x, [1, 99])
        x = np.clip((x - low) / max(high - low, 1e-6), 0, 1)
    elif method == "zscore":
        x = np.clip((x - np.nanmean(x)) / max(np.nanstd(x), 1e-6), -5, 5)
    return np.nan_to_num(x, nan=0.0).astype(np.float32)


def decode(data: bytes, size: int, method: str) -> np.ndarray:
    """A file's first frame, rescaled, normalized and resized to a square."""
    raw, slope, intercept = pixel_array(data)
    image = raw.astype(np.float64) * slope + intercept
    while image.ndim > 2:
        image = image[0]
    return resize_bilinear(normalize(np.atleast_2d(image), method), size, size).astype(np.float32)


def slices_of(spark: SparkSession, root: str, paths: DataFrame, size: int, method: str = "per_slice_robust", strict: bool = False) -> DataFrame:
    """``relative_path`` and ``image`` (size * size floats) of each distinct path; a file that can't be decoded raises if
    ``strict``, else is zeros with the error's name in ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, errors = [], []
            for content, failed in zip(batch.column(2), batch.column(3).to_pylist()):
                try:
                    if failed:
                        raise OSError(failed)
                    images.append(decode(content.as_py(), size, method).ravel())
                    errors.append(None)
                except Exception as error:
                    if strict:
                        raise
                    images.append(np.zeros(size * size, dtype=np.float32))
                    errors.append(type(error).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["relative_path", "image", "error"])

    return contents_of(spark, root, paths).mapInArrow(run, "relative_path string, image array<float>, error string")


def load_windows(spark: SparkSession, root: str, windows: DataFrame, size: int, method: str = "per_slice_robust", strict: bool = False) -> DataFrame:
    """``windows`` (study_id, window_index, paths) with ``channels``, the images of their paths in order.

    Overlapping windows share slices, so each is decoded once and joined to every place that has it.
    """
    places = windows.select("study_id", "window_index", F.posexplode("paths").alias("channel", "relative_path"))
    images = slices_of(spark, root, places, size, method, strict)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size * size)
    joined = places.join(images, "relative_path", "left").select("study_id", "window_index", F.struct("channel", F.coalesce("image", zeros).alias("image")).alias("c"))
    gathered = joined.groupBy("study_id", "window_index").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return windows.join(gathered.select("study_id", "window_index", F.col("c.image").alias("channels")), ["study_id", "window_index"])


def collate(studies: list[dict], n_labels: int) -> dict[str, np.ndarray]:
    """Studies of a batch as dense arrays: windows padded with zeros to the longest study, a mask of real ones, missing labels NaN.

    A study has ``channels`` (windows, each a list of equal images) and ``metadata`` (a vector for each window) and may have ``labels``.
    """
    if any(not s["channels"] for s in studies):
        raise ValueError("a study without windows can't be batched")
    longest = max(len(s["channels"]) for s in studies)
    images = np.zeros((len(studies), longest, *np.shape(studies[0]["channels"][0])), dtype=np.float32)
    metadata = np.zeros((len(studies), longest, len(studies[0]["metadata"][0])), dtype=np.float32)
    mask, labels = np.zeros((len(studies), longest), dtype=bool), np.full((len(studies), n_labels), np.nan, dtype=np.float32)
    for i, s in enumerate(studies):
        n = len(s["channels"])
        images[i, :n], metadata[i, :n], mask[i, :n] = s["channels"], s["metadata"], True
        if s.get("labels") is not None:
            labels[i] = [np.nan if v is None else v for v in s["labels"]]
    return {"images": images, "metadata": metadata, "mask": mask, "labels": labels}


def pool_features(output: np.ndarray) -> np.ndarray:
    """A backbone's output as one vector an image: as it is, the first token of a sequence, or the mean over space."""
    if output.ndim == 2:
        return output
    if output.ndim == 3:
        return output[:, 0]
    if output.ndim in (4, 5):
        return output.mean(axis=tuple(range(2, output.ndim)))
    raise ValueError(f"can't pool an output of {output.ndim} dimensions")


def predict(df: DataFrame, features: str, model, name: str = "scores") -> DataFrame:
    """Scores of each row's features by ``model``, a picklable function of a matrix, in Arrow batches."""
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(model(np.stack(batch.to_numpy())), dtype=np.float64)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, "array<double>")(F.transform(features, lambda x: x.cast("double"))))


def png(image: np.ndarray) -> bytes:
    """An RGB image (height, width, 3; 0 to 255) as a PNG file."""
    height, width, _ = image.shape
    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), image.astype(np.uint8).reshape(height, width * 3)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def montages(spark: SparkSession, root: str, slots: DataFrame, tile: int = 128, per_row: int = 9) -> DataFrame:
    """``study_id`` and a PNG for each study: a row of tiles for each plane and fluid sensitivity; a slice that can't be decoded is a
    dark red tile.  ``slots`` is what the montage selection gives, at most ``per_row`` tiles a slot."""
    images = slices_of(spark, root, slots.select(F.col("path").alias("relative_path")), tile)
    joined = slots.join(images.withColumnRenamed("relative_path", "path"), "path", "left")
    piece = F.struct(F.coalesce("plane", F.lit("")).alias("plane"), F.coalesce("fluid_sensitive", F.lit(-1.0)).alias("fluid"), F.col("slot_index"), F.when(F.col("error").isNull(), F.col("image")).alias("image"))
    studies = joined.groupBy("study_id").agg(F.array_sort(F.collect_list(piece)).alias("tiles"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tiles in batch.column(1).to_pylist():
                rows: dict = {}
                for t in tiles:
                    rows.setdefault((t["plane"], t["fluid"]), []).append(t["image"])
                canvas = np.zeros((len(rows) * tile, per_row * tile, 3))
                for y, row in enumerate(rows.values()):
                    for x, image in enumerate(row[:per_row]):
                        shown = np.array([96.0, 0, 0]) if image is None else np.asarray(image).reshape(tile, tile, 1) * 255
                        canvas[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] = shown
                out.append(png(canvas))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["study_id", "png"])

    return studies.mapInArrow(render, "study_id string, png binary")


def write_montages(montage: DataFrame, folder: str) -> int:
    """Write the PNGs of a small sample of studies to a local folder, one at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in montage.toLocalIterator():
        with open(os.path.join(folder, row["study_id"].replace(".", "_").replace("/", "_") + ".png"), "wb") as f:
            f.write(row["png"])
        n += 1
    return n
