"""Sweeps: every combination of a few settings, as configurations or as a table."""

from __future__ import annotations

import itertools
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .config import fingerprint, load_config, save_config, set_path


def combinations(matrix: dict[str, list]) -> list[dict]:
    """All combinations in the matrix' order, the last key varying fastest."""
    return [dict(zip(matrix, values)) for values in itertools.product(*matrix.values())]


def sweep_frame(spark: SparkSession, matrix: dict[str, list]) -> DataFrame:
    """A row for each combination, numbered in order; the matrix is a driver-side setting of a few dozen rows."""
    kinds = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType()}
    fields = [T.StructField(k, kinds.get(type(v[0]), T.StringType())) for k, v in matrix.items()]
    rows = [(*c.values(), i) for i, c in enumerate(combinations(matrix))]
    return spark.createDataFrame(rows, T.StructType([*fields, T.StructField("run", T.IntegerType())]))


def write_sweep(base: list[str], matrix: dict[str, list], folder: str) -> list[str]:
    """Write a configuration for each combination, named by its number and fingerprint, and the list of them; returns the paths."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for i, choice in enumerate(combinations(matrix)):
        config = load_config(base)
        for key, value in choice.items():
            set_path(config, key, value)
        paths.append(os.path.join(folder, f"run-{i:03d}-{fingerprint(config)}.json"))
        save_config(config, paths[-1])
    with open(os.path.join(folder, "queue.json"), "w", encoding="utf-8") as f:
        json.dump(paths, f, indent=1)
    return paths
