"""Label audits: prevalence, confidence, co-occurrence, correlation, domains, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, known, vendor_family
from .stats import correlation


def gold_raw(columns: list[str]) -> Column:
    """All labels present, whatever they say."""
    return F.forall(F.array(*(F.col(c).cast("string") for c in columns)), lambda x: x.isNotNull())


def gold_numeric(columns: list[str]) -> Column:
    """All labels present as numbers."""
    return F.forall(F.array(*(finite(c) for c in columns)), lambda x: x.isNotNull())


def long_labels(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each row and label: keys, label, value."""
    return df.select(*keys, *(finite(c).alias(c) for c in columns)).unpivot(keys, columns, "label", "value")


def label_inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """Positive, negative, missing and prevalence of each label."""
    v = F.col("value")
    return long_labels(df, [], columns).groupBy("label").agg(F.count_if(v == 1).alias("positive"), F.count_if(v == 0).alias("negative"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("prevalence"))


def bootstrap_interval(values: np.ndarray, resamples: int = 2000, seed: int = 2026) -> tuple[float, float] | None:
    """95 % interval of the mean by resampling; None without values."""
    if not len(values):
        return None
    rng = np.random.default_rng(seed)
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(resamples)])
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def prevalence_intervals(df: DataFrame, columns: list[str], resamples: int = 2000, seed: int = 2026) -> DataFrame:
    """Bootstrap interval of each label's prevalence over its present values.

    A mean of 0/1 labels only needs their counts, so a group is reduced to its distinct values and counts before Python
    sees it: what arrives is a few rows however many studies there are.
    """
    counts = long_labels(df, [], columns).where("value is not null").groupBy("label", "value").agg(F.count("*").alias("n"))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        n = int(pdf["n"].sum())
        rng = np.random.default_rng(seed)
        drawn = rng.multinomial(n, pdf["n"].to_numpy() / n, size=resamples) @ pdf["value"].to_numpy() / n
        low, high = np.percentile(drawn, [2.5, 97.5])
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "n": [n], "ci_low": [low], "ci_high": [high]})

    return counts.groupBy("label").applyInPandas(interval, "label string, n long, ci_low double, ci_high double")


def _pairs(columns: list[str], cell) -> list[Column]:
    return [cell(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]


def _unfold(row: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A one-row table of cells i_j as label_a, label_b, value."""
    cells = [F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), F.col(f"{i}_{j}").alias(name)) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every two labels over rows that have both, in one pass."""
    numbers = df.select(*(finite(c).alias(c) for c in columns))
    return _unfold(numbers.agg(*_pairs(columns, lambda a, b: correlation(F.col(a), F.col(b)))), columns, "correlation")


def co_occurrence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of every two labels over gold rows: rows positive for both, and that over rows positive for either (0 if none)."""
    on = {c: finite(c) == 1 for c in columns}
    gold = df.where(gold_numeric(columns))
    both = gold.agg(*_pairs(columns, lambda a, b: F.count_if(on[a] & on[b])))
    either = gold.agg(*_pairs(columns, lambda a, b: F.coalesce(F.try_divide(F.count_if(on[a] & on[b]), F.count_if(on[a] | on[b])), F.lit(0.0))))
    return _unfold(both, columns, "together").join(_unfold(either, columns, "jaccard"), ["label_a", "label_b"])


def as_matrix(pairs: DataFrame, columns: list[str], value: str) -> DataFrame:
    """label_a, label_b and a value as a square table."""
    return pairs.groupBy("label_a").pivot("label_b", columns).agg(F.first(value))


def label_domains(df: DataFrame, columns: list[str], vendor: str) -> DataFrame:
    """Gold rows, positives and prevalence of each label in each vendor family."""
    gold = df.where(gold_numeric(columns)).withColumn("family", vendor_family(vendor))
    return long_labels(gold, ["family"], columns).groupBy("label", "family").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 1).alias("positive"), F.avg("value").alias("prevalence"))


def positives_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many gold rows have how many positive labels."""
    total = sum((F.when(finite(c) == 1, 1).otherwise(0) for c in columns), F.lit(0))
    return df.where(gold_numeric(columns)).groupBy(total.cast("int").alias("positives")).agg(F.count("*").alias("n"))


def buckets(df: DataFrame, plane: str | None, fluid: str | None) -> DataFrame:
    """Counts by plane and fluid sensitivity, 'Unknown' for what is missing (a NULL column name: all of it)."""
    part = lambda c: known(c) if c else F.lit("Unknown")
    return df.groupBy(F.concat(part(plane), F.lit("/fluid="), part(fluid)).alias("bucket")).agg(F.count("*").alias("n"))


def coverage(studies: DataFrame, on_disk: DataFrame, gold: Column) -> DataFrame:
    """How much of a study table is on disk: counts of studies and gold ones, what is missing, and shares (NULL of nothing).

    ``studies`` and ``on_disk`` have study_uid; a study on disk that the table doesn't have is unrecognized.
    """
    present = on_disk.select("study_uid").distinct().withColumn("_disk", F.lit(True))
    table = studies.select("study_uid", F.coalesce(gold, F.lit(False)).alias("_gold")).groupBy("study_uid").agg(F.max("_gold").alias("_gold"))
    both = table.join(present, "study_uid", "full")
    known_, disk, is_gold = F.col("_gold").isNotNull(), F.coalesce("_disk", F.lit(False)), F.coalesce("_gold", F.lit(False))
    out = both.agg(
        F.count_if(known_).alias("studies"), F.count_if(is_gold).alias("gold"), F.count_if(disk).alias("on_disk"), F.count_if(known_ & disk).alias("covered"),
        F.count_if(is_gold & disk).alias("gold_covered"), F.count_if(is_gold & ~disk).alias("gold_missing"), F.count_if(disk & ~known_).alias("unrecognized"),
    )
    return out.withColumn("study_share", F.try_divide("covered", "studies")).withColumn("gold_share", F.try_divide("gold_covered", "gold"))


def missing_gold(studies: DataFrame, on_disk: DataFrame, gold: Column) -> DataFrame:
    """Gold studies that aren't on disk, in order."""
    return studies.where(gold).select("study_uid").distinct().join(on_disk.select("study_uid").distinct(), "study_uid", "left_anti").orderBy("study_uid")


def recognized(studies: DataFrame, on_disk: DataFrame) -> DataFrame:
    return studies.select("study_uid").intersect(on_disk.select("study_uid"))


def unrecognized(studies: DataFrame, on_disk: DataFrame) -> DataFrame:
    return on_disk.select("study_uid").subtract(studies.select("study_uid"))


def of_studies_on_disk(series: DataFrame, on_disk: DataFrame) -> DataFrame:
    return series.join(on_disk.select("study_uid").distinct(), "study_uid", "left_semi")
