"""Choice of a fixed number of candidate windows, and gathering what was chosen."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(df: DataFrame, group: str, index: str, valid: Column | None) -> DataFrame:
    kept = df.where(valid) if valid is not None else df
    w = Window.partitionBy(group)
    return kept.withColumn("_i", F.row_number().over(w.orderBy(index)) - 1).withColumn("_n", F.count("*").over(w))


def central(df: DataFrame, group: str, index: str, k: int, valid: Column | None = None) -> DataFrame:
    """The ``k`` valid candidates in the middle of each group."""
    start = F.floor((F.col("_n") - F.least(F.lit(k), F.col("_n"))) / 2)
    return _placed(df, group, index, valid).where((F.col("_i") >= start) & (F.col("_i") < start + k)).drop("_i", "_n")


def uniform(df: DataFrame, group: str, index: str, k: int, valid: Column | None = None) -> DataFrame:
    """``k`` valid candidates spread evenly over each group, places rounded half to even."""
    step = (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))
    chosen = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.bround(s * step, 0) == F.col("_i"))
    return _placed(df, group, index, valid).where((F.col("_n") <= k) | chosen).drop("_i", "_n")


def utility(scores: str = "scores") -> Column:
    """A window's utility: its greatest score over labels."""
    return F.array_max(scores)


def top_k(df: DataFrame, group: str, index: str, priority: Column, k: int) -> DataFrame:
    """The ``k`` windows of greatest priority of each group, with their rank; equals by index."""
    w = Window.partitionBy(group).orderBy(F.desc("_priority"), index)
    return df.withColumn("_priority", priority).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_priority")


def top_k_utility(df: DataFrame, group: str, index: str, k: int, scores: str = "scores", valid: Column | None = None) -> DataFrame:
    return top_k(df.where(valid) if valid is not None else df, group, index, utility(scores), k)


def top_k_recall_safe(df: DataFrame, group: str, index: str, k: int, scores: str = "scores", valid: Column | None = None) -> DataFrame:
    """Top ``k`` where each label's best window goes before all others.

    A best window's utility is raised by four times the greatest absolute utility of the group plus one.  Best windows come from an
    aggregate of the exploded scores, so no window function sorts them once more for each label.
    """
    df = (df.where(valid) if valid is not None else df).withColumn("_u", utility(scores))
    long = df.select(group, index, F.posexplode(scores).alias("label", "score"))
    best = long.groupBy(group, "label").agg(F.min_by(F.col(index), F.struct((-F.col("score")).alias("s"), F.col(index))).alias(index)).select(group, index).distinct().withColumn("_best", F.lit(1.0))
    scale = df.groupBy(group).agg((F.max(F.abs("_u")) + 1).alias("_scale"))
    joined = df.join(best, [group, index], "left").join(scale, group)
    return top_k(joined, group, index, F.col("_u") + F.coalesce("_best", F.lit(0.0)) * F.col("_scale") * 4.0, k).withColumn("proposed", F.col("_best").isNotNull()).drop("_u", "_best", "_scale")


def gather(df: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` that were selected, with their rank."""
    return df.join(selection.select(*keys, "rank"), keys)


def best_epoch(metrics: DataFrame, score: str = "score", epoch: str = "epoch") -> DataFrame:
    """The row of the greatest score, the earliest of equals."""
    return metrics.orderBy(F.desc_nulls_last(score), epoch).limit(1)


def evidence_mask(scores: str, least: float) -> Column:
    """The labels (at most 63) whose score is ``least`` or more, as bits: that of label i is bit i."""
    bits = F.transform(scores, lambda x, i: F.when(x >= least, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def most_covered(masks: list[int], k: int) -> int:
    """The most labels that ``k`` windows cover together, exactly, by branch and bound over the windows' label masks.

    Windows whose labels another has too are left out.  A branch takes one of the windows that have the rarest label still open, or gives that label up; it ends where even the greatest gains of as
    many windows as are left would not pass the best cover so far.
    """
    kept: list[int] = []
    for m in sorted(set(masks), key=lambda m: (-m.bit_count(), m)):
        if m and all(m & ~other for other in kept):
            kept.append(m)
    best = 0

    def search(covered: int, given_up: int, left: int) -> None:
        nonlocal best
        best = max(best, covered.bit_count())
        gains = sorted(((m & ~covered & ~given_up).bit_count() for m in kept), reverse=True)[:left]
        if not gains or not gains[0] or covered.bit_count() + sum(gains) <= best:
            return
        open_ = 0
        for m in kept:
            open_ |= m & ~covered & ~given_up
        bits = [1 << i for i in range(open_.bit_length()) if open_ >> i & 1]
        rarest = min(bits, key=lambda b: sum(1 for m in kept if m & b))
        for m in sorted((m for m in kept if m & rarest), key=lambda m: -(m & ~covered & ~given_up).bit_count()):
            search(covered | (m & ~given_up), given_up, left - 1)
        search(covered, given_up | rarest, left)

    search(0, 0, k)
    return best


def oracle_coverage(df: DataFrame, group: str, k: int, least: float, scores: str = "scores") -> DataFrame:
    """group, evidence (labels that some window shows) and oracle (the most of them that any ``k`` windows show together).

    Of a group only distinct label sets come together, at most ``2 ** labels``.
    """

    @F.pandas_udf("int")
    def oracle(sets: pd.Series) -> pd.Series:
        return sets.map(lambda s: most_covered([int(m) for m in s], k))

    masks = df.select(group, evidence_mask(scores, least).alias("_m")).distinct().groupBy(group).agg(F.collect_set("_m").alias("_s"), F.bit_or("_m").alias("_all"))
    return masks.select(group, F.bit_count("_all").alias("evidence"), oracle("_s").alias("oracle"))


def coverage_at(selected: DataFrame, group: str, least: float, name: str, scores: str = "scores") -> DataFrame:
    """group and, as ``name``, how many labels its selected windows show together."""
    return selected.groupBy(group).agg(F.bit_count(F.bit_or(evidence_mask(scores, least))).alias(name))


def regret(df: DataFrame, group: str, index: str, k: int, least: float, selectors: dict[str, DataFrame], scores: str = "scores") -> DataFrame:
    """group, evidence, oracle, and of each selector (rows of group and index) how many labels it covers and how many fewer than the best choice of ``k`` windows."""
    out = oracle_coverage(df, group, k, least, scores)
    for name, chosen in selectors.items():
        found = coverage_at(df.join(chosen.select(group, index), [group, index], "left_semi"), group, least, name, scores)
        out = out.join(found, group, "left").withColumn(name, F.coalesce(name, F.lit(0))).withColumn(f"{name}_regret", F.col("oracle") - F.col(name))
    return out
