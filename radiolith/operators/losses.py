"""Losses as aggregates over (study, label) and (study, window, label) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bce_with_logits, sigmoid, softplus


def masked_bce(df: DataFrame, logit: str, target: str, positive_weight: float = 1.0) -> DataFrame:
    """Mean cross-entropy over cells that have a target; 0 if none has."""
    return df.where(F.col(target).isNotNull()).agg(F.coalesce(F.avg(bce_with_logits(logit, target, positive_weight)), F.lit(0.0)).alias("loss"), F.count("*").alias("cells"))


def pairwise_ranking(df: DataFrame, label: str, logit: str, target: str, batch: str | None = None) -> DataFrame:
    """Mean softplus of negative less positive score over all pairs of a label (in a batch), for each label with both.

    Pairs are those of one training batch; with ``batch`` the join stays inside it.  Over whole tables use
    :func:`radiolith.operators.metrics.auc`, which ranks instead of pairing.
    """
    keys = [label] + ([batch] if batch else [])
    rows = df.where(F.col(target).isNotNull())
    pos = rows.where(F.col(target) > 0.5).select(*keys, F.col(logit).alias("_p"))
    neg = rows.where(F.col(target) <= 0.5).select(*keys, F.col(logit).alias("_n"))
    return pos.join(neg, keys).groupBy(*keys).agg(F.avg(softplus(F.col("_n") - F.col("_p"))).alias("loss"), F.count("*").alias("pairs"))


def coverage_loss(scores: DataFrame, labels: DataFrame, k: int, temperature: float = 0.2, study: str = "study", window: str = "window", label: str = "label") -> DataFrame:
    """Soft coverage of evidence by the top ``k`` windows, one row for each positive study and label.

    ``scores`` has study, window, label, score and evidence (NULL unknown); ``labels`` has study, label and value.  A window's gate is
    the logistic of its utility over the k-th utility; coverage is one less the product of what each gate leaves uncovered.
    """
    utility = scores.groupBy(study, window).agg(F.max("score").alias("_u"))
    w = Window.partitionBy(study)
    ranked = utility.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_u"), window))).withColumn("_k", F.least(F.count("*").over(w), F.lit(k)))
    threshold = ranked.where("_r = _k").select(study, F.col("_u").alias("_t"))
    gates = ranked.join(threshold, study).select(study, window, sigmoid((F.col("_u") - F.col("_t")) / max(temperature, 1e-4)).alias("_g"))
    evidence = F.coalesce(F.least(F.greatest(F.col("evidence"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    kept = F.least(F.greatest(F.col("_g") * evidence, F.lit(0.0)), F.lit(1 - 1e-6))
    covered = scores.join(gates, [study, window]).groupBy(study, label).agg((1 - F.exp(F.sum(F.log(1 - kept)))).alias("coverage"), F.count("evidence").alias("_known"))
    wanted = labels.where("value > 0.5").select(study, label)
    return covered.where("_known > 0").join(wanted, [study, label]).select(study, label, "coverage", (-F.log(F.greatest(F.col("coverage"), F.lit(1e-6)))).alias("loss"))


def composite(bce: DataFrame, ranking: DataFrame, coverage: DataFrame, weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> DataFrame:
    """Weighted sum of the three losses, in one row with its parts."""
    none = F.lit(None).cast("double")
    parts = bce.select(F.col("loss").alias("bce"), none.alias("ranking"), none.alias("coverage"))
    parts = parts.unionByName(ranking.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("ranking")), allowMissingColumns=True)
    parts = parts.unionByName(coverage.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("coverage")), allowMissingColumns=True)
    one = parts.agg(*(F.max(c).alias(c) for c in ("bce", "ranking", "coverage")))
    return one.withColumn("total", weights[0] * F.col("bce") + weights[1] * F.col("ranking") + weights[2] * F.col("coverage"))
