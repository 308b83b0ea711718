"""Ranking metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sums


def auc(df: DataFrame, label: str, score: str, target: str, parts: int | None = None) -> DataFrame:
    """Area under the ROC curve of each label by average ranks, NULL where a class is missing; rows without score or target are left out.

    Equal scores are counted before they are ranked, so a popular score is one row; the ranks of a label's distinct scores run over ranges of them.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(target).isNotNull())
    ties = rows.groupBy(label, score).agg(F.count("*").alias("_n"), F.count_if(F.col(target) > 0.5).alias("_p"))
    ranked = running_sums(ties, [label], score, ["_n"], parts).withColumn("_rank", F.col("before__n") + (F.col("_n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(label).agg(F.sum(F.col("_rank") * F.col("_p")).alias("_s"), F.sum("_p").alias("positives"), F.sum("_n").alias("n"))
    p, n = F.col("positives").cast("double"), F.col("n") - F.col("positives")
    return sums.select(label, "n", "positives", F.when((p > 0) & (n > 0), (F.col("_s") - p * (p + 1) / 2) / (p * n)).alias("auc"))


def macro_auc(per_label: DataFrame) -> DataFrame:
    """Mean over the labels that have one, and how many have."""
    return per_label.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("valid_labels"))


def first_prediction(df: DataFrame, study: str, order: str) -> DataFrame:
    """The first prediction of each study: what several workers padded to equal shares counts once."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(study).orderBy(order))).where("_n = 1").drop("_n")


def evaluate(predictions: DataFrame, study: str, order: str, label: str, logit: str, target: str) -> DataFrame:
    """AUC of each label over the first prediction of each study."""
    from ..functions.exprs import sigmoid

    keyed = predictions.withColumn("_key", F.struct(study, label))
    once = first_prediction(keyed, "_key", order).drop("_key").withColumn("probability", sigmoid(logit))
    return auc(once, label, "probability", target)
