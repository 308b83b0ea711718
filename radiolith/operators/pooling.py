"""Pooling of window features into study features; one row a window, so nothing is padded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def _long(df: DataFrame, keys: list[str], features: str, extra: list[str] = ()) -> DataFrame:
    return df.select(*keys, *extra, F.posexplode(features).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def mean_max(df: DataFrame, group: str, features: str, valid: Column | None = None) -> DataFrame:
    """Mean and greatest of each dimension over valid windows; groups without any give zeros."""
    flag = valid if valid is not None else F.lit(True)
    long = _long(df.withColumn("_v", flag), [group], features, ["_v"])
    on = F.when(F.col("_v"), F.col("x"))
    return long.groupBy(group, "dim").agg(F.coalesce(F.avg(on), F.lit(0.0)).alias("mean"), F.coalesce(F.max(on), F.lit(0.0)).alias("maximum"))


def softmax(logit: Column | str, partition: list[str]) -> Column:
    """Shares of a partition by the exponential of a logit, shifted by the greatest."""
    z = F.col(logit) if isinstance(logit, str) else logit
    w = Window.partitionBy(*partition)
    e = F.exp(z - F.max(z).over(w))
    return e / F.sum(e).over(w)


def softmax_pool(df: DataFrame, group: list[str], logit: Column, features: str) -> DataFrame:
    """Dimensions averaged by softmax weights of a logit for each window.

    Written as two aggregates (greatest logit, then weighted sums): their partial sums leave the map side, where a window function
    would sort every window's features.
    """
    with_logit = df.withColumn("_z", logit)
    top = with_logit.groupBy(*group).agg(F.max("_z").alias("_top"))
    weighed = with_logit.join(top, group).withColumn("_e", F.exp(F.col("_z") - F.col("_top")))
    return _long(weighed, group, features, ["_e"]).groupBy(*group, "dim").agg((F.sum(F.col("_e") * F.col("x")) / F.sum("_e")).alias("pooled"))


def attention(df: DataFrame, group: str, features: str, query: list[float]) -> DataFrame:
    """One weight for each window, from its features' product with ``query``."""
    return softmax_pool(df, [group], dot(F.col(features), F.array(*(F.lit(float(q)) for q in query))), features)


def label_attention(df: DataFrame, group: str, features: str, queries: dict[str, list[float]]) -> DataFrame:
    """One weight for each window and label, from its features' product with the label's query."""
    each = F.array(*(F.struct(F.lit(name).alias("label"), F.array(*(F.lit(float(q)) for q in query)).alias("query")) for name, query in queries.items()))
    wide = df.withColumn("_q", F.explode(each)).select("*", "_q.label", "_q.query")
    return softmax_pool(wide, [group, "label"], dot(F.col(features), F.col("query")), features)


def linear(df: DataFrame, keys: list[str], value: str, weights: DataFrame, bias: str = "bias") -> DataFrame:
    """A linear output over pooled dimensions: ``weights`` has dim, w and the bias of each output."""
    return df.join(F.broadcast(weights), "dim").groupBy(*keys, "output").agg((F.sum(F.col(value) * F.col("w")) + F.max(bias)).alias("logit"))
