"""Running sums and distributions over an order too long for one task: ranges are dealt over partitions, sums of the ranges before are carried."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize


def running_sums(rows: DataFrame, keys: list[str], value: str, sums: list[str], parts: int | None = None, following: str | None = None) -> DataFrame:
    """``rows`` (one for each value of a key) with ``before_<s>``, the sum of ``s`` over the key's lesser values, for each of ``sums``.

    Rows are dealt by ranges of key and value, so a key's values lie in as many partitions as its share of the rows.  Sums run within a range; what lies before a range
    comes from the ranges' totals, one row for each range and key in it, of which all ranges of a key (``parts`` at most) meet in one task.  ``following`` names a column for
    the key's next greater value.  Null keys are keys of their own.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *keys, value).withColumn("_rl_part", F.spark_partition_id()), "ranges")  # part numbers are settled once
    totals = placed.groupBy("_rl_part", *keys).agg(*(F.sum(s).alias(f"_rl_sum_{s}") for s in sums), F.min(value).alias("_rl_least"))
    before = Window.partitionBy(*keys).orderBy("_rl_part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_rl_part")
    carried = totals.select(
        F.col("_rl_part").alias("_rl_at"), *(F.col(f"`{k}`").alias(f"_rl_key_{i}") for i, k in enumerate(keys)),
        *(F.coalesce(F.sum(f"_rl_sum_{s}").over(before), F.lit(0)).alias(f"_rl_before_{s}") for s in sums), F.lead("_rl_least").over(after).alias("_rl_next"),
    )
    inside = Window.partitionBy("_rl_part", *keys).orderBy(value)
    lesser = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"_rl_own_{s}": F.coalesce(F.sum(s).over(lesser), F.lit(0)) for s in sums} | ({following: F.lead(value).over(inside)} if following else {}))
    same = [F.col("_rl_part") == F.col("_rl_at"), *(F.col(f"`{k}`").eqNullSafe(F.col(f"_rl_key_{i}")) for i, k in enumerate(keys))]
    joined = own.join(carried, reduce(Column.__and__, same), "left")
    out = {f"before_{s}": F.col(f"_rl_own_{s}") + F.col(f"_rl_before_{s}") for s in sums} | ({following: F.coalesce(following, "_rl_next")} if following else {})
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), *(c.alias(name) for name, c in out.items()))


def ecdf(rows: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """keys, value, n, share: of every distinct value how many rows have it and what share of the key's rows is not greater.  Rows without a value don't count."""
    ties = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    totals = ties.groupBy(*keys).agg(F.sum("n").alias("_rl_all")).select(*(F.col(f"`{k}`").alias(f"_rl_k{i}") for i, k in enumerate(keys)), "_rl_all")
    ranked = running_sums(ties, keys, value, ["n"], parts)
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_rl_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    return ranked.join(totals, same).select(*keys, value, "n", ((F.col("before_n") + F.col("n")) / F.col("_rl_all")).alias("share"))


def domain_shift(rows: DataFrame, group: str, groups: list, columns: list[str], bins: int = 32, parts: int | None = None) -> DataFrame:
    """metric, group, n, n_rest, ks, wasserstein, jensen_shannon: how far each group's values of a column lie from those of all other rows.

    ``ks`` is the greatest difference of both cumulative shares, ``wasserstein`` the area between them (in the column's unit), ``jensen_shannon`` the divergence in bits of
    histograms of ``bins`` equal widths between the column's least and greatest value.  All come from one merged order of distinct values with a count for each group, dealt by
    ranges.  Rows without a group belong to the rest, values that are null or not finite don't count, a side without rows gives NULLs.  ``groups`` are as many as columns of a row.
    """
    long = rows.select(F.col(group).alias("_g"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["_g"], columns, "metric", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    counts = [f"_c{i}" for i in range(len(groups))]
    ties = long.groupBy("metric", "value").agg(F.count("*").alias("_n"), *(F.count_if(F.col("_g") == F.lit(g)).alias(c) for g, c in zip(groups, counts)))
    ties = materialize(ties, "ties")
    sizes = ties.groupBy("metric").agg(F.sum("_n").alias("_everything"), *(F.sum(c).alias(f"{c}_all") for c in counts), F.min("value").alias("_low"), F.max("value").alias("_high"))
    ranked = running_sums(ties, ["metric"], "value", ["_n", *counts], parts, "_next").join(F.broadcast(sizes), "metric")  # a row for each column
    width = F.col("_high") - F.col("_low")
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_low")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("c"), (F.col(f"before_{c}") + F.col(c)).alias("upto"), F.col(f"{c}_all").alias("all")) for i, c in enumerate(counts))))
    each = ranked.select("metric", "value", "_next", "_n", "_everything", (F.col("before__n") + F.col("_n")).alias("_upto"), place.alias("_bin"), sides.alias("s"))
    rest = F.col("_everything") - F.col("s.all")
    gap = F.abs(F.try_divide(F.col("s.upto"), F.col("s.all")) - F.try_divide(F.col("_upto") - F.col("s.upto"), rest))
    each = each.withColumns({"_gap": gap, "_area": gap * (F.coalesce("_next", "value") - F.col("value"))})
    by_bin = each.groupBy("metric", F.col("s.i").alias("i"), "_bin").agg(
        F.max("_gap").alias("ks"), F.sum("_area").alias("area"), F.sum("s.c").alias("c"), F.sum("_n").alias("all_in"), F.first("s.all").alias("n"), F.first(rest).alias("n_rest")
    )
    p, q = F.try_divide(F.col("c"), F.col("n")), F.try_divide(F.col("all_in") - F.col("c"), F.col("n_rest"))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    by_bin = by_bin.withColumn("js", F.when(p.isNotNull() & q.isNotNull(), (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2))
    out = by_bin.groupBy("metric", "i").agg(F.first("n").alias("n"), F.first("n_rest").alias("n_rest"), F.max("ks").alias("ks"), F.sum("area").alias("wasserstein"), F.sum("js").alias("jensen_shannon"))
    names = F.array(*(F.lit(g).cast(rows.schema[group].dataType) for g in groups))
    return out.select("metric", F.get(names, F.col("i")).alias("group"), "n", "n_rest", "ks", "wasserstein", "jensen_shannon")
