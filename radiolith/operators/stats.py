"""Aggregations that several audits share: numeric summaries, deterministic modes, guarded correlations, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


#: Rank error of the sketches that percentiles are narrowed with, and rows of a bracket that may be sorted in one task.
SKETCH = 10_000
FEW = 100_000


def numeric_summary(df: DataFrame, columns: list[str], percentiles=PERCENTILES, exact: bool = True, sketch: int = SKETCH, few: int = FEW) -> DataFrame:
    """Count, min, mean, max, deviation and percentiles of numeric columns, one row a column.

    The deviation of a single value is 0; a column without values has a count of 0 and NULLs.  A percentile between two values is interpolated; NaN is greater than all
    numbers.  The first pass over ``df`` takes the moments and a sketch of each column.  With ``exact`` the sketch brackets each percentile; further passes count what lies before and in the
    brackets, narrow those that hold more than ``few`` rows, and sort only what is in the last ones.  No pass shuffles more than that, but ``df`` is read about three
    times, so write it first where it is costly.  ``exact=False`` gives the sketches' values.
    """
    wide = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    shares = [p / 100 for p in percentiles]
    margin = 2.0 / sketch
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in ((-margin, margin) if exact else (0.0,))]
    number = lambda i: F.when(~F.isnan(f"c{i}"), F.col(f"c{i}"))
    first = wide.agg(*(
        F.struct(
            F.count(f"c{i}").alias("n"), F.count(number(i)).alias("numbers"), F.min(f"c{i}").alias("minimum"), F.avg(f"c{i}").alias("mean"), F.max(f"c{i}").alias("maximum"), F.stddev_samp(f"c{i}").alias("deviation"),
            F.min(number(i)).alias("low"), F.max(number(i)).alias("high"), F.percentile_approx(number(i), asked, sketch).alias("points"),
        ).alias(f"s{i}")
        for i in range(len(columns))
    )).first()
    found = [first[f"s{i}"] for i in range(len(columns))]
    points = _exact_points(wide, found, shares, sketch, few) if exact else [list(f["points"] or [None] * len(shares)) for f in found]
    rows = []
    for name, f, own in zip(columns, found, points):
        deviation = None if not f["n"] else 0.0 if f["n"] == 1 else f["deviation"]
        rows.append((name, f["n"], f["minimum"], f["mean"], f["maximum"], deviation, *own))
    names = "metric string, n long, minimum double, mean double, maximum double, deviation double, " + ", ".join(f"p{p} double" for p in percentiles)
    return df.sparkSession.createDataFrame(rows, names)  # a row for each column


def _exact_points(wide: DataFrame, found: list, shares: list[float], sketch: int, few: int) -> list[list[float | None]]:
    """Interpolated values at the shares of each column, by brackets (column, share, least, greatest, rows before, rows within) around their ranks."""
    ranks = {(i, k): (int(s * (f["n"] - 1)), s * (f["n"] - 1)) for i, f in enumerate(found) for k, s in enumerate(shares) if f["n"]}
    bracket = {(i, k): (found[i]["points"][2 * k], found[i]["points"][2 * k + 1]) for (i, k), (low, _) in ranks.items() if low < found[i]["numbers"]}
    state: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    whole: set[tuple[int, int]] = set()
    while bracket:
        inside = lambda i, a, b: (F.col(f"c{i}") >= F.lit(a)) & (F.col(f"c{i}") <= F.lit(b))
        counted = wide.agg(*(F.struct(F.count_if(F.col(f"c{i}") < F.lit(a)).alias("before"), F.count_if(inside(i, a, b)).alias("within")).alias(f"b{i}_{k}") for (i, k), (a, b) in bracket.items())).first()
        wider, narrow = {}, {}
        for (i, k), (a, b) in bracket.items():
            before, within = counted[f"b{i}_{k}"]
            low, at = ranks[i, k]
            top = min(low + (at > low), found[i]["numbers"] - 1)
            if not before <= low <= top < before + within and (i, k) not in whole:
                wider[i, k] = (found[i]["low"], found[i]["high"])  # a sketch that missed: from the whole range again
                whole.add((i, k))
            elif within > few and a < b and (i, k, a, b) not in state:
                narrow[i, k] = (a, b, before, within)
            else:
                state[i, k] = (a, b, before, within)
        bracket = wider
        if narrow:
            margin = 2.0 / sketch
            asked = {key: [min(1.0, max(0.0, (ranks[key][0] + d - before) / max(within - 1, 1) + e)) for d, e in ((0, -margin), (1, margin))] for key, (a, b, before, within) in narrow.items()}
            again = wide.agg(*(F.percentile_approx(F.when(inside(i, a, b), F.col(f"c{i}")), asked[i, k], sketch).alias(f"b{i}_{k}") for (i, k), (a, b, _, _) in narrow.items())).first()
            for i, k in narrow:
                a, b = again[f"b{i}_{k}"]
                if (a, b) == narrow[i, k][:2]:  # as narrow as values are: so many equal ones are counted, not sorted
                    state[i, k] = narrow[i, k]
                else:
                    bracket[i, k] = (a, b)
    hits = F.array_compact(F.array(*(F.when((F.col(f"c{i}") >= F.lit(a)) & (F.col(f"c{i}") <= F.lit(b)), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(before).alias("before"), F.col(f"c{i}").alias("v"))) for (i, k), (a, b, before, _) in state.items()))) if state else None
    picked: dict[tuple[int, int, int], float] = {}
    if hits is not None:
        ties = wide.select(F.explode(hits).alias("h")).groupBy("h.i", "h.k", "h.before", "h.v").agg(F.count("*").alias("n"))
        running = F.sum("n").over(Window.partitionBy("i", "k").orderBy("v"))
        placed = ties.withColumn("upto", running + F.col("before")).withColumn("from", F.col("upto") - F.col("n"))
        wanted = wide.sparkSession.createDataFrame([(i, k, r) for (i, k) in state for r in {ranks[i, k][0], min(ranks[i, k][0] + 1, found[i]["numbers"] - 1)}], "i int, k int, rank long")
        for r in placed.join(F.broadcast(wanted), ["i", "k"]).where("from <= rank and rank < upto").collect():  # two rows for each percentile
            picked[r["i"], r["k"], r["rank"]] = r["v"]
    out = []
    for i, f in enumerate(found):
        own: list[float | None] = []
        for k in range(len(shares)):
            if (i, k) not in ranks:
                own.append(None)
                continue
            low, at = ranks[i, k]
            a = picked.get((i, k, low), float("nan"))
            b = a if at == low else picked.get((i, k, low + 1), float("nan"))
            own.append(a if a == b else a * (low + 1 - at) + b * (at - low))
        out.append(own)
    return out


def shard_sketches(df: DataFrame, shard: str, columns: list[str], k: int = 200) -> DataFrame:
    """A row for each shard and column: metric, n, total, minimum, maximum, and a quantile sketch whose rows merge with those of any other shards.

    Rows are kept a shard at a time, so a corpus that grows by shards is summed up without reading the old ones again.  Nulls and NaN don't count.
    """
    long = df.select(F.col(shard).alias("shard"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["shard"], columns, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("shard", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_summary(sketches: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """metric, n, mean, minimum, maximum and approximate percentiles from the rows of any shards."""
    merged = sketches.groupBy("metric").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select("metric", "n", "mean", "minimum", "maximum", *(F.kll_sketch_get_quantile_double("_s", F.lit(p / 100)).alias(f"p{p}") for p in percentiles))


def by_levels(df: DataFrame, keys: list[str], levels: list[list[str]], columns: list[str]) -> DataFrame:
    """Statistics of columns at several levels in one pass: level (a bit for each key that the level leaves out, the first key's highest), keys, metric, rows, missing, unique,
    minimum, mean, maximum, deviation.

    ``levels`` are the sets of keys to group by, [] for the whole table.  A key that is null in the data and one that a level leaves out are told apart by ``level``.
    """
    wide = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    each = lambda c: F.struct(F.lit(c).alias("metric"), F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("missing"), F.count_distinct(c).alias("unique"), F.min(c).alias("minimum"), F.avg(c).alias("mean"), F.max(c).alias("maximum"), F.stddev_samp(c).alias("deviation"))
    grouped = wide.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(F.grouping_id(*keys).cast("int").alias("level"), F.array(*(each(c) for c in columns)).alias("_s"))
    return grouped.select("level", *keys, F.inline("_s"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, each: int, seed: int = 0, always: Column | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``sample_rank`` (from 1, by hash of ``key`` and ``seed`` in the stratum) and ``reason``: of every stratum the ``each`` rows of least hash, so one with no more is whole, and all
    rows for which ``always`` holds (errors, outliers), which take no place in a stratum.

    The least hashes of a part of a stratum hold those of the stratum, so parts are cut before they meet, a large stratum never is in one task, and rows added later only push others
    out.  The rows are the same however the table is dealt.  Null strata are strata of their own.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    must = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    marked = df.withColumns({"_rl_must": must, "_rl_hash": F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")})
    order = ("_rl_hash", F.col(key))
    dealt = marked.where("not _rl_must").withColumn("_rl_salt", F.pmod(F.xxhash64(key), F.lit(n)))
    some = dealt.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*strata, "_rl_salt").orderBy(*order))).where(F.col("sample_rank") <= each)
    chosen = some.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("sample_rank") <= each)
    whole = marked.where("_rl_must").withColumn("sample_rank", F.lit(None).cast("int"))
    out = chosen.drop("_rl_salt").withColumn("reason", F.lit("stratum")).unionByName(whole.withColumn("reason", F.lit("always")))
    return out.drop("_rl_must", "_rl_hash")


def frequencies(df: DataFrame, columns: list[str], skip_empty: bool = True) -> DataFrame:
    """Counts of the values of several columns in one pass: column, value, n."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value")
    if skip_empty:
        long = long.where("value is not null and value <> ''")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def first_mode(df: DataFrame, keys: list[str], value: str, order: Column, name: str) -> DataFrame:
    """The commonest value of each key; of equals the one that comes first by ``order``. NULL and empty values don't count."""
    counted = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.min_by(F.col(value), F.struct((-F.col("_n")).alias("n"), F.col("_first")))
    return counted.groupBy(*keys).agg(best.alias(name))


def average_rank(partition: list[str], value: str, among: Column | None = None) -> Column:
    """Rank of a value among its partition, the mean of the places of equals."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    equals = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count("*").over(equals) - 1) / F.lit(2.0)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; NULL for fewer than two pairs or where a side doesn't vary."""
    pair = lambda a, b: F.when(F.expr("true") & _c(a).isNotNull() & _c(b).isNotNull(), _c(a).cast("double"))
    a, b = pair(x, y), pair(y, x)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
