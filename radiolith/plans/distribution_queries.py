"""Queries of distributions: cumulative shares, domain shift, sketches, levels, stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges, stats
from . import roles as R
from .catalog import query


@query("""SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS share FROM lineitem WHERE l_quantity IS NOT NULL""")
def ecdf(spark, sf):
    return ranges.ecdf(R.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("share", F.round("share", 9))


_SHIFTED = ["l_quantity", "l_extendedprice", "l_discount"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS metric, l_returnflag AS g, {c} AS value FROM lineitem WHERE {c} IS NOT NULL" for c in _SHIFTED)


@query(f"""WITH l AS ({_LONG}), g AS (SELECT unnest(['A', 'N', 'R']) AS "group"),
    t AS (SELECT metric, "group", value, count(*) AS n, count(*) FILTER (g = "group") AS c FROM l, g GROUP BY ALL),
    w AS (SELECT *, sum(c) OVER p AS upto, sum(n) OVER p AS all_upto, sum(c) OVER a AS total, sum(n) OVER a AS everything, lead(value) OVER p AS following, min(value) OVER a AS low, max(value) OVER a AS high
        FROM t WINDOW p AS (PARTITION BY metric, "group" ORDER BY value), a AS (PARTITION BY metric, "group")),
    x AS (SELECT *, abs(upto / total - (all_upto - upto) / (everything - total)) AS gap, least(floor((value - low) / (high - low) * 32), 31) AS bin FROM w),
    b AS (SELECT metric, "group", bin, max(gap) AS ks, sum(gap * (coalesce(following, value) - value)) AS area, sum(c) / any_value(total) AS p, sum(n - c) / any_value(everything - total) AS q, any_value(total)::BIGINT AS n, any_value(everything - total)::BIGINT AS n_rest FROM x GROUP BY ALL)
    SELECT metric, "group", any_value(n) AS n, any_value(n_rest) AS n_rest, round(max(ks), 6) AS ks, round(sum(area), 6) AS wasserstein,
        round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS jensen_shannon FROM b GROUP BY ALL""")
def domain_shift(spark, sf):
    out = ranges.domain_shift(R.table(spark, sf, "lineitem"), "l_returnflag", ["A", "N", "R"], _SHIFTED)
    return out.withColumns({c: F.round(c, 6) for c in ("ks", "wasserstein", "jensen_shannon")})


_SKETCHED = ["l_quantity", "l_extendedprice"]


# The sketches are random within their rank error, so what SQL can say of them is that every percentile lies within it.
@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 4) AS mean, min({c}) AS minimum, max({c}) AS maximum, 0 AS beyond FROM lineitem" for c in _SKETCHED))
def quantile_sketches(spark, sf):
    from ..functions.scratch import materialize

    rows = R.table(spark, sf, "lineitem").withColumn("shard", F.col("l_orderkey") % 8)
    first = stats.shard_sketches(rows.where("shard < 5"), "shard", _SKETCHED)
    later = stats.shard_sketches(rows.where("shard >= 5"), "shard", _SKETCHED)  # shards that came later join as rows
    merged = materialize(stats.merged_summary(materialize(first.unionByName(later), "sketches")), "summary")
    points = merged.select("metric", F.explode(F.array(*(F.struct(F.lit(p / 100).alias("share"), F.col(f"p{p}").alias("point")) for p in stats.PERCENTILES))).alias("p")).select("metric", "p.*")
    long = rows.select(*_SKETCHED).unpivot([], _SKETCHED, "metric", "value")
    ranked = long.join(F.broadcast(points), "metric").groupBy("metric", "share").agg(F.avg((F.col("value") < F.col("point")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("point")).cast("int")).alias("upto"))  # points: seven a column
    beyond = ranked.groupBy("metric").agg(F.count_if((F.col("below") > F.col("share") + 0.03) | (F.col("upto") < F.col("share") - 0.03)).cast("int").alias("beyond"))
    return merged.join(beyond, "metric").select("metric", "n", F.round("mean", 4).alias("mean"), "minimum", "maximum", "beyond")


_KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_LEVELS = [["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag", "l_linestatus"], ["l_linestatus"], []]
_SETS = ", ".join("(" + ", ".join(level) + ")" for level in _LEVELS)


@query(f"""WITH d AS (SELECT l_returnflag, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_linestatus END AS l_linestatus, l_linenumber, l_quantity, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_discount END AS l_discount FROM lineitem)
    """ + " UNION ALL ".join(f"""SELECT GROUPING_ID({', '.join(_KEYS)})::INT AS level, {', '.join(_KEYS)}, '{c}' AS metric, count(*) AS "rows", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
    round(min({c}), 6) AS minimum, round(avg({c}), 6) AS mean, round(max({c}), 6) AS maximum, round(stddev_samp({c}), 6) AS deviation FROM d GROUP BY GROUPING SETS ({_SETS})""" for c in ("l_quantity", "l_discount")))
def grouped_statistics(spark, sf):
    d = R.table(spark, sf, "lineitem").withColumns({"l_linestatus": F.when(~(F.col("l_tax") > 0.07), F.col("l_linestatus")), "l_discount": F.when(~(F.col("l_discount") < 0.02), F.col("l_discount"))})
    out = stats.by_levels(d, _KEYS, _LEVELS, ["l_quantity", "l_discount"])
    return out.withColumns({c: F.round(c, 6) for c in ("minimum", "mean", "maximum", "deviation")})


_OUTLIER = "l_extendedprice > 104000"


@query(f"""WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS slice, l_returnflag, l_linestatus, l_linenumber, {_OUTLIER} AS must FROM lineitem),
    h AS (SELECT *, concat('0x', substr(md5('2026/' || slice), 1, 15))::BIGINT AS h FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY h, slice) AS r FROM h WHERE NOT must)
    SELECT slice, l_returnflag, l_linestatus, l_linenumber, r::INT AS sample_rank, 'stratum' AS reason FROM r WHERE r <= 40
    UNION ALL SELECT slice, l_returnflag, l_linestatus, l_linenumber, NULL, 'always' FROM h WHERE must""")
def stratified_sample(spark, sf):
    rows = R.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slice"), "l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice")
    return stats.stratified_sample(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], "slice", 40, 2026, F.expr(_OUTLIER)).drop("l_extendedprice")


_PIXELS = """SELECT vec_id * 2 AS image_id, embedding::DOUBLE[] AS e FROM embeddings
    UNION ALL SELECT vec_id * 2 + 1, list_transform(range(1, 65), lambda i: 1.5 * embedding[i]::DOUBLE + 0.2 + ((vec_id * 31 + i * 17) % 13 - 6) / 60.0::DOUBLE) FROM embeddings"""


# Embeddings as images of 8 x 8 pixels, each also brighter, with more contrast and some noise.
@query(f"""WITH RECURSIVE i AS ({_PIXELS}), p AS (SELECT image_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS k FROM i),
    b AS (SELECT u, v, x * 8 + y AS k, cos(pi() * (2 * x + 1) * u / 16) * cos(pi() * (2 * y + 1) * v / 16) AS c FROM range(8) a(u), range(8) b(v), range(8) c(x), range(8) d(y)),
    f AS (SELECT image_id, u * 8 + v AS bit, sum(x * c) AS f FROM p JOIN b USING (k) GROUP BY 1, 2),
    m AS (SELECT image_id, median(f) AS m FROM f GROUP BY 1),
    h AS MATERIALIZED (SELECT image_id, sum(CASE WHEN f > m THEN 1::HUGEINT << bit ELSE 0 END)::UBIGINT AS h FROM f JOIN m USING (image_id) GROUP BY 1),
    l AS MATERIALIZED (SELECT a.image_id AS a, b.image_id AS b FROM h a JOIN h b ON a.image_id <> b.image_id AND bit_count(xor(a.h, b.h)) <= 8),
    r AS (SELECT image_id AS a, image_id AS b FROM h UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT image_id, printf('%016x', h) AS hash, (SELECT count(*) FROM l WHERE l.a = h.image_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = h.image_id) AS component FROM h""")
def perceptual_near_duplicates(spark, sf):
    from ..operators import perceptual

    e = R.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    noisy = F.transform("e", lambda x, i: 1.5 * x + 0.2 + ((F.col("vec_id") * 31 + (i + 1) * 17) % 13 - 6) / 60.0)
    images = e.select((F.col("vec_id") * 2).alias("image_id"), "e").unionByName(e.select((F.col("vec_id") * 2 + 1).alias("image_id"), noisy.alias("e")))
    hashed = images.select("image_id", perceptual.perceptual_hash("e", 8, 8).alias("hash"))
    return perceptual.near_duplicates(hashed, "image_id", "hash").withColumn("hash", F.lower(F.lpad(F.hex("hash"), 16, "0")))


@query("""WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, avg(x) AS mean FROM p GROUP BY 1),
    d AS (SELECT label, mean, count(*) AS n, sum((x - mean) ** 2) AS s2, sum((x - mean) ** 3) AS s3, sum((x - mean) ** 4) AS s4 FROM p JOIN m USING (label) GROUP BY 1, 2)
    SELECT label, n, round(mean, 8) + 0.0::DOUBLE AS mean, round(sqrt(s2 / n), 8) AS deviation, round(sqrt(n) * s3 / s2 ** 1.5, 6) + 0.0::DOUBLE AS skewness, round(n * s4 / s2 ** 2, 6) AS kurtosis FROM d""")
def series_moments(spark, sf):
    from ..operators import proxies

    e = R.table(spark, sf, "embeddings").select("label", proxies.image_moments("embedding").alias("m"))
    out = proxies.merged_moments(e, ["label"], "m")
    return out.withColumns({c: F.round(c, 8) + 0.0 for c in ("mean", "deviation")} | {c: F.round(c, 6) + 0.0 for c in ("skewness", "kurtosis")})


@query("""WITH w AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    c AS (SELECT label, vec_id, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM w)
    SELECT label, vec_id, round(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 8) + 0.0::DOUBLE AS likeness FROM c""")
def neighbour_likeness(spark, sf):
    from ..operators import proxies

    out = proxies.neighbour_likeness(R.table(spark, sf, "embeddings"), ["label"], [F.col("vec_id")], "embedding")
    return out.select("label", "vec_id", (F.round("likeness", 8) + 0.0).alias("likeness"))


@query()
def image_proxies(spark, sf):
    from ..operators import proxies

    return R.table(spark, sf, "embeddings").select("vec_id", proxies.image_proxies("embedding", 8, 8).alias("p")).select("vec_id", "p.*")
