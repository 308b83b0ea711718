"""Queries of pixel arrays, pooling, losses, metrics and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import losses, metrics, pixels, pooling, selection, split
from . import roles as R
from .catalog import query

_LONG = "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS place, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(f"""WITH v AS ({_LONG}), s AS (SELECT vec_id, quantile_cont(x, 0.01) AS lo, greatest(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), 1e-6) AS w FROM v GROUP BY 1)
    SELECT vec_id, place, round(least(greatest((x - lo) / w, 0.0), 1.0), 5) + 0.0::DOUBLE AS x FROM v JOIN s USING (vec_id)""")
def normalize_robust(spark, sf):
    return pixels.normalized(R.table(spark, sf, "embeddings"), ["vec_id"], "embedding", "per_slice_robust").withColumn("x", F.round("x", 5) + 0.0)


@query(f"""WITH v AS ({_LONG}), s AS (SELECT vec_id, avg(x) AS a, greatest(stddev_pop(x), 1e-6) AS b FROM v GROUP BY 1)
    SELECT vec_id, place, round(least(greatest((x - a) / b, -5.0), 5.0), 5) + 0.0::DOUBLE AS x FROM v JOIN s USING (vec_id)""")
def normalize_zscore(spark, sf):
    return pixels.normalized(R.table(spark, sf, "embeddings"), ["vec_id"], "embedding", "zscore").withColumn("x", F.round("x", 5) + 0.0)


@query("""SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE value / 1000 END, 6) AS position, CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE event_id % 2 END::DOUBLE AS fluid, (event_type = 'click')::INT::DOUBLE AS sagittal, (event_type = 'view')::INT::DOUBLE AS coronal FROM events""")
def window_metadata(spark, sf):
    e = R.table(spark, sf, "events")
    plane = F.when(F.col("event_type") == "click", "Sagittal").when(F.col("event_type") == "view", "Coronal")
    v = X.window_metadata(F.when(F.col("event_id") % 4 != 0, F.col("value") / 1000), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2), plane)
    at = lambda i: F.get("v", F.lit(i))
    return e.select("event_id", v.alias("v")).select("event_id", F.round(at(0), 6).alias("position"), at(1).alias("fluid"), at(2).alias("sagittal"), at(3).alias("coronal"))


@query(f"""SELECT vec_id, count(*)::INT AS pixel_count, round(min(x), 5) AS minimum, round(max(x), 5) AS maximum, round(avg(x), 5) + 0.0::DOUBLE AS mean, round(stddev_pop(x), 5) AS deviation,
    round(count(*) FILTER (x = 0) / count(*)::DOUBLE, 5) AS zero_fraction, 1.0::DOUBLE AS finite_fraction FROM ({_LONG}) GROUP BY 1""")
def pixel_stats(spark, sf):
    out = R.table(spark, sf, "embeddings").select("vec_id", *pixels.pixel_stats("embedding"))
    return out.select("vec_id", "pixel_count", *((F.round(c, 5) + 0.0).alias(c) for c in out.columns[2:]))


_DEEP = ", ".join(f"round(quantile_cont(x, {p / 100}), 5) + 0.0::DOUBLE AS p{str(p).replace('.', '_')}" for p in pixels.DEEP_PERCENTILES)


@query(f"""WITH v AS ({_LONG}), b AS (SELECT vec_id, median(x) AS m, min(x) AS lo, max(x) AS hi, count(*) AS n, {_DEEP} FROM v GROUP BY 1),
    a AS (SELECT vec_id, median(abs(x - m)) AS mad FROM v JOIN b USING (vec_id) GROUP BY 1),
    q AS (SELECT vec_id, least(floor((x - lo) / (hi - lo) * 128), 127) AS bin, count(*) / any_value(n)::DOUBLE AS q FROM v JOIN b USING (vec_id) GROUP BY 1, 2),
    e AS (SELECT vec_id, -sum(q * log2(q)) AS entropy FROM q GROUP BY 1)
    SELECT b.* EXCLUDE (m, lo, hi, n), round(mad, 5) AS mad, round(entropy, 5) AS entropy FROM b JOIN a USING (vec_id) JOIN e USING (vec_id)""")
def deep_pixel_stats(spark, sf):
    out = pixels.deep_stats(R.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", *((F.round(c, 5) + 0.0).alias(c) for c in out.columns[1:]))


@query(f"SELECT vec_id, place, round(CASE WHEN vec_id % 2 = 0 THEN x * 2 - 1 ELSE x END, 5) + 0.0::DOUBLE AS x FROM ({_LONG})")
def rescale(spark, sf):
    even = F.col("vec_id") % 2 == 0
    v = X.rescaled("embedding", F.when(even, F.lit("2")).otherwise("bad"), F.when(even, F.lit(-1.0)))
    return R.table(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("place", "x")).withColumn("x", F.round("x", 5) + 0.0)


@query(f"SELECT vec_id, place, round((x - 0.1) / CASE WHEN place % 2 = 0 THEN 0.5 ELSE 1e-6 END, 3) + 0.0::DOUBLE AS x FROM ({_LONG})")
def standardize_channels(spark, sf):
    v = X.standardized(F.transform("embedding", lambda x: x.cast("double")), [0.1] * 64, [0.5, 0.0] * 32)
    return R.table(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("place", "x")).withColumn("x", F.round("x", 3) + 0.0)


# Half of each side, with pixel centers at halves: every pixel is the mean of four.
@query(f"SELECT vec_id, (place // 16 * 4 + place % 8 // 2)::INT AS place, round(avg(x), 5) + 0.0::DOUBLE AS x FROM ({_LONG}) GROUP BY 1, 2")
def resize_images(spark, sf):
    out = pixels.resized(R.table(spark, sf, "embeddings"), "embedding", 8, 8, 4, 4).select("vec_id", F.posexplode("resized").alias("place", "x"))
    return out.withColumn("x", F.round("x", 5) + 0.0)


_FEATURES = "SELECT label AS study, vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(f"SELECT study, dim, round(coalesce(avg(CASE WHEN ok THEN x END), 0), 5) + 0.0::DOUBLE AS mean, round(coalesce(max(CASE WHEN ok THEN x END), 0), 5) + 0.0::DOUBLE AS maximum FROM (SELECT f.*, e.embedding[1] > 0 AS ok FROM ({_FEATURES}) f JOIN embeddings e USING (vec_id)) GROUP BY 1, 2")
def pool_mean_max(spark, sf):
    out = pooling.mean_max(R.windows(spark, sf), "study", "features", F.get("features", F.lit(0)) > 0)
    return out.select("study", "dim", (F.round("mean", 5) + 0.0).alias("mean"), (F.round("maximum", 5) + 0.0).alias("maximum"))


_QUERY = [round(((i * 37) % 11 - 5) / 2.0, 2) for i in range(64)]


def _attend(queries: str, keys: str) -> str:
    return f"""q AS ({queries}), v AS (SELECT label AS study, vec_id, embedding::DOUBLE[] AS f FROM embeddings), z AS (SELECT study, vec_id, f, {keys} list_inner_product(f, query) AS z FROM v, q),
    m AS (SELECT study, {keys} max(z) AS m FROM z GROUP BY ALL), e AS (SELECT z.study, {keys.replace('label_id', 'z.label_id')} f, exp(z - m) AS e FROM z JOIN m ON m.study = z.study {'AND m.label_id = z.label_id' if keys else ''}),
    x AS (SELECT study, {keys} e, (generate_subscripts(f, 1) - 1)::INT AS dim, unnest(f) AS x FROM e)
    SELECT study, {keys.replace('label_id', 'label_id AS label')} dim, round(sum(e * x) / sum(e), 5) + 0.0::DOUBLE AS pooled FROM x GROUP BY ALL"""


@query("WITH " + _attend(f"SELECT {_QUERY}::DOUBLE[] AS query", ""))
def pool_attention(spark, sf):
    return pooling.attention(R.windows(spark, sf), "study", "features", _QUERY).withColumn("pooled", F.round("pooled", 5) + 0.0)


def _label_queries():
    return [(f"L{k}", [_QUERY[(i + 5 * k) % 64] for i in range(64)]) for k in range(3)]


@query("WITH " + _attend(" UNION ALL ".join(f"SELECT '{k}' AS label_id, {v}::DOUBLE[] AS query" for k, v in _label_queries()), "label_id, "))
def pool_label_query(spark, sf):
    return pooling.label_attention(R.windows(spark, sf), "study", "features", dict(_label_queries())).withColumn("pooled", F.round("pooled", 5) + 0.0)


@query(f"""WITH p AS (SELECT study, dim, avg(x) AS m FROM ({_FEATURES}) GROUP BY 1, 2) SELECT study, 'o' || o AS output, round(sum(m * (dim - 30.0 + o) / 10.0) + o, 4) + 0.0::DOUBLE AS logit FROM p, range(2) r(o) GROUP BY study, o""")
def linear_head(spark, sf):
    pooled = pooling.mean_max(R.windows(spark, sf), "study", "features")
    weights = spark.createDataFrame([(d, f"o{o}", (d - 30.0 + o) / 10.0, float(o)) for d in range(64) for o in range(2)], "dim int, output string, w double, bias double")
    return pooling.linear(pooled, ["study"], "mean", weights).withColumn("logit", F.round("logit", 4) + 0.0)


_CELLS = "SELECT vec_id, label AS batch, (generate_subscripts(embedding[1:12], 1) - 1)::INT AS label, unnest(embedding[1:12])::DOUBLE * 8 AS z FROM embeddings"
_TARGET = "CASE WHEN (vec_id + label) % 5 = 0 THEN NULL ELSE ((vec_id * 7 + label) % 2)::DOUBLE END"


def _cells(spark, sf):
    long = R.windows(spark, sf).select(F.col("window").alias("vec_id"), F.col("study").alias("batch"), F.posexplode("scores").alias("label", "s"))
    target = F.when((F.col("vec_id") + F.col("label")) % 5 != 0, ((F.col("vec_id") * 7 + F.col("label")) % 2).cast("double"))
    return long.select("vec_id", "batch", "label", (F.col("s") * 8).alias("z"), target.alias("y"))


_SOFTPLUS = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"


@query(f"""WITH c AS (SELECT z, {_TARGET} AS y FROM ({_CELLS})) SELECT round(avg(3 * y * {_SOFTPLUS.format('(-z)')} + (1 - y) * {_SOFTPLUS.format('z')}), 6) AS loss, count(y) AS cells FROM c WHERE y IS NOT NULL""")
def loss_bce(spark, sf):
    return losses.masked_bce(_cells(spark, sf), "z", "y", 3.0).withColumn("loss", F.round("loss", 6))


# Pairs are those of a training batch: 32 windows, at any size of the table.
@query(f"""WITH c AS (SELECT vec_id // 32 AS batch, label, z, {_TARGET} AS y FROM ({_CELLS})) SELECT p.label, p.batch, round(avg({_SOFTPLUS.format('(n.z - p.z)')}), 6) AS loss, count(*) AS pairs
    FROM c p JOIN c n ON p.label = n.label AND p.batch = n.batch AND p.y = 1 AND n.y = 0 GROUP BY 1, 2""")
def loss_rank(spark, sf):
    cells = _cells(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 32))
    return losses.pairwise_ranking(cells, "label", "z", "y", "batch").withColumn("loss", F.round("loss", 6))


_COVER = f"""s AS (SELECT batch AS study, vec_id AS "window", label, z / 8 AS score, CASE WHEN label % 4 = 3 THEN NULL ELSE abs(z) / 8 END AS evidence FROM ({_CELLS})),
    u AS (SELECT study, "window", max(score) AS u FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY u DESC, "window") AS r, least(count(*) OVER (PARTITION BY study), 15) AS k FROM u),
    g AS (SELECT r.study, r."window", 1 / (1 + exp(-(r.u - t.u) / 0.2)) AS g FROM r JOIN r t ON t.study = r.study AND t.r = t.k),
    c AS (SELECT study, label, 1 - exp(sum(ln(1 - least(greatest(g * coalesce(least(greatest(evidence, 0), 1), 0), 0), 1 - 1e-6)))) AS coverage, count(evidence) AS known FROM s JOIN g USING (study, "window") GROUP BY 1, 2)"""


def _coverage(spark, sf):
    s = _cells(spark, sf).select(F.col("batch").alias("study"), F.col("vec_id").alias("window"), "label", (F.col("z") / 8).alias("score"), F.when(F.col("label") % 4 != 3, F.abs("z") / 8).alias("evidence"))
    positive = s.select("study", "label", ((F.col("study") + F.col("label")) % 2).cast("double").alias("value")).distinct()
    return losses.coverage_loss(s, positive, 15)


@query(f"WITH {_COVER} SELECT study, label, round(coverage, 6) AS coverage, round(-ln(greatest(coverage, 1e-6)), 6) AS loss FROM c WHERE known > 0 AND (study + label) % 2 = 1")
def loss_coverage(spark, sf):
    return _coverage(spark, sf).withColumns({"coverage": F.round("coverage", 6), "loss": F.round("loss", 6)})


@query(f"""WITH {_COVER}, x AS (SELECT vec_id, batch, label, z, {_TARGET} AS y FROM ({_CELLS})),
    b AS (SELECT avg(y * {_SOFTPLUS.format('(-z)')} + (1 - y) * {_SOFTPLUS.format('z')}) AS bce FROM x WHERE y IS NOT NULL),
    k AS (SELECT avg(l) AS ranking FROM (SELECT avg({_SOFTPLUS.format('(n.z - p.z)')}) AS l FROM x p JOIN x n ON p.label = n.label AND p.vec_id // 32 = n.vec_id // 32 AND p.y = 1 AND n.y = 0 GROUP BY p.label, p.vec_id // 32)),
    v AS (SELECT avg(-ln(greatest(coverage, 1e-6))) AS coverage FROM c WHERE known > 0 AND (study + label) % 2 = 1)
    SELECT round(bce, 6) AS bce, round(ranking, 6) AS ranking, round(v.coverage, 6) AS coverage, round(bce + 0.1 * ranking + 0.1 * v.coverage, 6) AS total FROM b, k, v""")
def loss_composite(spark, sf):
    cells = _cells(spark, sf)
    out = losses.composite(losses.masked_bce(cells, "z", "y"), losses.pairwise_ranking(cells.withColumn("batch", F.floor(F.col("vec_id") / 32)), "label", "z", "y", "batch"), _coverage(spark, sf))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def _auc_sql(source: str) -> str:
    return f"""x AS ({source}), r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0::DOUBLE AS r FROM x),
    a AS (SELECT label, count(*) AS n, count(*) FILTER (y = 1) AS positives, sum(CASE WHEN y = 1 THEN r END) AS s FROM r GROUP BY 1),
    auc AS (SELECT label, n, positives, CASE WHEN positives > 0 AND n > positives THEN (s - positives * (positives + 1) / 2.0::DOUBLE) / (positives::DOUBLE * (n - positives)) END AS auc FROM a)"""


_SCORED = f"SELECT 'quality' AS label, n_chars AS score, quality AS y FROM ({R.LABELLED}) WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', n_chars, toxic FROM ({R.LABELLED}) WHERE toxic IS NOT NULL"


def _scored(spark, sf):
    from ..operators.labels import long_labels

    return long_labels(R.labelled(spark, sf), ["study_uid", "n_chars"], R.LABEL_NAMES)


@query(f"WITH {_auc_sql(_SCORED)} SELECT label, n::BIGINT AS n, positives, round(auc, 6) AS auc FROM auc")
def auc_per_label(spark, sf):
    return metrics.auc(_scored(spark, sf), "label", "n_chars", "value").withColumn("auc", F.round("auc", 6))


@query(f"WITH {_auc_sql(_SCORED)} SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS valid_labels FROM auc")
def auc_macro(spark, sf):
    return metrics.macro_auc(metrics.auc(_scored(spark, sf), "label", "n_chars", "value")).withColumn("macro_auc", F.round("macro_auc", 6))


_TWICE = f"SELECT label::VARCHAR AS label, round(z, 4) AS score, {_TARGET} AS y FROM ({_CELLS}) WHERE {_TARGET} IS NOT NULL"


@query(f"WITH {_auc_sql(_TWICE)} SELECT label, n::BIGINT AS n, positives, round(auc, 5) AS auc FROM auc")
def evaluate_predictions(spark, sf):
    cells = _cells(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"), F.round("z", 4).alias("z"), "y")
    gathered = cells.withColumn("idx", F.lit(0)).unionByName(cells.withColumns({"idx": F.lit(1), "z": F.lit(99.0)}))
    return metrics.evaluate(gathered, "vec_id", "idx", "label", "z", "y").withColumn("auc", F.round("auc", 5))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def dedup_first(spark, sf):
    e = R.table(spark, sf, "events").withColumn("order", F.struct("ts", "event_id"))
    return metrics.first_prediction(e, "user_id", "order").select("user_id", "event_id")


@query("SELECT a AS selector, b AS k, c AS aggregator, (row_number() OVER (ORDER BY i, j, l) - 1)::INT AS run FROM (VALUES (0, 'uniform'), (1, 'learned')) x(i, a), (VALUES (0, 6), (1, 9), (2, 15)) y(j, b), (VALUES (0, 'mean'), (1, 'attention')) z(l, c)")
def sweep_matrix(spark, sf):
    from ..sweep import sweep_frame

    return sweep_frame(spark, {"selector": ["uniform", "learned"], "k": [6, 9, 15], "aggregator": ["mean", "attention"]})


@query("SELECT i::INT AS step, round(CASE WHEN i < 10 THEN (i + 1) / 10.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1, (i - 10) / 90.0::DOUBLE))) END, 6) AS factor, i % 4 = 0 OR i = 99 AS applies FROM range(100) r(i)")
def learning_schedule(spark, sf):
    return spark.range(100).select(F.col("id").cast("int").alias("step"), F.round(X.learning_rate("id", 10, 100), 6).alias("factor"), X.is_update_step("id", 4, F.lit(99)).alias("applies"))


@query("SELECT event_id, round(value, 6) AS value FROM events ORDER BY round(value, 6) DESC, event_id LIMIT 1")
def best_epoch(spark, sf):
    e = R.table(spark, sf, "events").select("event_id", F.round("value", 6).alias("value"))
    return selection.best_epoch(e, "value", "event_id")


@query("SELECT doc_id, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def label_vectors(spark, sf):
    rows = R.labelled(spark, sf).select("doc_id", X.label_vector(F.when(F.col("quality").isNotNull(), F.array("quality", "toxic")), 2).alias("v"))
    return rows.select("doc_id", F.get("v", F.lit(0)).alias("quality"), F.get("v", F.lit(1)).alias("toxic"))


@query("""SELECT source AS "group", dim AS label, max(v)::DOUBLE AS value, sum(v)::DOUBLE AS total FROM (SELECT source, 0 AS dim, coalesce(quality, 0) AS v FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT source, 1, coalesce(toxic, 0) FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2""")
def group_label_vectors(spark, sf):
    rows = R.labelled(spark, sf).select(F.col("study_uid").alias("study_id"), "source", F.when(F.col("quality").isNotNull(), F.array("quality", "toxic")).alias("labels"))
    out = split.group_labels(rows, rows.select("study_id", F.col("source").alias("group")), 2)
    return out.select("group", F.posexplode(F.arrays_zip("labels", "totals")).alias("label", "z")).select("group", "label", F.col("z.labels").alias("value"), F.col("z.totals").alias("total"))
