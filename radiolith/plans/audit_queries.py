"""Queries of the audit: files, headers, series, labels, coverage, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import duplicates, labels, series, stats
from . import roles as R
from .catalog import query

_SHARD = "(concat('0x', substr(md5({0}), 1, 8))::BIGINT % {1})::INT"
_FRACTION = "concat('0x', substr(md5({0}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query(f"""SELECT {_SHARD.format('url', 16)} AS shard, count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1""")
def file_index_shards(spark, sf):
    pages = R.table(spark, sf, "pages").select(X.stable_shard("url", 16).alias("shard"), F.octet_length("html").alias("size"))
    return pages.groupBy("shard").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"""SELECT page_id, {_SHARD.format('url', 16)} AS shard FROM pages WHERE {_SHARD.format('url', 16)} IN (0, 3, 5, 6, 7)""")
def shard_prune(spark, sf):
    from ..operators.files import parse_shards

    pages = R.table(spark, sf, "pages").select("page_id", X.stable_shard("url", 16).alias("shard"))
    return pages.where(F.col("shard").isin(parse_shards("0,3,5-7", 16)))


@query(f"""SELECT doc_id, round({_FRACTION.format('doc_id::VARCHAR')}, 6) AS fraction FROM documents WHERE {_FRACTION.format('doc_id::VARCHAR')} < 0.1""")
def stable_sample(spark, sf):
    docs = R.table(spark, sf, "documents").select("doc_id", X.stable_fraction(F.col("doc_id").cast("string")).alias("fraction"))
    return docs.where("fraction < 0.1").select("doc_id", F.round("fraction", 6).alias("fraction"))


@query()
def blake2b_shard(spark, sf):
    return R.table(spark, sf, "pages").select("page_id", X.blake2b_shard("url", 16).alias("shard"), F.round(X.blake2b_fraction("url"), 6).alias("fraction"))


@query("""WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS a FROM pages)
    SELECT DISTINCT nullif(a[1], '') AS study, nullif(a[2], '') AS series FROM p""")
def path_parts(spark, sf):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return R.table(spark, sf, "pages").select(X.path_part(path, 0).alias("study"), X.path_part(path, 1).alias("series")).distinct()


@query(f"""WITH h AS (SELECT s.relative_path, CASE WHEN l_tax > 0.06 THEN NULL WHEN l_tax > 0.04 THEN '' ELSE 'S' || o_custkey END AS hdr, l_linestatus AS st, l_orderkey
        FROM (SELECT x.*, x.status AS l_linestatus FROM ({R.LINES}) x) s JOIN orders ON o_orderkey = l_orderkey)
    SELECT coalesce(nullif(hdr, ''), nullif(split_part(relative_path, '/', 1), ''), '') AS study_uid, count(*) AS n FROM h GROUP BY 1""")
def uid_fallback(spark, sf):
    orders = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    header = F.when(F.col("l_tax") > 0.06, None).when(F.col("l_tax") > 0.04, "").otherwise(F.concat(F.lit("S"), F.col("o_custkey")))
    rows = R.lines(spark, sf).join(orders, "l_orderkey").select("relative_path", header.alias("StudyInstanceUID"), F.lit(None).cast("string").alias("SeriesInstanceUID"))
    return series.with_identity(rows).groupBy("study_uid").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    c AS (SELECT vec_id, e, e[2]*e[6]-e[3]*e[5] AS cx, e[3]*e[4]-e[1]*e[6] AS cy, e[1]*e[5]-e[2]*e[4] AS cz FROM v),
    n AS (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) AS s FROM c),
    u AS (SELECT vec_id, e, cx/s AS x, cy/s AS y, cz/s AS z, s FROM n)
    SELECT vec_id, CASE WHEN s <= 1e-8 THEN 'Unknown' WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'Sagittal' WHEN abs(y) >= abs(z) THEN 'Coronal' ELSE 'Axial' END AS plane,
        round(x*e[7]+y*e[8]+z*e[9], 6) AS position_scalar FROM u""")
def plane_from_orientation(spark, sf):
    e = R.table(spark, sf, "embeddings")
    g = X.slice_geometry(F.slice("embedding", 1, 6), F.slice("embedding", 7, 3))
    return e.select("vec_id", g.alias("g")).select("vec_id", "g.plane", F.round("g.position", 6).alias("position_scalar"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE sha256('salt' || chr(0) || c_name) END AS patient_hash FROM customer""")
def patient_hash(spark, sf):
    name = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name"))
    return R.table(spark, sf, "customer").select("c_custkey", X.identity_hash(name, "salt").alias("patient_hash"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::DOUBLE END AS k FROM events""")
def finite_cast(spark, sf):
    text = F.get_json_object("props", "$.k")
    dirty = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 7 == 0, "many").otherwise(text)
    return R.table(spark, sf, "events").select("event_id", X.finite(dirty).alias("k"))


_MAKER = "CASE s_suppkey % 6 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'Philips Healthcare' WHEN 2 THEN 'GE MEDICAL SYSTEMS' WHEN 3 THEN 'TOSHIBA_MEC' WHEN 4 THEN '' ELSE s_name END"


@query(f"""WITH s AS (SELECT s_suppkey, {_MAKER} AS maker FROM supplier)
    SELECT s_suppkey, CASE WHEN maker = '' THEN 'Unknown' WHEN contains(lower(maker), 'siemens') THEN 'Siemens' WHEN contains(lower(maker), 'philips') THEN 'Philips'
        WHEN contains(lower(maker), 'ge medical') THEN 'GE' WHEN contains(lower(maker), 'toshiba') THEN 'Canon/Toshiba' ELSE maker END AS family FROM s""")
def vendor_family(spark, sf):
    return R.table(spark, sf, "supplier").select("s_suppkey", X.vendor_family(F.expr(_MAKER)).alias("family"))


@query(f"""SELECT lang || '/fluid=' || coalesce(quality::VARCHAR, 'Unknown') AS bucket, count(*) AS n FROM ({R.LABELLED}) GROUP BY 1""")
def bucket_default(spark, sf):
    return labels.buckets(R.labelled(spark, sf), "lang", "quality")


@query(f"SELECT status, derived_plane, count(*) AS n FROM ({R.LINES}) GROUP BY 1, 2")
def status_counts(spark, sf):
    return R.lines(spark, sf).groupBy("status", "derived_plane").agg(F.count("*").alias("n"))


@query("""SELECT 'l_linestatus' AS field, l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2""")
def multi_frequency(spark, sf):
    return stats.frequencies(R.table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag", "l_linenumber"])


_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count({c}) AS n, round(min({c}), 4) AS minimum, round(avg({c}), 4) AS mean, round(max({c}), 4) AS maximum, round(stddev_samp({c}), 4) AS deviation, "
        + ", ".join(f"round(quantile_cont({c}, {p / 100}), 4) AS p{p}" for p in stats.PERCENTILES)
        + " FROM lineitem"
        for c in _METRICS
    )
)
def numeric_summary(spark, sf):
    out = stats.numeric_summary(R.table(spark, sf, "lineitem"), _METRICS)
    return out.select("metric", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


_SERIES_SQL = f"""s AS ({R.SLICES}),
    modes AS (SELECT study_uid, series_uid, arg_min(v, (-n, f)) AS plane_mode FROM (SELECT study_uid, series_uid, derived_plane AS v, count(*) AS n, min(relative_path) AS f FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
    vendors AS (SELECT study_uid, series_uid, arg_min(v, (-n, f)) AS vendor_mode FROM (SELECT study_uid, series_uid, manufacturer AS v, count(*) AS n, min(relative_path) AS f FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
    gaps AS (SELECT study_uid, series_uid, position_scalar - lag(position_scalar) OVER (PARTITION BY study_uid, series_uid ORDER BY position_scalar) AS gap FROM s),
    spacing AS (SELECT study_uid, series_uid, quantile_cont(gap, 0.5) AS spacing_median, CASE WHEN avg(gap) > 1e-8 THEN stddev_pop(gap) / avg(gap) END AS spacing_cv FROM gaps GROUP BY 1, 2),
    ranks AS (SELECT study_uid, series_uid, rank() OVER (PARTITION BY study_uid, series_uid ORDER BY position_scalar) + (count(*) OVER (PARTITION BY study_uid, series_uid, position_scalar) - 1) / 2.0::DOUBLE AS p,
        rank() OVER (PARTITION BY study_uid, series_uid ORDER BY instance_number) + (count(*) OVER (PARTITION BY study_uid, series_uid, instance_number) - 1) / 2.0::DOUBLE AS i FROM s),
    agree AS (SELECT study_uid, series_uid, CASE WHEN count(*) >= 2 AND stddev_pop(p) * stddev_pop(i) <> 0 THEN covar_pop(p, i) / (stddev_pop(p) * stddev_pop(i)) END AS order_spearman, count(*) AS order_pairs FROM ranks GROUP BY 1, 2),
    base AS (SELECT study_uid, series_uid, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_bytes, count(*) FILTER (status <> 'ok') AS error_count, count(position_scalar) AS position_count,
        count(position_scalar) - count(DISTINCT position_scalar) AS duplicate_positions, count(DISTINCT rows_) AS distinct_rows, count(DISTINCT columns_) AS distinct_columns, min(patient_hash) AS patient_hash FROM s GROUP BY 1, 2),
    inventory AS (SELECT * FROM base JOIN modes USING (study_uid, series_uid) JOIN vendors USING (study_uid, series_uid) JOIN spacing USING (study_uid, series_uid) JOIN agree USING (study_uid, series_uid)
        LEFT JOIN ({R.SERIES_METADATA}) USING (series_uid))"""


@query(f"""WITH {_SERIES_SQL} SELECT study_uid, series_uid, file_count, total_bytes, error_count, position_count, duplicate_positions, distinct_rows, distinct_columns, patient_hash, plane_mode, vendor_mode,
    round(spacing_median, 6) AS spacing_median, round(spacing_cv, 6) AS spacing_cv, round(order_spearman, 6) + 0.0::DOUBLE AS order_spearman, order_pairs, metadata_plane, fluid_sensitive FROM inventory""")
def series_inventory(spark, sf):
    out = series.series_inventory(R.slices(spark, sf), R.series_metadata(spark, sf))
    rounded = {c: F.round(c, 6) + 0.0 for c in ("spacing_median", "spacing_cv", "order_spearman")}
    return out.withColumns(rounded)


@query(f"SELECT study_uid, count(DISTINCT series_uid) AS series_count, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_bytes FROM ({R.SLICES}) GROUP BY 1")
def study_inventory(spark, sf):
    return series.study_inventory(R.slices(spark, sf))


@query(f"""WITH {_SERIES_SQL} SELECT * FROM (SELECT study_uid, series_uid, plane_mode, metadata_plane, duplicate_positions, round(order_spearman, 6) + 0.0::DOUBLE AS order_spearman, concat_ws(';', CASE WHEN metadata_plane <> plane_mode THEN 'plane_conflict' END,
    CASE WHEN duplicate_positions > 0 THEN 'duplicate_position' END, CASE WHEN order_pairs >= 3 AND abs(round(order_spearman, 9)) < 0.9 THEN 'order_disagreement' END) AS issues FROM inventory) WHERE issues <> ''""")
def geometry_issues(spark, sf):
    found = series.geometry_issues(series.series_inventory(R.slices(spark, sf), R.series_metadata(spark, sf)))
    return found.select("study_uid", "series_uid", "plane_mode", "metadata_plane", "duplicate_positions", (F.round("order_spearman", 6) + 0.0).alias("order_spearman"), "issues")


@query(f"""WITH s AS ({R.SLICES}) SELECT study_uid, series_uid, arg_min(v, (-n, f)) AS plane FROM (SELECT study_uid, series_uid, derived_plane AS v, count(*) AS n, min(relative_path) AS f FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def mode_first_seen(spark, sf):
    return stats.first_mode(R.slices(spark, sf), series.KEY, "derived_plane", series.encounter_order(), "plane")


@query(f"""WITH s AS ({R.SLICES}), m AS (SELECT study_uid, arg_min(v, (-n, f)) AS vendor FROM (SELECT study_uid, manufacturer AS v, count(*) AS n, min(relative_path) AS f FROM s GROUP BY 1, 2) GROUP BY 1)
    SELECT c_custkey::VARCHAR AS study_uid, coalesce(vendor, 'Unknown') AS family FROM customer LEFT JOIN m ON study_uid = c_custkey::VARCHAR""")
def study_vendor_mode(spark, sf):
    mode = stats.first_mode(R.slices(spark, sf), ["study_uid"], "manufacturer", series.encounter_order(), "vendor")
    studies = R.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("study_uid"))
    return studies.join(mode, "study_uid", "left").select("study_uid", X.vendor_family("vendor").alias("family"))


@query(f"""SELECT 'header' AS stage, relative_path, 'Unreadable' AS error_type, derived_plane AS error_message FROM ({R.LINES}) WHERE status <> 'ok'
    UNION ALL SELECT 'pixel', event_id::VARCHAR, event_type, left(props, 1000) FROM events WHERE event_type = 'error' OR value > 90""")
def quarantine_union(spark, sf):
    headers = R.lines(spark, sf).select("relative_path", "status", F.lit("Unreadable").alias("error_type"), F.col("derived_plane").alias("error_message"))
    status = F.when((F.col("event_type") == "error") | (F.col("value") > 90), "error").otherwise("ok")
    pixels = R.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("relative_path"), status.alias("status"), F.col("event_type").alias("error_type"), F.col("props").alias("error_message"))
    return series.quarantine(headers, pixels)


@query(f"SELECT relative_path, series_uid FROM ({R.LINES}) WHERE status = 'ok'")
def without_quarantined(spark, sf):
    records = R.lines(spark, sf)
    bad = series.failures(records.withColumns({"error_type": F.lit("x"), "error_message": F.lit("x")}), "header")
    return series.without_quarantined(records, bad).select("relative_path", "series_uid")


@query(" UNION ALL ".join(f"SELECT '{c}' AS label, count(*) FILTER ({c} = 1) AS positive, count(*) FILTER ({c} = 0) AS negative, count(*) FILTER ({c} IS NULL) AS missing, round(avg({c}), 6) AS prevalence FROM ({R.LABELLED})" for c in R.LABEL_NAMES))
def label_inventory(spark, sf):
    return labels.label_inventory(R.labelled(spark, sf), R.LABEL_NAMES).withColumn("prevalence", F.round("prevalence", 6))


@query()
def label_bootstrap_ci(spark, sf):
    return labels.prevalence_intervals(R.table(spark, sf, "labels"), R.LABEL_NAMES)


_PAIRS = [(a, b) for a in R.LABEL_NAMES for b in R.LABEL_NAMES]


@query(" UNION ALL ".join(f"SELECT '{a}' AS label_a, '{b}' AS label_b, round(CASE WHEN stddev_pop({a}) * stddev_pop({b}) <> 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 6) AS correlation FROM labels WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS))
def label_correlation(spark, sf):
    return labels.correlations(R.table(spark, sf, "labels"), R.LABEL_NAMES).withColumn("correlation", F.round("correlation", 6))


@query(" UNION ALL ".join(f"SELECT '{a}' AS label_a, '{b}' AS label_b, count(*) FILTER ({a} = 1 AND {b} = 1) AS together FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL" for a, b in _PAIRS))
def label_cooccurrence(spark, sf):
    return labels.co_occurrence(R.table(spark, sf, "labels"), R.LABEL_NAMES).select("label_a", "label_b", "together")


@query(" UNION ALL ".join(f"SELECT '{a}' AS label_a, '{b}' AS label_b, round(coalesce(count(*) FILTER ({a} = 1 AND {b} = 1) / nullif(count(*) FILTER ({a} = 1 OR {b} = 1), 0)::DOUBLE, 0.0::DOUBLE), 6) AS jaccard FROM labels" for a, b in _PAIRS))
def label_jaccard(spark, sf):
    return labels.co_occurrence(R.table(spark, sf, "labels"), R.LABEL_NAMES).select("label_a", "label_b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT 'quality' AS label_a, count(*) FILTER (quality = 1) AS quality, count(*) FILTER (quality = 1 AND toxic = 1) AS toxic FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (quality = 1 AND toxic = 1), count(*) FILTER (toxic = 1) FROM labels")
def label_matrix(spark, sf):
    return labels.as_matrix(labels.co_occurrence(R.table(spark, sf, "labels"), R.LABEL_NAMES), R.LABEL_NAMES, "together")


@query(" UNION ALL ".join(f"SELECT '{c}' AS label, source AS family, count(*) AS n, count(*) FILTER ({c} = 1) AS positive, round(avg({c}), 6) AS prevalence FROM ({R.LABELLED}) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY source" for c in R.LABEL_NAMES))
def label_domain(spark, sf):
    return labels.label_domains(R.labelled(spark, sf), R.LABEL_NAMES, "source").withColumn("prevalence", F.round("prevalence", 6))


@query("SELECT ((quality = 1)::INT + (toxic = 1)::INT)::INT AS positives, count(*) AS n FROM labels GROUP BY 1")
def positive_histogram(spark, sf):
    return labels.positives_histogram(R.table(spark, sf, "labels"), R.LABEL_NAMES)


_COVERAGE_SQL = f"t AS (SELECT study_uid, quality IS NOT NULL AND toxic IS NOT NULL AS gold FROM ({R.LABELLED})), d AS (SELECT DISTINCT study_uid FROM ({R.ON_DISK}))"


@query(f"""WITH {_COVERAGE_SQL}, j AS (SELECT t.study_uid IS NOT NULL AS known, coalesce(t.gold, false) AS gold, d.study_uid IS NOT NULL AS disk FROM t FULL JOIN d ON t.study_uid = d.study_uid)
    SELECT count(*) FILTER (known) AS studies, count(*) FILTER (gold) AS gold, count(*) FILTER (disk) AS on_disk, count(*) FILTER (known AND disk) AS covered, count(*) FILTER (gold AND disk) AS gold_covered,
    count(*) FILTER (gold AND NOT disk) AS gold_missing, count(*) FILTER (disk AND NOT known) AS unrecognized, round(count(*) FILTER (known AND disk) / count(*) FILTER (known)::DOUBLE, 6) AS study_share,
    round(count(*) FILTER (gold AND disk) / count(*) FILTER (gold)::DOUBLE, 6) AS gold_share FROM j""")
def coverage_summary(spark, sf):
    out = labels.coverage(R.labelled(spark, sf), R.on_disk(spark, sf), labels.gold_numeric(R.LABEL_NAMES))
    return out.withColumns({c: F.round(c, 6) for c in ("study_share", "gold_share")})


@query(f"WITH {_COVERAGE_SQL} SELECT study_uid FROM t WHERE gold AND study_uid NOT IN (SELECT study_uid FROM d)")
def missing_gold(spark, sf):
    return labels.missing_gold(R.labelled(spark, sf), R.on_disk(spark, sf), labels.gold_raw(R.LABEL_NAMES))


@query(f"WITH {_COVERAGE_SQL} SELECT study_uid FROM t INTERSECT SELECT study_uid FROM d")
def recognized_intersect(spark, sf):
    return labels.recognized(R.labelled(spark, sf), R.on_disk(spark, sf))


@query(f"WITH {_COVERAGE_SQL} SELECT study_uid FROM d EXCEPT SELECT study_uid FROM t")
def unrecognized_except(spark, sf):
    return labels.unrecognized(R.labelled(spark, sf), R.on_disk(spark, sf))


@query(f"WITH {_COVERAGE_SQL} SELECT lang || '/fluid=' || coalesce(quality::VARCHAR, 'Unknown') AS bucket, count(*) AS n FROM ({R.LABELLED}) WHERE study_uid IN (SELECT study_uid FROM d) GROUP BY 1")
def buckets_on_disk(spark, sf):
    return labels.buckets(labels.of_studies_on_disk(R.labelled(spark, sf), R.on_disk(spark, sf)), "lang", "quality")


_SAME_TEXT = "SELECT sha256(text) AS key, count(*) AS size, min(lpad(doc_id::VARCHAR, 12, '0')) AS first_member FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def _texts(spark, sf):
    return R.table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("m"))


@query(f"SELECT 'pixel' AS level, * FROM ({_SAME_TEXT})")
def duplicate_groups(spark, sf):
    return duplicates.duplicate_groups(_texts(spark, sf), "key", "m", "pixel")


@query(f"""WITH g AS ({_SAME_TEXT}), m AS (SELECT sha256(text) AS key, lpad(doc_id::VARCHAR, 12, '0') AS member FROM documents)
    SELECT 'pixel' AS level, key, member, member = first_member AS stands FROM m JOIN g USING (key)""")
def duplicate_members(spark, sf):
    return duplicates.duplicate_members(_texts(spark, sf), "key", "m", "pixel")


@query("""WITH g AS (SELECT sha256(text) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1), h AS (SELECT md5(html) AS k, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1),
    c AS (SELECT role || md5(text) AS k, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1)
    SELECT * FROM (SELECT 'sop' AS level, count(*) AS groups, sum(n)::BIGINT AS members FROM g UNION ALL SELECT 'pixel', count(*), sum(n)::BIGINT FROM h UNION ALL SELECT 'series_signature', count(*), sum(n)::BIGINT FROM c) WHERE groups > 0""")
def duplicate_levels(spark, sf):
    a = duplicates.duplicate_groups(R.table(spark, sf, "documents").select(F.sha2("text", 256).alias("k"), F.col("doc_id").cast("string").alias("m")), "k", "m", "sop")
    b = duplicates.duplicate_groups(R.table(spark, sf, "pages").select(F.md5("html").alias("k"), F.col("page_id").cast("string").alias("m")), "k", "m", "pixel")
    c = duplicates.duplicate_groups(R.table(spark, sf, "conversations").select(F.concat("role", F.md5("text")).alias("k"), F.col("conv_id").cast("string").alias("m")), "k", "m", "series_signature")
    return duplicates.level_counts(a.unionByName(b).unionByName(c))


@query("""WITH o AS (SELECT conv_id, md5(text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, string_agg(h, '|' ORDER BY i) AS signature, max(n) AS slice_count FROM o WHERE i = 0 OR i = n // 2 OR i = n - 1 GROUP BY 1""")
def series_signature(spark, sf):
    c = R.table(spark, sf, "conversations").withColumn("h", F.md5("text"))
    return duplicates.series_signatures(c, ["conv_id"], "h", [F.col("turn"), F.col("role"), F.col("text")])


@query("""WITH m AS (SELECT DISTINCT sha256(text) AS k, source AS s FROM documents), l AS (SELECT k, min(s) AS a FROM m GROUP BY 1) SELECT DISTINCT a AS study_a, s AS study_b FROM m JOIN l USING (k) WHERE a < s""")
def cross_study_edges(spark, sf):
    return duplicates.cross_study_edges(R.table(spark, sf, "documents").select(F.sha2("text", 256).alias("k"), F.col("source").alias("study")), "k", "study")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY 1, 2")
def upsert_last_wins(spark, sf):
    e = R.table(spark, sf, "events").withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    return series.upsert(e, "key", ["event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query(f"""SELECT {_SHARD.format('relative_path', 8)} AS shard, count(*) AS files, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS errors FROM ({R.LINES}) GROUP BY 1""")
def shard_tally(spark, sf):
    return series.shard_tally(R.lines(spark, sf).withColumn("shard", X.stable_shard("relative_path", 8)))


@query(f"SELECT count(*) AS files, count(DISTINCT series_uid) AS series, count(DISTINCT study_uid) AS studies FROM ({R.SLICES})")
def dataset_levels(spark, sf):
    return series.dataset_levels(R.slices(spark, sf))
