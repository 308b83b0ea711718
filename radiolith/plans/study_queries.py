"""Queries of manifests, selection, groups and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import duplicates, graph, manifest, selection, split
from . import roles as R
from .catalog import query

_EVENT_ORDER = "ORDER BY ts, event_id"


def _events(spark, sf):
    return R.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("series_uid"), F.col("event_id").cast("string").alias("path"), "ts", "event_id", F.col("event_type").alias("plane"))


@query(f"""SELECT series_uid, relative_path, (row_number() OVER (PARTITION BY series_uid ORDER BY CASE WHEN instance_number = 2 THEN NULL ELSE position_scalar END ASC NULLS LAST,
    CASE WHEN instance_number = 3 THEN NULL ELSE instance_number END ASC NULLS FIRST, relative_path) - 1)::INT AS i, count(*) OVER (PARTITION BY series_uid)::INT AS n FROM ({R.LINES})""")
def slice_order(spark, sf):
    rows = R.lines(spark, sf)
    holes = rows.withColumns({"position_scalar": F.when(F.col("instance_number") != 2, F.col("position_scalar")), "instance_number": F.when(F.col("instance_number") != 3, F.col("instance_number"))})
    return manifest.ordered_slices(holes, ["series_uid"]).select("series_uid", "relative_path", F.col("i").cast("int").alias("i"), "n")


_UNIFORM = "CASE WHEN n <= {k} THEN range(n) ELSE list_distinct(list_transform(range({k}), lambda j: CASE WHEN j = {k} - 1 THEN n - 1 ELSE round_even(j * ((n - 1) / {d}::DOUBLE), 0)::BIGINT END)) END"
_WINDOWS_SQL = f"""o AS (SELECT user_id::VARCHAR AS series_uid, event_id::VARCHAR AS path, event_type AS plane, row_number() OVER (PARTITION BY user_id {_EVENT_ORDER}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT series_uid, any_value(n) AS n, list(path ORDER BY i) AS p, list(plane ORDER BY i) AS planes FROM o GROUP BY 1),
    c AS (SELECT series_uid, n, p, planes, unnest({_UNIFORM.format(k=5, d=4)}) AS c FROM s)"""


@query(f"""WITH {_WINDOWS_SQL} SELECT series_uid, c::INT AS center_index, concat_ws(';', p[greatest(c - 1, 0) + 1], p[c + 1], p[least(c + 1, n - 1) + 1]) AS paths,
    round(c / greatest(1, n - 1)::DOUBLE, 6) AS relative_position, n::INT AS series_length, planes[n // 2 + 1] AS middle_plane FROM c""")
def windows_25d(spark, sf):
    w = manifest.neighbour_windows(_events(spark, sf), ["series_uid"], "path", 5, order=[F.col("ts"), F.col("event_id")], plane="plane")
    return w.select("series_uid", "center_index", F.array_join("paths", ";").alias("paths"), F.round("relative_position", 6).alias("relative_position"), "series_length", "middle_plane")


_TURNS = """t AS (SELECT conv_id::VARCHAR AS study, role AS series, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id, role) AS n, md5(text) AS path FROM conversations),
    s AS (SELECT study, series, any_value(n) AS n, list(path ORDER BY i) AS p FROM t GROUP BY 1, 2),
    w AS (SELECT study, series, n, p, unnest(range(n)) AS c FROM s)"""


def _manifest(spark, sf):
    turns = R.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("study_uid"), F.col("role").alias("series"), F.md5("text").alias("path"), "turn", "text")
    turns = turns.withColumn("series_uid", F.concat_ws("/", "study_uid", "series"))
    w = manifest.neighbour_windows(turns, ["study_uid", "series_uid"], "path", 0, order=[F.col("turn"), F.col("text")])
    meta = turns.select("series_uid", F.when(F.col("series") == "user", "Axial").alias("plane"), F.when(F.col("series") == "user", 1.0).alias("fluid_sensitive")).distinct()
    lab = R.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("study_uid"), "quality", "toxic")
    return manifest.study_manifest(w, meta, manifest.label_arrays(lab, "study_uid", ["quality", "toxic", "other"]))


@query(f"""WITH {_TURNS} SELECT study AS study_id, concat_ws('/', study, series) AS series_id, (row_number() OVER (PARTITION BY study ORDER BY concat_ws('/', study, series), c) - 1)::INT AS window_index, c::INT AS center_index,
    concat_ws(';', p[greatest(c - 1, 0) + 1], p[c + 1], p[least(c + 1, n - 1) + 1]) AS paths, CASE series WHEN 'user' THEN 'Axial' ELSE 'Unknown' END AS plane,
    round(c / greatest(1, n - 1)::DOUBLE, 6) AS relative_position, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM w LEFT JOIN labels ON doc_id::VARCHAR = study""")
def study_manifest(spark, sf):
    w = manifest.windows_of(_manifest(spark, sf))
    return w.select("study_id", "series_id", "window_index", "center_index", F.array_join("paths", ";").alias("paths"), "plane", F.round("relative_position", 6).alias("relative_position"), F.get("labels", F.lit(0)).alias("quality"), F.get("labels", F.lit(1)).alias("toxic"))


@query(f"SELECT study_uid, arg_min(patient_hash, (series_uid, position_scalar, instance_number, relative_path)) AS patient_hash FROM ({R.SLICES}) GROUP BY 1")
def first_patient(spark, sf):
    return manifest.first_patient(R.slices(spark, sf))


def _select_sql(keep: str) -> str:
    return f"""WITH o AS (SELECT label AS study, vec_id AS "window", row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE embedding[1] > 0)
    SELECT study, "window" FROM o WHERE {keep}"""


@query(_select_sql(f"list_contains({_UNIFORM.format(k=15, d=14)}, i)"))
def uniform_select(spark, sf):
    return selection.uniform(R.windows(spark, sf), "study", "window", 15, F.get("scores", F.lit(0)) > 0).select("study", "window")


@query(_select_sql("i >= (n - least(15, n)) // 2 AND i < (n - least(15, n)) // 2 + 15"))
def central_select(spark, sf):
    return selection.central(R.windows(spark, sf), "study", "window", 15, F.get("scores", F.lit(0)) > 0).select("study", "window")


@query(f"""WITH o AS (SELECT user_id::VARCHAR AS study_id, event_type AS plane, event_id % 2 AS fluid, event_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id) - 1 AS i,
    count(*) OVER (PARTITION BY user_id, event_type, event_id % 2) AS n FROM events) SELECT study_id, plane, fluid::DOUBLE AS fluid_sensitive, i::INT AS slot_index, path FROM o WHERE list_contains({_UNIFORM.format(k=9, d=8)}, i)""")
def montage_slots(spark, sf):
    e = R.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("study_id"), F.col("event_type").alias("plane"), (F.col("event_id") % 2).cast("double").alias("fluid_sensitive"), F.col("event_id").alias("window_index"), F.array(F.lit("-"), F.col("event_id").cast("string"), F.lit("+")).alias("paths"))
    return manifest.montage_slots(e, 9).withColumn("slot_index", F.col("slot_index").cast("int"))


@query("SELECT doc_id::VARCHAR AS study_id FROM documents ORDER BY md5(doc_id || '|2026'), doc_id::VARCHAR LIMIT 40")
def montage_sample(spark, sf):
    return manifest.shuffled_sample(R.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("study_id")), "study_id", 40, seed=2026)


@query(f"""WITH w AS ({R.WINDOWS}), u AS (SELECT study, "window", list_max(scores) AS u FROM w) SELECT study, "window", rank::INT AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY study ORDER BY u DESC, "window") AS rank FROM u) WHERE rank <= 15""")
def topk_utility(spark, sf):
    return selection.top_k_utility(R.windows(spark, sf), "study", "window", 15).select("study", "window", "rank")


_RECALL_SAFE = f"""w AS ({R.WINDOWS}), u AS (SELECT study, "window", list_max(scores) AS u, scores FROM w), l AS (SELECT study, "window", unnest(scores) AS s, generate_subscripts(scores, 1) AS label FROM w),
    b AS (SELECT DISTINCT study, "window" FROM (SELECT study, "window", row_number() OVER (PARTITION BY study, label ORDER BY s DESC, "window") AS r FROM l) WHERE r = 1),
    c AS (SELECT study, max(abs(u)) + 1 AS scale FROM u GROUP BY 1),
    p AS (SELECT u.study, u."window", u + CASE WHEN b."window" IS NULL THEN 0 ELSE scale * 4 END AS p, b."window" IS NOT NULL AS proposed FROM u JOIN c USING (study) LEFT JOIN b ON b.study = u.study AND b."window" = u."window")"""


@query(f"""WITH {_RECALL_SAFE} SELECT study, "window", rank::INT AS rank, proposed FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY p DESC, "window") AS rank FROM p) WHERE rank <= 15""")
def topk_recall_safe(spark, sf):
    return selection.top_k_recall_safe(R.windows(spark, sf), "study", "window", 15).select("study", "window", "rank", "proposed")


@query(f"""WITH w AS ({R.WINDOWS}), u AS (SELECT study, "window", row_number() OVER (PARTITION BY study ORDER BY list_max(scores) DESC, "window") AS rank, scores[1] AS first_score FROM w)
    SELECT study, "window", rank::INT AS rank, round(first_score, 6) AS first_score FROM u WHERE rank <= 3""")
def gather_selected(spark, sf):
    w = R.windows(spark, sf)
    chosen = selection.top_k_utility(w, "study", "window", 3)
    return selection.gather(w, chosen, ["study", "window"]).select("study", "window", "rank", F.round(F.get("scores", F.lit(0)), 6).alias("first_score"))


_MASK = "list_sum(list_transform(range(1, 13), lambda i: CASE WHEN scores[i] >= 1.5 THEN (1 << (i - 1)::INT)::BIGINT ELSE 0 END))::BIGINT"


# Any two windows by enumeration; the selectors' two by their ranks.
@query(f"""WITH {_RECALL_SAFE}, m AS (SELECT study, "window", {_MASK} AS m FROM w),
    best AS (SELECT a.study, max(bit_count(a.m | b.m)) AS oracle FROM m a JOIN m b ON a.study = b.study GROUP BY 1),
    e AS (SELECT study, bit_count(bit_or(m)) AS evidence FROM m GROUP BY 1),
    safe AS (SELECT study, "window", row_number() OVER (PARTITION BY study ORDER BY p DESC, "window") AS r FROM p),
    q AS (SELECT study, "window", row_number() OVER (PARTITION BY study ORDER BY u DESC, "window") AS r FROM u),
    places AS (SELECT study, "window", row_number() OVER x - 1 AS i, count(*) OVER (PARTITION BY study) AS n FROM w WINDOW x AS (PARTITION BY study ORDER BY "window")),
    f AS (SELECT e.study, evidence, oracle, (SELECT bit_count(bit_or(m.m)) FROM q JOIN m USING (study, "window") WHERE q.study = e.study AND q.r <= 2) AS utility,
        (SELECT bit_count(bit_or(m.m)) FROM safe JOIN m USING (study, "window") WHERE safe.study = e.study AND safe.r <= 2) AS recall_safe,
        (SELECT bit_count(bit_or(m.m)) FROM places JOIN m USING (study, "window") WHERE places.study = e.study AND i >= (n - least(2, n)) // 2 AND i < (n - least(2, n)) // 2 + 2) AS central FROM e JOIN best USING (study))
    SELECT study, evidence, oracle, utility, oracle - utility AS utility_regret, recall_safe, oracle - recall_safe AS recall_safe_regret, central, oracle - central AS central_regret FROM f""")
def selector_regret(spark, sf):
    w = R.windows(spark, sf)
    chosen = {"utility": selection.top_k_utility(w, "study", "window", 2), "recall_safe": selection.top_k_recall_safe(w, "study", "window", 2), "central": selection.central(w, "study", "window", 2)}
    return selection.regret(w, "study", "window", 2, 1.5, chosen)


def _edges(spark, sf):
    docs = R.table(spark, sf, "documents")
    keyed = docs.select(F.col("doc_id").alias("study"), F.sha2("text", 256).alias("k")).unionByName(docs.select(F.col("doc_id").alias("study"), F.concat_ws("/", "lang", "n_chars").alias("k")))
    return duplicates.cross_study_edges(keyed, "k", "study")


_EDGES = """k AS (SELECT doc_id, sha256(text) AS k FROM documents UNION ALL SELECT doc_id, concat_ws('/', lang, n_chars) FROM documents), m AS (SELECT k, min(doc_id) AS a FROM k GROUP BY 1),
    e AS (SELECT DISTINCT a, doc_id AS b FROM k JOIN m USING (k) WHERE a < doc_id)"""


@query(f"""WITH RECURSIVE {_EDGES}, d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS other FROM d UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.other)
    SELECT node, min(other) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    return graph.components(_edges(spark, sf), "study_a", "study_b")


def _studies(spark, sf):
    lab = F.when(F.col("quality").isNotNull(), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.when(F.col("lang") == "en", 0.0).otherwise(F.col("quality").cast("double"))))
    studies = R.labelled(spark, sf, shuffle=True)  # several jobs read them
    return studies.select(F.col("study_uid").alias("study_id"), F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 3)).alias("patient_hash"), lab.alias("labels"))


@query()
def folds(spark, sf):
    edges = _edges(spark, sf).select(F.col("study_a").cast("string").alias("study_a"), F.col("study_b").cast("string").alias("study_b"))
    return split.assign_folds(_studies(spark, sf), 5, 2026, edges, n_labels=3)


# How many groups with a positive label each fold has, from most to least: as level as they can be.
@query("""WITH g AS (SELECT source || '-' || d.doc_id // 3 AS g, max(CASE WHEN quality IS NULL THEN 0 ELSE greatest(quality, toxic) END) AS positive, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
    t AS (SELECT count(*) FILTER (positive > 0) AS l, count(*) AS all_groups, sum(n)::BIGINT AS studies FROM g)
    SELECT i::INT AS place, ((l + 4 - i) // 5)::BIGINT AS labelled_groups FROM t, range(5) r(i)""")
def folds_level(spark, sf):
    studies = _studies(spark, sf)
    assigned = split.assign_folds(studies, 5, 2026, None, n_labels=3).join(studies.select("study_id", "labels"), "study_id")
    groups = assigned.groupBy("group").agg(F.first("fold").alias("fold"), F.max(F.exists("labels", lambda x: x > 0)).alias("positive"))
    counts = groups.groupBy("fold").agg(F.count_if("positive").alias("labelled_groups"))
    return counts.select((F.row_number().over(Window.orderBy(F.desc("labelled_groups"))) - 1).alias("place"), "labelled_groups")


@query("SELECT unnest(['study_id', 'patient_hash', 'group']) AS kind, 0::BIGINT AS leaking")
def folds_disjoint(spark, sf):
    studies = _studies(spark, sf)
    assigned = split.assign_folds(studies, 5, 2026, None, n_labels=3).join(studies.select("study_id", "patient_hash"), "study_id")
    return split.check_folds(assigned, ["study_id", "patient_hash", "group"])


_FOLD = "(concat('0x', substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INT"


def _hash_folds(spark, sf):
    from ..functions.exprs import stable_shard

    return R.labelled(spark, sf).withColumn("fold", stable_shard("study_uid", 5))


@query(f"""SELECT 'source' AS kind, source AS key, count(DISTINCT {_FOLD}) AS folds FROM documents GROUP BY source HAVING count(DISTINCT {_FOLD}) > 1
    UNION ALL SELECT 'text', sha256(text), count(DISTINCT {_FOLD}) FROM documents GROUP BY sha256(text) HAVING count(DISTINCT {_FOLD}) > 1""")
def fold_leakage(spark, sf):
    docs = R.table(spark, sf, "documents").withColumn("text", F.sha2("text", 256)).join(_hash_folds(spark, sf).select("doc_id", "fold"), "doc_id")
    return split.leaks(docs, "source").unionByName(split.leaks(docs, "text"))


@query(f"""WITH x AS (SELECT {_FOLD.replace('doc_id', 'd.doc_id')} AS fold, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT fold, 0 AS label, count(*) AS studies, count(*) FILTER (q > 0) AS positives FROM x GROUP BY 1 UNION ALL SELECT fold, 1, count(*), count(*) FILTER (t > 0) FROM x GROUP BY 1""")
def fold_diagnostics(spark, sf):
    rows = _hash_folds(spark, sf).withColumn("labels", F.array("quality", "toxic"))
    return split.fold_diagnostics(rows, "labels", 2)


@query(f"SELECT doc_id FROM (SELECT doc_id, {_FOLD} AS fold FROM documents) WHERE fold <> 2")
def fold_training(spark, sf):
    return split.training_view(_hash_folds(spark, sf), 2).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_FOLD} AS fold FROM documents) WHERE fold = 2")
def fold_validation(spark, sf):
    return split.validation_view(_hash_folds(spark, sf), 2).select("doc_id")
