"""Folds that keep related studies together and labels balanced, and the check that nothing leaks across them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import label_vector
from ..functions.joins import PER_SALT, heavy_keys, shuffled, spread_join
from ..functions.scratch import materialize
from .graph import components
from .ranges import running_sums


def study_groups(studies: DataFrame, edges: DataFrame | None = None, per_salt: int = PER_SALT) -> DataFrame:
    """``study_id`` and ``group``: studies that share a patient or are linked, directly or through others, are one group.

    ``studies`` has study_id and patient_hash (NULL: no known patient); links with an unknown end don't count.  The group is named by
    its least study.  Studies of a patient link to the patient's least one, so a patient with many is a star, not all pairs.
    """
    known = studies.where("patient_hash is not null and patient_hash <> ''").select("study_id", "patient_hash")
    patients = known.groupBy("patient_hash").agg(F.min("study_id").alias("a"), F.count("*").alias("_n"))
    heavy = heavy_keys(patients.select("patient_hash", "_n"), "_n", known.count(), per_salt)  # one default patient may have any share of the studies
    links = spread_join(known, patients.drop("_n"), ["patient_hash"], heavy, F.xxhash64("study_id"), "inner", shuffle=True).where("study_id <> a").select("a", F.col("study_id").alias("b"))
    if edges is not None:
        known = studies.select("study_id").distinct()
        own = edges.select(F.col("study_a").alias("a"), F.col("study_b").alias("b"))
        own = own.join(shuffled(known.withColumnRenamed("study_id", "a")), "a", "left_semi").join(shuffled(known.withColumnRenamed("study_id", "b")), "b", "left_semi")
        links = links.unionByName(own.select("a", "b"))
    found = components(links)
    return studies.select("study_id").distinct().join(shuffled(found), F.col("study_id") == F.col("node"), "left").select("study_id", F.coalesce("component", "study_id").alias("group"))


def group_labels(studies: DataFrame, groups: DataFrame, n_labels: int) -> DataFrame:
    """One row for each group: number of studies, the element-wise greatest labels and their sums."""
    rows = studies.join(shuffled(groups), "study_id").select("group", "study_id", label_vector("labels", n_labels).alias("labels"))
    long = rows.select("group", F.posexplode("labels").alias("label", "value")).groupBy("group", "label").agg(F.max("value").alias("value"), F.sum("value").alias("total"))
    folded = long.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("label", "value", "total"))).alias("_l"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    return folded.join(shuffled(sizes), "group").select("group", "size", F.col("_l.value").alias("labels"), F.col("_l.total").alias("totals"))


def deal_classes(classes: list[tuple[str, int]], folds: int) -> dict[str, tuple[int, list[int]]]:
    """Of classes (a digit for each label, 1 where a group of the class has it; how many groups), rarest labels first: how many groups every fold takes, and which folds take one of the
    groups that are left.

    Those are the folds with the fewest groups, then the ones whose label sums then come nearest to their share, then the first; so folds' groups, and each class' groups in
    them, differ by one at most.
    """
    if not classes:
        return {}
    sets = np.array([[int(d) for d in c] for c, _ in classes], dtype=float)
    counts = np.array([n for _, n in classes], dtype=float)
    totals = counts @ sets
    goal, weight = totals / folds, 1.0 / np.maximum(totals, 1.0)
    have, taken = np.zeros((folds, sets.shape[1])), np.zeros(folds, dtype=int)
    out = {}
    for k in sorted(range(len(classes)), key=lambda k: (-float(sets[k] @ weight), classes[k][0])):
        base, left = divmod(classes[k][1], folds)
        have += base * sets[k]
        taken += base
        cost = (((have + sets[k] - goal) / np.maximum(goal, 1.0)) ** 2).mean(axis=1)
        extra = np.lexsort((np.arange(folds), cost, taken))[:left]
        have[extra] += sets[k]
        taken[extra] += 1
        out[classes[k][0]] = (base, extra.tolist())
    return out


def assign_folds(studies: DataFrame, folds: int = 5, seed: int = 2026, edges: DataFrame | None = None, n_labels: int = 12) -> DataFrame:
    """``study_id``, ``group`` and ``fold``.

    Groups with a positive label are dealt by class, the set of labels that they have: what is decided one after another are classes, at most ``2 ** n_labels`` of them, by their counts; a group's fold
    follows from its rank, by seeded hash, in its class.  The others only have to level the folds' sizes: in a seeded order, their running study
    count is cut where the folds' remaining room ends.
    """
    groups = study_groups(studies, edges)
    table = materialize(group_labels(studies, groups, n_labels), "groups")  # read by five jobs
    positive = F.exists("labels", lambda x: x > 0)
    class_ = F.array_join(F.transform("labels", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    labelled = table.where(positive).select("group", "size", class_.alias("class"), F.struct(F.xxhash64("group", F.lit(seed)).alias("h"), F.col("group").alias("g")).alias("order"), F.lit(1).alias("one"))
    plan = deal_classes(sorted(tuple(r) for r in labelled.groupBy("class").count().collect()), folds)
    dealt = studies.sparkSession.createDataFrame([(c, base, extra) for c, (base, extra) in plan.items()], "class string, base long, extra array<int>")
    rank, even = F.col("before_one"), F.col("base") * folds
    fold = F.when(rank < even, rank % folds).otherwise(F.get("extra", (rank - even).cast("int"))).cast("int")
    ranked = running_sums(labelled, ["class"], "order", ["one"]).join(F.broadcast(dealt), "class")  # a row for each class
    placed = materialize(ranked.select("group", "size", fold.alias("fold")), "placed")
    taken = {r["fold"]: r["n"] for r in placed.groupBy("fold").agg(F.sum("size").alias("n")).collect()}
    rest = table.where(~positive)
    n_rest = rest.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    room = fill_evenly(np.array([taken.get(f, 0) for f in range(folds)]), int(n_rest))
    levelled = _level(rest, room, seed + 1)
    both = placed.select("group", "fold").unionByName(levelled)
    return groups.join(shuffled(both), "group").select("study_id", "group", F.col("fold").cast("int").alias("fold"))


def fill_evenly(sizes: np.ndarray, more: int) -> np.ndarray:
    """How many of ``more`` studies each fold takes so that sizes become as level as they can."""
    level = sizes.astype(float).copy()
    take = np.zeros(len(sizes))
    left = float(more)
    for _ in range(len(sizes)):
        low = level.min()
        at = level == low
        above = level[~at]
        step = min(left / at.sum(), (above.min() - low) if len(above) else np.inf)
        level[at] += step
        take[at] += step
        left -= step * at.sum()
        if left <= 1e-9:
            break
    return take


#: Hash buckets over which the running count of unlabelled studies is summed.
BUCKETS = 4096


def _level(rest: DataFrame, room: np.ndarray, seed: int) -> DataFrame:
    """Folds of groups by the running count of studies in hash order, cut where each fold's room ends.

    The count runs within hash buckets; what lies before a bucket comes from the buckets' totals, 4096 numbers at any size.
    """
    bucket = F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(BUCKETS)).cast("int")
    rows = rest.select("group", "size", bucket.alias("bucket"))
    totals = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("size").alias("n")).collect()}
    before, starts = 0, []
    for b in range(BUCKETS):
        starts.append(float(before))
        before += totals.get(b, 0)
    running = F.sum("size").over(Window.partitionBy("bucket").orderBy(F.xxhash64("group"), "group").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = rest.sparkSession.createDataFrame(list(enumerate(starts)), "bucket int, start double")
    middle = F.col("start") + F.col("running") - F.col("size") / 2.0
    fold = F.lit(len(room) - 1)
    for f in range(len(room) - 2, -1, -1):
        fold = F.when(middle <= float(np.cumsum(room)[f]), F.lit(f)).otherwise(fold)
    return rows.withColumn("running", running).join(F.broadcast(table), "bucket").select("group", fold.cast("int").alias("fold"))


def leaks(assigned: DataFrame, key: str) -> DataFrame:
    """Keys (patients, groups, studies) that lie in more than one fold."""
    return assigned.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count_distinct("fold").alias("folds")).where("folds > 1").select(F.lit(key).alias("kind"), "key", "folds")


def check_folds(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """For each kind of key how many lie in several folds; all zero if nothing leaks."""
    whole = leaks(assigned, keys[0])
    for key in keys[1:]:
        whole = whole.unionByName(leaks(assigned, key))
    kinds = assigned.sparkSession.createDataFrame([(k,) for k in keys], "kind string")
    return kinds.join(whole.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("leaking"))


def require_disjoint(assigned: DataFrame, keys: list[str]) -> None:
    """Raise if anything leaks across folds."""
    bad = [(r["kind"], r["leaking"]) for r in check_folds(assigned, keys).collect() if r["leaking"]]
    if bad:
        raise ValueError("folds are not disjoint: " + ", ".join(f"{n} of {k}" for k, n in bad))


def fold_diagnostics(assigned: DataFrame, labels: str, n_labels: int) -> DataFrame:
    """Studies and positives of each label in each fold."""
    long = assigned.select("fold", F.posexplode(label_vector(labels, n_labels)).alias("label", "value"))
    return long.groupBy("fold", "label").agg(F.count("*").alias("studies"), F.count_if(F.col("value") > 0).alias("positives"))


def training_view(manifest: DataFrame, fold: int) -> DataFrame:
    return manifest.where(F.col("fold") != fold)


def validation_view(manifest: DataFrame, fold: int) -> DataFrame:
    return manifest.where(F.col("fold") == fold)
