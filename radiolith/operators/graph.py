"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import PER_SALT, heavy_keys, shuffled, spread_join
from ..functions.scratch import discard, materialize


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60, per_salt: int = PER_SALT, shuffle: bool = True) -> DataFrame:
    """``node`` and ``component``, the least node reachable, for every node of an edge.

    Each round a node takes the least label around it, then the label of that label, so rounds grow with the logarithm of the
    longest path.  Labels are a written table after each round; only whether something changed reaches the driver.  Nodes with very many
    edges, and labels that very many nodes have, are split over salts.  Three joins a round: with ``shuffle`` none of them sends a table through the driver, without it
    the planner may broadcast small ones.
    """
    one = edges.select(F.col(left).alias("node"), F.col(right).alias("other")).where("node is not null and other is not null")
    both = materialize(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    size = both.count()
    hubs = heavy_keys(both.groupBy("other").agg(F.count("*").alias("n")), "n", size, per_salt)
    hubs = materialize(hubs, "hubs") if hubs is not None else None
    try:
        for _ in range(max_rounds):
            met = spread_join(both, labels.withColumnRenamed("node", "other"), ["other"], hubs, F.xxhash64("node"), "inner", shuffle)
            around = met.groupBy("node").agg(F.min("component").alias("around"))
            near = materialize(labels.join(shuffled(around) if shuffle else around, "node").select("node", F.col("component").alias("was"), F.least("component", "around").alias("component")), "labels")
            jump = near.select(F.col("node").alias("component"), F.col("component").alias("next"))
            popular = heavy_keys(near.groupBy("component").agg(F.count("*").alias("n")), "n", size, per_salt)
            after = spread_join(near, jump, ["component"], popular, F.xxhash64("node"), shuffle=shuffle)
            after = materialize(after.select("node", F.coalesce("next", "component").alias("component"), "was"), "labels")
            settled = after.where("component <> was").isEmpty()
            discard(near)
            discard(labels)
            labels = after
            if settled:
                return labels.select("node", "component")
    finally:
        discard(both)
        discard(hubs)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
