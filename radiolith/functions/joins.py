"""Equi-joins whose hot keys are split over several tasks, without leaning on the planner to notice them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key in one salt, and most keys that can have several: a key has more than a 65,536th of all rows, so the
#: list of such keys is always small enough to broadcast.
PER_SALT = 20_000
MOST_HEAVY = 65_536


def heavy_keys(counts: DataFrame, n: str, rows: int, per_salt: int = PER_SALT) -> DataFrame | None:
    """Of ``counts`` (key columns and ``n``, the rows of each key) the keys to split, with the number of salts; None where there can't be any."""
    per = max(per_salt, -(-rows // MOST_HEAVY))
    if rows <= per:
        return None
    return counts.where(F.col(n) > per).withColumn("_rl_salts", F.ceil(F.col(n) / per).cast("int")).drop(n)


def shuffled(right: DataFrame) -> DataFrame:
    """``right`` for a join that shuffles both sides at any size: a broadcast passes the table through the driver, and over many joins what passes grows with the input."""
    return right.hint("merge")


def spread_join(left: DataFrame, right: DataFrame, key: list[str], heavy: DataFrame | None, by: Column, how: str = "left", shuffle: bool = False) -> DataFrame:
    """``left`` joined with ``right``, whose rows have unique keys; rows of ``left`` with a heavy key are dealt by the integer ``by`` over the
    key's salts, and right's row goes to each of them.  Null keys match nothing, as in any join.  With ``shuffle`` neither side passes through the driver, only the list of heavy keys."""
    through = shuffled if shuffle else lambda df: df
    if heavy is None:
        return left.join(through(right), key, how)
    heavy = F.broadcast(heavy)
    dealt = left.join(heavy, key, "left").withColumn("_rl_salt", F.coalesce(F.pmod(by, F.col("_rl_salts")), F.lit(0)).cast("int")).drop("_rl_salts")
    copies = right.join(heavy, key, "left").withColumn("_rl_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_rl_salts", F.lit(1)) - 1))).drop("_rl_salts")
    return dealt.join(through(copies), [*key, "_rl_salt"], how).drop("_rl_salt")
