"""Chains of parents by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent_chains(df: DataFrame, key: str = "id", parent: str = "parent_id", most: int | None = None) -> DataFrame:
    """``key, depth, root``: the number of ancestors of every row and the last of them (the row itself where it has none).

    Each round joins every row with the one that its pointer reaches, so pointers cover 1, 2, 4, ... ancestors, and ends once none is left. A cycle never ends: rows on one or
    below one have more ancestors than there are rows; with ``most``, depths are cut there and rounds end as soon as pointers cover so many. Rows that
    reach a cycle have depth ``most`` (null without it) and no root. A parent that is no row counts as an ancestor, without ancestors, and is no root. Keys are unique.
    """
    bound = most if most is not None else df.count()
    up = F.col("up")
    walk = df.select(
        F.col(key), F.col(parent).alias("at"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("bigint").alias("hops"), F.when(F.col(parent).isNull(), F.col(key)).alias("root"), F.col(key).alias("last")
    ).persist()
    old, reach = [walk], 1
    while reach <= bound and not walk.where("at is not null").isEmpty():
        other = walk.select(F.col(key).alias("_key"), F.struct("at", "hops", "root", "last").alias("up"))
        walk = walk.join(other, F.col("at") == F.col("_key"), "left").select(
            F.col(key), up["at"].alias("at"), (F.col("hops") + F.coalesce(up["hops"], F.lit(0))).alias("hops"),
            F.coalesce("root", up["root"], F.when(F.col("at").isNotNull() & F.col("_key").isNull(), F.col("last"))).alias("root"), F.coalesce(up["last"], F.col("last")).alias("last"),
        ).persist()
        old.append(walk)
        reach *= 2
    endless = F.col("at").isNotNull() | (F.col("hops") > bound)
    out = walk.select(F.col(key), (F.least("hops", F.lit(most)) if most is not None else F.when(~endless, F.col("hops"))).cast("bigint").alias("depth"), F.when(~endless, F.col("root")).alias("root"))
    for df_ in old[:-1]:
        df_.unpersist()
    return out
