"""Alias chains to their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import dropped, written


def flatten_chains(chain: DataFrame, rounds: int = 40) -> DataFrame:
    """(player_id, next or null) -> player_id, root, depth.  Pointer jumping: rounds grow with the logarithm of the longest chain.

    A cycle has no root and raises: a node that jumps back to itself at once, others after `rounds`.
    """
    at = written(chain.select("player_id", F.coalesce("next", "player_id").alias("root"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    for _ in range(rounds):
        step = at.select(F.col("player_id").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        new = written(at.join(step, "root", "left").select("player_id", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("r2", "root") != F.col("root")).alias("moved")))
        dropped(at)
        if new.where("root = player_id and depth > 0").take(1):
            break
        if not new.where("moved").take(1):
            return new.drop("moved")
        path, at = new._written_path, new.drop("moved")
        at._written_path = path
    raise ValueError("the chain has a cycle")
