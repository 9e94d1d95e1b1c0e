"""Merges without a MERGE statement: the rewritten table as one grouping over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], monotone: dict[str, str] | None = None) -> DataFrame:
    """Old rows with new ones in their place, by key.  monotone: column -> a value that, once there, stays.

    Every key comes once; of several new rows with one key the largest wins.
    """
    rest = [c for c in old.columns if c not in keys]
    rows = old.select(*old.columns, F.lit(0).alias("_new")).unionByName(new.select(*old.columns, F.lit(1).alias("_new")))
    best = F.max_by(F.struct(*rest), F.struct("_new", *rest)).alias("_row")
    stays = [F.max((F.col(c) == v).cast("int")).alias(f"_has_{c}") for c, v in (monotone or {}).items()]
    merged = rows.groupBy(*keys).agg(best, *stays)
    value = lambda c: F.when(F.col(f"_has_{c}") == 1, F.lit(monotone[c])).otherwise(F.col(f"_row.{c}")) if c in (monotone or {}) else F.col(f"_row.{c}")
    return merged.select(*(F.col(c) if c in keys else value(c).alias(c) for c in old.columns))


def changed_since(source: DataFrame, watermark: str, tie: str, low: Column, high_at: Column, high_tie: Column, overlap_seconds: int = 3600) -> DataFrame:
    """Rows from overlap before the low watermark up to the high one, by (watermark, tie-breaker)."""
    return source.where((F.col(watermark) >= low - F.expr(f"INTERVAL {overlap_seconds} SECONDS")) & (F.struct(watermark, tie) <= F.struct(high_at.alias(watermark), high_tie.alias(tie))))


def high_watermark(source: DataFrame, watermark: str, tie: str) -> DataFrame:
    """The largest (watermark, tie-breaker), in one row."""
    return source.agg(F.max(F.struct(watermark, tie)).alias("m")).select(f"m.{watermark}", f"m.{tie}")


def first_of_each(stage: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return stage.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def stage_check(stage: DataFrame, keys: list[str]) -> DataFrame:
    """row_count, null_keys, duplicate_keys of a stage table."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    per = stage.groupBy(*keys).agg(F.count("*").alias("n"), F.max(null.cast("int")).alias("null_key"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when(F.col("null_key") == 1, F.col("n"))), F.lit(0)).alias("null_keys"), F.count(F.when((F.col("n") > 1) & (F.col("null_key") == 0), 1)).alias("duplicate_keys"))
