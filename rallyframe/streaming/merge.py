"""The incremental merge and the weekly window as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import first_of_each, latest_wins
from ..sources.staging import removed, version_path, versions


def merge_stream(source: DataFrame, target: str, keys: list[str], watermark: str, checkpoint: str):
    """Starts a stream that merges each batch into the Parquet table at `target`, the latest watermark winning.

    Each batch writes the merged table as a new version beside the one before; the newest
    version with a success mark is the table.  So there is no moment without a table: a crash
    leaves an unmarked version that nobody reads, and a batch that is delivered again merges
    into the newest version, which changes nothing.  The two newest versions stay.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = versions(spark, target)
        rows = first_of_each(batch, keys, [F.desc(watermark), *(F.desc(c) for c in batch.columns if c not in keys)])
        if done:
            old = spark.read.parquet(version_path(target, done[-1]))
            # rows older than the target's stay out
            rows = latest_wins(old, rows.join(old.select(*keys, F.col(watermark).alias("_old")), keys, "left").where(F.col("_old").isNull() | (F.col(watermark) >= F.col("_old"))).drop("_old"), keys)
        rows.write.mode("overwrite").parquet(version_path(target, done[-1] + 1 if done else 0))
        for version in done[:-1]:
            removed(spark, version_path(target, version))

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_table(spark, target: str) -> DataFrame:
    done = versions(spark, target)
    if not done:
        raise ValueError(f"no complete version in {target}")
    return spark.read.parquet(version_path(target, done[-1]))


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling weeks (from Monday) by platform and kind, for a stream or a table; rows later than `late` are left out of a stream."""
    source = events.withWatermark("seen_at", late) if events.isStreaming else events
    week = F.window("seen_at", "7 days", "7 days", "4 days")  # 1970-01-05 was a Monday
    return source.groupBy(week.alias("w"), "platform_id", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("week"), "platform_id", "kind", "n", "total")
