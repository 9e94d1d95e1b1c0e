"""Raw evidence as a content-addressed sink: each payload once, by scope, request and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import found

KEY = ["scope", "fingerprint", "sha256"]
BUCKETS = 64
PAYLOADS = "scope string, fingerprint string, sha256 string, payload string, first_at timestamp, bucket int, batch long"
SEEN = "scope string, fingerprint string, sha256 string, scraped_at timestamp, http_status int, batch long"


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with the hash of their payload; a null payload counts as empty, a null scope or fingerprint too."""
    empty = {c: F.coalesce(c, F.lit("")) for c in ("scope", "fingerprint", "payload")}
    return rows.withColumns(empty).withColumn("sha256", F.sha2("payload", 256))


def _table(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    if not found(spark, f"{target}/{name}/batch=*/_SUCCESS"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/{name}")


def keep_batch(rows: DataFrame, batch: int, target: str) -> None:
    """Adds one batch of scope, fingerprint, payload, scraped_at, http_status.

    A payload is written by the first batch that brings it; each batch also writes when it last saw
    each key.  A batch has its own folders and looks at earlier batches only, so one that is delivered again
    writes the same again in its own place.  Within a batch the earliest row brings the payload.
    """
    spark, rows = rows.sparkSession, keyed(rows).persist()
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
    new = rows.groupBy(*KEY).agg(F.min("payload").alias("payload"), F.min("scraped_at").alias("first_at")).withColumn("bucket", bucket)
    before = _table(spark, target, "payloads", PAYLOADS).where(F.col("batch") < batch).select("bucket", *KEY)  # keys alone are read
    new.join(before, ["bucket", *KEY], "left_anti").write.mode("overwrite").parquet(f"{target}/payloads/batch={batch}")
    seen = rows.groupBy(*KEY).agg(F.max(F.struct("scraped_at", "http_status")).alias("s")).select(*KEY, "s.*")
    seen.write.mode("overwrite").parquet(f"{target}/seen/batch={batch}")
    rows.unpersist()


def evidence_stream(source: DataFrame, target: str, checkpoint: str):
    """Starts the sink over a stream of rows as `keep_batch` takes them."""
    return source.writeStream.foreachBatch(lambda rows, batch: keep_batch(rows, batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evidence(spark: SparkSession, target: str) -> DataFrame:
    """KEY, payload, first_at, last_at, http_status (of the last sight): a row for each content."""
    last = _table(spark, target, "seen", SEEN).groupBy(*KEY).agg(F.max(F.struct("scraped_at", "batch", "http_status")).alias("s"))
    return _table(spark, target, "payloads", PAYLOADS).join(last, KEY).select(*KEY, "payload", "first_at", F.col("s.scraped_at").alias("last_at"), F.col("s.http_status").alias("http_status"))
