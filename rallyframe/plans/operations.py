"""Monitoring, retention and incremental sync, over the scrape log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import changed_since, first_of_each, high_watermark, stage_check
from ..operators.sides import rate
from ..sources.adapter import Domain
from .catalog import query
from .players import n_if, pct


@query("q97_queue_summary", "SELECT kind, count(*) AS jobs, count(*) FILTER (WHERE value > 50) AS heavy, min(seen_at) AS first_at, max(seen_at) AS last_at FROM log GROUP BY kind")
def queue_summary(d: Domain) -> DataFrame:
    return d.events.groupBy("kind").agg(F.count("*").alias("jobs"), n_if("value > 50").alias("heavy"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))


@query("q98_scrape_summary", f"SELECT platform_id, CAST(seen_at AS DATE) AS day, count(*) AS scrapes, count(*) FILTER (WHERE kind = 'error') AS failed, {pct('count(*) FILTER (WHERE kind = ' + chr(39) + 'error' + chr(39) + ')', 'count(*)')} AS failed_share FROM log GROUP BY ALL")
def scrape_summary(d: Domain) -> DataFrame:
    return d.events.groupBy("platform_id", F.to_date("seen_at").alias("day")).agg(F.count("*").alias("scrapes"), n_if("kind = 'error'").alias("failed"), rate(n_if("kind = 'error'"), F.count("*")).alias("failed_share"))


@query("q98_recent_failures", "SELECT event_id, seen_at, resource_id, total FROM (SELECT *, count(*) OVER () AS total FROM log WHERE kind = 'error') ORDER BY seen_at DESC, event_id LIMIT 20")
def recent_failures(d: Domain) -> DataFrame:
    bad = d.events.where("kind = 'error'")
    return bad.orderBy(F.desc("seen_at"), "event_id").limit(20).select("event_id", "seen_at", "resource_id").crossJoin(F.broadcast(bad.agg(F.count("*").alias("total"))))


@query("q99_pipeline_runs", """SELECT CAST(seen_at AS DATE) AS run_day, string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS stages, CAST(sum(n) AS BIGINT) AS rows_seen, CASE WHEN sum(CASE WHEN kind = 'error' THEN n ELSE 0 END) = 0 THEN 'ok' ELSE 'failed' END AS state FROM (SELECT CAST(seen_at AS DATE) AS seen_at, kind, count(*) AS n FROM log GROUP BY ALL) GROUP BY ALL""")
def pipeline_runs(d: Domain) -> DataFrame:
    """Runs with their stages nested."""
    s = d.events.groupBy(F.to_date("seen_at").alias("run_day"), "kind").agg(F.count("*").alias("n"))
    stage = F.concat_ws(":", "kind", F.col("n").cast("string"))
    return s.groupBy("run_day").agg(F.array_join(F.sort_array(F.collect_list(stage)), ",").alias("stages"), F.sum("n").alias("rows_seen"), F.when(F.sum(F.when(F.col("kind") == "error", F.col("n")).otherwise(0)) == 0, "ok").otherwise("failed").alias("state"))


@query("q101_run_barrier", "SELECT platform_id, count(*) FILTER (WHERE kind = 'signup') AS pending, count(*) FILTER (WHERE kind = 'error') AS failed, count(*) FILTER (WHERE kind = 'signup') = 0 AND count(*) FILTER (WHERE kind = 'error') = 0 AS may_go FROM log GROUP BY platform_id")
def run_barrier(d: Domain) -> DataFrame:
    g = d.events.groupBy("platform_id").agg(n_if("kind = 'signup'").alias("pending"), n_if("kind = 'error'").alias("failed"))
    return g.withColumn("may_go", (F.col("pending") == 0) & (F.col("failed") == 0))


@query("q102_due_resources", """WITH r AS (SELECT resource_id, max(seen_at) AS last_at, count(*) FILTER (WHERE kind = 'error') AS failures FROM log GROUP BY resource_id), e AS (SELECT max(seen_at) AS as_of FROM log),
    w AS (SELECT resource_id, last_at, failures, as_of, CASE WHEN failures > 0 THEN least(86400, 300 * pow(2, least(failures - 1, 8))) ELSE 3600 END AS wait FROM r CROSS JOIN e)
    SELECT resource_id, failures, CAST(wait AS BIGINT) AS wait_seconds, epoch_us(last_at) + CAST(wait AS BIGINT) * 1000000 <= epoch_us(as_of) AS is_due FROM w""")
def due_resources(d: Domain) -> DataFrame:
    """Resources that are due: hourly, or after an exponential pause of five minutes to a day."""
    r = d.events.groupBy("resource_id").agg(F.max("seen_at").alias("last_at"), n_if("kind = 'error'").alias("failures")).crossJoin(F.broadcast(d.events.agg(F.max("seen_at").alias("as_of"))))
    wait = F.when(F.col("failures") > 0, F.least(F.lit(86400.0), 300 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(8))))).otherwise(3600).cast("bigint")
    return r.select("resource_id", "failures", wait.alias("wait_seconds"), (F.unix_micros(F.col("last_at").cast("timestamp")) + wait * 1_000_000 <= F.unix_micros(F.col("as_of").cast("timestamp"))).alias("is_due"))


@query("q103_retention", "SELECT l.event_id FROM log l CROSS JOIN (SELECT max(seen_at) AS as_of FROM log) WHERE l.seen_at < as_of - INTERVAL 5 DAY AND kind <> 'purchase' AND NOT EXISTS (SELECT 1 FROM log x WHERE x.kind = 'purchase' AND x.resource_id = l.resource_id AND x.event_id % 11 = l.event_id % 11)")
def retention(d: Domain) -> DataFrame:
    """Old rows that nothing refers to: an anti-join on the reference's key."""
    e = d.events.crossJoin(F.broadcast(d.events.agg(F.max("seen_at").alias("as_of")))).where("seen_at < as_of - INTERVAL 5 DAY and kind <> 'purchase'").withColumn("part", F.col("event_id") % 11)
    held = d.events.where("kind = 'purchase'").select("resource_id", (F.col("event_id") % 11).alias("part")).distinct()
    return e.join(held, ["resource_id", "part"], "left_anti").select("event_id")


@query("q104_expired_batch", "SELECT event_id, seen_at FROM log WHERE kind = 'view' ORDER BY seen_at, event_id LIMIT 500")
def expired_batch(d: Domain) -> DataFrame:
    """The oldest 500 rows: one batch of a purge."""
    return d.events.where("kind = 'view'").orderBy("seen_at", "event_id").limit(500).select("event_id", "seen_at")


@query("q87_latest_by_resource", "SELECT resource_id, max_by(event_id, (seen_at, event_id)) AS event_id, max(seen_at) AS seen_at FROM log GROUP BY resource_id".replace("(seen_at, event_id)", "row(seen_at, event_id)"))
def latest_by_resource(d: Domain) -> DataFrame:
    return first_of_each(d.events, ["resource_id"], [F.desc("seen_at"), F.desc("event_id")]).select("resource_id", "event_id", "seen_at")


#: Half-way between the log's first and last moment, to the second: where the second run of an export begins.
MIDDLE_SQL = "cut AS (SELECT make_timestamp((epoch_us(min(seen_at)) // 1000000 + epoch_us(max(seen_at)) // 1000000) // 2 * 1000000) AS cut FROM log)"


def middle(log: DataFrame) -> DataFrame:
    at = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    return log.agg(F.timestamp_seconds(F.floor((F.min(at) + F.max(at)) / 2)).alias("cut"))


@query("s17_incremental_rows", f"""WITH {MIDDLE_SQL}, h AS (SELECT seen_at, event_id FROM log ORDER BY seen_at DESC, event_id DESC LIMIT 1), low AS (SELECT max(seen_at) AS seen_at FROM log, cut WHERE log.seen_at < cut)
    SELECT l.event_id, l.seen_at FROM log l, h, low WHERE l.seen_at >= low.seen_at - INTERVAL 3600 SECOND AND (l.seen_at < h.seen_at OR l.seen_at = h.seen_at AND l.event_id <= h.event_id)""")
def incremental_rows(d: Domain) -> DataFrame:
    """What a second run reads, the first having read the first half of the time: rows from an hour before its watermark up to the present one."""
    e = d.events.select("event_id", "seen_at")
    h = high_watermark(e, "seen_at", "event_id").select(F.col("seen_at").alias("h_at"), F.col("event_id").alias("h_id"))
    early = e.crossJoin(F.broadcast(middle(e))).where(F.col("seen_at") < F.col("cut"))
    low = high_watermark(early, "seen_at", "event_id").select(F.col("seen_at").alias("low_at"))
    return changed_since(e.crossJoin(F.broadcast(h)).crossJoin(F.broadcast(low)), "seen_at", "event_id", F.col("low_at"), F.col("h_at"), F.col("h_id")).select("event_id", "seen_at")


@query("q105_incremental_merge", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY resource_id, kind ORDER BY seen_at DESC, event_id DESC) AS n FROM log) SELECT resource_id, kind, event_id, seen_at, value FROM s WHERE n = 1""")
def incremental_merge(d: Domain) -> DataFrame:
    """Target and stage by key, the latest watermark winning: the log's first half as target, the rest as stage (`s17_two_runs` is the run over a stored table)."""
    from ..operators.merge import latest_wins

    e = d.events.select("resource_id", "kind", "seen_at", "event_id", "value")
    order = [F.desc("seen_at"), F.desc("event_id")]
    halves = e.crossJoin(F.broadcast(middle(e)))
    old, new = (first_of_each(halves.where(c).drop("cut"), ["resource_id", "kind"], order) for c in (F.col("seen_at") < F.col("cut"), F.col("seen_at") >= F.col("cut")))
    return latest_wins(old, new, ["resource_id", "kind"]).select("resource_id", "kind", "event_id", "seen_at", "value")


@query("s19_stage_check", "SELECT CAST(count(*) AS BIGINT) AS row_count, count(*) FILTER (WHERE external_id IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT external_id FROM players WHERE external_id IS NOT NULL GROUP BY external_id HAVING count(*) > 1)) AS duplicate_keys FROM players")
def check_stage(d: Domain) -> DataFrame:
    return stage_check(d.players, ["external_id"])


@query("a24_latency_percentiles", "WITH r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS k, count(*) OVER (PARTITION BY kind) AS n FROM log) SELECT kind, max(value) FILTER (WHERE k = CAST(ceil(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (WHERE k = CAST(ceil(n * 0.95) AS BIGINT)) AS p95, max(value) FILTER (WHERE k = CAST(ceil(n * 0.99) AS BIGINT)) AS p99 FROM r GROUP BY kind")
def latency(d: Domain) -> DataFrame:
    """Nearest-rank percentiles, which are the discrete ones: from counts of each value, without a sort of all rows."""
    v = d.events.groupBy("kind", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind")
    up_to = v.withColumn("c", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("n").over(w))
    p = lambda q: F.min(F.when(F.col("c") >= F.ceil(F.col("t") * F.lit(q).cast("decimal(4,2)")), F.col("value")))
    return up_to.groupBy("kind").agg(p("0.5").alias("p50"), p("0.95").alias("p95"), p("0.99").alias("p99"))
