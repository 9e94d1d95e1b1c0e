"""Event results with a side output of what was turned away, and the status of events over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dated_event, player_cell
from ..sources.staging import written

#: Rounds and their order.
ROUNDS = {"group": 10, "preliminary": 20, "last_128": 30, "last_64": 40, "last_32": 50, "last_16": 60, "quarter_final": 70, "semi_final": 80, "final": 90}
#: The statuses of an event; it goes forward through the first five, and completed is the end.
FORWARD = ["upcoming", "entries_open", "entries_closed", "in_progress", "awaiting_results", "completed"]


def event_results(rows: DataFrame) -> dict[str, DataFrame]:
    """row_id, event_id, event_name, home, away, round, played_at (text) -> rubbers, fixtures, quarantined.

    A row is taken if exactly one of its cells names the winner; else it goes to quarantine with
    its reason, as does a row without an id.  A round that is `unset` is the group stage, one without a name has none.  The event's rounds become one fixture each, of the day of its first
    row in the order of row_id, or the day in the event's name.  Rows with one id: the least row counts and the others are quarantined as repeated.
    """
    day = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as date)")
    r = rows.select("row_id", "event_id", dated_event(F.col("event_name"))["day"].alias("event_day"), player_cell(F.col("home")).alias("h"), player_cell(F.col("away")).alias("a"), F.when(F.trim("round") == "unset", "group").otherwise(F.nullif(F.trim("round"), F.lit(""))).alias("round_name"), "played_at")
    nth = F.row_number().over(Window.partitionBy("row_id").orderBy("event_id", "h", "a", "round_name", "played_at"))
    winners = F.coalesce(F.col("h.won"), F.lit(False)).cast("int") + F.coalesce(F.col("a.won"), F.lit(False)).cast("int")
    reason = F.when(F.col("row_id").isNull(), "no id").when(F.col("nth") > 1, "repeated id").when(winners == 0, "no winner").when(winners == 2, "two winners").when(F.coalesce(F.col("h.name"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("a.name"), F.lit("")).eqNullSafe(""), "no player")
    one = written(r.withColumn("nth", nth).withColumn("reason", reason))
    good = one.where("reason is null").withColumn("fixture_id", F.concat_ws(":", F.lit("event"), F.col("event_id").cast("string"), F.lit("round"), F.coalesce("round_name", F.lit("unknown"))))
    known = lambda c: F.coalesce(f"{c}.id", F.lower(F.regexp_replace(f"{c}.name", r"\s+", " ")))
    rubbers = good.select(F.col("row_id"), "fixture_id", known("h").alias("home_player"), known("a").alias("away_player"), F.col("h.won").cast("int").alias("home_games"), F.col("a.won").cast("int").alias("away_games"), F.lit("win_loss_only").alias("score_source"), day("played_at").alias("played_on"))
    first = good.groupBy("fixture_id", "event_id", "round_name").agg(F.min_by(F.struct(F.coalesce(day("played_at"), "event_day").alias("d")), "row_id").alias("f"), F.count("*").alias("rubbers"))
    order = F.get(F.array(*map(F.lit, ROUNDS.values())), F.nullif(F.array_position(F.array(*map(F.lit, ROUNDS)), F.col("round_name")), F.lit(0).cast("bigint")).cast("int") - 1)
    fixtures = first.select("fixture_id", "event_id", "round_name", order.alias("round_order"), F.col("f.d").alias("date_played"), "rubbers")
    return {"rubbers": rubbers, "fixtures": fixtures, "quarantined": one.where("reason is not null").select("row_id", "event_id", "reason")}


def status_on(day: Column) -> Column:
    """An event's status on a day, from its columns published, starts, ends, deadline and results_on (nulls: unknown)."""
    ends = F.coalesce("ends", "starts")
    by_day = (
        F.when(F.col("results_on") <= day, "completed")
        .when(day > ends, "awaiting_results")
        .when(day >= F.col("starts"), "in_progress")
        .when(F.col("deadline").isNotNull(), F.when(day <= F.col("deadline"), "entries_open").otherwise("entries_closed"))
        .otherwise("upcoming")
    )
    return F.when(F.col("published").isin("cancelled", "postponed"), F.col("published")).otherwise(by_day)


def lifecycle(snapshots: DataFrame) -> DataFrame:
    """event_id, as_of, published, starts, ends, deadline, results_on (as known on as_of) -> event_id, as_of, status.

    Status goes forward only: an event that is completed stays so, and one that has begun
    doesn't reopen its entries, whatever later snapshots say of its dates.  Cancelled and postponed hold while
    they are published.  Repeated (event_id, as_of): the furthest status.
    """
    place = F.array_position(F.array(*map(F.lit, FORWARD)), status_on(F.col("as_of")))
    one = snapshots.withColumn("place", place).groupBy("event_id", "as_of").agg(F.max("place").alias("place"), F.max(F.when(F.col("place") == 0, F.col("published"))).alias("off"))
    far = F.max("place").over(Window.partitionBy("event_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("far", far)
    done = F.col("far") == len(FORWARD)
    status = F.when(~done & F.col("off").isNotNull() & (F.col("place") == 0), F.col("off")).otherwise(F.element_at(F.array(*map(F.lit, FORWARD)), F.greatest(F.col("far"), F.lit(1)).cast("int")))
    return one.select("event_id", "as_of", status.alias("status"))
