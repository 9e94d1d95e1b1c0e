"""The rating fold: Glicko-2 over dates, each player's opponents taken from before the date.

Days follow each other, but within a day players are independent, as all are rated
against states from before it.  The fold goes over runs of days.  Every row of a match and
side is told beforehand the next run that its player takes part in, so a run hands each
player's state to that run's folder and no run reads or rewrites the states of players
that it doesn't rate: what is read and written grows with the matches alone.  Between runs
rows are packed (`packed`), as a run's one task would else spend most of its time on moving
single rows; packing and unpacking is done by many tasks.

A day with more than BLOCK matches is one step of joins and groupings: its matches meet
both players' states, what each match tells is summed by player (partly before the
shuffle), and one small update a player follows.  Shorter days are folded together, up to
BLOCK matches, as one group of bounded size, a day at a time in whole columns.  So no
group grows with the data, and the number of steps is at most that of the dates.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.glicko import INITIAL_DEVIATION, INITIAL_RATING, INITIAL_VOLATILITY, PERIOD_DAYS, SCALE, State, expected_score, g_of, inflate, inflated_deviation, predicted, settled_all, update
from ..sources.staging import dropped, found, new_folder, parts_of, removed, written

#: Matches of a run of days that are folded as one group; bounds a task's memory (by estimate some 300 MB, not measured).
BLOCK = 500_000
PERIODS = "player_id long, day date, matches int, wins int, losses int, rating_before double, deviation_before double, rating double, deviation double, volatility double, total_matches int, total_wins int"
STATES = "window int, player_id long, rating double, deviation double, volatility double, day date, total_matches int, total_wins int"
#: A side of a match, with the next run of its player (NO_RUN: none).
SIDES = "window int, day date, player_id long, other long, won boolean, next int"
#: In a written run: no run rates the player again; the player has a later row in the same run.
NO_RUN, SAME_RUN = 0, -1
#: Rows that are packed as one, at most, and what packed rows of a run hold.
PACK = 65_536
PACKED_SIDES, PACKED_PERIODS = f"{SIDES}, run int", f"window int, {PERIODS}, next int"


def fold(rows: pd.DataFrame, state: dict | None = None) -> tuple[pd.DataFrame, dict]:
    """rows: day, home, away, home_won -> PERIODS, and the states behind them: player -> (State, last day, matches, wins).  Match by match: what runs are tested against."""
    state, out = dict(state or {}), []
    for day, part in rows.groupby("day", sort=True):
        before = {}
        for p in pd.unique(part[["home", "away"]].to_numpy().ravel()):
            s, last, *_ = state.get(p, (State(), None, 0, 0))
            before[p] = s if last is None else inflate(s, (day - last).days - 1)
        seen: dict = {}
        for h, a, won in zip(part["home"], part["away"], part["home_won"]):
            seen.setdefault(h, []).append((before[a].rating, before[a].deviation, float(won)))
            seen.setdefault(a, []).append((before[h].rating, before[h].deviation, float(not won)))
        for p in sorted(seen):
            new, wins = update(before[p], sorted(seen[p])), sum(int(x[2]) for x in seen[p])
            _, _, n, w = state.get(p, (None, None, 0, 0))
            state[p] = (new, day, n + len(seen[p]), w + wins)
            out.append((p, day, len(seen[p]), wins, len(seen[p]) - wins, before[p].rating, before[p].deviation, new.rating, new.deviation, new.volatility, n + len(seen[p]), w + wins))
    return pd.DataFrame(out, columns=[x.split()[0] for x in PERIODS.split(", ")]), state


def _runs(days: list[tuple[date, int]], block: int) -> list[tuple[date, date, int]]:
    """(first day, last day, matches) of runs of days with at most `block` matches, longer days alone."""
    out: list[tuple[date, date, int]] = []
    for day, n in days:
        if out and out[-1][2] + n <= block:
            out[-1] = (out[-1][0], day, out[-1][2] + n)
        else:
            out.append((day, day, n))
    return out


EPOCH = date(1970, 1, 1)
_RUN_COLUMNS = ["player_id", "day", "matches", "wins", "losses", "rating_before", "deviation_before", "rating", "deviation", "volatility", "total_matches", "total_wins", "next"]


def fold_sides(sides: dict[str, np.ndarray], before: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Both sides of every match of a run (day and last day in days since 1970), and states from before it -> the columns of PERIODS with the next run of each row."""
    me, ids = pd.factorize(sides["player_id"], sort=True)
    on, days = pd.factorize(sides["day"], sort=True)
    n = len(ids)
    coming = np.empty(n, "int64")
    coming[me] = sides["next"]  # all rows of a player tell the same
    # one number tells day, player, opponent and result: sorted by it, sums don't depend on the order of rows
    key = np.sort(((on * n + me) * n + pd.Index(ids).get_indexer(sides["other"])) * 2 + sides["won"])
    won, other, period = (key % 2).astype(float), key // 2 % n, key // (2 * n)
    starts = np.flatnonzero(np.r_[True, period[1:] != period[:-1]])
    on, who = np.divmod(period[starts], n)
    played = np.diff(np.r_[starts, len(key)])
    wins = np.add.reduceat(won, starts).astype("int64")
    me = period % n
    rating, deviation, volatility, g_now = np.full(n, INITIAL_RATING), np.full(n, INITIAL_DEVIATION), np.full(n, INITIAL_VOLATILITY), np.empty(n)
    last, matches, won_by = np.full(n, -1 << 30), np.zeros(n, "int64"), np.zeros(n, "int64")
    at = np.searchsorted(ids, before["player_id"])
    for mine, c in ((rating, "rating"), (deviation, "deviation"), (volatility, "volatility"), (last, "day"), (matches, "total_matches"), (won_by, "total_wins")):
        mine[at] = before[c]
    out = {c: np.empty(len(starts)) for c in ("rating_before", "deviation_before", "rating", "deviation", "volatility")} | {c: np.empty(len(starts), "int64") for c in ("total_matches", "total_wins")}
    cuts = np.searchsorted(on, np.arange(len(days) + 1))  # of periods by day
    ends = np.r_[starts, len(key)]
    for today, i, j in zip(days.tolist(), cuts, cuts[1:]):
        a, b, p = ends[i], ends[j], who[i:j]
        c, o, y, s = me[a:b], other[a:b], won[a:b], starts[i:j] - a
        idle = np.where(last[p] == -1 << 30, 0, today - last[p] - 1)
        wide = SCALE * np.minimum(INITIAL_DEVIATION / SCALE, np.sqrt((deviation[p] / SCALE) ** 2 + volatility[p] ** 2 * np.maximum(0, idle) / PERIOD_DAYS))
        was, g_now[p] = rating[p], 1 / np.sqrt(1 + 3 * (wide / SCALE) ** 2 / np.pi**2)
        g = g_now[o]  # opponents are rated today too
        e = 1 / (1 + np.exp(-g * (rating[c] - rating[o]) / SCALE))
        new = settled_all(was, wide, volatility[p], np.add.reduceat(g * g * e * (1 - e), s), np.add.reduceat(g * (y - e), s))
        rating[p], deviation[p], volatility[p] = new
        last[p] = today
        matches[p] += played[i:j]
        won_by[p] += wins[i:j]
        for column, x in zip(out.values(), (was, wide, *new, matches[p], won_by[p])):
            column[i:j] = x
    latest = np.empty(n, "int64")
    latest[who] = np.arange(len(who))
    out |= {"player_id": ids[who], "day": days[on], "matches": played, "wins": wins, "losses": played - wins}
    out["next"] = np.where(latest[who] == np.arange(len(who)), coming[who], SAME_RUN)
    return {c: out[c] for c in _RUN_COLUMNS}


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}


def _packed_rows(rows: pa.Table, by: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each value of `by` and at most PACK rows that have it: the values and those rows as one Arrow stream."""
    keys = np.stack([rows[c].to_numpy() for c in by])
    if (keys != keys[:, :1]).any():
        order = np.lexsort(keys[::-1])
        rows, keys = rows.take(pa.array(order)), keys[:, order]
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        for i in range(a, b, PACK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(rows.slice(i, min(PACK, b - i)).combine_chunks())
            yield pa.record_batch([rows[c].slice(i, 1).combine_chunks() for c in by] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*by, "rows"])


def _unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch["rows"]:
            yield from pa.ipc.open_stream(rows.as_buffer())


def packed(df: DataFrame, *by: str) -> DataFrame:
    """df in few rows (see _packed_rows), so that a single task has little to do with each of its rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _packed_rows(pa.Table.from_batches([batch]), list(by))

    return df.mapInArrow(pack, ", ".join([f"{c} int" for c in by] + ["rows binary"]))


def unpacked(df: DataFrame, schema: str) -> DataFrame:
    return df.select("rows").mapInArrow(_unpacked_rows, schema)


def _folded(sides: DataFrame, before: DataFrame, windows: int) -> DataFrame:
    """A short run of days: one group for each window, of its packed sides and states.  Packed rows by window and next run."""
    names = pa.schema([(c, _KINDS[t]) for c, t in (x.split() for x in PACKED_PERIODS.split(", "))])

    def run(held: pa.Table) -> pa.Table:
        def of(is_state: bool, *columns: str) -> dict[str, np.ndarray]:
            rows = list(_unpacked_rows(held.filter(held["is_state"] if is_state else pc.invert(held["is_state"])).to_batches()))
            rows = pa.Table.from_batches(rows) if rows else names.empty_table()
            return {c: (rows[c].cast(pa.int32()) if c == "day" else rows[c]).to_numpy() for c in columns if c in rows.column_names}

        sides = of(False, "player_id", "day", "other", "won", "next")
        if not len(sides["day"]):
            return pa.schema([("window", pa.int32()), ("next", pa.int32()), ("rows", pa.binary())]).empty_table()
        out = fold_sides(sides, of(True, "player_id", "day", "rating", "deviation", "volatility", "total_matches", "total_wins"))
        out |= {"day": out["day"].astype("int32"), "window": np.full(len(out["day"]), held["window"][0].as_py())}
        return pa.Table.from_batches(_packed_rows(pa.table([pa.array(out[f.name]).cast(f.type) for f in names], schema=names), ["window", "next"]))

    both = sides.select("window", F.lit(False).alias("is_state"), "rows").union(before.select("window", F.lit(True), "rows"))
    return both.repartition(windows, "window").groupBy("window").applyInArrow(run, "window int, next int, rows binary")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("rating", "deviation", "volatility")]))
def _settled(rating: pd.Series, deviation: pd.Series, volatility: pd.Series, information: pd.Series, gain: pd.Series) -> pd.DataFrame:
    new = settled_all(*(x.to_numpy() for x in (rating, deviation, volatility, information, gain)))
    return pd.DataFrame(dict(zip(("rating", "deviation", "volatility"), new)))


def _one_day(sides: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A day of any size, by joins and groupings; with the table of states that it has written."""
    both = sides.withColumn("won", F.col("won").cast("double"))
    known = both.select("window", "player_id", F.col("day").alias("on")).distinct().join(before, ["window", "player_id"], "left")
    wide = inflated_deviation(F.col("deviation"), F.col("volatility"), F.datediff("on", "day") - 1)
    start = written(known.select("window", "player_id", F.coalesce("rating", F.lit(INITIAL_RATING)).alias("r"), F.coalesce(wide, F.lit(INITIAL_DEVIATION)).alias("d"), F.coalesce("volatility", F.lit(INITIAL_VOLATILITY)).alias("v"), F.coalesce("total_matches", F.lit(0)).alias("n"), F.coalesce("total_wins", F.lit(0)).alias("w")))
    theirs = start.select("window", F.col("player_id").alias("other"), F.col("r").alias("o_r"), F.col("d").alias("o_d"))
    met = both.join(theirs, ["window", "other"]).join(start, ["window", "player_id"])
    e, g = expected_score(F.col("r"), F.col("o_r"), F.col("o_d")), g_of(F.col("o_d"))
    told = met.groupBy("window", "player_id", "day").agg(F.count("*").alias("matches"), F.sum("won").alias("wins"), F.sum(g * g * e * (1 - e)).alias("information"), F.sum(g * (F.col("won") - e)).alias("gain"), F.max("next").alias("next"))
    new = told.join(start, ["window", "player_id"]).withColumn("s", _settled("r", "d", "v", "information", "gain"))
    whole = lambda c: c.cast("int")
    out = new.select("window", "player_id", "day", whole(F.col("matches")).alias("matches"), whole(F.col("wins")).alias("wins"), whole(F.col("matches") - F.col("wins")).alias("losses"), F.col("r").alias("rating_before"), F.col("d").alias("deviation_before"), "s.rating", "s.deviation", "s.volatility", whole(F.col("n") + F.col("matches")).alias("total_matches"), whole(F.col("w") + F.col("wins")).alias("total_wins"), "next")
    return out, start


def window_periods(matches: DataFrame, states: DataFrame | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """matches: window, day, home, away, home_won -> (window and PERIODS, a row for each player and day with matches; STATES behind the last day).

    states: STATES to go on from, all from before the first day; a replay from a checkpoint.
    """
    spark, block = matches.sparkSession, block or BLOCK
    matches = written(matches.select(F.col("window").cast("int").alias("window"), "day", "home", "away", "home_won").where("day is not null and home is not null and away is not null and home_won is not null"))
    sizes = matches.groupBy("window", "day").count().groupBy("day").agg(F.max("count").alias("n"))
    days = [(r["day"], r["n"]) for r in sizes.orderBy("day").collect()]  # a row a date
    runs = _runs(days, block)
    starts = [first for first, *_ in runs]
    run_of = spark.createDataFrame([(day, bisect_right(starts, day)) for day, _ in days], "day date, run int")
    sides = _sides(matches, run_of, max(1, len(runs)), max(4, -(-max((n for *_, n in runs), default=0) // block)))
    path, stored = new_folder(spark, "periods"), "window int, rows binary"
    columns = [x.split() for x in PACKED_PERIODS.split(", ")]
    write = lambda rows, no: packed(rows.select(*(F.col(c).cast(t).alias(c) for c, t in columns)), "window", "next").write.partitionBy("next").mode("append").parquet(f"{path}/run={no}")
    spark.createDataFrame([], stored).write.parquet(f"{path}/run=0/next={NO_RUN}")
    if states is not None:  # states from before the first run go to the first one of their player, too
        first = matches.select("window", F.explode(F.array("home", "away")).alias("player_id"), "day").groupBy("window", "player_id").agg(F.min("day").alias("on"))
        first = first.join(F.broadcast(run_of.withColumnRenamed("day", "on")), "on").select("window", "player_id", F.col("run").alias("next"))
        given = states.join(first, ["window", "player_id"], "left").withColumn("next", F.coalesce("next", F.lit(NO_RUN)))
        write(given.select(*(F.col(c) if c in given.columns else F.lit(None).cast(t).alias(c) for c, t in columns)), 0)
    for no, (_, _, n) in enumerate(runs, 1):
        at = f"{sides}/run={no}"
        handed = found(spark, f"{path}/run=*/next={no}")
        before = spark.read.schema(stored).parquet(*handed) if handed else spark.createDataFrame([], stored)
        part = spark.read.schema(stored).parquet(at)
        if n <= block:
            _folded(part, before, len(parts_of(spark, at, "window"))).write.partitionBy("next").parquet(f"{path}/run={no}")
        else:
            state = unpacked(before, PACKED_PERIODS).select(*(c.split()[0] for c in STATES.split(", ")))
            out, used = _one_day(unpacked(part, PACKED_SIDES), state)
            write(out, no)
            dropped(used)
    removed(spark, sides)
    dropped(matches)
    rows = spark.read.schema(f"{stored}, next int, run int").parquet(path)
    return unpacked(rows.where("run > 0"), PACKED_PERIODS).drop("next"), unpacked(rows.where(F.col("next") == NO_RUN), PACKED_PERIODS).select(*(c.split()[0] for c in STATES.split(", ")))


def _sides(matches: DataFrame, run_of: DataFrame, runs: int, tasks: int) -> str:
    """Writes SIDES by run and window, each row with the next run of its player; the folder.  runs: how many there are; tasks: into how many parts each is cut, by player."""
    path = new_folder(matches.sparkSession, "sides")
    row = lambda me, other, won: F.struct(F.col(me).alias("player_id"), F.col(other).alias("other"), won.alias("won"))
    both = matches.join(F.broadcast(run_of), "day").select("run", "window", "day", F.explode(F.array(row("home", "away", F.col("home_won")), row("away", "home", ~F.col("home_won")))).alias("s")).select("run", "window", "day", "s.*")
    later = Window.partitionBy("window", "player_id").orderBy(F.desc("run")).rangeBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("next", F.coalesce(F.min("run").over(later), F.lit(NO_RUN)))
    told = told.select(*(c.split()[0] for c in PACKED_SIDES.split(", "))).repartition(runs * tasks, "run", "window", F.pmod(F.xxhash64("player_id"), F.lit(tasks))).sortWithinPartitions("run", "window")
    packed(told, "run", "window").write.partitionBy("run", "window").parquet(path)
    return path


def rating_periods(matches: DataFrame, block: int | None = None) -> DataFrame:
    """matches: day, home, away, home_won -> PERIODS, a row for each player and day with matches."""
    return window_periods(matches.withColumn("window", F.lit(0)), None, block)[0].drop("window")


def weekly_ratings(periods: DataFrame) -> DataFrame:
    """PERIODS -> player_id, week (its Monday), rating, deviation and matches behind the week, change in the week, week's matches and wins."""
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    of = periods.groupBy("player_id", week).agg(F.max_by(F.struct("rating", "deviation", "volatility", "total_matches", "day"), "day").alias("s"), F.min_by("rating_before", "day").alias("start"), F.sum("matches").alias("week_matches"), F.sum("wins").alias("week_wins"))
    return of.select("player_id", "week", "s.rating", "s.deviation", "s.volatility", F.col("s.total_matches").cast("long").alias("matches"), F.col("s.day").alias("last_day"), (F.col("s.rating") - F.col("start")).alias("change"), "week_matches", "week_wins")


def latest(periods: DataFrame) -> DataFrame:
    """The state of each player behind their last day."""
    cols = ["rating", "deviation", "volatility", "total_matches", "total_wins", "day"]
    return periods.groupBy("player_id").agg(F.max_by(F.struct(*cols), "day").alias("s")).select("player_id", "s.*").withColumn("conservative", F.col("rating") - 2 * F.col("deviation"))


def backtest(matches: DataFrame, windows: list[int], evaluated_days: int = 180, block: int | None = None) -> DataFrame:
    """For each training window (years): predictions of the last days from states before each day.

    window, day, probability (clipped), home_won, cold_start.  The windows are folded side
    by side; a prediction joins a match to both players' states from before its day.
    """
    end = matches.agg(F.max("day").alias("end"))
    each = matches.crossJoin(F.broadcast(end)).withColumn("window", F.explode(F.array(*map(F.lit, windows)))).where(F.col("day") > F.add_months("end", -12 * F.col("window")))
    p = window_periods(each, None, block)[0]
    side = lambda who: p.select("window", "day", F.col("player_id").alias(who), F.struct(F.col("rating_before").alias("r"), F.col("deviation_before").alias("d"), (F.col("total_matches") == F.col("matches")).alias("new")).alias(f"{who}_s"))
    late = each.where(F.datediff("end", "day") < evaluated_days).join(side("home"), ["window", "day", "home"]).join(side("away"), ["window", "day", "away"])
    chance = predicted(F.col("home_s.r"), F.col("home_s.d"), F.col("away_s.r"), F.col("away_s.d"))
    return late.select("window", "day", F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), chance)).alias("probability"), "home_won", (F.col("home_s.new") | F.col("away_s.new")).alias("cold_start"))


def report(predictions: DataFrame) -> DataFrame:
    """Brier score, log loss, accuracy and calibration error of each window."""
    y = F.col("home_won").cast("double")
    p = F.col("probability")
    right = (p >= 0.5) == F.col("home_won")
    bucket = F.least(F.lit(9), F.floor(p * 10)).alias("bucket")
    cells = predictions.groupBy("window", bucket).agg(F.count("*").alias("n"), F.sum(F.pow(p - y, F.lit(2))).alias("brier"), F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), F.sum(right.cast("int")).alias("right"), F.sum(F.col("cold_start").cast("int")).alias("cold"), F.abs(F.sum(p) - F.sum(y)).alias("off"))
    n = F.sum("n")
    return cells.groupBy("window").agg(n.alias("matches"), (F.sum("brier") / n).alias("brier"), (F.sum("loss") / n).alias("log_loss"), (F.sum("right") / n).alias("accuracy"), (F.sum("off") / n).alias("calibration_error"), F.sum("cold").alias("cold_starts"))


