"""A player's insights: months and peaks, splits, form with its class, milestones and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sides import singles
from ..sources.adapter import Domain
from .catalog import query
from .details import PERCENT_SQL, _percent
from .players import RUNS_SQL, n_if, runs

#: Least matches of a season and of a month that count for peaks, milestones, and rates from which form is hot or steady.
SEASON_MIN, MONTH_MIN, MILESTONES, HOT, STEADY, NEW = 5, 3, (50, 100, 250, 500, 1000), 70, 45, 5


def _played(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("played"), n_if("won").alias("wins")).withColumn("win_rate", _percent(F.col("wins"), F.col("played")))


def _played_sql(by: str, name: str, source: str = "singles") -> str:
    return f"(SELECT player_id, {by} AS {name}, count(*) AS played, count(*) FILTER (WHERE won) AS wins, {PERCENT_SQL.format('count(*) FILTER (WHERE won)', 'count(*)')} AS win_rate FROM {source} GROUP BY player_id, {by})"


MONTH_SQL = "strftime(day, '%Y-%m')"


@query("q13_months", f"SELECT * FROM {_played_sql(MONTH_SQL, 'month')}")
def months(d: Domain) -> DataFrame:
    """Each player's months with the share of matches won."""
    return _played(singles(d), "player_id", F.date_format("day", "yyyy-MM").alias("month"))


@query("q13_peaks", f"""WITH y AS {_played_sql("year(day)", "year")}, m AS {_played_sql(MONTH_SQL, "month")},
    yr AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played >= 5 DESC, win_rate DESC, played DESC, year) AS best, row_number() OVER (PARTITION BY player_id ORDER BY played DESC, win_rate DESC, year) AS active FROM y),
    mr AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY win_rate DESC, played DESC, month) AS best, row_number() OVER (PARTITION BY player_id ORDER BY win_rate, played DESC, month) AS worst FROM m WHERE played >= 3)
    SELECT b.player_id, CAST(b.year AS INTEGER) AS best_year, b.played AS best_year_played, b.win_rate AS best_year_rate, CAST(a.year AS INTEGER) AS active_year, a.played AS active_year_played, h.month AS best_month, h.win_rate AS best_month_rate, l.month AS worst_month, l.win_rate AS worst_month_rate
    FROM yr b JOIN yr a ON a.player_id = b.player_id AND a.active = 1 LEFT JOIN mr h ON h.player_id = b.player_id AND h.best = 1 LEFT JOIN mr l ON l.player_id = b.player_id AND l.worst = 1 WHERE b.best = 1""")
def peaks(d: Domain) -> DataFrame:
    """Best year (of those with five matches, of all where there is none such), busiest year, best and worst month of three matches or more."""
    s = singles(d)
    row = F.struct("year", "played", "win_rate")
    enough = (F.col("played") >= SEASON_MIN).cast("int")
    y = _played(s, "player_id", F.year("day").alias("year")).groupBy("player_id").agg(F.max_by(row, F.struct(enough, "win_rate", "played", -F.col("year"))).alias("b"), F.max_by(row, F.struct("played", "win_rate", -F.col("year"))).alias("a"))
    back = -F.year("first") * 12 - F.month("first")
    m = _played(s, "player_id", F.to_date(F.date_trunc("month", "day")).alias("first")).where(F.col("played") >= MONTH_MIN)
    named = F.struct(F.date_format("first", "yyyy-MM").alias("month"), "win_rate")
    m = m.groupBy("player_id").agg(F.max_by(named, F.struct("win_rate", "played", back)).alias("h"), F.max_by(named, F.struct(-F.col("win_rate"), "played", back)).alias("l"))
    part = lambda c, f, name: F.col(f"{c}.{f}").alias(name)
    return y.join(m, "player_id", "left").select("player_id", part("b", "year", "best_year"), part("b", "played", "best_year_played"), part("b", "win_rate", "best_year_rate"), part("a", "year", "active_year"), part("a", "played", "active_year_played"), part("h", "month", "best_month"), part("h", "win_rate", "best_month_rate"), part("l", "month", "worst_month"), part("l", "win_rate", "worst_month_rate"))


@query("q15_splits", f"""WITH s AS (SELECT player_id, 'league' AS kind, league_id AS part, won FROM singles UNION ALL SELECT player_id, 'division', division, won FROM singles),
    p AS (SELECT player_id, kind, part, count(*) AS played, {PERCENT_SQL.format("count(*) FILTER (WHERE won)", "count(*)")} AS win_rate FROM s GROUP BY player_id, kind, part)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, kind ORDER BY played DESC, win_rate DESC, part) AS place FROM p) WHERE place <= 6""")
def splits(d: Domain) -> DataFrame:
    """Each player's six most played leagues and divisions."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("part"))
    p = _played(singles(d).select("player_id", "won", F.inline(F.array(part("league", "league_id"), part("division", "division")))), "player_id", "kind", "part").drop("wins")
    place = F.row_number().over(Window.partitionBy("player_id", "kind").orderBy(F.desc("played"), F.desc("win_rate"), "part"))
    return p.withColumn("place", place.cast("bigint")).where("place <= 6")


@query("w13_momentum", f"""WITH r AS (SELECT player_id, won, row_number() OVER (PARTITION BY player_id ORDER BY day DESC, rubber_id DESC, side DESC) AS n FROM singles),
    a AS (SELECT player_id, count(*) FILTER (WHERE n <= 10) AS last_10, {PERCENT_SQL.format("count(*) FILTER (WHERE won AND n <= 10)", "count(*) FILTER (WHERE n <= 10)")} AS rolling_10, {PERCENT_SQL.format("count(*) FILTER (WHERE won)", "count(*)")} AS rolling_20, string_agg(CASE WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY n) AS results FROM r WHERE n <= 20 GROUP BY player_id)
    SELECT player_id, rolling_10, rolling_20, CASE WHEN last_10 < 5 THEN 'new' WHEN rolling_10 >= 70 THEN 'hot' WHEN rolling_10 >= 45 THEN 'steady' ELSE 'cold' END AS momentum, results FROM a""")
def momentum(d: Domain) -> DataFrame:
    """The last ten and twenty matches, the class of the ten, and the results from the latest on."""
    n = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("day"), F.desc("rubber_id"), F.desc("side")))
    r = singles(d).select("player_id", "won", n.alias("n")).where("n <= 20")
    results = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.when(F.col("won"), "W").otherwise("L").alias("w")))), lambda s: s["w"]), "")
    a = r.groupBy("player_id").agg(n_if("n <= 10").alias("last_10"), n_if("won and n <= 10").alias("won_10"), F.count("*").alias("last_20"), n_if("won").alias("won_20"), results.alias("results"))
    a = a.withColumns({"rolling_10": _percent(F.col("won_10"), F.col("last_10")), "rolling_20": _percent(F.col("won_20"), F.col("last_20"))})
    kind = F.when(F.col("last_10") < NEW, "new").when(F.col("rolling_10") >= HOT, "hot").when(F.col("rolling_10") >= STEADY, "steady").otherwise("cold")
    return a.select("player_id", "rolling_10", "rolling_20", kind.alias("momentum"), "results")


@query("q16_milestones", f"""{RUNS_SQL}, longest AS (SELECT player_id, max(length) AS longest FROM r WHERE won GROUP BY player_id), today AS (SELECT max(day) AS today FROM singles),
    t AS (SELECT player_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS season, count(*) FILTER (WHERE is_active AND won) AS season_wins, min(day) FILTER (WHERE is_active) AS began FROM singles LEFT JOIN (SELECT season_id, is_active FROM seasons) USING (season_id) GROUP BY player_id),
    e AS (SELECT *, CASE WHEN season > 0 THEN {PERCENT_SQL.format("season_wins", "season")} ELSE 0 END AS rate, greatest(1, datediff('day', began, today)) AS days FROM t CROSS JOIN today)
    SELECT player_id, total AS total_matches, coalesce(longest, 0) AS longest_win_streak, concat_ws(',', CASE WHEN total >= 50 THEN '50' END, CASE WHEN total >= 100 THEN '100' END, CASE WHEN total >= 250 THEN '250' END, CASE WHEN total >= 500 THEN '500' END, CASE WHEN total >= 1000 THEN '1000' END) AS milestones,
        season AS season_matches, rate AS season_win_rate, CASE WHEN season = 0 THEN 0 ELSE greatest(season, (730 * season + days) // (2 * days)) END AS projected_matches, rate >= 70 AS on_track FROM e LEFT JOIN longest USING (player_id)""")
def milestones(d: Domain) -> DataFrame:
    """Totals passed, the longest run of wins, and what the active season comes to in a year at its pace up to the last day of all."""
    s = singles(d)
    longest = runs(s).where("won").groupBy("player_id").agg(F.max("length").alias("longest"))
    active = F.broadcast(d.seasons.where("is_active").select("season_id", F.lit(True).alias("active")))  # a row a league
    t = s.join(active, "season_id", "left").groupBy("player_id").agg(F.count("*").alias("total"), n_if("active").alias("season"), n_if("active and won").alias("wins"), F.min(F.when(F.col("active"), F.col("day"))).alias("began"))
    t = t.crossJoin(F.broadcast(s.agg(F.max("day").alias("today")))).join(longest, "player_id", "left")
    days = F.greatest(F.lit(1), F.datediff("today", "began")).cast("bigint")
    rate = F.when(F.col("season") > 0, _percent(F.col("wins"), F.col("season"))).otherwise(F.lit(0).cast("bigint"))
    pace = F.floor((730 * F.col("season") + days) / (2 * days)).cast("bigint")
    hits = F.array_join(F.filter(F.array(*map(F.lit, MILESTONES)), lambda m: m <= F.col("total")).cast("array<string>"), ",")
    return t.select("player_id", F.col("total").alias("total_matches"), F.coalesce("longest", F.lit(0).cast("bigint")).alias("longest_win_streak"), hits.alias("milestones"), F.col("season").alias("season_matches"), rate.alias("season_win_rate"), F.when(F.col("season") == 0, F.lit(0).cast("bigint")).otherwise(F.greatest("season", pace)).alias("projected_matches"), (rate >= 70).alias("on_track"))
