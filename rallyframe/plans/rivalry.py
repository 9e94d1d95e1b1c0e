"""Head-to-head queries: pairs, rivals, common opponents, form and rating change of the two busiest players."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sides import focus, rate, sides, singles
from ..sources.adapter import Domain
from .catalog import query
from .players import n_if, pct


def _focused(d: Domain, of) -> DataFrame:
    """Matches of the two busiest players, tagged k = 1 and 2."""
    return of.join(F.broadcast(focus(d)), "player_id")


@query("q21_pair_list", """SELECT s.rubber_id, s.day, s.player_id, s.opponent_id, own, opp, CASE WHEN won THEN 'W' ELSE 'L' END AS result, count(*) FILTER (WHERE won) OVER () AS wins
    FROM sides s WHERE player_id = (SELECT player_id FROM focus WHERE k = 1) AND opponent_id = (SELECT opponent_id FROM (SELECT opponent_id, count(*) AS n FROM singles WHERE player_id = (SELECT player_id FROM focus WHERE k = 1) AND opponent_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, opponent_id LIMIT 1))""")
def pair_list(d: Domain) -> DataFrame:
    """All meetings of the busiest player with their most frequent opponent, whatever the outcome, and the wins."""
    mine = sides(d).join(F.broadcast(focus(d, 1).select("player_id")), "player_id", "left_semi")
    top = mine.where("opponent_id is not null and not is_doubles and outcome <> 'walkover'").groupBy("opponent_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "opponent_id").limit(1)
    meet = mine.join(F.broadcast(top.select("opponent_id")), "opponent_id", "left_semi")
    return meet.select("rubber_id", "day", "player_id", "opponent_id", "own", "opp", F.when(F.col("won"), "W").otherwise("L").alias("result")).crossJoin(F.broadcast(meet.agg(n_if("won").alias("wins"))))


RIVALS_SQL = f"""WITH m AS (
        SELECT player_id, opponent_id, won, row_number() OVER (PARTITION BY player_id, opponent_id ORDER BY day, rubber_id, side) AS n, count(*) OVER (PARTITION BY player_id, opponent_id) AS played FROM singles WHERE opponent_id IS NOT NULL
    ), a AS (
        SELECT player_id, opponent_id, played, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE won AND n <= played // 2) AS early_wins, played // 2 AS early, count(*) FILTER (WHERE won AND n > played // 2) AS late_wins FROM m GROUP BY player_id, opponent_id, played HAVING played >= 3
    ), b AS (
        SELECT *, {pct("wins", "played")} AS win_rate, CAST(late_wins AS DOUBLE) / (played - early) - CAST(early_wins AS DOUBLE) / early AS gain FROM a
    ), t AS (
        SELECT 'toughest' AS kind, *, row_number() OVER (PARTITION BY player_id ORDER BY win_rate, played DESC, opponent_id) AS place FROM b
        UNION ALL SELECT 'easiest', *, row_number() OVER (PARTITION BY player_id ORDER BY win_rate DESC, played DESC, opponent_id) FROM b
        UNION ALL SELECT 'improving', *, row_number() OVER (PARTITION BY player_id ORDER BY gain DESC, played DESC, opponent_id) FROM b WHERE gain > 0
    )"""


@query("q22_rivals", RIVALS_SQL + " SELECT kind, player_id, opponent_id, played, wins, win_rate, place FROM t WHERE place <= 4")
def rivals(d: Domain) -> DataFrame:
    """For every player the four toughest, easiest and most improving opponents met three times or more."""
    pair = Window.partitionBy("player_id", "opponent_id")
    m = singles(d).where("opponent_id is not null").select("player_id", "opponent_id", "won", F.row_number().over(pair.orderBy("day", "rubber_id", "side")).alias("n"), F.count("*").over(pair).alias("played"))
    early = F.floor(F.col("played") / 2)
    a = m.where("played >= 3").groupBy("player_id", "opponent_id", "played").agg(n_if("won").alias("wins"), n_if(F.col("won") & (F.col("n") <= early)).alias("early_wins"), n_if(F.col("won") & (F.col("n") > early)).alias("late_wins"))
    a = a.withColumn("win_rate", rate(F.col("wins"), F.col("played"))).withColumn("gain", F.col("late_wins") / (F.col("played") - early) - F.col("early_wins") / early)
    mine = Window.partitionBy("player_id")
    place = lambda *by: F.row_number().over(mine.orderBy(*by, F.desc("played"), "opponent_id"))
    kinds = [("toughest", place("win_rate"), F.lit(True)), ("easiest", place(F.desc("win_rate")), F.lit(True)), ("improving", place(F.desc("gain")), F.col("gain") > 0)]
    ranked = a.withColumns({k: p for k, p, _ in kinds})
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.when(ok, F.col(k)).alias("place")) for k, _, ok in kinds)))
    return ranked.select("*", each.alias("t")).where("t.place <= 4").select("t.kind", "player_id", "opponent_id", "played", "wins", "win_rate", F.col("t.place").cast("bigint").alias("place"))


COMMON_SQL = f"""WITH a AS (SELECT f.k, opponent_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins, max(day) AS last_day FROM singles s JOIN focus f USING (player_id)
        WHERE f.k <= 2 AND opponent_id IS NOT NULL AND opponent_id NOT IN (SELECT player_id FROM focus WHERE k <= 2) GROUP BY ALL),
    c AS (SELECT x.opponent_id, x.played AS played_1, x.wins AS wins_1, y.played AS played_2, y.wins AS wins_2, {pct("x.wins", "x.played")} AS rate_1, {pct("y.wins", "y.played")} AS rate_2, greatest(x.last_day, y.last_day) AS last_day
        FROM a x JOIN a y USING (opponent_id) WHERE x.k = 1 AND y.k = 2)"""


def common_opponents(d: Domain) -> DataFrame:
    """Opponents that both have met, from one grouping with conditional sums in place of a self-join."""
    f = focus(d)
    m = _focused(d, singles(d)).where("opponent_id is not null").join(F.broadcast(f.select(F.col("player_id").alias("opponent_id"))), "opponent_id", "left_anti")
    of = lambda k: (n_if(F.col("k") == k).alias(f"played_{k}"), n_if((F.col("k") == k) & F.col("won")).alias(f"wins_{k}"))
    a = m.groupBy("opponent_id").agg(*of(1), *of(2), F.max("day").alias("last_day")).where("played_1 > 0 and played_2 > 0")
    return a.withColumns({f"rate_{k}": rate(F.col(f"wins_{k}"), F.col(f"played_{k}")) for k in (1, 2)})


@query("q23_common_summary", COMMON_SQL + """ SELECT count(*) AS opponents, count(*) FILTER (WHERE rate_1 > rate_2) AS better_1, count(*) FILTER (WHERE rate_1 < rate_2) AS better_2, CAST(sum(least(played_1, played_2)) AS BIGINT) AS evidence, round(avg(rate_1), 6) AS mean_1, round(avg(rate_2), 6) AS mean_2 FROM c""")
def common_summary(d: Domain) -> DataFrame:
    return common_opponents(d).agg(F.count("*").alias("opponents"), n_if("rate_1 > rate_2").alias("better_1"), n_if("rate_1 < rate_2").alias("better_2"), F.sum(F.least("played_1", "played_2")).alias("evidence"), F.round(F.avg("rate_1"), 6).alias("mean_1"), F.round(F.avg("rate_2"), 6).alias("mean_2"))


ORDERS = {"edge": "rate_1 - rate_2 DESC", "recent": "last_day DESC", "closest": "abs(rate_1 - rate_2)", "evidence": "least(played_1, played_2) DESC"}


def _common(mode: str) -> None:
    sql_order = ORDERS[mode]

    @query(f"q26_common_by_{mode}", COMMON_SQL + f" SELECT opponent_id, played_1, wins_1, rate_1, played_2, wins_2, rate_2, last_day FROM c ORDER BY {sql_order}, opponent_id LIMIT 21")
    def run(d: Domain) -> DataFrame:
        by = F.expr(sql_order.removesuffix(" DESC"))
        return common_opponents(d).orderBy(by.desc() if sql_order.endswith("DESC") else by, "opponent_id").limit(21).select("opponent_id", "played_1", "wins_1", "rate_1", "played_2", "wins_2", "rate_2", "last_day")


for _k in ORDERS:
    _common(_k)


@query("q24_recent_form", """SELECT player_id, rubber_id, day, opponent_id, won, place FROM (SELECT s.*, row_number() OVER (PARTITION BY s.player_id ORDER BY day DESC, rubber_id DESC, side) AS place FROM singles s JOIN focus f USING (player_id) WHERE f.k <= 2) WHERE place <= 10""")
def recent_form(d: Domain) -> DataFrame:
    w = Window.partitionBy("player_id").orderBy(F.desc("day"), F.desc("rubber_id"), "side")
    return _focused(d, singles(d)).withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 10").select("player_id", "rubber_id", "day", "opponent_id", "won", "place")


# A plain running rating stands in for the fold's output where a query only reads a history: 1500 and 10 for each win more than loss.
HISTORY_SQL = """hist AS (
        SELECT player_id, week, max(running) AS rating, max(n) AS matches, sum(step) AS change FROM (
            SELECT player_id, week, step, n, last_value(running) OVER (PARTITION BY player_id, week ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS running FROM (
                SELECT player_id, CAST(date_trunc('week', day) AS DATE) AS week, CASE WHEN won THEN 10 WHEN lost THEN -10 ELSE 0 END AS step,
                    1500 + sum(CASE WHEN won THEN 10 WHEN lost THEN -10 ELSE 0 END) OVER w AS running, row_number() OVER w AS n
                FROM singles WHERE outcome = 'normal' AND status = 'completed' WINDOW w AS (PARTITION BY player_id ORDER BY day, rubber_id, side))) GROUP BY player_id, week)"""


def weekly(s: DataFrame) -> DataFrame:
    """Tumbling weeks of a running rating: player_id, week, rating behind the week, matches so far, change in the week."""
    w = Window.partitionBy("player_id").orderBy("day", "rubber_id", "side")
    step = F.when(F.col("won"), 10).when(F.col("lost"), -10).otherwise(0)
    r = s.where("outcome = 'normal' and status = 'completed'").select("player_id", F.to_date(F.date_trunc("week", "day")).alias("week"), step.alias("step"), (F.sum(step).over(w) + 1500).alias("running"), F.row_number().over(w).cast("bigint").alias("n"))
    return r.groupBy("player_id", "week").agg(F.max_by("running", "n").alias("rating"), F.max("n").alias("matches"), F.sum("step").alias("change"))


@query("q50_weekly_history", f"WITH {HISTORY_SQL} SELECT player_id, week, CAST(rating AS BIGINT) AS rating, matches, CAST(change AS BIGINT) AS change FROM hist")
def weekly_history(d: Domain) -> DataFrame:
    return weekly(singles(d))


@query("q25_rating_twelve_weeks", f"""WITH {HISTORY_SQL}, last AS (SELECT max(week) AS week FROM hist)
    SELECT player_id, CAST(max_by(rating, week) AS BIGINT) AS rating_now, CAST(max_by(rating, week) FILTER (WHERE week <= (SELECT week FROM last) - 84) AS BIGINT) AS rating_then FROM hist WHERE player_id IN (SELECT player_id FROM focus WHERE k <= 2) GROUP BY player_id""")
def rating_twelve_weeks(d: Domain) -> DataFrame:
    """As-of: the latest rating, and the latest that is twelve weeks old or older."""
    h = weekly(singles(d))
    then = h.agg(F.date_sub(F.max("week"), 84).alias("then"))
    mine = h.join(F.broadcast(focus(d).select("player_id")), "player_id", "left_semi").crossJoin(F.broadcast(then))
    return mine.groupBy("player_id").agg(F.max_by("rating", "week").alias("rating_now"), F.max_by("rating", F.when(F.col("week") <= F.col("then"), F.col("week"))).alias("rating_then"))


@query("q60_rating_change", f"WITH {HISTORY_SQL} SELECT player_id, week, CAST(rating AS BIGINT) AS rating, CAST(rating - lag(rating) OVER (PARTITION BY player_id ORDER BY week) AS BIGINT) AS since_last FROM hist QUALIFY week >= DATE '1998-01-01'")
def rating_change(d: Domain) -> DataFrame:
    """Change since the week before, computed before the range is cut."""
    before = F.lag("rating").over(Window.partitionBy("player_id").orderBy("week"))
    return weekly(singles(d)).select("player_id", "week", "rating", (F.col("rating") - before).alias("since_last")).where("week >= date'1998-01-01'")


@query("q27_league_encounters", """SELECT league_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins, max(day) AS last_day FROM singles s JOIN focus f USING (player_id) WHERE f.k = 1 GROUP BY league_id""")
def league_encounters(d: Domain) -> DataFrame:
    return _focused(d, singles(d)).where("k = 1").groupBy("league_id").agg(F.count("*").alias("played"), n_if("won").alias("wins"), F.max("day").alias("last_day"))
