"""Data-quality queries: coverage, sources, competitions, duplicates, issues, snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import CLASSIFIED_SQL, classified
from ..operators.merge import latest_wins
from ..operators.sides import rate
from ..sources.adapter import Domain
from .catalog import query
from .players import n_if, pct

BAD_DAY = "(effective_day < DATE '1992-06-01' OR effective_day > DATE '2001-06-01' OR year(effective_day) IN (1900, 1919, 1970))"


def _player_rows(d: Domain) -> DataFrame:
    c = classified(d)
    row = lambda me, other: F.struct(F.col(me).alias("player_id"), F.col(other).alias("opponent_id"))
    return c.select("rubber_id", "competition_id", "league_id", "effective_day", "reason", F.explode(F.array(row("home_player", "away_player"), row("away_player", "home_player"))).alias("s")).select("*", "s.*").drop("s").where("player_id is not null")


PLAYER_ROWS_SQL = CLASSIFIED_SQL + """, player_rows AS (SELECT rubber_id, competition_id, league_id, effective_day, reason, home_player AS player_id, away_player AS opponent_id FROM classified WHERE home_player IS NOT NULL
    UNION ALL SELECT rubber_id, competition_id, league_id, effective_day, reason, away_player, home_player FROM classified WHERE away_player IS NOT NULL)"""

COVER_SQL = f"""WITH {PLAYER_ROWS_SQL}, cover AS (SELECT player_id, count(*) AS matches, count(*) FILTER (WHERE reason = 'eligible') AS rated, count(*) FILTER (WHERE reason = 'doubles') AS doubles, count(*) FILTER (WHERE reason = 'fixture_not_completed') AS pending,
        count(DISTINCT opponent_id) FILTER (WHERE reason = 'eligible') AS opponents, min(effective_day) AS first_day, max(effective_day) AS last_day FROM player_rows GROUP BY player_id),
    named AS (SELECT *, CASE WHEN rated = 0 AND doubles = matches THEN 'doubles_only' WHEN rated = 0 AND pending > 0 THEN 'pending_only' WHEN rated = 0 THEN 'unrated' WHEN rated < 10 THEN 'few_matches' WHEN opponents < 3 THEN 'few_opponents' ELSE 'covered' END AS category FROM cover)"""


def coverage(d: Domain) -> DataFrame:
    c = _player_rows(d).groupBy("player_id").agg(
        F.count("*").alias("matches"), n_if("reason = 'eligible'").alias("rated"), n_if("reason = 'doubles'").alias("doubles"), n_if("reason = 'fixture_not_completed'").alias("pending"),
        F.countDistinct(F.when(F.col("reason") == "eligible", F.col("opponent_id"))).alias("opponents"), F.min("effective_day").alias("first_day"), F.max("effective_day").alias("last_day"),
    )
    none = F.col("rated") == 0
    category = F.when(none & (F.col("doubles") == F.col("matches")), "doubles_only").when(none & (F.col("pending") > 0), "pending_only").when(none, "unrated").when(F.col("rated") < 10, "few_matches").when(F.col("opponents") < 3, "few_opponents").otherwise("covered")
    return c.withColumn("category", category)


@query("q67_player_coverage", COVER_SQL + " SELECT * FROM named")
def q67(d: Domain) -> DataFrame:
    return coverage(d)


@query("q68_coverage_summary", COVER_SQL + f" SELECT category, count(*) AS players, CAST(sum(matches) AS BIGINT) AS matches, {pct('CAST(sum(rated) AS BIGINT)', 'CAST(sum(matches) AS BIGINT)')} AS rated_share FROM named GROUP BY category")
def q68(d: Domain) -> DataFrame:
    return coverage(d).groupBy("category").agg(F.count("*").alias("players"), F.sum("matches").alias("matches"), rate(F.sum("rated"), F.sum("matches")).alias("rated_share"))


@query("q69_same_day_leagues", f"WITH {PLAYER_ROWS_SQL}, day_rows AS (SELECT player_id, effective_day, count(DISTINCT league_id) AS leagues, count(*) AS matches FROM player_rows WHERE effective_day IS NOT NULL GROUP BY ALL) SELECT player_id, count(*) AS busy_days, max(leagues) AS most_leagues, max(matches) AS most_matches FROM day_rows WHERE leagues > 1 GROUP BY player_id")
def same_day_leagues(d: Domain) -> DataFrame:
    """Players seen in several leagues on one day: by day first, then by player."""
    rows = _player_rows(d).where("effective_day is not null").select("player_id", "effective_day", "league_id").repartition(d.shares, "player_id")  # serves both groupings
    day = rows.groupBy("player_id", "effective_day").agg(F.countDistinct("league_id").alias("leagues"), F.count("*").alias("matches"))
    return day.where("leagues > 1").groupBy("player_id").agg(F.count("*").alias("busy_days"), F.max("leagues").alias("most_leagues"), F.max("matches").alias("most_matches"))


@query("q70_duplicate_groups", f"""WITH {CLASSIFIED_SQL} SELECT effective_day, least(home_player, away_player) AS player_1, greatest(home_player, away_player) AS player_2, count(*) AS copies, count(DISTINCT league_id) AS leagues, string_agg(CAST(rubber_id AS VARCHAR), ',' ORDER BY rubber_id) AS rubbers
    FROM classified WHERE home_player IS NOT NULL AND away_player IS NOT NULL AND effective_day IS NOT NULL AND NOT is_doubles GROUP BY ALL HAVING count(*) > 1""")
def duplicate_groups(d: Domain) -> DataFrame:
    """Rubbers of one pair of players on one day."""
    c = classified(d).where("home_player is not null and away_player is not null and effective_day is not null and not is_doubles")
    g = c.groupBy("effective_day", F.least("home_player", "away_player").alias("player_1"), F.greatest("home_player", "away_player").alias("player_2"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("rubber_id")), lambda x: x.cast("string")), ",")
    return g.agg(F.count("*").alias("copies"), F.countDistinct("league_id").alias("leagues"), ids.alias("rubbers")).where("copies > 1")


@query("q71_source_quality", f"WITH {CLASSIFIED_SQL} SELECT league_id, count(*) AS rubbers, count(*) FILTER (WHERE reason = 'eligible') AS rated, count(*) FILTER (WHERE home_player IS NULL OR away_player IS NULL) AS unknown_players, count(*) FILTER (WHERE effective_day IS NULL) AS undated, count(*) FILTER (WHERE {BAD_DAY}) AS bad_days, {pct('count(*) FILTER (WHERE reason = ' + chr(39) + 'eligible' + chr(39) + ')', 'count(*)')} AS rated_share FROM classified GROUP BY league_id")
def source_quality(d: Domain) -> DataFrame:
    return _quality(classified(d), "league_id")


def _quality(c: DataFrame, *by: str) -> DataFrame:
    return c.groupBy(*by).agg(F.count("*").alias("rubbers"), n_if("reason = 'eligible'").alias("rated"), n_if("home_player is null or away_player is null").alias("unknown_players"), n_if("effective_day is null").alias("undated"), n_if(BAD_DAY).alias("bad_days"), rate(n_if("reason = 'eligible'"), F.count("*")).alias("rated_share"))


@query("q72_competition_quality", f"WITH {CLASSIFIED_SQL} SELECT league_id, competition_id, count(*) AS rubbers, count(*) FILTER (WHERE reason = 'eligible') AS rated, count(*) FILTER (WHERE home_player IS NULL OR away_player IS NULL) AS unknown_players, count(*) FILTER (WHERE effective_day IS NULL) AS undated, count(*) FILTER (WHERE {BAD_DAY}) AS bad_days, {pct('count(*) FILTER (WHERE reason = ' + chr(39) + 'eligible' + chr(39) + ')', 'count(*)')} AS rated_share FROM classified GROUP BY ALL")
def competition_quality(d: Domain) -> DataFrame:
    return _quality(classified(d), "league_id", "competition_id")


ISSUES_SQL = f"""WITH {CLASSIFIED_SQL}, issues AS (
    SELECT 'suspicious_date' AS kind, 'high' AS severity, rubber_id, effective_day FROM classified WHERE {BAD_DAY}
    UNION ALL SELECT 'date_conflict', 'medium', rubber_id, effective_day FROM classified WHERE abs(datediff('day', date_played, played_on)) > 7
    UNION ALL SELECT reason, 'low', rubber_id, effective_day FROM classified WHERE reason LIKE 'missing%' OR reason = 'same_canonical_player')"""


def issues(d: Domain) -> DataFrame:
    """Every issue of every rubber, from one scan."""
    kinds = F.array(
        F.struct(F.expr(f"case when {BAD_DAY} then 'suspicious_date' end").alias("kind"), F.lit("high").alias("severity")),
        F.struct(F.expr("case when abs(datediff(date_played, played_on)) > 7 then 'date_conflict' end").alias("kind"), F.lit("medium").alias("severity")),
        F.struct(F.expr("case when reason like 'missing%' or reason = 'same_canonical_player' then reason end").alias("kind"), F.lit("low").alias("severity")),
    )
    return classified(d).select(F.explode(kinds).alias("i"), "rubber_id", "effective_day").where("i.kind is not null").select("i.kind", "i.severity", "rubber_id", "effective_day")


@query("q73_issues", ISSUES_SQL + " SELECT * FROM issues")
def q73(d: Domain) -> DataFrame:
    return issues(d)


@query("q75_issue_summary", ISSUES_SQL + " SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n DESC, kind) AS place FROM (SELECT severity, kind, count(*) AS n FROM issues GROUP BY ALL)")
def issue_summary(d: Domain) -> DataFrame:
    from pyspark.sql import Window

    level = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    g = issues(d).groupBy("severity", "kind").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(level, F.desc("n"), "kind")).cast("bigint"))


@query("q74_issue_lifecycle", ISSUES_SQL.replace("classified AS (", "classified AS MATERIALIZED (", 1).replace("issues AS (", "issues AS MATERIALIZED (", 1) + """, g AS (SELECT kind, rubber_id, max(was) AS was, 1 - min(was) AS stays FROM (SELECT kind, rubber_id, unnest(list_filter([CASE WHEN rubber_id % 3 <> 0 THEN 1 END, CASE WHEN rubber_id % 5 <> 0 THEN 0 END], lambda x: x IS NOT NULL)) AS was FROM issues) GROUP BY kind, rubber_id)
    SELECT kind, rubber_id, CASE WHEN was = 1 AND stays = 1 THEN 'open' WHEN was = 1 THEN 'resolved' ELSE 'new' END AS state FROM g""")
def issue_lifecycle(d: Domain) -> DataFrame:
    """Issues found before (a stand-in: two thirds of them) against those found now (four fifths): new, open or resolved."""
    i = issues(d).select("kind", "rubber_id")
    rows = i.where("rubber_id % 3 <> 0").withColumn("was", F.lit(1)).unionByName(i.where("rubber_id % 5 <> 0").withColumn("was", F.lit(0)))
    g = rows.groupBy("kind", "rubber_id").agg(F.max("was").alias("was"), (1 - F.min("was")).alias("now"))
    return g.select("kind", "rubber_id", F.when((F.col("was") == 1) & (F.col("now") == 1), "open").when(F.col("was") == 1, "resolved").otherwise("new").alias("state"))


@query("q78_audit_snapshot", f"""WITH {CLASSIFIED_SQL} SELECT count(*) AS rubbers, count(*) FILTER (WHERE reason = 'eligible') AS rated, count(DISTINCT competition_id) AS competitions, (SELECT count(*) FROM players WHERE canonical_id IS NOT NULL) AS aliases,
    (SELECT count(*) FROM (SELECT home_player FROM classified WHERE reason = 'eligible' UNION SELECT away_player FROM classified WHERE reason = 'eligible')) AS network, max(effective_day) AS last_day FROM classified""")
def audit_snapshot(d: Domain) -> DataFrame:
    c = classified(d)
    a = c.agg(F.count("*").alias("rubbers"), n_if("reason = 'eligible'").alias("rated"), F.countDistinct("competition_id").alias("competitions"), F.max("effective_day").alias("last_day"))
    b = d.players.agg(n_if("canonical_id is not null").alias("aliases"))
    n = c.where("reason = 'eligible'").select(F.explode(F.array("home_player", "away_player")).alias("p")).agg(F.countDistinct("p").alias("network"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(n))


@query("s13_upsert", """SELECT rubber_id, home_games, away_games, CASE WHEN was = 'completed' OR now = 'completed' THEN 'completed' ELSE coalesce(now, was) END AS status FROM (
    SELECT coalesce(n.rubber_id, o.rubber_id) AS rubber_id, coalesce(n.home_games, o.home_games) AS home_games, coalesce(n.away_games, o.away_games) AS away_games, o.status AS was, n.status AS now
    FROM (SELECT rubber_id, home_games, away_games, status FROM matches WHERE rubber_id % 4 <> 0) o FULL JOIN (SELECT rubber_id, away_games AS home_games, home_games AS away_games, CASE WHEN rubber_id % 7 = 0 THEN 'completed' ELSE status END AS status FROM matches WHERE rubber_id % 3 = 0) n USING (rubber_id))""")
def upsert(d: Domain) -> DataFrame:
    """Old rows and new ones, the new win; a completed status never goes back."""
    m = d.matches.select("rubber_id", "home_games", "away_games", "status")
    new = m.where("rubber_id % 3 = 0").select("rubber_id", F.col("away_games").alias("home_games"), F.col("home_games").alias("away_games"), F.when(F.col("rubber_id") % 7 == 0, "completed").otherwise(F.col("status")).alias("status"))
    return latest_wins(m.where("rubber_id % 4 <> 0"), new, ["rubber_id"], monotone={"status": "completed"})
