"""League, competition, team and fixture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sides import halves, rate, sides
from ..sources.adapter import Domain
from .catalog import query
from .players import n_if, pct

RESULTS_SQL = """scores AS (SELECT fixture_id, count(*) FILTER (WHERE home_games > away_games) AS home_score, count(*) FILTER (WHERE home_games < away_games) AS away_score FROM matches GROUP BY fixture_id),
    played AS (SELECT f.*, home_score, away_score FROM fixtures f JOIN scores USING (fixture_id) WHERE NOT f.deleted AND status = 'completed'),
    team_rows AS (SELECT *, home_team AS team, home_score AS own, away_score AS opp FROM played UNION ALL SELECT *, away_team, away_score, home_score FROM played),
    standing AS (SELECT competition_id, season_id, league_id, team, count(*) AS played, count(*) FILTER (WHERE own > opp) AS won, count(*) FILTER (WHERE own = opp) AS drawn, count(*) FILTER (WHERE own < opp) AS lost, CAST(sum(CASE WHEN own > opp THEN 2 WHEN own = opp THEN 1 ELSE 0 END) AS BIGINT) AS points FROM team_rows GROUP BY ALL),
    table_rows AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY points DESC, won DESC, team) AS place FROM standing)"""


def fixture_scores(d: Domain) -> DataFrame:
    """Completed fixtures with rubbers won by either side."""
    s = d.matches.groupBy("fixture_id").agg(n_if("home_games > away_games").alias("home_score"), n_if("home_games < away_games").alias("away_score"))
    return d.fixtures.where(~F.col("deleted") & (F.col("status") == "completed")).join(s, "fixture_id")


def team_rows(d: Domain) -> DataFrame:
    row = lambda t, a, b: F.struct(F.col(t).alias("team"), F.col(a).alias("own"), F.col(b).alias("opp"))
    return fixture_scores(d).select("*", F.explode(F.array(row("home_team", "home_score", "away_score"), row("away_team", "away_score", "home_score"))).alias("r")).select("*", "r.*").drop("r")


def standings(d: Domain) -> DataFrame:
    points = F.when(F.col("own") > F.col("opp"), 2).when(F.col("own") == F.col("opp"), 1).otherwise(0)
    s = team_rows(d).groupBy("competition_id", "season_id", "league_id", "team").agg(F.count("*").alias("played"), n_if("own > opp").alias("won"), n_if("own = opp").alias("drawn"), n_if("own < opp").alias("lost"), F.sum(points).alias("points"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("competition_id").orderBy(F.desc("points"), F.desc("won"), "team")).cast("bigint"))


@query("q38_standings", f"WITH {RESULTS_SQL} SELECT competition_id, place, team, played, won, drawn, lost, points FROM table_rows")
def q38(d: Domain) -> DataFrame:
    return standings(d).select("competition_id", "place", "team", "played", "won", "drawn", "lost", "points")


@query("q35_title_races", f"WITH {RESULTS_SQL} SELECT competition_id, max(team) FILTER (WHERE place = 1) AS leader, CAST(max(points) FILTER (WHERE place = 1) - max(points) FILTER (WHERE place = 2) AS BIGINT) AS gap FROM table_rows JOIN seasons USING (season_id, league_id) WHERE is_active GROUP BY competition_id")
def title_races(d: Domain) -> DataFrame:
    """Leader of each active competition and the gap to the second."""
    s = standings(d).where("place <= 2").join(d.seasons.where("is_active").select("season_id"), "season_id", "left_semi")
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    return s.groupBy("competition_id").agg(at("team", 1).alias("leader"), (at("points", 1) - at("points", 2)).alias("gap"))


@query("q36_champions", f"""WITH {RESULTS_SQL} SELECT season_id, count(DISTINCT competition_id) AS competitions, count(DISTINCT team) AS teams, string_agg(CAST(competition_id AS VARCHAR) || ':' || CAST(team AS VARCHAR), ',' ORDER BY competition_id) FILTER (WHERE place = 1) AS champions FROM table_rows GROUP BY season_id""")
def champions(d: Domain) -> DataFrame:
    first = F.when(F.col("place") == 1, F.struct("competition_id", F.concat_ws(":", F.col("competition_id").cast("string"), F.col("team").cast("string")).alias("t")))
    return standings(d).groupBy("season_id").agg(F.countDistinct("competition_id").alias("competitions"), F.countDistinct("team").alias("teams"), F.array_join(F.transform(F.sort_array(F.collect_list(first)), lambda x: x["t"]), ",").alias("champions"))


@query("q34_top_teams", f"""WITH {RESULTS_SQL}, a AS (SELECT team, CAST(sum(played) AS BIGINT) AS played, CAST(sum(won) AS BIGINT) AS won FROM standing GROUP BY team HAVING sum(played) >= 3) SELECT team, played, won, {pct("won", "played")} AS win_rate FROM a ORDER BY win_rate DESC, played DESC, team LIMIT 20""")
def top_teams(d: Domain) -> DataFrame:
    a = team_rows(d).groupBy("team").agg(F.count("*").alias("played"), n_if("own > opp").alias("won")).where("played >= 3")
    return a.withColumn("win_rate", rate(F.col("won"), F.col("played"))).orderBy(F.desc("win_rate"), F.desc("played"), "team").limit(20)


@query("q29_league_list", """SELECT league_id, league_name, count(DISTINCT s.season_id) AS seasons, string_agg(DISTINCT CAST(f.competition_id AS VARCHAR), ',' ORDER BY CAST(f.competition_id AS VARCHAR)) AS active_competitions
    FROM leagues JOIN seasons s USING (league_id) LEFT JOIN (SELECT DISTINCT season_id, competition_id FROM fixtures) f ON f.season_id = s.season_id AND s.is_active GROUP BY ALL""")
def league_list(d: Domain) -> DataFrame:
    """Leagues with the competitions of their active season, as a nested list."""
    c = d.fixtures.select("season_id", "competition_id").distinct().join(d.seasons, "season_id")
    own = F.collect_set(F.when(F.col("is_active"), F.col("competition_id").cast("string")))
    a = c.groupBy("league_id").agg(F.countDistinct("season_id").alias("seasons"), F.array_join(F.sort_array(own), ",").alias("active_competitions"))
    return d.leagues.join(a, "league_id").select("league_id", "league_name", "seasons", "active_competitions")


@query("q30_league_overview", """WITH f AS (SELECT league_id, count(*) AS fixtures, count(*) FILTER (WHERE status = 'completed') AS completed, count(DISTINCT competition_id) AS competitions FROM fixtures WHERE NOT deleted GROUP BY league_id),
    p AS (SELECT league_id, count(DISTINCT player_id) AS players, count(DISTINCT rubber_id) AS rubbers FROM sides GROUP BY league_id) SELECT league_id, league_name, fixtures, completed, competitions, players, rubbers FROM leagues JOIN f USING (league_id) LEFT JOIN p USING (league_id)""")
def league_overview(d: Domain) -> DataFrame:
    """Fixtures and players are summed up apart and then joined, so neither multiplies the other."""
    f = d.fixtures.where(~F.col("deleted")).groupBy("league_id").agg(F.count("*").alias("fixtures"), n_if("status = 'completed'").alias("completed"), F.countDistinct("competition_id").alias("competitions"))
    p = sides(d).groupBy("league_id").agg(F.countDistinct("player_id").alias("players"), F.countDistinct("rubber_id").alias("rubbers"))
    return d.leagues.join(f, "league_id").join(p, "league_id", "left")


@query("q37_league_snapshot", """WITH m AS (SELECT league_id, competition_id, player_id FROM sides JOIN seasons USING (season_id, league_id) WHERE is_active)
    SELECT league_id, competition_id, count(DISTINCT player_id) AS players FROM m GROUP BY ALL UNION ALL SELECT league_id, NULL, count(DISTINCT player_id) FROM m GROUP BY league_id""")
def league_snapshot(d: Domain) -> DataFrame:
    """Players of each active division and of the league, from one scan by grouping sets."""
    m = sides(d).join(d.seasons.where("is_active").select("season_id"), "season_id", "left_semi").select("league_id", "competition_id", "player_id")
    return m.groupingSets([["league_id", "competition_id"], ["league_id"]], "league_id", "competition_id").agg(F.countDistinct("player_id").alias("players"))


@query("q31_collection_totals", """SELECT (SELECT count(*) FROM leagues) AS leagues, (SELECT count(*) FROM fixtures WHERE NOT deleted) AS fixtures, (SELECT count(DISTINCT team) FROM half) AS teams, (SELECT count(DISTINCT player_id) FROM sides) AS players""")
def collection_totals(d: Domain) -> DataFrame:
    one = [d.leagues.agg(F.count("*").alias("leagues")), d.fixtures.where(~F.col("deleted")).agg(F.count("*").alias("fixtures")), sides(d).agg(F.countDistinct("player_id").alias("players"))]
    teams = halves(d.matches).agg(F.countDistinct("team").alias("teams"))
    return one[0].crossJoin(F.broadcast(one[1])).crossJoin(F.broadcast(teams)).crossJoin(F.broadcast(one[2]))


@query("q32_recent_results", """WITH top AS (SELECT * FROM fixtures WHERE NOT deleted AND status = 'completed' AND date_played IS NOT NULL ORDER BY date_played DESC, fixture_id LIMIT 20)
    SELECT top.fixture_id, top.date_played, top.home_team, top.away_team, count(rubber_id) FILTER (WHERE home_games > away_games) AS home_score, count(rubber_id) FILTER (WHERE home_games < away_games) AS away_score FROM top LEFT JOIN rubbers r ON r.fixture_id = top.fixture_id AND NOT r.deleted GROUP BY ALL""")
def recent_results(d: Domain) -> DataFrame:
    """The page first, its rubbers after."""
    top = d.fixtures.where(~F.col("deleted") & (F.col("status") == "completed") & F.col("date_played").isNotNull()).orderBy(F.desc("date_played"), "fixture_id").limit(20).select("fixture_id", "date_played", "home_team", "away_team")
    r = d.rubbers.where(~F.col("deleted")).join(F.broadcast(top.select("fixture_id")), "fixture_id", "left_semi").groupBy("fixture_id").agg(n_if("home_games > away_games").alias("home_score"), n_if("home_games < away_games").alias("away_score"))
    return top.join(r, "fixture_id", "left").fillna(0, ["home_score", "away_score"])


@query("q33_upcoming", """SELECT fixture_id, date_played, home_team, away_team FROM fixtures WHERE NOT deleted AND status = 'upcoming' ORDER BY date_played NULLS LAST, fixture_id LIMIT 20""")
def upcoming(d: Domain) -> DataFrame:
    return d.fixtures.where(~F.col("deleted") & (F.col("status") == "upcoming")).orderBy(F.asc_nulls_last("date_played"), "fixture_id").limit(20).select("fixture_id", "date_played", "home_team", "away_team")


@query("q40_team_fixtures", f"""WITH {RESULTS_SQL}, busy AS (SELECT team FROM team_rows GROUP BY team ORDER BY count(*) DESC, team LIMIT 1)
    SELECT fixture_id, date_played, team, own, opp FROM team_rows WHERE team = (SELECT team FROM busy) ORDER BY date_played DESC NULLS LAST, fixture_id LIMIT 10""")
def team_fixtures(d: Domain) -> DataFrame:
    t = team_rows(d)
    busy = t.groupBy("team").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "team").limit(1)
    return t.join(F.broadcast(busy.select("team")), "team", "left_semi").orderBy(F.desc_nulls_last("date_played"), "fixture_id").limit(10).select("fixture_id", "date_played", "team", "own", "opp")


@query("q41_roster", """SELECT team, canonical AS player_id, count(DISTINCT rubber_id) AS played, count(*) FILTER (WHERE won) AS wins FROM (
    SELECT team, rubber_id, raw AS r, own > opp AS won FROM half UNION ALL SELECT team, rubber_id, raw_partner, own > opp FROM half) JOIN ident i ON i.player_id = r GROUP BY ALL""")
def roster(d: Domain) -> DataFrame:
    """Players of each team over four slots; wins count by slot, matches once."""
    h = halves(d.matches).select("team", "rubber_id", (F.col("own") > F.col("opp")).alias("won"), F.explode(F.array("raw", "raw_partner")).alias("r"))
    return h.join(d.identity.withColumnRenamed("player_id", "r"), "r").groupBy("team", F.col("canonical").alias("player_id")).agg(F.countDistinct("rubber_id").alias("played"), n_if("won").alias("wins"))


@query("q42_team_form", f"""WITH {RESULTS_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date_played DESC NULLS LAST, fixture_id DESC, own) AS n FROM team_rows)
    SELECT team, string_agg(CASE WHEN own > opp THEN 'W' WHEN own = opp THEN 'D' ELSE 'L' END, '' ORDER BY n) AS form FROM last WHERE n <= 10 GROUP BY team""")
def team_form(d: Domain) -> DataFrame:
    w = Window.partitionBy("team").orderBy(F.desc_nulls_last("date_played"), F.desc("fixture_id"), "own")
    last = team_rows(d).withColumn("n", F.row_number().over(w)).where("n <= 10")
    mark = F.when(F.col("own") > F.col("opp"), "W").when(F.col("own") == F.col("opp"), "D").otherwise("L")
    return last.groupBy("team").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", mark.alias("x")))), lambda s: s["x"]), "").alias("form"))


@query("q44_fixture_rubbers", """WITH f AS (SELECT fixture_id FROM matches GROUP BY fixture_id ORDER BY count(*) DESC, fixture_id LIMIT 5)
    SELECT m.fixture_id, rubber_id, a.canonical AS home_1, b.canonical AS home_2, c.canonical AS away_1, e.canonical AS away_2, home_games, away_games FROM matches m JOIN f USING (fixture_id)
    LEFT JOIN ident a ON a.player_id = home_1 LEFT JOIN ident b ON b.player_id = home_2 LEFT JOIN ident c ON c.player_id = away_1 LEFT JOIN ident e ON e.player_id = away_2""")
def fixture_rubbers(d: Domain) -> DataFrame:
    """Rubbers of the five largest fixtures with four canonical players."""
    m = d.matches
    top = m.groupBy("fixture_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fixture_id").limit(5)
    m = m.join(F.broadcast(top.select("fixture_id")), "fixture_id", "left_semi").select("fixture_id", "rubber_id", "home_1", "home_2", "away_1", "away_2", "home_games", "away_games")
    for slot in ("home_1", "home_2", "away_1", "away_2"):
        m = m.join(d.identity.select(F.col("player_id").alias(slot), F.col("canonical").alias(f"{slot}_own")), slot, "left").drop(slot).withColumnRenamed(f"{slot}_own", slot)
    return m
