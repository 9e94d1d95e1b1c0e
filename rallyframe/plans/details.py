"""Detail pages, filtered lists, quality listings and small relational forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.classify import CLASSIFIED_SQL, classified
from ..operators.sides import focus, rate, sides, singles
from ..sources.adapter import Domain
from .catalog import query
from .players import n_if, pct

PERCENT_SQL = "CAST((200 * {0} + {1}) // (2 * {1}) AS BIGINT)"


def _percent(part, whole):
    """A whole percentage, halves up, in whole numbers."""
    return F.floor((200 * part + whole) / (2 * whole)).cast("bigint")


@query("q14_insight_rivals", f"""WITH m AS (SELECT player_id, opponent_id, won, row_number() OVER (PARTITION BY player_id, opponent_id ORDER BY day, rubber_id, side) AS n, count(*) OVER (PARTITION BY player_id, opponent_id) AS played FROM singles WHERE opponent_id IS NOT NULL),
    a AS (SELECT player_id, opponent_id, played, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE won AND n <= played // 2) AS early, count(*) FILTER (WHERE won AND n > played // 2) AS late FROM m GROUP BY ALL),
    r AS (SELECT *, {PERCENT_SQL.format("wins", "played")} AS share, CASE WHEN played >= 4 THEN {PERCENT_SQL.format("late", "(played - played // 2)")} - {PERCENT_SQL.format("early", "(played // 2)")} END AS delta FROM a),
    t AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played < 3, share, played DESC, opponent_id) AS hard, row_number() OVER (PARTITION BY player_id ORDER BY played < 3, share DESC, played DESC, opponent_id) AS easy, row_number() OVER (PARTITION BY player_id ORDER BY delta DESC NULLS LAST, opponent_id) AS rise FROM r)
    SELECT player_id, max(opponent_id) FILTER (WHERE hard = 1 AND played >= 3) AS toughest_id, max(share) FILTER (WHERE hard = 1 AND played >= 3) AS toughest_rate, max(opponent_id) FILTER (WHERE easy = 1 AND played >= 3) AS easiest_id, max(share) FILTER (WHERE easy = 1 AND played >= 3) AS easiest_rate,
        max(opponent_id) FILTER (WHERE rise = 1 AND delta > 0) AS improving_id, max(delta) FILTER (WHERE rise = 1 AND delta > 0) AS delta_points FROM t GROUP BY player_id""")
def insight_rivals(d: Domain) -> DataFrame:
    """Each player's hardest and easiest opponent of three matches or more, and the one they improved against most."""
    pair = Window.partitionBy("player_id", "opponent_id")
    s = singles(d).where("opponent_id is not null").select("player_id", "opponent_id", "day", "rubber_id", "side", "won").repartition(d.shares, "player_id")  # serves all that follows
    m = s.select("player_id", "opponent_id", "won", F.row_number().over(pair.orderBy("day", "rubber_id", "side")).alias("n"), F.count("*").over(pair).alias("played"))
    half = F.floor(F.col("played") / 2)
    a = m.groupBy("player_id", "opponent_id", "played").agg(n_if("won").alias("wins"), n_if(F.col("won") & (F.col("n") <= half)).alias("early"), n_if(F.col("won") & (F.col("n") > half)).alias("late"))
    delta = F.when(F.col("played") >= 4, _percent(F.col("late"), F.col("played") - half) - _percent(F.col("early"), half))
    r = a.select("player_id", "opponent_id", "played", _percent(F.col("wins"), F.col("played")).alias("share"), delta.alias("delta"))
    often, last = F.col("played") >= 3, -F.col("opponent_id")
    best = lambda ok, *order: F.max(F.when(ok, F.struct(*order, last.alias("o"))))
    g = r.groupBy("player_id").agg(best(often, (-F.col("share")).alias("s"), "played").alias("hard"), best(often, F.col("share").alias("s"), "played").alias("easy"), best(F.col("delta") > 0, "delta").alias("rise"))
    return g.select("player_id", (-F.col("hard.o")).alias("toughest_id"), (-F.col("hard.s")).alias("toughest_rate"), (-F.col("easy.o")).alias("easiest_id"), F.col("easy.s").alias("easiest_rate"), (-F.col("rise.o")).alias("improving_id"), F.col("rise.delta").alias("delta_points"))


def filtered_matches(d: Domain, team: DataFrame | None = None, event: DataFrame | None = None) -> DataFrame:
    """Matches of the busiest player with a team or in an event: exactly one filter, a table of one column of ids; the other is not applied."""
    if (team is None) == (event is None):
        raise ValueError("exactly one of team and event")
    mine = sides(d).join(F.broadcast(focus(d, 1).select("player_id")), "player_id", "left_semi")
    some = mine.join(team, "team", "left_semi") if team is not None else mine.join(event, "competition_id", "left_semi")
    return some.orderBy(F.desc("day"), F.desc("rubber_id"), "side").limit(20).select("player_id", "rubber_id", "day", "competition_id", "team", "opponent_id", "own", "opp")


def _filtered(column: str) -> str:
    return f"""WITH f AS (SELECT s.* FROM sides s JOIN focus USING (player_id) WHERE k = 1), top AS (SELECT {column} FROM f WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)
    SELECT player_id, rubber_id, day, competition_id, team, opponent_id, own, opp FROM f WHERE {column} = (SELECT {column} FROM top) ORDER BY day DESC, rubber_id DESC, side LIMIT 20"""


def _most_frequent(d: Domain, column: str) -> DataFrame:
    mine = sides(d).join(F.broadcast(focus(d, 1).select("player_id")), "player_id", "left_semi").where(F.col(column).isNotNull())
    return F.broadcast(mine.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).select(column))


@query("q18_matches_by_team", _filtered("team"))
def matches_by_team(d: Domain) -> DataFrame:
    return filtered_matches(d, team=_most_frequent(d, "team"))


@query("q18_matches_by_event", _filtered("competition_id"))
def matches_by_event(d: Domain) -> DataFrame:
    return filtered_matches(d, event=_most_frequent(d, "competition_id"))


@query("q20_event_matches", """WITH f AS (SELECT s.* FROM sides s JOIN focus USING (player_id) WHERE k <= 2), l AS (SELECT player_id, competition_id, row_number() OVER (PARTITION BY player_id ORDER BY max(day) DESC, competition_id) AS n FROM f GROUP BY player_id, competition_id)
    SELECT player_id, competition_id, rubber_id, day, opponent_id, side, own, opp, CASE WHEN won THEN 'W' WHEN lost THEN 'L' ELSE 'D' END AS result FROM f JOIN l USING (player_id, competition_id) WHERE n = 1""")
def event_matches(d: Domain) -> DataFrame:
    """All matches of the two busiest players in the event that each played last."""
    f = sides(d).join(F.broadcast(focus(d).select("player_id")), "player_id", "left_semi")
    last = f.groupBy("player_id").agg(F.max(F.struct("day", (-F.col("competition_id")).alias("o"))).alias("t")).select("player_id", (-F.col("t.o")).alias("competition_id"))
    mark = F.when(F.col("won"), "W").when(F.col("lost"), "L").otherwise("D")
    return f.join(F.broadcast(last), ["player_id", "competition_id"], "left_semi").select("player_id", "competition_id", "rubber_id", "day", "opponent_id", "side", "own", "opp", mark.alias("result"))


TEAMS_SQL = "teams AS (SELECT home_team AS team, competition_id, season_id, league_id FROM fixtures WHERE NOT deleted UNION SELECT away_team, competition_id, season_id, league_id FROM fixtures WHERE NOT deleted)"


@query("q39_team_summary", f"WITH {TEAMS_SQL} SELECT teams.*, league_name FROM teams LEFT JOIN leagues USING (league_id)")
def team_summary(d: Domain) -> DataFrame:
    """Each team with its competition, season and league."""
    t = d.fixtures.where("not deleted").select(F.explode(F.array("home_team", "away_team")).alias("team"), "competition_id", "season_id", "league_id").distinct()
    return t.join(F.broadcast(d.leagues), "league_id", "left").select("team", "competition_id", "season_id", "league_id", "league_name")


@query("q43_team_data", """WITH t AS (SELECT home_team AS team, fixture_id, date_played, status FROM fixtures WHERE NOT deleted UNION ALL SELECT away_team, fixture_id, date_played, status FROM fixtures WHERE NOT deleted), r AS (SELECT DISTINCT fixture_id FROM rubbers WHERE NOT deleted)
    SELECT team, count(*) AS fixtures, count(*) FILTER (WHERE status = 'completed') AS completed, count(r.fixture_id) AS with_rubbers, max(date_played) AS last_day,
        CASE WHEN count(r.fixture_id) > 0 THEN 'available' WHEN count(*) FILTER (WHERE status = 'completed') > 0 THEN 'source_data_missing' ELSE 'no_matches_yet' END AS availability FROM t LEFT JOIN r USING (fixture_id) GROUP BY team""")
def team_data(d: Domain) -> DataFrame:
    """What is there of each team, and whether its matches are available, none has been played yet, or the source holds none of those played."""
    r = d.rubbers.where("not deleted").select("fixture_id").distinct().withColumn("has", F.lit(True))
    f = d.fixtures.where("not deleted").join(r, "fixture_id", "left").select(F.explode(F.array("home_team", "away_team")).alias("team"), "status", "has", "date_played")
    t = f.groupBy("team").agg(F.count("*").alias("fixtures"), n_if("status = 'completed'").alias("completed"), F.count("has").alias("with_rubbers"), F.max("date_played").alias("last_day"))
    return t.withColumn("availability", F.when(F.col("with_rubbers") > 0, "available").when(F.col("completed") > 0, "source_data_missing").otherwise("no_matches_yet"))


@query("q47_event_results", """WITH c AS (SELECT competition_id FROM matches GROUP BY competition_id ORDER BY count(*) DESC, competition_id LIMIT 1)
    SELECT rubber_id, played_on, home_games, away_games, coalesce(h.name, 'Unknown') AS home_name, coalesce(a.name, 'Unknown') AS away_name, CASE WHEN home_games > away_games THEN 'home' ELSE 'away' END AS winner_side, coalesce(h.canonical_id, h.player_id) AS home_id, coalesce(a.canonical_id, a.player_id) AS away_id
    FROM matches m LEFT JOIN players h ON h.player_id = home_1 LEFT JOIN players a ON a.player_id = away_1 WHERE competition_id = (SELECT competition_id FROM c) AND NOT is_doubles""")
def event_results(d: Domain) -> DataFrame:
    """Results of the largest event with names, Unknown where there is none."""
    m = d.matches
    top = m.groupBy("competition_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "competition_id").limit(1).select("competition_id")
    m = m.where("not is_doubles").join(F.broadcast(top), "competition_id", "left_semi").select("rubber_id", "played_on", "home_games", "away_games", "home_1", "away_1")
    for side in ("home", "away"):
        p = d.players.select(F.col("player_id").alias(f"{side}_1"), F.col("name").alias(f"{side}_name"), F.coalesce("canonical_id", "player_id").alias(f"{side}_id"))
        m = m.join(p, f"{side}_1", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", F.lit("Unknown")))
    return m.select("rubber_id", "played_on", "home_games", "away_games", "home_name", "away_name", F.when(F.col("home_games") > F.col("away_games"), "home").otherwise("away").alias("winner_side"), "home_id", "away_id")


@query("q66_reasons_of_players", f"""WITH {CLASSIFIED_SQL}, s AS (SELECT home_player AS player_id, rubber_id, effective_day, reason FROM classified UNION ALL SELECT away_player, rubber_id, effective_day, reason FROM classified)
    SELECT player_id, reason, rubbers, rubber_id AS latest_rubber, effective_day AS latest_day FROM (SELECT *, count(*) OVER (PARTITION BY player_id, reason) AS rubbers, row_number() OVER (PARTITION BY player_id, reason ORDER BY effective_day DESC NULLS LAST, rubber_id DESC) AS n FROM s WHERE player_id IS NOT NULL) WHERE n = 1""")
def audit_evidence(d: Domain) -> DataFrame:
    """For each player and reason: how many rubbers, and the latest of them as evidence."""
    s = classified(d).select("rubber_id", "effective_day", "reason", F.explode(F.array("home_player", "away_player")).alias("player_id")).where("player_id is not null")
    latest = F.max_by(F.struct("rubber_id", "effective_day"), F.struct(F.coalesce("effective_day", F.lit("0001-01-01").cast("date")), "rubber_id"))
    return s.groupBy("player_id", "reason").agg(F.count("*").alias("rubbers"), latest.alias("l")).select("player_id", "reason", "rubbers", F.col("l.rubber_id").alias("latest_rubber"), F.col("l.effective_day").alias("latest_day"))


@query("q76_quality_listing", f"WITH {CLASSIFIED_SQL} SELECT competition_id, count(*) AS rubbers, {pct('count(*) FILTER (WHERE reason = ' + chr(39) + 'eligible' + chr(39) + ')', 'count(*) FILTER (WHERE NOT is_doubles)')} AS rated_share FROM classified GROUP BY competition_id ORDER BY rated_share NULLS LAST, rubbers DESC, competition_id LIMIT 25 OFFSET 25")
def quality_listing(d: Domain) -> DataFrame:
    """The second page of competitions, those with the smallest rated share of singles first."""
    c = classified(d).groupBy("competition_id").agg(F.count("*").alias("rubbers"), rate(n_if("reason = 'eligible'"), n_if("not is_doubles")).alias("rated_share"))
    return c.orderBy(F.asc_nulls_last("rated_share"), F.desc("rubbers"), "competition_id").offset(25).limit(25)


@query("q81_source_snapshot", f"""WITH c AS (SELECT f.league_id AS platform_id, count(DISTINCT f.league_id) AS leagues, count(DISTINCT f.competition_id) AS competitions, count(DISTINCT f.fixture_id) AS fixtures, count(r.rubber_id) AS rubbers,
        count(r.rubber_id) FILTER (WHERE coalesce(r.played_on, f.date_played) IS NOT NULL) AS dated, count(r.rubber_id) FILTER (WHERE r.score_source = 'games') AS scored, count(r.rubber_id) FILTER (WHERE r.home_1 IS NULL OR r.away_1 IS NULL) AS missing_player_rubbers
        FROM fixtures f LEFT JOIN (SELECT * FROM rubbers WHERE NOT deleted) r USING (fixture_id) WHERE NOT f.deleted GROUP BY f.league_id),
    p AS (SELECT platform_id, count(*) AS external_players, count(DISTINCT coalesce(canonical_id, player_id)) AS canonical_players FROM players WHERE NOT deleted GROUP BY platform_id),
    s AS (SELECT platform_id, count(*) AS total_scrapes, count(*) FILTER (WHERE kind = 'error') AS failed_scrapes, max(seen_at) AS latest_activity_at, max_by(event_id, row(seen_at, event_id)) FILTER (WHERE kind = 'error') AS last_error FROM log GROUP BY platform_id),
    g AS (SELECT platform_id, count(*) AS resources, count(*) FILTER (WHERE last_kind = 'error') AS unhealthy_resources FROM (SELECT platform_id, resource_id, max_by(kind, row(seen_at, event_id)) AS last_kind FROM log GROUP BY platform_id, resource_id) GROUP BY platform_id),
    i AS (SELECT platform_id FROM c UNION SELECT platform_id FROM p UNION SELECT platform_id FROM s)
    SELECT platform_id, CASE WHEN coalesce(unhealthy_resources, 0) > 0 THEN 'degraded' WHEN latest_activity_at IS NOT NULL THEN 'healthy' ELSE 'unobserved' END AS health, coalesce(leagues, 0) AS leagues, coalesce(competitions, 0) AS competitions, coalesce(fixtures, 0) AS fixtures, coalesce(rubbers, 0) AS rubbers,
        {pct('dated', 'rubbers')} AS dated_rubbers_pct, {pct('scored', 'rubbers')} AS full_score_rubbers_pct, coalesce(missing_player_rubbers, 0) AS missing_player_rubbers, coalesce(external_players, 0) AS external_players, coalesce(canonical_players, 0) AS canonical_players,
        coalesce(total_scrapes, 0) AS total_scrapes, coalesce(failed_scrapes, 0) AS failed_scrapes, coalesce(resources, 0) AS resources, coalesce(unhealthy_resources, 0) AS unhealthy_resources, latest_activity_at, last_error
    FROM i LEFT JOIN c USING (platform_id) LEFT JOIN p USING (platform_id) LEFT JOIN s USING (platform_id) LEFT JOIN g USING (platform_id)""")
def source_snapshot(d: Domain) -> DataFrame:
    """A row for each platform (a league's is of its own number): what it holds, what was scraped, and its health by failing resources and latest activity."""
    f = d.fixtures.where("not deleted").select("fixture_id", "league_id", "competition_id", "date_played")
    r = d.rubbers.where("not deleted").groupBy("fixture_id").agg(F.count("*").alias("rubbers"), n_if("played_on is not null").alias("played"), n_if("score_source = 'games'").alias("scored"), n_if("home_1 is null or away_1 is null").alias("missing_player_rubbers"))
    dated = F.when(F.col("date_played").isNotNull(), F.col("rubbers")).otherwise(F.col("played"))
    c = f.join(r, "fixture_id", "left").groupBy(F.col("league_id").alias("platform_id")).agg(F.countDistinct("league_id").alias("leagues"), F.countDistinct("competition_id").alias("competitions"), F.count("*").alias("fixtures"), F.sum("rubbers").alias("rubbers"), F.sum(dated).alias("dated"), F.sum("scored").alias("scored"), F.sum("missing_player_rubbers").alias("missing_player_rubbers"))
    p = d.players.where("not deleted").groupBy("platform_id").agg(F.count("*").alias("external_players"), F.countDistinct(F.coalesce("canonical_id", "player_id")).alias("canonical_players"))
    at = F.struct("seen_at", "event_id")
    g = d.events.groupBy("platform_id", "resource_id").agg(F.max_by("kind", at).alias("last_kind"), F.count("*").alias("n"), n_if("kind = 'error'").alias("failed"), F.max("seen_at").alias("seen_at"), F.max(F.when(F.col("kind") == "error", at)).alias("error"))
    s = g.groupBy("platform_id").agg(F.sum("n").alias("total_scrapes"), F.sum("failed").alias("failed_scrapes"), F.count("*").alias("resources"), n_if("last_kind = 'error'").alias("unhealthy_resources"), F.max("seen_at").alias("latest_activity_at"), F.max("error").getField("event_id").alias("last_error"))
    health = F.when(F.col("unhealthy_resources") > 0, "degraded").when(F.col("latest_activity_at").isNotNull(), "healthy").otherwise("unobserved")
    counts = ["leagues", "competitions", "fixtures", "rubbers", "missing_player_rubbers", "external_players", "canonical_players", "total_scrapes", "failed_scrapes", "resources", "unhealthy_resources"]
    every = c.join(p, "platform_id", "full").join(s, "platform_id", "full").fillna(0, counts)
    return every.select("platform_id", health.alias("health"), *counts, rate(F.col("dated"), F.col("rubbers")).alias("dated_rubbers_pct"), rate(F.col("scored"), F.col("rubbers")).alias("full_score_rubbers_pct"), "latest_activity_at", "last_error")


@query("q100_latest_run", """WITH k AS (SELECT max(CAST(seen_at AS DATE)) AS run_key FROM log), s AS (SELECT run_key, kind AS stage, count(*) AS n, min(seen_at) AS started_at, max(seen_at) AS finished_at, max_by(event_id, row(seen_at, event_id)) AS last_event FROM log, k WHERE CAST(seen_at AS DATE) = run_key GROUP BY run_key, kind)
    SELECT run_key, CASE WHEN count(*) FILTER (WHERE stage = 'error') OVER () > 0 THEN 'failed' ELSE 'completed' END AS run_status, row_number() OVER (ORDER BY started_at, stage) AS place, stage, CASE stage WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, n, started_at, finished_at, last_event FROM s""")
def latest_run(d: Domain) -> DataFrame:
    """The latest run (a day of the log) with its status, and its stages in the order in which they began."""
    last = d.events.agg(F.to_date(F.max("seen_at")).alias("run_key"))
    s = d.events.join(F.broadcast(last), F.to_date("seen_at") == F.col("run_key")).groupBy("run_key", F.col("kind").alias("stage"))
    s = s.agg(F.count("*").alias("n"), F.min("seen_at").alias("started_at"), F.max("seen_at").alias("finished_at"), F.max_by("event_id", F.struct("seen_at", "event_id")).alias("last_event"))
    failed = F.col("stage") == "error"
    every = Window.partitionBy("run_key")  # a row a stage
    return s.select("run_key", F.when(F.max(failed).over(every), "failed").otherwise("completed").alias("run_status"), F.row_number().over(every.orderBy("started_at", "stage")).cast("bigint").alias("place"), "stage", F.when(failed, "failed").otherwise("completed").alias("status"), "n", "started_at", "finished_at", "last_event")


@query("q99_overall_state", """WITH r AS (SELECT resource_id, max_by(kind, row(seen_at, event_id)) AS last_kind FROM log GROUP BY resource_id), c AS (SELECT count(*) FILTER (WHERE last_kind = 'error') AS failing, count(*) FILTER (WHERE last_kind = 'signup') AS pending, count(*) AS resources FROM r),
    k AS (SELECT count(DISTINCT CAST(seen_at AS DATE)) AS runs FROM log), l AS (SELECT count(*) FILTER (WHERE kind = 'error') > 0 AS latest_failed FROM log WHERE CAST(seen_at AS DATE) = (SELECT max(CAST(seen_at AS DATE)) FROM log))
    SELECT failing, pending, resources, runs, latest_failed, CASE WHEN failing > 0 OR latest_failed THEN 'attention' WHEN pending > 0 THEN 'running' WHEN resources > 0 THEN 'idle' ELSE 'unobserved' END AS state FROM c, k, l""")
def overall_state(d: Domain) -> DataFrame:
    """One row: resources that fail or wait, runs, whether the latest failed, and the state that all this comes to."""
    r = d.events.groupBy("resource_id").agg(F.max_by("kind", F.struct("seen_at", "event_id")).alias("last_kind"))
    c = r.agg(n_if("last_kind = 'error'").alias("failing"), n_if("last_kind = 'signup'").alias("pending"), F.count("*").alias("resources"))
    day = d.events.groupBy(F.to_date("seen_at").alias("day")).agg(F.max(F.col("kind") == "error").alias("failed"))
    k = day.agg(F.count("*").alias("runs"), F.coalesce(F.max_by("failed", "day"), F.lit(False)).alias("latest_failed"))
    state = F.when((F.col("failing") > 0) | F.col("latest_failed"), "attention").when(F.col("pending") > 0, "running").when(F.col("resources") > 0, "idle").otherwise("unobserved")
    return c.crossJoin(F.broadcast(k)).withColumn("state", state)


@query("a07_global_having", "SELECT 'tied' AS what, count(*) AS n, max(day) AS last_day FROM singles WHERE NOT won AND NOT lost HAVING count(*) > 0 UNION ALL SELECT 'both', count(*), max(day) FROM singles WHERE won AND lost HAVING count(*) > 0")
def global_having(d: Domain) -> DataFrame:
    """One row in all for a condition that is met, none for one that never is."""
    s = singles(d)
    counted = lambda what, cond: s.where(cond).agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.max("day").alias("last_day")).where("n > 0")
    return counted("tied", "not won and not lost").unionByName(counted("both", "won and lost"))


@query("a11_ordered_json", "SELECT league_id, CAST(to_json(list({'season_id': season_id, 'n': n} ORDER BY season_id)) AS VARCHAR) AS seasons FROM (SELECT league_id, season_id, count(*) AS n FROM fixtures GROUP BY ALL) GROUP BY league_id")
def ordered_json(d: Domain) -> DataFrame:
    """Seasons of each league as one JSON array in order."""
    s = d.fixtures.groupBy("league_id", "season_id").agg(F.count("*").alias("n"))
    return s.groupBy("league_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("season_id", "n")))).alias("seasons"))


@query("w09_first_and_last", """WITH n AS (SELECT player_id, rubber_id, day, row_number() OVER (PARTITION BY player_id ORDER BY day, rubber_id, side) AS up, row_number() OVER (PARTITION BY player_id ORDER BY day DESC, rubber_id DESC, side DESC) AS down FROM singles)
    SELECT player_id, max(rubber_id) FILTER (WHERE up = 1) AS first_rubber, max(day) FILTER (WHERE up = 1) AS first_day, max(rubber_id) FILTER (WHERE down = 1) AS last_rubber, max(day) FILTER (WHERE down = 1) AS last_day FROM n GROUP BY player_id""")
def first_and_last(d: Domain) -> DataFrame:
    """First and last match by one grouping, where two opposite numberings would sort twice."""
    order = F.struct("day", "rubber_id", "side")
    g = singles(d).groupBy("player_id").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    return g.select("player_id", F.col("a.rubber_id").alias("first_rubber"), F.col("a.day").alias("first_day"), F.col("z.rubber_id").alias("last_rubber"), F.col("z.day").alias("last_day"))


@query("e08_stale_resources", "SELECT resource_id, max(seen_at) AS last_at FROM log GROUP BY resource_id HAVING max(seen_at) < (SELECT max(seen_at) FROM log) - INTERVAL 12 HOUR")
def stale_resources(d: Domain) -> DataFrame:
    """Resources not seen for half a day."""
    r = d.events.groupBy("resource_id").agg(F.max("seen_at").alias("last_at"))
    return r.crossJoin(F.broadcast(d.events.agg(F.max("seen_at").alias("as_of")))).where("last_at < as_of - INTERVAL 12 HOUR").drop("as_of")


@query("u04_disjoint_paths", "SELECT source, day, count(*) AS n FROM (SELECT 'rubber' AS source, played_on AS day FROM matches WHERE played_on IS NOT NULL UNION ALL SELECT 'fixture', date_played FROM matches WHERE played_on IS NULL AND date_played IS NOT NULL) GROUP BY ALL")
def disjoint_paths(d: Domain) -> DataFrame:
    """Dates from the rubber, else from its fixture: two paths that share no row, in one scan."""
    m = d.matches.where("played_on is not null or date_played is not null")
    return m.groupBy(F.when(F.col("played_on").isNotNull(), "rubber").otherwise("fixture").alias("source"), F.coalesce("played_on", "date_played").alias("day")).agg(F.count("*").alias("n"))


@query("f13_months", """WITH b AS (SELECT min(date_trunc('month', day)) AS a, max(date_trunc('month', day)) AS z FROM singles), m AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM b)
    SELECT month, count(day) AS matches, sum(count(day)) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS three_months FROM m LEFT JOIN singles ON CAST(date_trunc('month', day) AS DATE) = month GROUP BY month""")
def months(d: Domain) -> DataFrame:
    """Every month from the first match to the last, those without matches too, and the sum of three months; a row a month."""
    n = singles(d).groupBy(F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.count("*").alias("matches"))
    every = n.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    out = every.join(n, "month", "left").fillna(0, ["matches"])
    return out.withColumn("three_months", F.sum("matches").over(Window.orderBy("month").rowsBetween(-2, 0)))


@query("p10_known_names", "SELECT player_id, trim(name) AS name FROM players WHERE nullif(trim(name), '') IS NOT NULL AND lower(trim(name)) NOT IN ('unknown', 'n/a', 'tbc') AND external_id IS NOT NULL")
def known_names(d: Domain) -> DataFrame:
    """Players with a name that says something."""
    name = F.trim("name")
    return d.players.where(F.nullif(name, F.lit("")).isNotNull() & ~F.lower(name).isin("unknown", "n/a", "tbc") & F.col("external_id").isNotNull()).select("player_id", name.alias("name"))


@query("p14_json_defaults", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 5) AS k, coalesce(CAST(json_extract_string(props, '$.limit') AS BIGINT), 30) AS page, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events", domain=False)
def json_defaults(d: Domain) -> DataFrame:
    """Fields of a JSON setting with a default, and whether a key is there."""
    k, page = (F.get_json_object("props", f"$.{x}") for x in ("k", "limit"))
    return d.table("events").select("event_id", F.coalesce(k.cast("bigint"), F.lit(5)).alias("k"), F.coalesce(page.cast("bigint"), F.lit(30)).alias("page"), k.isNotNull().alias("has_k"))


@query("s02_listed_ids", "SELECT v.label, player_id, name FROM (VALUES (1, 'one'), (2, 'two'), (5, 'five'), (5000000, 'none')) v(id, label) LEFT JOIN players ON player_id = v.id")
def listed_ids(d: Domain) -> DataFrame:
    """A short list of ids given as rows, each with its player where there is one."""
    v = d.spark.createDataFrame([(1, "one"), (2, "two"), (5, "five"), (5000000, "none")], "player_id long, label string")
    p = d.players.select("player_id", "name", F.lit(True).alias("found"))
    return F.broadcast(v).join(p, "player_id", "left").select("label", F.when(F.col("found"), F.col("player_id")).alias("player_id"), "name")
