"""Match lists by source, what two players' records say of their next match, season histories, movers of a rating run and the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.paging import exact_page
from ..operators.rating_fold import rating_periods
from ..operators.sides import focus, singles
from ..sources.adapter import Domain
from ..sources.staging import written
from .catalog import query
from .details import PERCENT_SQL
from .leagues import RESULTS_SQL, standings
from .ratings import eligible
from .rivalry import COMMON_SQL, HISTORY_SQL, common_opponents, weekly

#: The division whose competitions stand for tournaments; the others are leagues'.
TOURNAMENTS = 5
UNKNOWN = "unknown"


def matches_of(d: Domain, players: DataFrame, source: str = "all") -> DataFrame:
    """Singles of the players against opponents with a name, from one source (all, league or tournament), with what a list shows of them; what isn't won counts as lost.

    players: player_id, a few rows.
    """
    if source not in ("all", "league", "tournament"):
        raise ValueError(f"no such source: {source}")
    cup = F.col("division") == TOURNAMENTS
    m = singles(d).join(F.broadcast(players.select("player_id")), "player_id")
    m = m if source == "all" else m.where(cup if source == "tournament" else ~cup)
    names = d.players.select(F.col("player_id").alias("opponent_id"), F.col("name").alias("opponent"))
    m = m.join(names, "opponent_id").where((F.trim("opponent") != "") & (F.lower(F.trim("opponent")) != UNKNOWN)).join(F.broadcast(d.leagues), "league_id")
    event = F.when(cup, F.col("competition_id"))
    label = F.when(cup, F.concat(F.lit("Event "), F.col("competition_id").cast("string"))).otherwise(F.concat_ws(" · ", "league_name", F.col("competition_id").cast("string")))
    games = F.concat(F.col("own").cast("string"), F.lit("-"), F.col("opp").cast("string"))
    result = F.concat_ws(" ", F.when(F.col("won"), "Won").otherwise("Lost"), F.when(F.col("score_source") != "win_loss_only", games))
    return m.select("player_id", "rubber_id", "fixture_id", F.col("day").alias("date"), F.when(cup, "tournament").otherwise("league").alias("source"), label.alias("source_label"), event.alias("event_id"), "opponent", "opponent_id", result.alias("result"), F.col("won").alias("is_win"))


def _matches_sql(condition: str, offset: int) -> str:
    return f"""WITH m AS (SELECT s.player_id, s.rubber_id, s.fixture_id, s.day AS date, s.side, CASE WHEN division = {TOURNAMENTS} THEN 'tournament' ELSE 'league' END AS source, CASE WHEN division = {TOURNAMENTS} THEN 'Event ' || competition_id ELSE league_name || ' · ' || competition_id END AS source_label, CASE WHEN division = {TOURNAMENTS} THEN competition_id END AS event_id,
        p.name AS opponent, s.opponent_id, CASE WHEN won THEN 'Won' ELSE 'Lost' END || CASE WHEN score_source = 'win_loss_only' THEN '' ELSE ' ' || own || '-' || opp END AS result, won AS is_win
        FROM singles s JOIN focus f ON f.player_id = s.player_id AND f.k = 1 JOIN players p ON p.player_id = s.opponent_id JOIN leagues USING (league_id) WHERE nullif(trim(p.name), '') IS NOT NULL AND lower(trim(p.name)) <> 'unknown' AND {condition}),
    n AS (SELECT * EXCLUDE (side), row_number() OVER (ORDER BY date DESC, rubber_id DESC, result) - {offset} AS place, count(*) OVER () AS total FROM m) SELECT *, {offset} + 20 < total AS has_more FROM n WHERE place > 0 AND place <= 20"""


def _page(d: Domain, source: str, offset: int) -> DataFrame:
    page = exact_page(matches_of(d, focus(d, 1), source), [F.desc("date"), F.desc("rubber_id"), F.asc("result")], 20, offset)
    return page.withColumns({x: F.col(x).cast("bigint") for x in ("place", "total")})


@query("q17_matches_all", _matches_sql("true", 40))
def matches_all(d: Domain) -> DataFrame:
    """The third page of twenty of the busiest player's matches from every source, by offset, with the total."""
    return _page(d, "all", 40)


@query("q17_matches_league", _matches_sql(f"division <> {TOURNAMENTS}", 20))
def matches_league(d: Domain) -> DataFrame:
    return _page(d, "league", 20)


@query("q17_matches_tournament", _matches_sql(f"division = {TOURNAMENTS}", 0))
def matches_tournament(d: Domain) -> DataFrame:
    return _page(d, "tournament", 0)


#: What a direct win counts in points of win rate, and the scores and counts between verdicts.
DIRECT, EVEN, CLOSE, SOME, MANY = 12, 3, 5, 2, 5


def evidence(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """What speaks for either of two players: confidence, predicted (A, B or even) and the reasons in a line each.

    pairs: player_a, player_b, encounters, a_wins, b_wins; records: player_id, played, wins, where players without matches may be missing.
    """
    rate = F.when(F.col("played") > 0, F.floor((200 * F.col("wins") + F.col("played")) / (2 * F.col("played")))).otherwise(0)
    of = lambda side: records.select(F.col("player_id").alias(f"player_{side}"), rate.cast("bigint").alias(f"{side}_rate"))
    p = pairs.join(of("a"), "player_a", "left").join(of("b"), "player_b", "left").fillna(0, ["a_rate", "b_rate"])
    direct, form = F.col("a_wins") - F.col("b_wins"), F.col("a_rate") - F.col("b_rate")
    score = direct * DIRECT + form
    who = lambda x: F.when(x > 0, "Player A").otherwise("Player B")
    words = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    # fixed values: the sentences
    series = (
        F.when(F.col("encounters") == 0, "No direct encounters are recorded, so the comparison relies on broader player records.")
        .when(direct == 0, words("The direct series is level across ", F.col("encounters"), " encounters."))
        .otherwise(words(who(direct), " leads the direct series by ", F.abs(direct), F.when(F.abs(direct) == 1, " match.").otherwise(" matches.")))
    )
    overall = F.when(F.abs(form) >= CLOSE, words(who(form), " has the stronger overall recorded win rate by ", F.abs(form), " percentage points.")).otherwise("Their overall recorded win rates are closely matched.")
    sure = F.when(F.col("encounters") >= MANY, "high").when(F.col("encounters") >= SOME, "medium").otherwise("low")
    careful = F.when(F.col("encounters") < MANY, "Treat the prediction cautiously because the direct sample is limited.")
    predicted: Column = F.when(score > EVEN, "A").when(score < -EVEN, "B").otherwise("even")
    return p.select("player_a", "player_b", "encounters", "a_wins", "b_wins", "a_rate", "b_rate", score.alias("score"), sure.alias("confidence"), predicted.alias("predicted"), F.concat_ws("\n", series, overall, careful).alias("reasons"))


@query("q27_evidence", f"""WITH p AS (SELECT player_id AS player_a, opponent_id AS player_b, count(*) AS encounters, count(*) FILTER (WHERE won) AS a_wins, count(*) FILTER (WHERE NOT won) AS b_wins FROM singles WHERE player_id < opponent_id GROUP BY ALL), r AS (SELECT player_id, {PERCENT_SQL.format("count(*) FILTER (WHERE won)", "count(*)")} AS rate FROM singles GROUP BY player_id),
    s AS (SELECT p.*, a.rate AS a_rate, b.rate AS b_rate, a_wins - b_wins AS direct, a.rate - b.rate AS form FROM p JOIN r a ON a.player_id = player_a JOIN r b ON b.player_id = player_b), v AS (SELECT *, direct * {DIRECT} + form AS score FROM s)
    SELECT player_a, player_b, encounters, a_wins, b_wins, a_rate, b_rate, score, CASE WHEN encounters >= {MANY} THEN 'high' WHEN encounters >= {SOME} THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN score > {EVEN} THEN 'A' WHEN score < -{EVEN} THEN 'B' ELSE 'even' END AS predicted,
        CASE WHEN direct = 0 THEN 'The direct series is level across ' || encounters || ' encounters.' ELSE CASE WHEN direct > 0 THEN 'Player A' ELSE 'Player B' END || ' leads the direct series by ' || abs(direct) || CASE WHEN abs(direct) = 1 THEN ' match.' ELSE ' matches.' END END
        || chr(10) || CASE WHEN abs(form) >= {CLOSE} THEN CASE WHEN form > 0 THEN 'Player A' ELSE 'Player B' END || ' has the stronger overall recorded win rate by ' || abs(form) || ' percentage points.' ELSE 'Their overall recorded win rates are closely matched.' END
        || CASE WHEN encounters < {MANY} THEN chr(10) || 'Treat the prediction cautiously because the direct sample is limited.' ELSE '' END AS reasons FROM v""")
def pair_evidence(d: Domain) -> DataFrame:
    """For every two players that met: their series, their records and the verdict; a match that A didn't win is B's."""
    s = singles(d)
    pairs = s.where("player_id < opponent_id").groupBy(F.col("player_id").alias("player_a"), F.col("opponent_id").alias("player_b")).agg(F.count("*").alias("encounters"), F.count_if("won").alias("a_wins"), F.count_if(~F.col("won")).alias("b_wins"))
    return evidence(pairs, s.groupBy("player_id").agg(F.count("*").alias("played"), F.count_if("won").alias("wins")))


@query("q36_season_history", f"""WITH {RESULTS_SQL}, c AS (SELECT season_id, competition_id, team FROM table_rows WHERE place = 1), t AS (SELECT season_id, count(DISTINCT team) AS teams FROM (SELECT season_id, unnest([home_team, away_team]) AS team FROM fixtures WHERE NOT deleted) GROUP BY season_id),
    f AS (SELECT season_id, league_id, count(DISTINCT competition_id) AS divisions, count(*) AS fixtures, max(date_played) AS last_day FROM fixtures WHERE NOT deleted GROUP BY ALL), j AS (SELECT season_id, CAST(to_json(list_sort(list(DISTINCT {{'division_name': CAST(competition_id AS VARCHAR), 'team_name': CAST(team AS VARCHAR)}}))) AS VARCHAR) AS champions FROM c GROUP BY season_id),
    k AS (SELECT f.league_id, f.season_id, is_active, divisions, teams, fixtures, coalesce(champions, '[]') AS champions, row_number() OVER (PARTITION BY f.league_id ORDER BY is_active DESC, last_day DESC NULLS LAST, f.season_id DESC) AS place FROM f JOIN seasons s ON s.season_id = f.season_id LEFT JOIN t ON t.season_id = f.season_id LEFT JOIN j ON j.season_id = f.season_id) SELECT * FROM k WHERE place <= 6""")
def season_history(d: Domain) -> DataFrame:
    """The latest six seasons of each league with their divisions, teams and fixtures, and the champions as a JSON array of objects."""
    f = d.fixtures.where("not deleted")
    counts = f.groupBy("season_id", "league_id").agg(F.countDistinct("competition_id").alias("divisions"), F.count("*").alias("fixtures"), F.max("date_played").alias("last_day"))
    teams = f.select("season_id", F.explode(F.array("home_team", "away_team")).alias("team")).groupBy("season_id").agg(F.countDistinct("team").alias("teams"))
    best = standings(d).where("place = 1").select("season_id", F.struct(F.col("competition_id").cast("string").alias("division_name"), F.col("team").cast("string").alias("team_name")).alias("c"))
    champions = best.groupBy("season_id").agg(F.to_json(F.sort_array(F.collect_set("c"))).alias("champions"))
    every = counts.join(d.seasons.select("season_id", "is_active"), "season_id").join(teams, "season_id", "left").join(champions, "season_id", "left")
    place = F.row_number().over(Window.partitionBy("league_id").orderBy(F.desc("is_active"), F.desc_nulls_last("last_day"), F.desc("season_id"))).cast("bigint")
    return every.withColumn("place", place).where("place <= 6").select("league_id", "season_id", "is_active", "divisions", "teams", "fixtures", F.coalesce("champions", F.lit("[]")).alias("champions"), "place")


def movers(periods: DataFrame, n: int = 5) -> DataFrame:
    """The n players whose rating rose most in a run and the n whose fell most: kind, place, player_id, change, rating before and after, deviation after.

    Ties go to the smaller player_id.  First and last period come from one grouping.
    """
    order = F.struct("day")
    p = periods.groupBy("player_id").agg(F.sum(F.col("rating") - F.col("rating_before")).alias("change"), F.min_by("rating_before", order).alias("rating_before"), F.max_by(F.struct("rating", "deviation"), order).alias("l"))
    p = p.select("player_id", "change", "rating_before", F.col("l.rating").alias("rating_after"), F.col("l.deviation").alias("deviation_after"))
    up = p.where("change > 0").orderBy(F.desc("change"), "player_id").limit(n).withColumn("kind", F.lit("increase"))
    down = p.where("change < 0").orderBy("change", "player_id").limit(n).withColumn("kind", F.lit("decrease"))
    return up.unionByName(down)


@query("q65_movers")
def run_movers(d: Domain) -> DataFrame:
    """Who rose and fell most in the latest half year of the fold."""
    p = written(rating_periods(eligible(d)))
    recent = p.crossJoin(F.broadcast(p.agg(F.add_months(F.max("day"), -6).alias("since")))).where("day > since")
    return movers(recent).join(d.players.select("player_id", F.col("name").alias("player_name")), "player_id", "left")


# Jobs of a queue, from the log: a row is a job that may have been tried, be locked, and run at or after the time it was seen.
JOBS_SQL = """WITH jobs AS (SELECT event_id AS job_id, kind AS task, event_id % 5 AS attempts, CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END AS max_attempts, event_id % 7 = 0 AS locked, seen_at AS created_at, seen_at + to_minutes(event_id % 600) AS updated_at, seen_at + to_hours(event_id % 30) AS run_at,
        CASE WHEN event_id % 5 > 0 THEN kind || ' failed for ' || resource_id END AS last_error FROM log), j AS (SELECT *, (SELECT max(seen_at) FROM log) AS now FROM jobs),
    t AS (SELECT *, attempts >= max_attempts AS failed, attempts < max_attempts AND NOT locked AND run_at <= now AS ready, attempts < max_attempts AND NOT locked AND run_at > now AS scheduled FROM j)"""
COUNTS_SQL = "count(*) AS total, count(*) FILTER (WHERE locked) AS running, count(*) FILTER (WHERE ready) AS ready, count(*) FILTER (WHERE scheduled) AS scheduled, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE failed AND updated_at >= date_trunc('day', now)) AS active_failed, count(*) FILTER (WHERE failed AND updated_at < date_trunc('day', now)) AS historical_failed"


def jobs(d: Domain) -> DataFrame:
    """The queue: job_id, task, attempts, max_attempts, locked, times, last_error, and now."""
    i = F.col("event_id")
    tried = i % 5
    rows = d.events.select(
        i.alias("job_id"), F.col("kind").alias("task"), tried.alias("attempts"), F.when(i % 2 == 0, 4).otherwise(3).alias("max_attempts"), (i % 7 == 0).alias("locked"), F.col("seen_at").alias("created_at"),
        (F.col("seen_at") + F.make_dt_interval(mins=(i % 600).cast("int"))).alias("updated_at"), (F.col("seen_at") + F.make_dt_interval(hours=(i % 30).cast("int"))).alias("run_at"), F.when(tried > 0, F.concat("kind", F.lit(" failed for "), F.col("resource_id").cast("string"))).alias("last_error"),
    )
    return rows.crossJoin(F.broadcast(d.events.agg(F.max("seen_at").alias("now"))))


def queue_states(j: DataFrame) -> DataFrame:
    """j with failed, ready and scheduled: a job out of attempts has failed, locked or not; one that is neither failed nor locked waits for its time or is ready."""
    failed, due = F.col("attempts") >= F.col("max_attempts"), F.col("run_at") <= F.col("now")
    free = ~failed & ~F.col("locked")
    return j.withColumns({"failed": failed, "ready": free & due, "scheduled": free & ~due})


def _counts() -> list[Column]:
    today = F.col("updated_at") >= F.date_trunc("day", "now")
    each = {"running": F.col("locked"), "ready": F.col("ready"), "scheduled": F.col("scheduled"), "failed": F.col("failed"), "active_failed": F.col("failed") & today, "historical_failed": F.col("failed") & ~today}
    return [F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in each.items())]


@query("q97_queue_totals", JOBS_SQL + f" SELECT {COUNTS_SQL}, min(created_at) FILTER (WHERE NOT failed) AS oldest_pending_at FROM t")
def queue_totals(d: Domain) -> DataFrame:
    return queue_states(jobs(d)).agg(*_counts(), F.min(F.when(~F.col("failed"), F.col("created_at"))).alias("oldest_pending_at"))


@query("q97_queue_tasks", JOBS_SQL + f", g AS (SELECT task, {COUNTS_SQL}, min(created_at) AS oldest_created_at, max(updated_at) AS latest_updated_at, max(left(last_error, 500)) AS latest_error FROM t GROUP BY task) SELECT *, row_number() OVER (ORDER BY failed DESC, running DESC, total DESC, task) AS place FROM g")
def queue_tasks(d: Domain) -> DataFrame:
    """The queue by task, most failures first; a row a task."""
    g = queue_states(jobs(d)).groupBy("task").agg(*_counts(), F.min("created_at").alias("oldest_created_at"), F.max("updated_at").alias("latest_updated_at"), F.max(F.left("last_error", F.lit(500))).alias("latest_error"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("failed"), F.desc("running"), F.desc("total"), "task")).cast("bigint"))


@query("q97_queue_jobs", JOBS_SQL + """, s AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN locked THEN 'running' WHEN run_at > now THEN 'scheduled' ELSE 'ready' END AS state FROM t)
    SELECT job_id, task, state, CAST(attempts AS BIGINT) AS attempts, CAST(max_attempts AS BIGINT) AS max_attempts, created_at, updated_at, run_at, nullif(left(coalesce(last_error, ''), 500), '') AS last_error FROM s ORDER BY CASE state WHEN 'failed' THEN 0 WHEN 'running' THEN 1 WHEN 'ready' THEN 2 ELSE 3 END, updated_at DESC, job_id LIMIT 50""")
def queue_jobs(d: Domain) -> DataFrame:
    """The first fifty jobs, failed ones before running, ready and scheduled ones, the latest first."""
    state = F.when(F.col("failed"), "failed").when(F.col("locked"), "running").when(F.col("scheduled"), "scheduled").otherwise("ready")
    s = queue_states(jobs(d)).withColumn("state", state)
    place = F.when(F.col("state") == "failed", 0).when(F.col("state") == "running", 1).when(F.col("state") == "ready", 2).otherwise(3)
    error = F.nullif(F.left(F.coalesce("last_error", F.lit("")), F.lit(500)), F.lit(""))
    page = s.orderBy(place, F.desc("updated_at"), "job_id").limit(50)
    return page.select("job_id", "task", "state", F.col("attempts").cast("bigint").alias("attempts"), F.col("max_attempts").cast("bigint").alias("max_attempts"), "created_at", "updated_at", "run_at", error.alias("last_error"))


# Where a source shows a competition's table and a fixture's card; kinds of sources without such pages give no address.
ADDRESSES = {
    ("api", "competition"): "{base}/api/divisions/{competition}/standings",
    ("api", "fixture"): "{base}/api/matches/{fixture}/sets",
    ("site", "competition"): "{base}/{league}/Tables/{season}/{competition}",
    ("site", "fixture"): "{base}/{league}/Results/MatchCard/{season}/{fixture}",
}


def source_address(kind: Column, page: str, **parts: Column) -> Column:
    """A page's address at its source: the template of the source's kind with its parts filled in; null for other kinds and where a part is missing."""
    out = F.lit(None).cast("string")
    for (k, p), template in ADDRESSES.items():
        if p == page:
            pieces = [parts[x[1:]].cast("string") if x.startswith("{") else F.lit(x) for x in template.replace("{", "\0{").replace("}", "\0").split("\0") if x]
            out = F.when(kind == k, F.concat(*pieces)).otherwise(out)
    return out


_SITE_SQL = "'https://s' || league_id || '.example'"


@query("f19_source_addresses", f"""WITH p AS (SELECT *, CASE league_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'site' END AS kind, {_SITE_SQL} AS base FROM fixtures WHERE NOT deleted)
    SELECT fixture_id, CASE kind WHEN 'api' THEN base || '/api/divisions/' || competition_id || '/standings' WHEN 'site' THEN base || '/' || league_id || '/Tables/' || season_id || '/' || competition_id END AS competition_url, CASE kind WHEN 'api' THEN base || '/api/matches/' || fixture_id || '/sets' WHEN 'site' THEN base || '/' || league_id || '/Results/MatchCard/' || season_id || '/' || fixture_id END AS fixture_url FROM p""")
def source_addresses(d: Domain) -> DataFrame:
    """Where each fixture and its competition can be seen: leagues' sources are of two kinds by turns, or of one without pages."""
    league = F.col("league_id")
    kind = F.when(league % 3 == 0, "api").when(league % 3 == 1, "site")
    parts = {"base": F.concat(F.lit("https://s"), league.cast("string"), F.lit(".example")), "league": league, "season": F.col("season_id"), "competition": F.col("competition_id"), "fixture": F.col("fixture_id")}
    return d.fixtures.where("not deleted").select("fixture_id", source_address(kind, "competition", **parts).alias("competition_url"), source_address(kind, "fixture", **parts).alias("fixture_url"))


# How much both must have played, against how many, for more than a low confidence.
HIGH_SAMPLE, HIGH_SHARED, MEDIUM_SAMPLE = 30, 5, 14


def shared_confidence(sample: Column, shared: Column) -> Column:
    return F.when((sample >= HIGH_SAMPLE) & (shared >= HIGH_SHARED), "high").when(sample >= MEDIUM_SAMPLE, "medium").otherwise("low")


@query("u10_shared_confidence", COMMON_SQL + f", s AS (SELECT count(*) AS shared, CAST(coalesce(sum(least(played_1, played_2)), 0) AS BIGINT) AS sample FROM c) SELECT shared, sample, CASE WHEN sample >= {HIGH_SAMPLE} AND shared >= {HIGH_SHARED} THEN 'high' WHEN sample >= {MEDIUM_SAMPLE} THEN 'medium' ELSE 'low' END AS confidence FROM s")
def common_confidence(d: Domain) -> DataFrame:
    """How far the common opponents of the two busiest players can be trusted."""
    s = common_opponents(d).agg(F.count("*").alias("shared"), F.coalesce(F.sum(F.least("played_1", "played_2")), F.lit(0)).alias("sample"))
    return s.withColumn("confidence", shared_confidence(F.col("sample"), F.col("shared")))


@query("q28_leaders_version", "SELECT greatest((SELECT max(updated_on) FROM rubbers WHERE NOT deleted), (SELECT max(created_on) FROM fixtures WHERE NOT deleted)) AS data_version")
def leaders_version(d: Domain) -> DataFrame:
    """The latest change in any table that the leader boards depend on; a table without rows doesn't count."""
    tables = ((d.rubbers, "updated_on"), (d.fixtures, "created_on"))
    rows = [t.where("not deleted").agg(F.max(c).alias("v")) for t, c in tables]
    return rows[0].unionByName(rows[1]).agg(F.max("v").alias("data_version"))


@query("q28_pair_version", f"""WITH {HISTORY_SQL}, p AS (SELECT player_id FROM focus WHERE k <= 2), r AS (SELECT max(greatest(updated_on, created_on)) AS rubbers_at, count(DISTINCT opponent_id) AS opponents FROM singles JOIN p USING (player_id)), h AS (SELECT max(week) AS history_at FROM hist JOIN p USING (player_id))
    SELECT rubbers_at, history_at, opponents, greatest(rubbers_at, history_at) AS data_version FROM r, h""")
def pair_version(d: Domain) -> DataFrame:
    """The latest change in all that a comparison of the two busiest players depends on: their matches with the fixtures, and their rating history."""
    two = F.broadcast(focus(d).select("player_id"))
    s = singles(d).join(two, "player_id", "left_semi")
    r = s.agg(F.max(F.greatest("updated_on", "created_on")).alias("rubbers_at"), F.countDistinct("opponent_id").alias("opponents"))
    h = weekly(s).agg(F.max("week").alias("history_at"))
    return r.crossJoin(F.broadcast(h)).withColumn("data_version", F.greatest("rubbers_at", "history_at"))
