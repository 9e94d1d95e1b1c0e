"""Player queries: leaders, profiles, form, streaks, insights, match lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sides import focus, halves, rate, sides, singles
from ..sources.adapter import Domain
from .catalog import query

MIN_PLAYED, LIMIT = 3, 50
PCT = "CAST((20000 * {w} + {p}) // (2 * {p}) AS DOUBLE) / 100"


def pct(w: str, p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {PCT.format(w=w, p=p)} END"


def n_if(cond: Column | str) -> Column:
    return F.count(F.when(F.expr(cond) if isinstance(cond, str) else cond, 1))


# ---- leader boards


def leader_table(d: Domain) -> DataFrame:
    """Season totals and the last ten results of every player in the active seasons.

    Deleted fixtures count here, deleted rubbers and players don't.
    """
    live = d.rubbers.where(~F.col("deleted") & ~F.col("is_doubles") & (F.col("outcome") != "walkover")).drop("deleted")
    f = d.fixtures.select("fixture_id", "season_id", "date_played", "created_on")
    own = halves(live.join(f, "fixture_id")).join(d.seasons.where("is_active").select("season_id"), "season_id", "left_semi")
    p = d.players.where(~F.col("deleted")).select(F.col("player_id").alias("raw"), F.coalesce("canonical_id", "player_id").alias("player_id"))
    rows = own.join(p, "raw").select("player_id", (F.col("own") > F.col("opp")).alias("won"), F.coalesce("date_played", "played_on", "created_on").alias("day"), "rubber_id", "side")
    w = Window.partitionBy("player_id").orderBy(F.desc("day"), F.desc("rubber_id"), "side")
    agg = rows.withColumn("k", F.row_number().over(w)).groupBy("player_id").agg(
        F.count("*").alias("played"), n_if("won").alias("wins"),
        n_if("k <= 10").alias("played_10"), n_if("k <= 10 and won").alias("wins_10"),
        n_if("k <= 5").alias("played_5"), n_if("k <= 5 and won").alias("wins_5"),
        n_if("k between 6 and 10").alias("played_prev"), n_if("k between 6 and 10 and won").alias("wins_prev"),
        F.min("day").alias("first_day"),
    )
    named = d.players.where(~F.col("deleted")).select("player_id", "name")
    score = F.round((F.col("wins").cast("decimal(20,10)") * 70 / F.col("played") + F.least("played", F.lit(30)).cast("decimal(20,10)")), 2)
    return agg.join(named, "player_id").withColumns({
        "win_rate": rate(F.col("wins"), F.col("played")),
        "rate_10": rate(F.col("wins_10"), F.col("played_10")),
        "rate_5": rate(F.col("wins_5"), F.col("played_5")),
        "combined": score.cast("double"),
        "improvement": ((F.col("wins_5") - F.col("wins_prev")) * 20).cast("double"),
    })


MODES = {
    "combined": (f"played >= {MIN_PLAYED}", "combined", ("played", "wins", "win_rate"), "combined"),
    "win_pct": ("played >= 10", "win_rate", ("played", "wins", "win_rate"), None),
    "most_played": ("true", "played", ("played", "wins", "win_rate"), None),
    "form": (f"played_10 >= {MIN_PLAYED}", "rate_10", ("played_10", "wins_10", "rate_10"), None),
    "improving": ("played_5 = 5 and played_prev = 5 and improvement > 0", "improvement", ("played_5", "wins_5", "rate_5"), "improvement"),
    "new_faces": ("true", "first_day", ("played", "wins", "win_rate"), None),
}

LEADERS_SQL = f"""
WITH mine AS (
    SELECT coalesce(p.canonical_id, p.player_id) AS player_id, own > opp AS won, coalesce(date_played, played_on, created_on) AS day, rubber_id, side
    FROM (
        SELECT rubber_id, 'home' AS side, fixture_id, home_1 AS raw, home_games AS own, away_games AS opp, played_on FROM rubbers WHERE NOT deleted AND NOT is_doubles AND outcome <> 'walkover'
        UNION ALL SELECT rubber_id, 'away', fixture_id, away_1, away_games, home_games, played_on FROM rubbers WHERE NOT deleted AND NOT is_doubles AND outcome <> 'walkover'
    ) h JOIN fixtures USING (fixture_id) JOIN seasons USING (season_id) JOIN players p ON p.player_id = raw WHERE is_active AND NOT p.deleted
), ranked AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY day DESC, rubber_id DESC, side) AS k FROM mine
), agg AS (
    SELECT player_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE k <= 10) AS played_10, count(*) FILTER (WHERE k <= 10 AND won) AS wins_10,
        count(*) FILTER (WHERE k <= 5) AS played_5, count(*) FILTER (WHERE k <= 5 AND won) AS wins_5, count(*) FILTER (WHERE k BETWEEN 6 AND 10) AS played_prev,
        count(*) FILTER (WHERE k BETWEEN 6 AND 10 AND won) AS wins_prev, min(day) AS first_day FROM ranked GROUP BY player_id
), board AS (
    SELECT agg.*, name, {pct("wins", "played")} AS win_rate, {pct("wins_10", "played_10")} AS rate_10, {pct("wins_5", "played_5")} AS rate_5,
        CAST((2 * (7000 * wins + 100 * least(played, 30) * played) + played) // (2 * played) AS DOUBLE) / 100 AS combined, CAST((wins_5 - wins_prev) * 20 AS DOUBLE) AS improvement
    FROM agg JOIN players USING (player_id) WHERE NOT deleted
)
"""


def _leaders(mode: str) -> None:
    keep, order, (played, wins, share), score = MODES[mode]
    tie = "win_rate DESC NULLS LAST, " if mode == "most_played" else ""
    sql = f"""{LEADERS_SQL}
    SELECT player_id, name, {played} AS played, {wins} AS wins, {played} - {wins} AS losses, {share} AS win_rate, {score or "CAST(NULL AS DOUBLE)"} AS score, first_day, rank FROM (
        SELECT board.*, row_number() OVER (ORDER BY {order} DESC NULLS LAST, played DESC, wins DESC, {tie}name, player_id) AS rank FROM board WHERE {keep}) WHERE rank <= {LIMIT}"""

    @query(f"q03_leaders_{mode}", sql)
    def run(d: Domain) -> DataFrame:
        ties = [F.desc_nulls_last("win_rate")] if mode == "most_played" else []
        by = [F.desc_nulls_last(order), F.desc("played"), F.desc("wins"), *ties, "name", "player_id"]
        top = leader_table(d).where(keep).orderBy(*by).limit(LIMIT)
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("bigint"))
        return top.select("player_id", "name", F.col(played).alias("played"), F.col(wins).alias("wins"), (F.col(played) - F.col(wins)).alias("losses"), F.col(share).alias("win_rate"), (F.col(score) if score else F.lit(None).cast("double")).alias("score"), "first_day", "rank")


for _m in MODES:
    _leaders(_m)


# ---- counts, search, profiles


@query("q01_counts", "SELECT (SELECT count(*) FROM players WHERE NOT deleted) AS players, (SELECT count(*) FROM rubbers WHERE NOT deleted) AS matches")
def counts(d: Domain) -> DataFrame:
    p = d.players.where(~F.col("deleted")).agg(F.count("*").alias("players"))
    return p.crossJoin(d.rubbers.where(~F.col("deleted")).agg(F.count("*").alias("matches")))


@query("q02_identity", """SELECT p.player_id AS requested, c.player_id, c.name, m.source_ids FROM players p JOIN ident i USING (player_id) JOIN players c ON c.player_id = i.canonical
    JOIN (SELECT canonical, string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) AS source_ids FROM ident GROUP BY canonical) m ON m.canonical = i.canonical""")
def identity(d: Domain) -> DataFrame:
    """Each id with its canonical player and all ids of that player."""
    groups = d.identity.groupBy("canonical").agg(F.array_join(F.transform(F.sort_array(F.collect_set("player_id")), lambda x: x.cast("string")), ",").alias("source_ids"))
    named = d.players.select(F.col("player_id").alias("canonical"), "name")
    return d.identity.join(groups, "canonical").join(named, "canonical").select(F.col("player_id").alias("requested"), F.col("canonical").alias("player_id"), "name", "source_ids")


SEARCH = "%#00000000_%"


@query("q04_search_global", """WITH page AS (SELECT player_id, name, count(*) OVER () AS total FROM players WHERE canonical_id IS NULL AND NOT deleted AND name ILIKE '%#00000000_%' ORDER BY name, player_id LIMIT 5)
    SELECT page.player_id, page.name, total, count(rubber_id) AS played, count(rubber_id) FILTER (WHERE won) AS wins FROM page LEFT JOIN singles USING (player_id) GROUP BY ALL""")
def search_global(d: Domain) -> DataFrame:
    """The page of names first, then the matches of its members alone."""
    found = d.players.where(F.col("canonical_id").isNull() & ~F.col("deleted") & F.col("name").ilike(SEARCH)).select("player_id", "name")
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("name", "player_id").limit(5).crossJoin(F.broadcast(total))
    mine = singles(d).join(F.broadcast(page.select("player_id")), "player_id", "left_semi").groupBy("player_id").agg(F.count("*").alias("played"), n_if("won").alias("wins"))
    return page.join(mine, "player_id", "left").fillna(0, ["played", "wins"])


@query("q05_search_scoped", """WITH a AS (SELECT player_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins FROM singles WHERE league_id = 1 GROUP BY player_id)
    SELECT player_id, name, played, wins, count(*) OVER () AS total FROM players JOIN a USING (player_id) WHERE NOT deleted AND name ILIKE '%1%' ORDER BY played DESC, player_id LIMIT 20""")
def search_scoped(d: Domain) -> DataFrame:
    """Names with activity in one league, with the number of all."""
    a = singles(d).where("league_id = 1").groupBy("player_id").agg(F.count("*").alias("played"), n_if("won").alias("wins"))
    found = d.players.where(~F.col("deleted") & F.col("name").ilike("%1%")).select("player_id", "name").join(a, "player_id")
    return found.orderBy(F.desc("played"), "player_id").limit(20).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@query("q06_browse", """WITH last AS (SELECT max(day) AS day FROM singles), a AS (SELECT player_id, count(*) AS played FROM singles WHERE singles.day > (SELECT day FROM last) - 100 GROUP BY player_id)
    SELECT player_id, name, played, count(*) OVER () AS total FROM players JOIN a USING (player_id) WHERE NOT deleted ORDER BY played DESC, name, player_id LIMIT 20""")
def browse(d: Domain) -> DataFrame:
    """Most active of the last hundred days of the data."""
    s = singles(d)
    last = s.agg(F.max("day").alias("last_day"))
    a = s.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("last_day", 100)).groupBy("player_id").agg(F.count("*").alias("played"))
    found = d.players.where(~F.col("deleted")).select("player_id", "name").join(a, "player_id")
    return found.orderBy(F.desc("played"), "name", "player_id").limit(20).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@query("q07_profile", f"""WITH career AS (SELECT player_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE lost) AS losses FROM sides WHERE outcome <> 'walkover' GROUP BY player_id),
    form AS (SELECT player_id, string_agg(CASE WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY day DESC, rubber_id DESC, side) AS form FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY day DESC, rubber_id DESC, side) AS k FROM singles) WHERE k <= 20 GROUP BY player_id)
    SELECT player_id, name, played, wins, losses, {pct("wins", "played")} AS win_rate, form FROM career JOIN players USING (player_id) LEFT JOIN form USING (player_id)""")
def profile(d: Domain) -> DataFrame:
    """Career of every player, doubles included, and the last twenty singles, latest first; a tie shows as L."""
    career = sides(d).where("outcome <> 'walkover'").groupBy("player_id").agg(F.count("*").alias("played"), n_if("won").alias("wins"), n_if("lost").alias("losses"))
    w = Window.partitionBy("player_id").orderBy(F.desc("day"), F.desc("rubber_id"), "side")
    last = singles(d).withColumn("k", F.row_number().over(w)).where("k <= 20")
    form = last.groupBy("player_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("won"), "W").otherwise("L").alias("x")))), lambda s: s["x"]), "").alias("form"))
    return career.join(d.players.select("player_id", "name"), "player_id").join(form, "player_id", "left").select("player_id", "name", "played", "wins", "losses", rate(F.col("wins"), F.col("played")).alias("win_rate"), "form")


@query("q08_affiliations", "SELECT DISTINCT player_id, team, league_id, season_id FROM sides JOIN seasons USING (season_id, league_id) WHERE is_active")
def affiliations(d: Domain) -> DataFrame:
    """Teams of the active seasons that each player stood for."""
    return sides(d).join(d.seasons.where("is_active").select("season_id"), "season_id", "left_semi").select("player_id", "team", "league_id", "season_id").distinct()


@query("q09_stats", """SELECT player_id, count(*) AS total, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE lost) AS losses FROM (
    SELECT rubber_id, i.canonical AS player_id, own > opp AS won, own < opp AS lost FROM half JOIN ident i ON i.player_id = raw WHERE outcome <> 'walkover'
    UNION ALL SELECT rubber_id, i.canonical, own > opp, own < opp FROM half JOIN ident i ON i.player_id = raw_partner WHERE outcome <> 'walkover') GROUP BY player_id""")
def stats(d: Domain) -> DataFrame:
    """Wins and losses over all four slots of a rubber, by explode and equi-join."""
    h = halves(d.matches).where("outcome <> 'walkover'").select(F.explode(F.array("raw", "raw_partner")).alias("raw"), (F.col("own") > F.col("opp")).alias("won"), (F.col("own") < F.col("opp")).alias("lost"))
    known = h.join(d.identity.select(F.col("player_id").alias("raw"), F.col("canonical").alias("player_id")), "raw")
    return known.groupBy("player_id").agg(F.count("*").alias("total"), n_if("won").alias("wins"), n_if("lost").alias("losses"))


@query("q10_nemesis", """WITH a AS (SELECT player_id, opponent_id, count(*) AS played, count(*) FILTER (WHERE lost) AS losses FROM singles WHERE opponent_id IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE lost) > 0)
    SELECT player_id, opponent_id, played, losses FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY losses DESC, played, opponent_id) AS k FROM a) WHERE k = 1""")
def nemesis(d: Domain) -> DataFrame:
    """For every player the opponent that beat them most."""
    a = singles(d).where("opponent_id is not null").groupBy("player_id", "opponent_id").agg(F.count("*").alias("played"), n_if("lost").alias("losses")).where("losses > 0")
    top = F.max_by(F.struct("opponent_id", "played", "losses"), F.struct("losses", -F.col("played"), -F.col("opponent_id"))).alias("t")
    return a.groupBy("player_id").agg(top).select("player_id", "t.*")


@query("q11_best_partner", """WITH a AS (SELECT s.player_id, i.canonical AS partner_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins FROM sides s JOIN ident i ON i.player_id = raw_partner WHERE is_doubles AND outcome <> 'walkover' GROUP BY ALL HAVING count(*) FILTER (WHERE won) > 0)
    SELECT player_id, partner_id, played, wins FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY wins DESC, played, partner_id) AS k FROM a) WHERE k = 1""")
def best_partner(d: Domain) -> DataFrame:
    partner = d.identity.select(F.col("player_id").alias("raw_partner"), F.col("canonical").alias("partner_id"))
    a = sides(d).where("is_doubles and outcome <> 'walkover'").join(partner, "raw_partner").groupBy("player_id", "partner_id").agg(F.count("*").alias("played"), n_if("won").alias("wins")).where("wins > 0")
    top = F.max_by(F.struct("partner_id", "played", "wins"), F.struct("wins", -F.col("played"), -F.col("partner_id"))).alias("t")
    return a.groupBy("player_id").agg(top).select("player_id", "t.*")


def runs(s: DataFrame) -> DataFrame:
    """Runs of like results: player_id, won, from_k, length (k counts from the first match), to_day.  Numbers of changes and of matches over one order, so rows are sorted once."""
    so_far = Window.partitionBy("player_id").orderBy("day", "rubber_id", "side")
    changed = ~F.col("won").eqNullSafe(F.lag("won").over(so_far)) | (F.row_number().over(so_far) == 1)
    a = s.withColumns({"k": F.row_number().over(so_far), "changed": changed}).withColumn("island", F.count_if("changed").over(so_far))
    return a.groupBy("player_id", "won", "island").agg(F.min("k").alias("from_k"), F.count("*").alias("length"), F.max("day").alias("to_day"))


def player_rows(d: Domain) -> DataFrame:
    """What runs are made of: the singles of a player in one task, in as many shares as the rubbers ask for."""
    return singles(d).select("player_id", "day", "rubber_id", "side", "won").repartition(d.shares, "player_id")


RUNS_SQL = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY day, rubber_id, side) AS k, row_number() OVER (PARTITION BY player_id, won ORDER BY day, rubber_id, side) AS j FROM singles),
    r AS (SELECT player_id, won, k - j AS island, min(k) AS from_k, count(*) AS length, max(day) AS to_day FROM a GROUP BY ALL)"""


@query("q12_current_streak", RUNS_SQL + " SELECT player_id, won, least(length, 10) AS length FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY from_k DESC) AS n FROM r) WHERE n = 1")
def current_streak(d: Domain) -> DataFrame:
    """The run that each player is on, counted to ten; a tie counts as not won."""
    return runs(player_rows(d)).groupBy("player_id").agg(F.max_by("won", "from_k").alias("won"), F.least(F.max_by("length", "from_k"), F.lit(10)).alias("length"))


@query("q16_longest_runs", RUNS_SQL + " SELECT player_id, coalesce(max(length) FILTER (WHERE won), 0) AS longest_win_run, coalesce(max(length) FILTER (WHERE NOT won), 0) AS longest_other_run, max(to_day) AS last_day FROM r GROUP BY player_id")
def longest_runs(d: Domain) -> DataFrame:
    longest = lambda c: F.coalesce(F.max(F.when(F.expr(c), F.col("length"))), F.lit(0))
    return runs(player_rows(d)).groupBy("player_id").agg(longest("won").alias("longest_win_run"), longest("not won").alias("longest_other_run"), F.max("to_day").alias("last_day"))


@query("q13_career_years", f"""WITH y AS (SELECT player_id, year(day) AS year, count(*) AS played, count(*) FILTER (WHERE won) AS wins FROM singles GROUP BY ALL),
    z AS (SELECT *, CASE WHEN played >= 5 THEN row_number() OVER (PARTITION BY player_id, played >= 5 ORDER BY CAST(wins AS DOUBLE) / played DESC, year) END AS k FROM y)
    SELECT player_id, CAST(year AS INTEGER) AS year, played, wins, {pct("wins", "played")} AS win_rate, coalesce(k = 1, false) AS is_peak FROM z""")
def career_years(d: Domain) -> DataFrame:
    """Each player's years, and the best of those with five matches or more."""
    y = singles(d).groupBy("player_id", F.year("day").alias("year")).agg(F.count("*").alias("played"), n_if("won").alias("wins"))
    k = F.row_number().over(Window.partitionBy("player_id", F.col("played") >= 5).orderBy(F.desc(F.col("wins") / F.col("played")), "year"))
    return y.withColumn("is_peak", (F.col("played") >= 5) & (k == 1)).select("player_id", "year", "played", "wins", rate(F.col("wins"), F.col("played")).alias("win_rate"), "is_peak")


@query("q15_score_patterns", f"""SELECT player_id, own, opp, side, count(*) AS played, {pct("count(*) FILTER (WHERE won)", "count(*)")} AS win_rate FROM singles WHERE score_source = 'games' GROUP BY ALL""")
def score_patterns(d: Domain) -> DataFrame:
    """Scores at home and away, for matches with games."""
    return singles(d).where("score_source = 'games'").groupBy("player_id", "own", "opp", "side").agg(F.count("*").alias("played"), rate(n_if("won"), F.count("*")).alias("win_rate"))


@query("q17_match_list", """WITH m AS (SELECT s.*, f.k AS focus, CASE WHEN score_source = 'win_loss_only' THEN CASE WHEN won THEN 'Won' WHEN lost THEN 'Lost' ELSE 'Drew' END
        ELSE CASE WHEN won THEN 'Won ' WHEN lost THEN 'Lost ' ELSE 'Drew ' END || CAST(own AS VARCHAR) || '-' || CAST(opp AS VARCHAR) END AS result FROM sides s JOIN focus f USING (player_id) WHERE f.k <= 2 AND opponent_id IS NOT NULL),
    c AS (SELECT focus, day, rubber_id FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY day DESC, rubber_id DESC, side) AS n FROM m) WHERE n = 10)
    SELECT m.player_id, m.rubber_id, m.day, opponent_id, result FROM (SELECT m.*, row_number() OVER (PARTITION BY m.focus ORDER BY m.day DESC, m.rubber_id DESC, m.side) AS n FROM m JOIN c USING (focus) WHERE m.day < c.day OR m.day = c.day AND m.rubber_id < c.rubber_id) m WHERE n <= 11""")
def match_list(d: Domain) -> DataFrame:
    """The second page of ten matches of the two busiest players, by keyset, with one row to look ahead."""
    verb = F.when(F.col("won"), "Won").when(F.col("lost"), "Lost").otherwise("Drew")
    result = F.when(F.col("score_source") == "win_loss_only", verb).otherwise(F.concat(verb, F.lit(" "), F.col("own").cast("string"), F.lit("-"), F.col("opp").cast("string")))
    m = sides(d).join(F.broadcast(focus(d).select("player_id")), "player_id", "left_semi").where("opponent_id is not null").withColumn("result", result)
    w = Window.partitionBy("player_id").orderBy(F.desc("day"), F.desc("rubber_id"), "side")
    cursor = m.withColumn("n", F.row_number().over(w)).where("n = 10").select("player_id", F.struct("day", "rubber_id").alias("cursor"))
    page = m.join(F.broadcast(cursor), "player_id").where(F.struct("day", "rubber_id") < F.col("cursor"))
    return page.withColumn("n", F.row_number().over(w)).where("n <= 11").select("player_id", "rubber_id", "day", "opponent_id", "result")


@query("q19_competition_summaries", """WITH a AS (SELECT s.player_id, competition_id, count(*) AS played, count(*) FILTER (WHERE won) AS wins, max(day) AS last_day FROM sides s JOIN focus f USING (player_id) WHERE f.k <= 2 GROUP BY ALL)
    SELECT player_id, competition_id, played, wins, last_day, total FROM (SELECT *, count(*) OVER (PARTITION BY player_id) AS total, row_number() OVER (PARTITION BY player_id ORDER BY last_day DESC, competition_id) AS n FROM a) WHERE n <= 10""")
def competition_summaries(d: Domain) -> DataFrame:
    a = sides(d).join(F.broadcast(focus(d).select("player_id")), "player_id", "left_semi").groupBy("player_id", "competition_id").agg(F.count("*").alias("played"), n_if("won").alias("wins"), F.max("day").alias("last_day"))
    mine = Window.partitionBy("player_id")
    return a.withColumn("total", F.count("*").over(mine)).withColumn("n", F.row_number().over(mine.orderBy(F.desc("last_day"), "competition_id"))).where("n <= 10").drop("n")


@query("q28_version_stamp", """SELECT player_id, greatest(max(updated_on), max(created_on), max(played_on)) AS version FROM sides GROUP BY player_id""")
def version_stamp(d: Domain) -> DataFrame:
    """The latest change behind each player's figures."""
    return sides(d).groupBy("player_id").agg(F.greatest(F.max("updated_on"), F.max("created_on"), F.max("played_on")).alias("version"))
