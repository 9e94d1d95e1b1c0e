"""Rating queries: classification, the fold and what is read from its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glicko
from ..operators.classify import CLASSIFIED_SQL, classified
from ..operators.ranking import placed
from ..operators.rating_fold import backtest, latest, rating_periods, report, weekly_ratings
from ..operators.sides import singles
from ..sources.adapter import Domain
from ..sources.staging import written
from .catalog import query
from .players import n_if
from .rivalry import HISTORY_SQL, weekly


def eligible(d: Domain) -> DataFrame:
    """Rated rubbers.  What the reason implies is asked for in plain conditions too, as these are applied before the rubbers are shuffled and joined."""
    implied = "not is_doubles and outcome = 'normal' and status = 'completed' and home_player is not null and away_player is not null"
    return classified(d).where(implied).where("reason = 'eligible'").select(F.col("effective_day").alias("day"), F.col("home_player").alias("home"), F.col("away_player").alias("away"), (F.col("home_games") > F.col("away_games")).alias("home_won"), "rubber_id", "home_games", "away_games")


@query("q48_classification", f"WITH {CLASSIFIED_SQL} SELECT rubber_id, effective_day, home_player, away_player, reason FROM classified")
def classification(d: Domain) -> DataFrame:
    return classified(d).select("rubber_id", "effective_day", "home_player", "away_player", "reason")


@query("q54_input_fingerprint", f"WITH {CLASSIFIED_SQL} SELECT league_id, season_id, md5(string_agg(CAST(rubber_id AS VARCHAR) || ':' || CAST(home_games AS VARCHAR) || '-' || CAST(away_games AS VARCHAR), ',' ORDER BY rubber_id)) AS fingerprint FROM classified WHERE reason = 'eligible' GROUP BY league_id, season_id")
def input_fingerprint(d: Domain) -> DataFrame:
    """md5 of each season's rated rubbers in order (a season is a bounded list); `set_fingerprint` is the form for any size."""
    r = classified(d).where("reason = 'eligible'")
    text = F.concat(F.col("rubber_id").cast("string"), F.lit(":"), F.col("home_games").cast("string"), F.lit("-"), F.col("away_games").cast("string"))
    return r.groupBy("league_id", "season_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rubber_id", text.alias("t")))), lambda x: x["t"]), ",")).alias("fingerprint"))


@query("q54_set_fingerprint")
def set_fingerprint(d: Domain) -> DataFrame:
    """Order-free fingerprint of all rated rubbers: sums combine in any order and need no sort."""
    r = classified(d).where("reason = 'eligible'")
    h = F.xxhash64("rubber_id", "home_player", "away_player", "home_games", "away_games", "effective_day")
    return r.agg(F.count("*").alias("rubbers"), F.bit_xor(h).alias("fingerprint"))


@query("q55_unique_opponents", f"WITH {CLASSIFIED_SQL} SELECT player_id, count(DISTINCT opponent) AS opponents FROM (SELECT home_player AS player_id, away_player AS opponent FROM classified WHERE reason = 'eligible' AND effective_day <= DATE '1999-06-30' UNION ALL SELECT away_player, home_player FROM classified WHERE reason = 'eligible' AND effective_day <= DATE '1999-06-30') GROUP BY player_id")
def unique_opponents(d: Domain) -> DataFrame:
    """Different opponents of each player up to a date."""
    e = eligible(d).where("day <= date'1999-06-30'")
    both = e.select(F.explode(F.array(F.struct(F.col("home").alias("player_id"), F.col("away").alias("o")), F.struct(F.col("away").alias("player_id"), F.col("home").alias("o"))))).select("col.*")
    return both.groupBy("player_id").agg(F.countDistinct("o").alias("opponents"))


@query("q49_rating_periods")
def periods(d: Domain) -> DataFrame:
    """Glicko-2 over all rated rubbers: a row for each player and day."""
    return rating_periods(eligible(d))


@query("q51_monthly_checkpoints")
def checkpoints(d: Domain) -> DataFrame:
    """The state of each player behind each month with matches: where a replay may start."""
    p = rating_periods(eligible(d))
    month = F.to_date(F.date_trunc("month", "day"))
    return p.groupBy("player_id", month.alias("month")).agg(F.max_by(F.struct("rating", "deviation", "volatility", "total_matches", "day"), "day").alias("s")).select("player_id", "month", "s.*")


def match_evidence(e: DataFrame, periods: DataFrame) -> DataFrame:
    """Each rated rubber from both sides, with the ratings before the day, what was expected and what the match changed, and the period it is part of."""
    row = lambda me, other, own, opp, won: F.struct(F.col(me).alias("player_id"), F.col(other).alias("opponent_id"), F.col(own).alias("own_games"), F.col(opp).alias("opponent_games"), won.alias("won"))
    sides = F.array(row("home", "away", "home_games", "away_games", F.col("home_won")), row("away", "home", "away_games", "home_games", ~F.col("home_won")))
    both = e.select("rubber_id", "day", F.explode(sides).alias("s")).select("rubber_id", "day", "s.*")
    own = periods.select("player_id", "day", "rating_before", "deviation_before", F.col("rating").alias("rating_after"), F.col("deviation").alias("deviation_after"), F.col("matches").alias("period_matches"), F.col("total_matches").alias("matches_after"), (F.col("rating") - F.col("rating_before")).alias("period_change"))
    theirs = periods.select(F.col("player_id").alias("opponent_id"), "day", F.col("rating_before").alias("opponent_rating"), F.col("deviation_before").alias("opponent_deviation"))
    out = both.join(own, ["player_id", "day"]).join(theirs, ["opponent_id", "day"])
    out = out.withColumn("expected", glicko.expected_score(F.col("rating_before"), F.col("opponent_rating"), F.col("opponent_deviation")))
    out = out.withColumn("surprise", F.col("won").cast("double") - F.col("expected"))
    changed = glicko.attributed_change(F.col("opponent_deviation"), F.col("deviation_after"), F.col("surprise"))
    told = glicko.information(F.col("expected"), F.col("opponent_deviation"))
    return out.withColumns({"attributed_change": changed, "information": told, "provisional_after": glicko.is_provisional(F.col("matches_after"), F.col("deviation_after"))})


@query("q52_match_audits")
def match_audits(d: Domain) -> DataFrame:
    """Each rated rubber from both sides: what was expected, how surprising the result was, and its share in the change of rating."""
    e = written(eligible(d))
    out = match_evidence(e, rating_periods(e))
    return out.select("rubber_id", "player_id", "opponent_id", "day", "won", "rating_before", "deviation_before", "opponent_rating", "opponent_deviation", "expected", "surprise", "attributed_change", "information")


@query("q52_audit_sums", f"""WITH {CLASSIFIED_SQL}, e AS (SELECT effective_day AS day, home_player AS h, away_player AS a FROM classified WHERE reason = 'eligible'), s AS (SELECT day, h AS p FROM e UNION ALL SELECT day, a FROM e)
    SELECT strftime(day, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS audits, count(DISTINCT (p, day)) AS periods, CAST(0 AS BIGINT) AS off FROM s GROUP BY 1""")
def audit_sums(d: Domain) -> DataFrame:
    """By month: audits, periods, and how many periods' change of rating is not the sum of what their matches are said to have changed."""
    e = written(eligible(d))
    p = match_evidence(e, rating_periods(e)).groupBy("player_id", "day").agg(F.count("*").alias("n"), F.abs(F.sum("attributed_change") - F.max("period_change")).alias("gap"), F.max("period_matches").alias("matches"))
    off = ~F.coalesce((F.col("gap") < 1e-6) & (F.col("n") == F.col("matches")), F.lit(False))
    return p.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("audits"), F.count("*").alias("periods"), F.count_if(off).alias("off"))


@query("q66_audit_evidence")
def player_evidence(d: Domain) -> DataFrame:
    """Each player's latest fifty included audits with both ratings before, the result, its share in the change, and the period behind it."""
    e = written(eligible(d))
    evidence = match_evidence(e, rating_periods(e)).withColumn("place", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("day"), "rubber_id"))).where("place <= 50")
    names = d.players.select(F.col("player_id").alias("opponent_id"), F.col("name").alias("opponent_name"))
    result = F.when(F.col("won"), "win").otherwise("loss").alias("result")
    score = F.concat_ws("-", F.col("own_games").cast("string"), F.col("opponent_games").cast("string")).alias("game_score")
    return evidence.join(names, "opponent_id", "left").select("player_id", "place", "rubber_id", F.col("day").alias("match_date"), "opponent_id", "opponent_name", result, score, "rating_before", "deviation_before", "opponent_rating", "opponent_deviation", "expected", "surprise", "attributed_change", "information", "rating_after", "deviation_after", "provisional_after", "period_matches", "period_change")


@query("q53_excluded_audits", f"WITH {CLASSIFIED_SQL} SELECT rubber_id, player_id, reason FROM (SELECT rubber_id, home_player AS player_id, reason FROM classified WHERE reason <> 'eligible' UNION ALL SELECT rubber_id, away_player, reason FROM classified WHERE reason <> 'eligible') WHERE player_id IS NOT NULL")
def excluded_audits(d: Domain) -> DataFrame:
    x = classified(d).where("reason <> 'eligible'").select("rubber_id", "reason", F.explode(F.array("home_player", "away_player")).alias("player_id"))
    return x.where("player_id is not null").select("rubber_id", "player_id", "reason")


def current_rankings(states: DataFrame, opponents: DataFrame, as_of) -> DataFrame:
    """Public rank among ranked players and rank among all, with the reason of those not ranked.

    states: player_id, rating, deviation, volatility, matches, last_day.  Ranks are
    over one row a player.
    """
    s = states.join(opponents, "player_id", "left").fillna(0, ["opponents"])
    days = F.datediff(as_of, "last_day")
    wide = glicko.inflated_deviation(F.col("deviation"), F.col("volatility"), days)
    s = s.withColumns({"days_inactive": days, "effective_deviation": wide, "reason": glicko.eligibility(F.lit(False), F.col("matches"), F.col("opponents"), days, wide)})
    s = s.withColumn("conservative", F.col("rating") - 2 * F.col("deviation"))
    return placed(s, [F.desc("conservative"), F.desc("matches"), F.asc("player_id")], {"historical_rank": F.lit(True), "rank": F.col("reason") == "ranked"})


CURRENT_SQL = f"""{HISTORY_SQL}, s AS (SELECT player_id, max_by(rating, week) AS rating, max(matches) AS matches, max(week) AS last_day FROM hist GROUP BY player_id),
    o AS (SELECT player_id, count(DISTINCT opponent_id) AS opponents FROM singles GROUP BY player_id), e AS (SELECT max(last_day) AS as_of FROM s),
    w AS (SELECT s.*, coalesce(opponents, 0) AS opponents, datediff('day', last_day, as_of) AS days_inactive, 173.7178 * least(350.0 / 173.7178, sqrt(pow(90.0 / 173.7178, 2) + 0.0036 * datediff('day', last_day, as_of) / 28)) AS wide FROM s CROSS JOIN e LEFT JOIN o USING (player_id)),
    r AS (SELECT *, CASE WHEN matches < 10 THEN 'insufficient_matches' WHEN opponents < 3 THEN 'insufficient_opponents' WHEN days_inactive > 365 THEN 'inactive' WHEN wide > 110 THEN 'high_uncertainty' ELSE 'ranked' END AS reason FROM w),
    current AS (SELECT player_id, CAST(rating AS BIGINT) AS rating, matches, reason, row_number() OVER by_rank AS historical_rank, CASE WHEN reason = 'ranked' THEN CAST(sum(CASE WHEN reason = 'ranked' THEN 1 ELSE 0 END) OVER (ORDER BY rating DESC, matches DESC, player_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS rank
    FROM r WINDOW by_rank AS (ORDER BY rating DESC, matches DESC, player_id))"""


@query("q56_current_rankings", f"WITH {CURRENT_SQL} SELECT * FROM current")
def rankings_from_history(d: Domain) -> DataFrame:
    """Current rankings over the plain running rating, which SQL can follow."""
    h = weekly(singles(d))
    s = h.groupBy("player_id").agg(F.max_by("rating", "week").alias("rating"), F.max("matches").alias("matches"), F.max("week").alias("last_day")).withColumns({"deviation": F.lit(90.0), "volatility": F.lit(0.06)})
    o = singles(d).groupBy("player_id").agg(F.countDistinct("opponent_id").alias("opponents"))
    end = s.agg(F.max("last_day").alias("as_of"))
    r = current_rankings(s.crossJoin(F.broadcast(end)), o, F.col("as_of"))
    return r.select("player_id", "rating", "matches", "reason", F.col("historical_rank").cast("bigint").alias("historical_rank"), F.col("rank").cast("bigint").alias("rank"))


def rating_history(d: Domain) -> DataFrame:
    """Weekly history of the fold's ratings over all rated rubbers, written once."""
    return written(weekly_ratings(rating_periods(eligible(d))))


@query("q50_rating_weeks")
def rating_weeks(d: Domain) -> DataFrame:
    """q50 over the fold's ratings: rating, deviation and matches behind each week with matches, and the week's change."""
    return rating_history(d)


@query("q25_ratings_twelve_weeks")
def ratings_twelve_weeks(d: Domain) -> DataFrame:
    """q25 over the fold's ratings, for all players: the latest, and the latest that is twelve weeks older than the last week."""
    h = rating_history(d)
    then = h.crossJoin(F.broadcast(h.agg(F.date_sub(F.max("week"), 84).alias("then"))))
    return then.groupBy("player_id").agg(F.max_by("rating", "week").alias("rating_now"), F.max_by("rating", F.when(F.col("week") <= F.col("then"), F.col("week"))).alias("rating_then"))


@query("q60_rating_changes")
def rating_changes(d: Domain) -> DataFrame:
    """q60 over the fold's ratings, for all weeks."""
    before = F.lag("rating").over(Window.partitionBy("player_id").orderBy("week"))
    return rating_history(d).select("player_id", "week", "rating", (F.col("rating") - before).alias("since_last"))


@query("q56_ratings_ranked")
def ratings_ranked(d: Domain) -> DataFrame:
    """q56 over the fold's ratings: every rated player with both ranks and the reason of those not ranked."""
    e = written(eligible(d))
    both = e.select(F.explode(F.array(F.struct(F.col("home").alias("player_id"), F.col("away").alias("o")), F.struct(F.col("away").alias("player_id"), F.col("home").alias("o"))))).select("col.*")
    s = latest(rating_periods(e)).select("player_id", "rating", "deviation", "volatility", F.col("total_matches").alias("matches"), F.col("day").alias("last_day"))
    return current_rankings(s.crossJoin(F.broadcast(e.agg(F.max("day").alias("as_of")))), both.groupBy("player_id").agg(F.countDistinct("o").alias("opponents")), F.col("as_of"))


#: Reasons in the order of the quality listing.
REASONS = ["critical_data_issue", "inactive", "high_uncertainty", "insufficient_opponents", "insufficient_matches"]


def quality_listing(rankings: DataFrame, best: str) -> DataFrame:
    """Ranked and other players by reason, each with its place in the listing and the number of players of its reason."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), F.lit(0).cast("bigint")), F.lit(len(REASONS) + 1).cast("bigint"))
    counts = rankings.groupBy("reason").agg(F.count("*").alias("players"))  # six rows at most
    listed = placed(rankings.withColumn("_order", order), [F.col("_order"), F.asc_nulls_last("rank"), F.desc(best), F.asc("player_id")], {"place": F.lit(True)})
    return listed.join(F.broadcast(counts), "reason").drop("_order")


@query("q77_ranking_quality", f"""WITH {CURRENT_SQL}, c AS (SELECT reason, count(*) AS players FROM current GROUP BY reason)
    SELECT player_id, reason, rank, historical_rank, rating, matches, players, row_number() OVER (ORDER BY CASE reason WHEN 'critical_data_issue' THEN 0 WHEN 'inactive' THEN 1 WHEN 'high_uncertainty' THEN 2 WHEN 'insufficient_opponents' THEN 3 WHEN 'insufficient_matches' THEN 4 ELSE 5 END, rank NULLS LAST, rating DESC, player_id) AS place
    FROM current JOIN c USING (reason)""")
def ranking_quality(d: Domain) -> DataFrame:
    """Players by why they are not ranked, over the plain running rating."""
    return quality_listing(rankings_from_history(d), "rating").select("player_id", "reason", "rank", "historical_rank", "rating", "matches", "players", F.col("place").cast("bigint").alias("place"))


@query("q77_ratings_quality")
def ratings_quality(d: Domain) -> DataFrame:
    """q77 over the fold's ratings."""
    return quality_listing(ratings_ranked(d), "conservative").select("player_id", "reason", "rank", "historical_rank", "rating", "effective_deviation", "conservative", "matches", "opponents", "days_inactive", "last_day", "players", "place")


@query("q57_ratings_page")
def ratings_page(d: Domain) -> DataFrame:
    """Current Glicko-2 rankings of the fold, first fifty by public rank."""
    r = ratings_ranked(d)
    return r.join(d.players.select("player_id", "name"), "player_id").orderBy(F.asc_nulls_last("rank"), "historical_rank").limit(50).select("player_id", "name", "rating", "deviation", "conservative", "matches", "reason", "rank", "historical_rank")


@query("q59_one_rating")
def one_rating(d: Domain) -> DataFrame:
    """The rating of the player with the most rated matches, with both ranks and the unrounded record."""
    return ratings_ranked(d).orderBy(F.desc("matches"), "player_id").limit(1)


@query("q58_predict_matches")
def predict_matches(d: Domain) -> DataFrame:
    """The symmetric chance, the combined deviation and how far to trust them, for every pair of the ten best."""
    top = latest(rating_periods(eligible(d))).orderBy(F.desc("conservative"), "player_id").limit(10).select("player_id", "rating", "deviation", glicko.is_provisional(F.col("total_matches"), F.col("deviation")).alias("provisional"))
    a, b = top.alias("a"), top.alias("b")
    pairs = a.crossJoin(F.broadcast(b)).where("a.player_id < b.player_id")  # ten rows
    return pairs.select(F.col("a.player_id").alias("player_1"), F.col("b.player_id").alias("player_2"), *predictions("a", "b"))


def predictions(a: str, b: str) -> list[Column]:
    """probability_1 and probability_2 (from 0 to 1, four places), combined_deviation (two places), confidence, for two sides with rating, deviation and provisional."""
    of = lambda side, c: F.col(f"{side}.{c}")
    first = F.greatest(F.lit(0.0), F.least(F.lit(1.0), glicko.predicted(of(a, "rating"), of(a, "deviation"), of(b, "rating"), of(b, "deviation"))))
    wide = F.sqrt(F.pow(of(a, "deviation"), F.lit(2)) + F.pow(of(b, "deviation"), F.lit(2)))
    trust = glicko.confidence(F.greatest(of(a, "deviation"), of(b, "deviation")), of(a, "provisional"), of(b, "provisional"))
    return [F.round(first, 4).alias("probability_1"), F.round(1 - first, 4).alias("probability_2"), F.round(wide, 2).alias("combined_deviation"), trust.alias("confidence")]


@query("q61_league_ranking", f"""WITH {HISTORY_SQL}, s AS (SELECT player_id, max_by(rating, week) AS rating, max(matches) AS matches FROM hist GROUP BY player_id),
    r AS (SELECT *, row_number() OVER (ORDER BY rating DESC, matches DESC, player_id) AS overall FROM s)
    SELECT player_id, CAST(rating AS BIGINT) AS rating, overall, row_number() OVER (ORDER BY overall) AS place FROM r WHERE player_id IN (SELECT player_id FROM singles WHERE league_id = 2)""")
def league_ranking(d: Domain) -> DataFrame:
    """Overall and local rank of the players that a league has seen."""
    return _league_ranking(d, weekly(singles(d)))


def _league_ranking(d: Domain, h: DataFrame) -> DataFrame:
    s = h.groupBy("player_id").agg(F.max_by("rating", "week").alias("rating"), F.max("matches").alias("matches"))
    order = [F.desc("rating"), F.desc("matches"), F.asc("player_id")]
    here = singles(d).where("league_id = 2").select("player_id").distinct().withColumn("here", F.lit(True))
    r = placed(s.join(here, "player_id", "left").withColumn("here", F.coalesce("here", F.lit(False))), order, {"overall": F.lit(True), "place": F.col("here")})
    return r.where("here").select("player_id", "rating", F.col("overall").cast("bigint").alias("overall"), F.col("place").cast("bigint").alias("place"))


@query("q61_league_ratings")
def league_ratings(d: Domain) -> DataFrame:
    """q61 over the fold's ratings."""
    return _league_ranking(d, rating_history(d))


@query("q62_risers", f"""WITH {HISTORY_SQL}, e AS (SELECT max(week) AS day FROM hist), a AS (SELECT player_id, max_by(rating, week) AS now, max_by(rating, week) FILTER (WHERE week <= (SELECT day FROM e) - 365) AS base FROM hist GROUP BY player_id)
    SELECT player_id, CAST(now AS BIGINT) AS now, CAST(base AS BIGINT) AS base, CAST(now - base AS BIGINT) AS gain, place FROM (SELECT *, row_number() OVER (ORDER BY now - base DESC, player_id) AS place FROM a WHERE base IS NOT NULL) WHERE place <= 20""")
def risers(d: Domain) -> DataFrame:
    """Largest gains on the latest rating of a year ago or before."""
    return _risers(weekly(singles(d)))


@query("q62_rating_risers")
def rating_risers(d: Domain) -> DataFrame:
    """q62 over the fold's ratings."""
    return _risers(rating_history(d))


def _risers(h: DataFrame) -> DataFrame:
    h = h.crossJoin(F.broadcast(h.agg(F.date_sub(F.max("week"), 365).alias("then"))))
    a = h.groupBy("player_id").agg(F.max_by("rating", "week").alias("now"), F.max_by("rating", F.when(F.col("week") <= F.col("then"), F.col("week"))).alias("base")).where("base is not null")
    a = a.withColumn("gain", F.col("now") - F.col("base")).orderBy(F.desc("gain"), "player_id").limit(20)
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gain"), "player_id")).cast("bigint"))


@query("q63_rating_jumps", f"WITH {HISTORY_SQL} SELECT player_id, week, CAST(change AS BIGINT) AS change FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY change DESC, week DESC) AS n FROM hist) WHERE n = 1")
def rating_jumps(d: Domain) -> DataFrame:
    """Each player's best week, the latest of equals."""
    return weekly(singles(d)).groupBy("player_id").agg(F.max_by(F.struct("week", "change"), F.struct("change", "week")).alias("s")).select("player_id", "s.*")


@query("q63_best_weeks")
def best_weeks(d: Domain) -> DataFrame:
    """q63 over the fold's ratings."""
    return rating_history(d).groupBy("player_id").agg(F.max_by(F.struct("week", "change"), F.struct("change", "week")).alias("s")).select("player_id", "s.*")


@query("q64_surprise_wins")
def surprise_wins(d: Domain) -> DataFrame:
    return match_audits(d).where("won").orderBy(F.desc("surprise"), "rubber_id", "player_id").limit(20)


@query("q65_run_summary", f"WITH {CLASSIFIED_SQL} SELECT reason, count(*) AS rubbers, count(DISTINCT competition_id) AS competitions, min(effective_day) AS first_day, max(effective_day) AS last_day FROM classified GROUP BY reason")
def run_summary(d: Domain) -> DataFrame:
    return classified(d).groupBy("reason").agg(F.count("*").alias("rubbers"), F.countDistinct("competition_id").alias("competitions"), F.min("effective_day").alias("first_day"), F.max("effective_day").alias("last_day"))


@query("q79_backtest")
def backtest_report(d: Domain) -> DataFrame:
    """Accuracy, Brier score, log loss and calibration over four training windows."""
    return report(backtest(eligible(d).drop("rubber_id"), [2, 3, 5, 10]))


@query("a20_calibration_histogram")
def calibration(d: Domain) -> DataFrame:
    p = backtest(eligible(d).drop("rubber_id"), [3])
    return p.groupBy(F.least(F.lit(9), F.floor(F.col("probability") * 10)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg("probability").alias("predicted"), F.avg(F.col("home_won").cast("double")).alias("observed"), n_if("cold_start").alias("cold_starts"))
