"""What an audit of rated data finds, and a table that remembers when each finding was first seen, last seen and gone.

A finding has a type, an entity and a body (severity, source, competition, day, details
as JSON text).  Input is the classified rubbers (`operators.classify`), as known at a date.

Defined cases: sides without a player take no part; a rubber with one player on both sides
counts once for them; empty tables give no findings; a key that is found twice in one run keeps the
larger body.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["issue_type", "entity_type", "entity_id"]
BODY = ["severity", "source_id", "competition_id", "match_day", "details"]
STORED = "issue_type string, entity_type string, entity_id string, severity string, source_id long, competition_id long, match_day date, details string, first_seen date, last_seen date, resolved_at date"

# Which findings there are, and how grave they are.
RUBBER_REASONS = {
    "missing_date": "warning",
    "missing_both_player_ids": "warning",
    "missing_home_player_id": "warning",
    "missing_away_player_id": "warning",
    "missing_both_player_records": "critical",
    "missing_home_player_record": "critical",
    "missing_away_player_record": "critical",
    "same_canonical_player": "critical",
    "tied_score": "warning",
}
PLAYER_CATEGORIES = {"eligible_in_window_without_rating": "critical", "rating_without_eligible_evidence": "critical", "only_invalid_singles": "warning"}
MISSING_PLAYERS = tuple(x for x in RUBBER_REASONS if "player_" in x and x.startswith("missing"))
MOST_OPPONENTS, CONFLICT_DAYS = 20, 7


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def _finding(kind: Column, severity: Column, entity: str, entity_id: Column, details: Column, source: Column | None = None, competition: Column | None = None, day: str = "effective_day") -> list[Column]:
    none = F.lit(None).cast("bigint")
    return [
        kind.alias("issue_type"),
        F.lit(entity).alias("entity_type"),
        entity_id.cast("string").alias("entity_id"),
        severity.alias("severity"),
        (none if source is None else source).alias("source_id"),
        (none if competition is None else competition).alias("competition_id"),
        F.col(day).alias("match_day"),
        details.alias("details"),
    ]


def player_sides(c: DataFrame) -> DataFrame:
    """Each rubber from the side of each of its known players, once for a player on both sides."""
    row = lambda me, other: F.struct(F.col(me).alias("player_id"), F.col(other).alias("opponent_id"))
    home, away = row("home_player", "away_player"), row("away_player", "home_player")
    both = F.when(F.col("home_player") == F.col("away_player"), F.array(home)).otherwise(F.array(home, away))
    return c.select("*", F.explode(both).alias("s")).select(*c.columns, "s.*").where("player_id is not null")


def player_coverage(c: DataFrame, players: DataFrame, ratings: DataFrame, window_start: date) -> DataFrame:
    """A row for each of the players (player_id): their matches by kind, and the category that these and a rating or none come to.

    ratings: player_id, rated_matches.
    """
    eligible, in_window = F.col("reason") == "eligible", F.col("effective_day") >= F.lit(window_start)
    singles = ~F.col("is_doubles")
    stats = player_sides(c).groupBy("player_id").agg(
        F.count("*").alias("raw_matches"),
        F.count_if(singles).alias("singles_matches"),
        F.count_if(singles & (F.col("outcome") == "normal")).alias("normal_singles_matches"),
        F.count_if(eligible).alias("eligible_matches_all_time"),
        F.count_if(eligible & in_window).alias("eligible_matches_in_window"),
        F.countDistinct(F.when(eligible & in_window, F.col("opponent_id"))).alias("unique_opponents_in_window"),
        F.min("effective_day").alias("first_match_date"),
        F.max("effective_day").alias("last_match_date"),
    )
    counts = [x for x in stats.columns if x.endswith(("matches", "time", "window"))]
    every = players.select("player_id").join(stats, "player_id", "left").fillna(0, counts).join(ratings.select("player_id", "rated_matches"), "player_id", "left")
    none = lambda x: F.col(x) == 0
    rated = F.col("rated_matches").isNotNull()
    category = (
        F.when(rated & none("eligible_matches_in_window"), "rating_without_eligible_evidence")
        .when(~rated & ~none("eligible_matches_in_window"), "eligible_in_window_without_rating")
        .when(none("raw_matches"), "no_raw_matches")
        .when(none("singles_matches"), "only_doubles")
        .when(none("normal_singles_matches"), "only_non_normal")
        .when(none("eligible_matches_all_time"), "only_invalid_singles")
        .when(none("eligible_matches_in_window"), "only_before_model_window")
        .otherwise("covered")
    )
    return every.withColumns({"rating_exists": rated, "category": category})


def player_findings(c: DataFrame, coverage: DataFrame) -> DataFrame:
    """Players whose category is a fault, those with the most opponents, and those seen on several sources in one day."""
    grave = F.col("category").isin(*(x for x, s in PLAYER_CATEGORIES.items() if s == "critical"))
    counted = ["raw_matches", "singles_matches", "normal_singles_matches", "eligible_matches_all_time", "eligible_matches_in_window", "unique_opponents_in_window", "first_match_date", "last_match_date", "rating_exists", "rated_matches"]
    last = "last_match_date"
    faults = coverage.where(F.col("category").isin(*PLAYER_CATEGORIES)).select(*_finding(F.col("category"), F.when(grave, "critical").otherwise("warning"), "player", F.col("player_id"), _json(**{x: F.col(x) for x in counted}), day=last))
    most = coverage.where("eligible_matches_in_window > 0").orderBy(F.desc("unique_opponents_in_window"), "player_id").limit(MOST_OPPONENTS)
    most = most.select(*_finding(F.lit("high_opponent_count"), F.lit("info"), "player", F.col("player_id"), _json(**{x: F.col(x) for x in ("unique_opponents_in_window", "eligible_matches_in_window", last)}), day=last))
    # sets of a player's day are small, and put together before the shuffle; two distinct counts would shuffle every side twice
    different = lambda x: F.size(F.collect_set(x)).cast("bigint")
    days = player_sides(c).where("effective_day is not null and league_id is not null").groupBy("player_id", "effective_day").agg(different("league_id").alias("sources"), different("competition_id").alias("competitions")).where("sources > 1")
    busy = days.groupBy("player_id").agg(F.count("*").alias("affected_days"), F.max("effective_day").alias("latest_date"), F.max("sources").alias("maximum_platforms"), F.max("competitions").alias("maximum_competitions"))
    busy = busy.select(*_finding(F.lit("same_day_cross_platform_activity"), F.lit("warning"), "player", F.col("player_id"), _json(**{x: F.col(x) for x in busy.columns[1:]}), day="latest_date"))
    return faults.unionByName(most).unionByName(busy)


def duplicate_candidates(c: DataFrame) -> DataFrame:
    """Rated rubbers of one pair, competition and day that are more than one: group_id, what they agree in, rubber_ids, source_ids and score_signatures as sorted arrays."""
    ahead = F.col("home_player") <= F.col("away_player")
    games = lambda x, y: F.concat_ws(":", F.col(x).cast("string"), F.col(y).cast("string"))
    score = F.when(ahead, games("home_games", "away_games")).otherwise(games("away_games", "home_games"))
    n = c.where("reason = 'eligible' and competition_id is not null").select("rubber_id", "competition_id", "league_id", F.col("effective_day").alias("match_day"), F.least("home_player", "away_player").alias("player_a"), F.greatest("home_player", "away_player").alias("player_b"), score.alias("score"))
    keys = ["competition_id", "match_day", "player_a", "player_b"]
    g = n.groupBy(*keys).agg(F.count("*").alias("rubber_count"), F.sort_array(F.collect_list("rubber_id")).alias("rubber_ids"), F.sort_array(F.collect_set("league_id")).alias("source_ids"), F.sort_array(F.collect_set("score")).alias("score_signatures")).where("rubber_count > 1")
    kind = F.when(F.size("score_signatures") > 1, "conflicting_score_candidate").otherwise("exact_score_candidate")
    return g.select(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias("group_id"), kind.alias("candidate_type"), *keys, "rubber_count", "rubber_ids", "source_ids", "score_signatures")


def duplicate_findings(groups: DataFrame) -> DataFrame:
    worse = F.col("candidate_type") == "conflicting_score_candidate"
    details = _json(**{x: F.col(x) for x in ("player_a", "player_b", "rubber_count", "rubber_ids", "source_ids", "score_signatures")})
    kind = F.when(worse, "conflicting_duplicate_candidate").otherwise("exact_duplicate_candidate")
    return groups.select(*_finding(kind, F.when(worse, "warning").otherwise("info"), "duplicate_group", F.col("group_id"), details, competition=F.col("competition_id"), day="match_day"))


def rubber_findings(c: DataFrame, first_day: date, last_day: date) -> DataFrame:
    """Rubbers that are turned away for what they lack, that lie outside first_day to last_day, or whose date is far from their fixture's: one scan for all kinds."""
    reason = F.when(F.col("reason").isin(*RUBBER_REASONS), F.col("reason"))
    grave = F.col("reason").isin(*(x for x, s in RUBBER_REASONS.items() if s == "critical"))
    day = F.col("effective_day")
    odd = F.when(day > F.lit(last_day), "future_match_date").when((day < F.lit(first_day)) | F.year(day).isin(1900, 1919, 1970), "suspicious_old_date")
    apart = F.abs(F.datediff("played_on", "date_played"))
    col = F.col
    kinds = F.array(
        F.struct(reason.alias("kind"), F.when(grave, "critical").otherwise("warning").alias("severity"), day.alias("day"), _json(fixture_id=col("fixture_id"), home_player=col("home_player"), away_player=col("away_player"), home_games=col("home_games"), away_games=col("away_games")).alias("details")),
        F.struct(odd.alias("kind"), F.when(odd == "future_match_date", "critical").otherwise("warning").alias("severity"), day.alias("day"), _json(fixture_id=col("fixture_id"), effective_date=day, eligibility_reason=col("reason")).alias("details")),
        F.struct(F.when(apart > CONFLICT_DAYS, "fixture_rubber_date_conflict").alias("kind"), F.lit("warning").alias("severity"), col("played_on").alias("day"), _json(fixture_id=col("fixture_id"), rubber_date=col("played_on"), fixture_date=col("date_played"), difference_days=apart).alias("details")),
    )
    i = c.select("rubber_id", "league_id", "competition_id", F.explode(F.filter(kinds, lambda k: k["kind"].isNotNull())).alias("i")).select("rubber_id", "league_id", "competition_id", "i.*")
    return i.select(*_finding(F.col("kind"), F.col("severity"), "rubber", F.col("rubber_id"), F.col("details"), F.col("league_id"), F.col("competition_id"), day="day"))


def refreshed(stored: DataFrame, found: DataFrame, at: date, types: list[str] | None = None) -> DataFrame:
    """The table of STORED columns after a run at a date that found KEY and BODY rows.

    What is found is open, with its newest body; what was open and isn't found any more is
    resolved at that date; what is found again is open again.  types: the issue types that the run
    looks for, all by default; others stay as they are.  One join, as keys are unique in either.
    """
    seen = found.groupBy(*KEY).agg(F.max(F.struct(*BODY)).alias("now"))
    old = stored.select(*KEY, F.struct(*BODY, "first_seen", "last_seen", "resolved_at").alias("was"))
    both = old.join(seen, KEY, "full")
    here, day = F.col("now").isNotNull(), F.lit(at)
    looked_for = F.lit(True) if types is None else F.col("issue_type").isin(*types)
    gone = F.when(F.col("was.resolved_at").isNull() & looked_for, day).otherwise(F.col("was.resolved_at"))
    return both.select(
        *KEY,
        *(F.when(here, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in BODY),
        F.coalesce("was.first_seen", day).alias("first_seen"),
        F.when(here, day).otherwise(F.col("was.last_seen")).alias("last_seen"),
        F.when(~here, gone).alias("resolved_at"),
    )


def quality_counts(c: DataFrame, by: str, suspicious: Column) -> DataFrame:
    """Rubbers by kind of fault, and their first and last day, for each value of a column."""
    r = F.col("reason")
    return c.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("total_rubbers"),
        F.count_if(r == "eligible").alias("eligible_rubbers"),
        F.count_if(r.isin(*MISSING_PLAYERS)).alias("missing_identity_rubbers"),
        F.count_if(r == "missing_date").alias("missing_date_rubbers"),
        F.count_if(~r.isin("eligible", "doubles", "non_normal_outcome")).alias("invalid_single_rubbers"),
        F.count_if(suspicious).alias("suspicious_date_rubbers"),
        F.min("effective_day").alias("first_match_date"),
        F.max("effective_day").alias("last_match_date"),
    )


def with_candidates(quality: DataFrame, groups: DataFrame, by: str, value: Column) -> DataFrame:
    """quality with the number of duplicate groups and conflicting ones that hold its value; value: a column of groups, or an exploded list of them."""
    n = groups.select(value.alias(by), "candidate_type").groupBy(by).agg(F.count("*").alias("duplicate_candidate_groups"), F.count_if(F.col("candidate_type") == "conflicting_score_candidate").alias("conflicting_candidate_groups"))
    return quality.join(n, by, "left").fillna(0, ["duplicate_candidate_groups", "conflicting_candidate_groups"])
