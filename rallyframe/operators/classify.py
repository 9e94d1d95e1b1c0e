"""Whether a rubber counts for ratings, and why not: the first reason in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapter import Domain


def classified(d: Domain) -> DataFrame:
    """Live rubbers: rubber_id, fixture, competition_id, league_id, effective_day, players, games, status, updated_on, reason."""
    f = d.fixtures.select("fixture_id", "competition_id", "league_id", "season_id", "status", F.when(~F.col("deleted"), F.col("date_played")).alias("date_played"))
    r = d.rubbers.where(~F.col("deleted")).drop("deleted").join(f, "fixture_id", "left")
    ids = d.identity
    for side in ("home", "away"):
        r = r.join(ids.select(F.col("player_id").alias(f"{side}_1"), F.col("canonical").alias(f"{side}_player")), f"{side}_1", "left")
    day = F.coalesce("played_on", "date_played")
    none = lambda c: F.col(c).isNull()
    reason = (
        F.when(F.col("is_doubles"), "doubles")
        .when(F.col("outcome") != "normal", "non_normal_outcome")
        .when(day.isNull(), "missing_date")
        .when(none("home_1") & none("away_1"), "missing_both_player_ids")
        .when(none("home_1"), "missing_home_player_id")
        .when(none("away_1"), "missing_away_player_id")
        .when(none("home_player") & none("away_player"), "missing_both_player_records")
        .when(none("home_player"), "missing_home_player_record")
        .when(none("away_player"), "missing_away_player_record")
        .when(F.col("home_player") == F.col("away_player"), "same_canonical_player")
        .when(F.col("home_games") == F.col("away_games"), "tied_score")
        .when(~F.col("status").eqNullSafe("completed"), "fixture_not_completed")
        .otherwise("eligible")
    )
    return r.select("rubber_id", "fixture_id", "competition_id", "league_id", "season_id", day.alias("effective_day"), "date_played", "played_on", "home_player", "away_player", "home_games", "away_games", "is_doubles", "outcome", "status", "updated_on", reason.alias("reason"))


CLASSIFIED_SQL = """classified AS (
        SELECT *, CASE WHEN is_doubles THEN 'doubles' WHEN outcome <> 'normal' THEN 'non_normal_outcome' WHEN effective_day IS NULL THEN 'missing_date'
            WHEN home_1 IS NULL AND away_1 IS NULL THEN 'missing_both_player_ids' WHEN home_1 IS NULL THEN 'missing_home_player_id' WHEN away_1 IS NULL THEN 'missing_away_player_id'
            WHEN home_player IS NULL AND away_player IS NULL THEN 'missing_both_player_records' WHEN home_player IS NULL THEN 'missing_home_player_record' WHEN away_player IS NULL THEN 'missing_away_player_record'
            WHEN home_player = away_player THEN 'same_canonical_player' WHEN home_games = away_games THEN 'tied_score' WHEN status IS DISTINCT FROM 'completed' THEN 'fixture_not_completed' ELSE 'eligible' END AS reason
        FROM (SELECT r.* EXCLUDE (deleted), competition_id, league_id, season_id, status, CASE WHEN NOT f.deleted THEN date_played END AS date_played, h.canonical AS home_player, a.canonical AS away_player,
                coalesce(played_on, CASE WHEN NOT f.deleted THEN date_played END) AS effective_day
            FROM rubbers r LEFT JOIN fixtures f USING (fixture_id) LEFT JOIN ident h ON h.player_id = home_1 LEFT JOIN ident a ON a.player_id = away_1 WHERE NOT r.deleted))"""
