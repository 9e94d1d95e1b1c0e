"""Unpivot of rubbers to the view of one player: one scan and one explode, where a union would scan twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import Domain

PAIRED = {"raw": ("home_1", "away_1"), "raw_opp": ("away_1", "home_1"), "raw_partner": ("home_2", "away_2"), "own": ("home_games", "away_games"), "opp": ("away_games", "home_games"), "team": ("home_team", "away_team"), "opp_team": ("away_team", "home_team")}


def halves(matches: DataFrame) -> DataFrame:
    """Each match as two rows, one a side: side, raw, raw_opp, raw_partner, own, opp, team, opp_team and the shared columns."""
    paired = {n: p for n, p in PAIRED.items() if set(p) <= set(matches.columns)}
    row = lambda i: F.struct(F.lit(("home", "away")[i]).alias("side"), *(F.col(p[i]).alias(n) for n, p in paired.items()))
    used = {c for p in paired.values() for c in p}
    return matches.select(*(c for c in matches.columns if c not in used), F.explode(F.array(row(0), row(1))).alias("h")).select("*", "h.*").drop("h")


def effective_day() -> Column:
    """Fixture date, else the rubber's own, else the day after the fixture was made."""
    return F.coalesce("date_played", "played_on", "created_on")


def sides(d: Domain) -> DataFrame:
    """Both sides of every match with canonical player and opponent (null where unknown), day, won and lost; a tie is neither."""
    ids = d.identity
    h = halves(d.matches)
    known = h.join(ids.select(F.col("player_id").alias("raw"), F.col("canonical").alias("player_id")), "raw")
    both = known.join(ids.select(F.col("player_id").alias("raw_opp"), F.col("canonical").alias("opponent_id")), "raw_opp", "left")
    return both.withColumns({"day": effective_day(), "won": F.col("own") > F.col("opp"), "lost": F.col("own") < F.col("opp")})


def singles(d: Domain) -> DataFrame:
    return sides(d).where(~F.col("is_doubles") & (F.col("outcome") != "walkover"))


def focus(d: Domain, n: int = 2) -> DataFrame:
    """The n players with the most singles: player_id, k from 1."""
    top = singles(d).groupBy("player_id").agg(F.count("*").alias("played")).orderBy(F.desc("played"), "player_id").limit(n)
    return top.select("player_id", F.row_number().over(Window.orderBy(F.desc("played"), "player_id")).cast("bigint").alias("k"))


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage, rounded half away from zero as a decimal; null for nothing played."""
    return F.round(part.cast("decimal(20,10)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), digits).cast("double")
