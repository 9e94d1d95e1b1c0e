"""Payloads, names, ranges and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import person_name, slug, valid_game
from ..operators.sides import singles
from ..sources.adapter import Domain
from ..sources.payloads import league_bundle
from .catalog import query
from .players import n_if

#: Ranges of a history, in months back from its last day.
RANGES = {"3m": 3, "1y": 12, "3y": 36, "10y": 120}


def bundles(d: Domain) -> DataFrame:
    """payload_id (a competition), payload: its teams and fixtures with their sets as JSON; every 23rd is cut off."""
    s = d.matches.select("competition_id", "fixture_id", "date_played", "home_team", "away_team", "rubber_id", F.struct(F.col("home_1").cast("string").alias("home_player"), F.col("away_1").cast("string").alias("away_player"), F.col("home_games").cast("int").alias("home_games"), F.col("away_games").cast("int").alias("away_games")).alias("set"))
    in_order = lambda key, c: F.transform(F.sort_array(F.collect_list(F.struct(key, c))), lambda x: x[c])
    f = s.groupBy("competition_id", "fixture_id", "date_played", "home_team", "away_team").agg(in_order("rubber_id", "set").alias("sets"))
    match = F.struct(F.col("fixture_id").cast("string").alias("id"), F.date_format("date_played", "yyyy-MM-dd").alias("date"), F.col("home_team").cast("string").alias("home"), F.col("away_team").cast("string").alias("away"), "sets")
    standing = F.struct(F.col("home_team").cast("string").alias("team_id"), F.concat(F.lit("Team "), "home_team").alias("team"))
    p = f.withColumns({"match": match, "standing": standing}).groupBy("competition_id").agg(in_order("fixture_id", "match").alias("matches"), F.collect_set("standing").alias("standings"))
    whole = F.to_json(F.struct("standings", "matches"))
    return p.select(F.col("competition_id").alias("payload_id"), F.when(F.col("competition_id") % 23 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("payload"))


@query("s07_bundle_rubbers", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY rubber_id) - 1 AS position FROM matches WHERE competition_id % 23 <> 0)
    SELECT fixture_id || '-' || position AS rubber_id, CAST(fixture_id AS VARCHAR) AS fixture_id, CAST(home_1 AS VARCHAR) AS home_player, CAST(away_1 AS VARCHAR) AS away_player, CAST(home_games AS INTEGER) AS home_games, CAST(away_games AS INTEGER) AS away_games FROM r""")
def bundle_rubbers(d: Domain) -> DataFrame:
    """The rubbers of all league payloads."""
    return league_bundle(bundles(d))["rubbers"]


@query("s07_bundle_fixtures", "SELECT DISTINCT CAST(fixture_id AS VARCHAR) AS fixture_id, date_played, CAST(home_team AS VARCHAR) AS home, CAST(away_team AS VARCHAR) AS away, 'completed' AS status FROM matches WHERE competition_id % 23 <> 0")
def bundle_fixtures(d: Domain) -> DataFrame:
    return league_bundle(bundles(d))["fixtures"]


@query("s07_rejected", "SELECT DISTINCT competition_id AS payload_id FROM matches WHERE competition_id % 23 = 0")
def rejected(d: Domain) -> DataFrame:
    """Payloads that can't be read."""
    return league_bundle(bundles(d))["rejected"]


@query("f05_names_and_slugs", """WITH n AS (SELECT player_id, name || ' of ' || league_name AS name FROM players JOIN leagues ON league_id = player_id % 5), k AS (SELECT player_id, CASE player_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN lower(name) ELSE name END AS raw FROM n)
    SELECT player_id, CASE WHEN player_id % 3 < 2 THEN array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE array_to_string(list_transform(string_split(raw, ' '), lambda w: CASE WHEN w = upper(w) AND length(w) > 1 OR w = lower(w) THEN upper(w[1]) || lower(w[2:]) ELSE w END), ' ') END AS name,
        regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM k""")
def names_and_slugs(d: Domain) -> DataFrame:
    """Players with their league's name, by turns in capitals, in small letters and as they are: smart case, and the slug."""
    n = d.players.withColumn("league_id", F.col("player_id") % 5).join(F.broadcast(d.leagues), "league_id").select("player_id", F.concat_ws(" of ", "name", "league_name").alias("name"))
    raw = F.when(F.col("player_id") % 3 == 0, F.upper("name")).when(F.col("player_id") % 3 == 1, F.lower("name")).otherwise(F.col("name"))
    return n.select("player_id", person_name(raw).alias("name"), slug(raw).alias("slug"))


@query("f11_ranges", """WITH t AS (SELECT max(day) AS today FROM singles), g AS (SELECT * FROM (VALUES ('3m', 3), ('1y', 12), ('3y', 36), ('10y', 120)) v(range_name, months)), s AS (SELECT range_name, CAST(today - to_months(months) AS DATE) AS starts FROM g, t)
    SELECT player_id, range_name, starts, count(*) FILTER (WHERE day >= starts) AS played, count(*) FILTER (WHERE day >= starts AND won) AS wins FROM singles, s GROUP BY ALL""")
def ranges(d: Domain) -> DataFrame:
    """Each player's matches in the last three months, year, three and ten years of all."""
    s = singles(d).select("player_id", "day", "won")
    begin = s.agg(F.max("day").alias("today")).select(F.inline(F.array(*(F.struct(F.lit(n).alias("range_name"), F.add_months("today", -m).alias("starts")) for n, m in RANGES.items()))))
    w = s.crossJoin(F.broadcast(begin))  # four rows
    return w.groupBy("player_id", "range_name", "starts").agg(n_if("day >= starts").alias("played"), n_if("day >= starts and won").alias("wins"))


@query("u17_valid_scores", "SELECT a, b, (greatest(a, b) = 11 AND least(a, b) <= 9) OR (greatest(a, b) > 11 AND abs(a - b) = 2) AS valid, count(*) AS n FROM (SELECT CAST(floor(l_quantity) AS BIGINT) % 16 AS a, l_partkey % 16 AS b FROM lineitem) GROUP BY ALL")
def valid_scores(d: Domain) -> DataFrame:
    """Pairs of numbers as they occur, and whether a game can end so."""
    s = d.table("lineitem").select((F.floor("l_quantity") % 16).cast("bigint").alias("a"), (F.col("l_partkey") % 16).alias("b"))
    return s.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("valid", valid_game(F.col("a"), F.col("b")))
