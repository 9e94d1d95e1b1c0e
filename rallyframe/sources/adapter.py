"""The match domain over the shared star-schema tables.

Only this module knows those tables; everything else takes the domain tables that
it returns.  Each is narrow, and scans keep only the columns a query asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rubbers of a share; a task that sorts both their sides several times takes some 200 MB.
SHARE = 500_000


@dataclass(frozen=True)
class Domain:
    """Domain tables of one data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def shares(self) -> int:
        """Into how many parts all sides are cut by player, so that a task's part doesn't grow with the tables."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // SHARE))

    @cached_property
    def players(self) -> DataFrame:
        """player_id, name, platform_id, external_id, canonical_id (null: its own), deleted, updated_at."""
        s = self.table("supplier")
        i = F.col("s_suppkey")
        return s.select(
            i.alias("player_id"),
            F.col("s_name").alias("name"),
            (F.col("s_nationkey") % 3).cast("bigint").alias("platform_id"),
            F.when(i % 13 != 12, F.concat(F.lit("x"), i.cast("string"))).alias("external_id"),
            F.when(i % 10 == 9, i - 1).alias("canonical_id"),
            (i % 37 == 36).alias("deleted"),
        )

    @cached_property
    def identity(self) -> DataFrame:
        """player_id -> canonical player_id: a dimension of the players' size."""
        return self.players.select("player_id", F.coalesce("canonical_id", "player_id").alias("canonical"))

    @cached_property
    def rubbers(self) -> DataFrame:
        """One row a rubber: of rows with one key the first in the order of all columns (latest-wins merge in small)."""
        n = self.table("supplier").agg((F.max("s_suppkey") + 1).alias("n_players"))
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)
        # one exchange by order serves the window and the join with the fixture
        one = self.table("lineitem").repartition("l_orderkey").withColumn("rn", F.row_number().over(w)).where("rn = 1").crossJoin(F.broadcast(n))
        o, line, doubles = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_orderkey") % 10 == 0
        home, away = F.col("l_suppkey"), F.col("l_partkey")
        slot = lambda x, d: F.pmod(x + d, F.col("n_players"))
        return one.select(
            (o * 10 + line).alias("rubber_id"),
            o.alias("fixture_id"),
            doubles.alias("is_doubles"),
            F.when(o % 41 != 0, slot(home, 0)).alias("home_1"),
            F.when(doubles, slot(home, 1)).alias("home_2"),
            F.when(o % 43 != 0, slot(away, 0)).alias("away_1"),
            F.when(doubles, slot(away, 1)).alias("away_2"),
            (F.floor("l_quantity") % 4).cast("bigint").alias("home_games"),
            (F.floor(F.round(F.col("l_tax") * 100)) % 4).cast("bigint").alias("away_games"),
            F.when(o % 17 == 0, "walkover").when(o % 29 == 0, "retired").otherwise("normal").alias("outcome"),
            F.when(line == 7, "win_loss_only").otherwise("games").alias("score_source"),
            F.when(line % 3 != 0, F.to_date("l_shipdate")).alias("played_on"),
            F.to_date("l_shipdate").alias("updated_on"),
            (o % 101 == 100).alias("deleted"),
        )

    @cached_property
    def leagues(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("bigint").alias("league_id"), F.col("r_name").alias("league_name"))

    @cached_property
    def fixtures(self) -> DataFrame:
        """fixture_id, competition, season and teams (by key), date, status, deleted."""
        where = self.table("customer").select(F.col("c_custkey"), F.col("c_nationkey").cast("bigint").alias("nation")).join(
            F.broadcast(self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").cast("bigint").alias("league_id"))), "nation"
        )
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("on"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("division"))
        season = F.col("league_id") * 10_000 + F.year("on")
        competition = season * 10 + F.col("division")
        return o.join(where, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("fixture_id"),
            "league_id",
            season.alias("season_id"),
            competition.alias("competition_id"),
            "division",
            (competition * 100 + F.col("nation")).alias("home_team"),
            (competition * 100 + F.col("o_orderkey") % 25).alias("away_team"),
            F.when(F.col("o_orderkey") % 53 != 52, F.col("on")).alias("date_played"),
            F.date_add("on", 1).alias("created_on"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "upcoming").otherwise("postponed").alias("status"),
            (F.col("o_orderkey") % 97 == 96).alias("deleted"),
        )

    @cached_property
    def seasons(self) -> DataFrame:
        """season_id, league_id, is_active (the latest of its league)."""
        s = self.fixtures.select("season_id", "league_id").distinct()
        return s.withColumn("is_active", F.col("season_id") == F.max("season_id").over(Window.partitionBy("league_id")))

    @cached_property
    def matches(self) -> DataFrame:
        """Live rubbers with their live fixture: the input of most queries."""
        f = self.fixtures.where(~F.col("deleted")).drop("deleted")
        return self.rubbers.where(~F.col("deleted")).drop("deleted").join(f, "fixture_id")

    @cached_property
    def events(self) -> DataFrame:
        """Scrape log rows: event_id, seen_at, platform_id, kind, value."""
        return self.table("events").select("event_id", F.col("ts").alias("seen_at"), (F.col("user_id") % 5).alias("platform_id"), F.col("user_id").alias("resource_id"), F.col("event_type").alias("kind"), "value")


# The same tables as DuckDB SQL, to check queries against.
DOMAIN_SQL = """
params AS (SELECT max(s_suppkey) + 1 AS n_players FROM supplier),
players AS (
    SELECT s_suppkey AS player_id, s_name AS name, CAST(s_nationkey % 3 AS BIGINT) AS platform_id,
        CASE WHEN s_suppkey % 13 <> 12 THEN 'x' || CAST(s_suppkey AS VARCHAR) END AS external_id,
        CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 END AS canonical_id, s_suppkey % 37 = 36 AS deleted
    FROM supplier
),
ident AS (SELECT player_id, coalesce(canonical_id, player_id) AS canonical FROM players),
rubbers AS (
    SELECT l_orderkey * 10 + l_linenumber AS rubber_id, l_orderkey AS fixture_id, l_orderkey % 10 = 0 AS is_doubles,
        CASE WHEN l_orderkey % 41 <> 0 THEN l_suppkey % n_players END AS home_1,
        CASE WHEN l_orderkey % 10 = 0 THEN (l_suppkey + 1) % n_players END AS home_2,
        CASE WHEN l_orderkey % 43 <> 0 THEN l_partkey % n_players END AS away_1,
        CASE WHEN l_orderkey % 10 = 0 THEN (l_partkey + 1) % n_players END AS away_2,
        CAST(floor(l_quantity) AS BIGINT) % 4 AS home_games, CAST(floor(round(l_tax * 100)) AS BIGINT) % 4 AS away_games,
        CASE WHEN l_orderkey % 17 = 0 THEN 'walkover' WHEN l_orderkey % 29 = 0 THEN 'retired' ELSE 'normal' END AS outcome,
        CASE WHEN l_linenumber = 7 THEN 'win_loss_only' ELSE 'games' END AS score_source,
        CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) END AS played_on, CAST(l_shipdate AS DATE) AS updated_on, l_orderkey % 101 = 100 AS deleted
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
    CROSS JOIN params WHERE rn = 1
),
leagues AS (SELECT CAST(r_regionkey AS BIGINT) AS league_id, r_name AS league_name FROM region),
fixtures AS (
    SELECT fixture_id, league_id, season_id, season_id * 10 + division AS competition_id, division,
        (season_id * 10 + division) * 100 + nation AS home_team, (season_id * 10 + division) * 100 + fixture_id % 25 AS away_team,
        CASE WHEN fixture_id % 53 <> 52 THEN on_day END AS date_played, on_day + 1 AS created_on, status, fixture_id % 97 = 96 AS deleted
    FROM (
        SELECT o_orderkey AS fixture_id, CAST(n_regionkey AS BIGINT) AS league_id, CAST(n_regionkey AS BIGINT) * 10000 + year(o_orderdate) AS season_id,
            CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS division, CAST(c_nationkey AS BIGINT) AS nation, CAST(o_orderdate AS DATE) AS on_day,
            CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'upcoming' ELSE 'postponed' END AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    )
),
seasons AS (SELECT season_id, league_id, season_id = max(season_id) OVER (PARTITION BY league_id) AS is_active FROM (SELECT DISTINCT season_id, league_id FROM fixtures)),
matches AS (SELECT r.* EXCLUDE (deleted), f.* EXCLUDE (deleted, fixture_id) FROM rubbers r JOIN fixtures f USING (fixture_id) WHERE NOT r.deleted AND NOT f.deleted),
log AS (SELECT event_id, ts AS seen_at, user_id % 5 AS platform_id, user_id AS resource_id, event_type AS kind, value FROM events),
half AS (
    SELECT * EXCLUDE (home_1, away_1, home_2, away_2, home_games, away_games, home_team, away_team), 'home' AS side, home_1 AS raw, away_1 AS raw_opp, home_2 AS raw_partner, home_games AS own, away_games AS opp, home_team AS team, away_team AS opp_team FROM matches
    UNION ALL
    SELECT * EXCLUDE (home_1, away_1, home_2, away_2, home_games, away_games, home_team, away_team), 'away', away_1, home_1, away_2, away_games, home_games, away_team, home_team FROM matches
),
sides AS (
    SELECT half.*, p.canonical AS player_id, o.canonical AS opponent_id, coalesce(date_played, played_on, created_on) AS day, own > opp AS won, own < opp AS lost
    FROM half JOIN ident p ON p.player_id = raw LEFT JOIN ident o ON o.player_id = raw_opp
),
singles AS (SELECT * FROM sides WHERE NOT is_doubles AND outcome <> 'walkover'),
focus AS (SELECT player_id, row_number() OVER (ORDER BY played DESC, player_id) AS k FROM (SELECT player_id, count(*) AS played FROM singles GROUP BY player_id))
"""
