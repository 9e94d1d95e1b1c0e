"""Verdicts on two players, movers of a run, states of jobs, and sources of a match list, by hand."""

import datetime

import pytest

from rallyframe.plans.records import evidence, matches_of, movers, queue_states

DAY = datetime.date


def verdict(spark, encounters, a_wins, b_wins, a=(0, 0), b=(0, 0)):
    pairs = spark.createDataFrame([(1, 2, encounters, a_wins, b_wins)], "player_a long, player_b long, encounters long, a_wins long, b_wins long")
    records = spark.createDataFrame([(i, *r) for i, r in ((1, a), (2, b)) if r != (0, 0)], "player_id long, wins long, played long")
    r = evidence(pairs, records).first()
    return r["score"], r["confidence"], r["predicted"], r["reasons"].split("\n")


CAREFUL = "Treat the prediction cautiously because the direct sample is limited."
CLOSE = "Their overall recorded win rates are closely matched."


@pytest.mark.parametrize(
    "given, want",
    [
        ((0, 0, 0), (0, "low", "even", ["No direct encounters are recorded, so the comparison relies on broader player records.", CLOSE, CAREFUL])),
        ((1, 1, 0, (1, 2), (1, 2)), (12, "low", "A", ["Player A leads the direct series by 1 match.", CLOSE, CAREFUL])),
        ((2, 1, 1, (1, 2), (5, 8)), (-13, "medium", "B", ["The direct series is level across 2 encounters.", "Player B has the stronger overall recorded win rate by 13 percentage points.", CAREFUL])),
        ((5, 1, 4, (9, 10), (1, 3)), (21, "high", "A", ["Player B leads the direct series by 3 matches.", "Player A has the stronger overall recorded win rate by 57 percentage points."])),
        ((6, 3, 3, (51, 100), (48, 100)), (3, "high", "even", ["The direct series is level across 6 encounters.", CLOSE])),
    ],
)
def test_evidence(spark, given, want):
    assert verdict(spark, *given) == want


def test_movers_of_a_run(spark):
    rows = [(1, DAY(2024, 1, 1), 1500.0, 1520.0, 300.0), (1, DAY(2024, 2, 1), 1520.0, 1510.0, 200.0), (2, DAY(2024, 1, 1), 1500.0, 1480.0, 300.0), (3, DAY(2024, 1, 1), 1500.0, 1500.0, 300.0), (4, DAY(2024, 1, 1), 1400.0, 1410.0, 90.0), (5, DAY(2024, 1, 1), 1400.0, 1300.0, 90.0)]
    p = spark.createDataFrame(rows, "player_id long, day date, rating_before double, rating double, deviation double")
    got = [(r["kind"], r["player_id"], r["change"], r["rating_before"], r["rating_after"], r["deviation_after"]) for r in movers(p, 2).collect()]
    assert sorted(got) == [("decrease", 2, -20.0, 1500.0, 1480.0, 300.0), ("decrease", 5, -100.0, 1400.0, 1300.0, 90.0), ("increase", 1, 10.0, 1500.0, 1510.0, 200.0), ("increase", 4, 10.0, 1400.0, 1410.0, 90.0)]
    assert movers(p.limit(0)).count() == 0


def test_states_of_jobs(spark):
    now = datetime.datetime(2024, 5, 1, 12)
    later, before = now + datetime.timedelta(hours=1), now - datetime.timedelta(hours=1)
    rows = [(1, 3, 3, True, before), (2, 0, 3, True, before), (3, 2, 3, False, now), (4, 0, 3, False, later), (5, 4, 3, False, later)]
    j = spark.createDataFrame([(*r, now) for r in rows], "job_id long, attempts int, max_attempts int, locked boolean, run_at timestamp, now timestamp")
    assert {r["job_id"]: (r["failed"], r["ready"], r["scheduled"]) for r in queue_states(j).collect()} == {1: (True, False, False), 2: (False, False, False), 3: (False, True, False), 4: (False, False, True), 5: (True, False, False)}


def test_sources_of_a_list():
    with pytest.raises(ValueError):
        matches_of(None, None, "friendly")


def test_addresses_of_sources(spark):
    from pyspark.sql import functions as F

    from rallyframe.plans.records import shared_confidence, source_address

    rows = spark.createDataFrame([("api", 7), ("site", 7), ("other", 7), (None, 7), ("site", None)], "kind string, fixture long")
    parts = {"base": F.lit("https://a.example"), "league": F.lit("north"), "season": F.lit(3), "competition": F.lit(4), "fixture": F.col("fixture")}
    got = rows.select(source_address(F.col("kind"), "competition", **parts).alias("c"), source_address(F.col("kind"), "fixture", **parts).alias("f")).collect()
    assert [tuple(r) for r in got] == [
        ("https://a.example/api/divisions/4/standings", "https://a.example/api/matches/7/sets"),
        ("https://a.example/north/Tables/3/4", "https://a.example/north/Results/MatchCard/3/7"),
        (None, None), (None, None), ("https://a.example/north/Tables/3/4", None),
    ]
    samples = spark.createDataFrame([(30, 5, "high"), (30, 4, "medium"), (29, 9, "medium"), (14, 0, "medium"), (13, 9, "low")], "n long, m long, want string")
    assert samples.where(shared_confidence(F.col("n"), F.col("m")) != F.col("want")).count() == 0
