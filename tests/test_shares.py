"""What is cut by player grows in number and not in size, and what is asked for early is what the reason implies."""

import random
from itertools import groupby

import pytest

from rallyframe.operators.classify import classified
from rallyframe.plans import audit, details, players, ratings
from rallyframe.sources import adapter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [players.current_streak, players.longest_runs, details.insight_rivals, audit.same_day_leagues])
def test_parts_grow_with_the_rubbers(spark, monkeypatch, query):
    monkeypatch.setattr(adapter, "SHARE", 500)
    d = adapter.Domain(spark, SF)
    assert d.shares == -(-d.table("lineitem").count() // 500) > 4
    assert query(d).rdd.getNumPartitions() == d.shares


def test_runs_of_any_results_sort_once(spark):
    draw = random.Random(7)
    rows = [(p, None, r, side, draw.choice([True, False, None])) for p in range(5) for r in range(40) for side in ("away", "home")]
    out = players.runs(spark.createDataFrame(rows, "player_id long, day date, rubber_id long, side string, won boolean"))
    want = set()
    for p in range(5):
        k = 1
        for won, run in groupby([won for q, *_, won in rows if q == p]):
            n = len(list(run))
            want.add((p, won, k, n))
            k += n
    assert {(r["player_id"], r["won"], r["from_k"], r["length"]) for r in out.collect()} == want
    assert len({line.split("Sort ")[1] for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line}) == 1


def test_rated_rubbers_are_chosen_before_joins(spark):
    d = adapter.Domain(spark, SF)
    plain = classified(d).where("reason = 'eligible'").select("rubber_id")
    mine = ratings.eligible(d).select("rubber_id")
    assert sorted(r[0] for r in mine.collect()) == sorted(r[0] for r in plain.collect())
    assert "LeftOuter" not in mine._jdf.queryExecution().optimizedPlan().toString()
