"""Match evidence and predictions against the formulas, row by row."""

import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from rallyframe.functions import glicko
from rallyframe.operators.rating_fold import rating_periods
from rallyframe.plans.ratings import match_evidence, predictions

SCALE = 173.7178


def test_evidence_adds_up(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        home, away = rng.sample(range(7), 2)
        h = rng.randrange(4)
        rows.append((i, date(2022, 1, 1) + timedelta(days=rng.randrange(25)), home, away, h, 3 - h, h > 3 - h))
    e = spark.createDataFrame(rows, "rubber_id long, day date, home long, away long, home_games long, away_games long, home_won boolean")
    got = match_evidence(e, rating_periods(e)).collect()
    assert len(got) == 2 * len(rows)
    sums: dict = {}
    for r in got:
        phi = r["opponent_deviation"] / SCALE
        g = 1 / math.sqrt(1 + 3 * phi * phi / math.pi**2)
        expected = 1 / (1 + math.exp(-g * (r["rating_before"] - r["opponent_rating"]) / SCALE))
        after = r["deviation_after"] / SCALE
        assert math.isclose(r["expected"], expected) and math.isclose(r["surprise"], r["won"] - expected, abs_tol=1e-12)
        assert math.isclose(r["attributed_change"], SCALE * after * after * g * (r["won"] - expected), abs_tol=1e-9)
        assert math.isclose(r["information"], g * g * expected * (1 - expected))
        assert r["provisional_after"] == (r["matches_after"] < 10 or r["deviation_after"] > 110)
        sums.setdefault((r["player_id"], r["day"], r["period_change"]), []).append(r["attributed_change"])
    assert all(math.isclose(sum(parts), change, abs_tol=1e-9) for (_, _, change), parts in sums.items())


def test_predictions(spark):
    sides = [(1500.0, 60.0, False), (1700.0, 70.0, False), (1500.0, 100.0, False), (9000.0, 40.0, True), (1500.0, 130.0, False)]
    df = spark.createDataFrame([(i, j, dict(zip(("rating", "deviation", "provisional"), a)), dict(zip(("rating", "deviation", "provisional"), b))) for i, a in enumerate(sides) for j, b in enumerate(sides) if i != j], "i int, j int, a struct<rating:double,deviation:double,provisional:boolean>, b struct<rating:double,deviation:double,provisional:boolean>")
    got = {(r["i"], r["j"]): r for r in df.select("i", "j", *predictions("a", "b")).collect()}
    assert [got[k]["confidence"] for k in ((0, 1), (0, 2), (0, 3), (0, 4))] == ["high", "medium", "low", "low"]
    assert got[(0, 1)]["combined_deviation"] == 92.2 and got[(3, 0)]["probability_1"] == 1.0
    assert all(abs(got[(i, j)]["probability_1"] - got[(j, i)]["probability_2"]) < 2e-4 and 0 <= r["probability_1"] <= 1 for (i, j), r in got.items())
    assert spark.range(1).select(glicko.confidence(F.lit(120.0), F.lit(None).cast("boolean"))).first()[0] == "medium"
