"""Engine parts on small inputs: Glicko-2, folds, merges, names, parsing, streams."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rallyframe.functions import glicko, text
from rallyframe.operators import graph, identity, merge, ranking, rating_fold
from rallyframe.sources import payloads
from rallyframe.streaming import merge as streams


def test_published_example():
    s = glicko.update(glicko.State(1500, 200, 0.06), [(1400, 30, 1.0), (1550, 100, 0.0), (1700, 300, 0.0)])
    assert (round(s.rating, 2), round(s.deviation, 2), round(s.volatility, 6)) == (1464.05, 151.52, 0.059996) or abs(s.rating - 1464.06) < 0.02


def test_update_ignores_order_and_inflation_is_bounded():
    seen = [(1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 1.0)]
    a, b = glicko.update(glicko.State(), seen), glicko.update(glicko.State(), seen[::-1])
    assert abs(a.rating - b.rating) < 1e-9 and abs(a.deviation - b.deviation) < 1e-9
    assert glicko.inflate(a, 10**7).deviation == pytest.approx(350.0)
    assert glicko.inflate(a, 0).deviation == pytest.approx(a.deviation)


def test_column_forms_equal_the_function(spark):
    df = spark.createDataFrame([(1500.0, 1600.0, 80.0, 0.06, 30.0)], "r double, o double, d double, v double, n double")
    e, w, p = df.select(glicko.expected_score(F.col("r"), F.col("o"), F.col("d")), glicko.inflated_deviation(F.col("d"), F.col("v"), F.col("n")), glicko.predicted(F.col("r"), F.col("d"), F.col("o"), F.col("d")) + glicko.predicted(F.col("o"), F.col("d"), F.col("r"), F.col("d"))).first()
    assert 0.3 < e < 0.4 and w == pytest.approx(glicko.inflate(glicko.State(1500, 80, 0.06), 30).deviation) and p == pytest.approx(1.0)


def played(n=120, players=9, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        h, a = rng.sample(range(players), 2)
        out.append((date(2024, 1, 1) + timedelta(days=i // 4 * 3), h, a, rng.random() < 0.5 + (h - a) * 0.04))
    return out


ROWS = "day date, home long, away long, home_won boolean"


@pytest.mark.parametrize("block", [10_000, 30, 1])
def test_fold_by_runs_of_days_equals_one_fold(spark, block):
    """One group, short runs of days, and every day by joins."""
    rows = [r for r in played(60) + [(d, h + 100, a + 100, w) for d, h, a, w in played(40, seed=3)]][: 100 if block > 1 else 40]
    got = rating_fold.rating_periods(spark.createDataFrame(rows, ROWS), block).toPandas().sort_values(["player_id", "day"]).reset_index(drop=True)
    want, _ = rating_fold.fold(pd.DataFrame(rows, columns=["day", "home", "away", "home_won"]))
    want = want.sort_values(["player_id", "day"]).reset_index(drop=True)
    assert got["player_id"].tolist() == want["player_id"].tolist() and got["day"].tolist() == want["day"].tolist()
    for c in ("rating", "deviation", "volatility", "rating_before", "deviation_before", "matches", "wins", "total_matches", "total_wins"):
        assert (abs(got[c] - want[c]) < 1e-6).all(), c
    assert got.groupby("player_id")["total_matches"].max().sum() == 2 * len(rows)
    assert rating_fold.rating_periods(spark.createDataFrame([], ROWS)).count() == 0


def test_runs_write_no_states_of_players_that_they_do_not_rate(spark, monkeypatch):
    """Thirteen runs of one match each, twelve of them of new players: rows written between runs grow with the matches, not with runs times players."""
    rows = [(date(2024, 1, 1) + timedelta(days=i), 2 * i, 2 * i + 1, i % 3 > 0) for i in range(12)] + [(date(2024, 2, 1), 0, 23, True)]
    real, sizes = rating_fold.written, []

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rating_fold, "written", counted)
    got = {(r["player_id"], r["day"]): r["rating"] for r in rating_fold.rating_periods(spark.createDataFrame(rows, ROWS), 1).collect()}
    want = rating_fold.fold(pd.DataFrame(rows, columns=["day", "home", "away", "home_won"]))[0]
    assert got == pytest.approx({(p, d): r for p, d, r in zip(want["player_id"], want["day"], want["rating"])})
    assert sum(sizes) <= 2 * len(rows)


def test_runs_hand_on_few_rows(spark, monkeypatch):
    """A run's one task reads and writes packed rows: as many as there are next runs, not one for each period; two windows are folded side by side."""
    rows = played(60)
    real, paths = rating_fold.new_folder, []
    monkeypatch.setattr(rating_fold, "new_folder", lambda s, stem: paths.append(real(s, stem)) or paths[-1])
    both = spark.createDataFrame([(w, *r) for w in (2, 5) for r in rows[:: 1 if w == 2 else 2]], "window int, " + ROWS)
    p, states = rating_fold.window_periods(both, None, 15)
    for w, part in ((2, rows), (5, rows[::2])):
        want = rating_fold.fold(pd.DataFrame(part, columns=["day", "home", "away", "home_won"]))[0]
        got = {(r["player_id"], r["day"]): r["rating"] for r in p.where(F.col("window") == w).collect()}
        assert got == pytest.approx({(p, d): r for p, d, r in zip(want["player_id"], want["day"], want["rating"])})
        assert states.where(F.col("window") == w).count() == want["player_id"].nunique()
    periods = next(x for x in paths if "periods-" in x)
    assert spark.read.parquet(periods).count() < p.count() / 3


def test_packed_rows_hold_all_rows(monkeypatch):
    monkeypatch.setattr(rating_fold, "PACK", 3)
    rows = pa.table({"window": pa.array([0, 1, 0, 1, 0, 0, 0], pa.int32()), "next": pa.array([2, 2, -1, 2, 2, 2, 2], pa.int32()), "x": list(range(7))})
    got = [(b["window"][0].as_py(), b["next"][0].as_py(), sorted(x for part in rating_fold._unpacked_rows([b]) for x in part["x"].to_pylist())) for b in rating_fold._packed_rows(rows, ["window", "next"])]
    assert sorted((w, n, tuple(x)) for w, n, x in got) == [(0, -1, (2,)), (0, 2, (0, 4, 5)), (0, 2, (6,)), (1, 2, (1, 3))]


def test_many_updates_at_once_equal_the_single_one():
    rng = random.Random(8)
    seen = [(rng.uniform(900, 2200), rng.uniform(30, 350), rng.uniform(0.03, 0.09), rng.uniform(0.01, 6), rng.uniform(-9, 9)) for _ in range(400)]
    got = glicko.settled_all(*(np.array(c) for c in zip(*seen)))
    want = [glicko.settled(glicko.State(r, d, v), i, g) for r, d, v, i, g in seen]
    for c, new in zip(("rating", "deviation", "volatility"), got):
        assert new.tolist() == pytest.approx([getattr(s, c) for s in want], rel=1e-9)
    assert all(len(c) == 0 for c in glicko.settled_all(*(np.array([]),) * 5))


def test_weeks_ranks_and_asof_equal_brute_force(spark):
    rows = played(80)
    p = rating_fold.rating_periods(spark.createDataFrame(rows, ROWS), 25)
    want = {}
    for r in sorted(p.collect(), key=lambda r: r["day"]):
        key = (r["player_id"], r["day"] - timedelta(days=r["day"].weekday()))
        start = want[key][1] if key in want else r["rating_before"]
        want[key] = (r["rating"], start, r["total_matches"])
    got = {(r["player_id"], r["week"]): (r["rating"], r["rating"] - r["change"], r["matches"]) for r in rating_fold.weekly_ratings(p).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    df = spark.createDataFrame([(i, (i * 7) % 23, i % 3 == 0) for i in range(200)], "i int, v int, ok boolean").repartition(7)
    places = {r["i"]: (r["all"], r["some"]) for r in ranking.placed(df, [F.desc("v"), F.asc("i")], {"all": F.lit(True), "some": F.col("ok")}).collect()}
    order = sorted(range(200), key=lambda i: (-((i * 7) % 23), i))
    assert places == {i: (n + 1, sum(j % 3 == 0 for j in order[: n + 1]) if i % 3 == 0 else None) for n, i in enumerate(order)}


def test_replay_from_a_checkpoint_equals_a_rebuild():
    rows = pd.DataFrame(played(), columns=["day", "home", "away", "home_won"])
    cut = date(2024, 2, 20)
    whole, end = rating_fold.fold(rows)
    _, state = rating_fold.fold(rows[rows["day"] <= cut])
    tail, again = rating_fold.fold(rows[rows["day"] > cut], state)
    assert end == again and len(tail) == (whole["day"] > cut).sum()


def test_backtest_does_not_look_ahead(spark):
    rows = played(200)
    a = rating_fold.backtest(spark.createDataFrame(rows, ROWS), [2], 60).toPandas()
    last = max(r[0] for r in rows)
    flipped = [(d, h, x, (not w) if d == last else w) for d, h, x, w in rows]
    b = rating_fold.backtest(spark.createDataFrame(flipped, ROWS), [2], 60).toPandas()
    assert sorted(a["probability"]) == sorted(b["probability"])
    r = rating_fold.report(spark.createDataFrame(a)).first()
    assert 0 <= r["brier"] <= 1 and r["matches"] == len(a)


def test_two_dense_pools_are_two_communities(spark):
    e = [(a, b, 1, 5.0) for p in (0, 10) for a in range(p, p + 5) for b in range(a + 1, p + 5)] + [(4, 10, 1, 0.1)]
    got = {r["player_id"]: r["community"] for r in graph.communities(spark.createDataFrame(e, "a long, b long, matches int, weight double")).collect()}
    assert [got[i] for i in range(5)] == [1] * 5 and [got[i] for i in range(10, 15)] == [2] * 5
    part = graph.bridges(spark.createDataFrame(e, "a long, b long, matches int, weight double"), spark.createDataFrame(list(got.items()), "player_id long, community long")).orderBy(F.desc("participation")).limit(2).collect()
    assert {r["player_id"] for r in part} == {4, 10}


def test_components_and_gains_over_the_whole_graph(spark):
    """Two components: gains are over the weight of all edges, and no single move betters what is found."""
    rng = random.Random(4)
    e = [(a, b, 1, round(rng.random() + (2 if a // 4 == b // 4 else 0), 3)) for p in (0, 100) for a in range(p, p + 12) for b in range(a + 1, p + 12) if rng.random() < 0.7]
    got = {r["player_id"]: r["community"] for r in graph.communities(spark.createDataFrame(e, "a long, b long, matches int, weight double")).collect()}
    two_m = 2 * sum(x[3] for x in e)
    degree = {n: sum(x[3] for x in e if n in x[:2]) for n in got}

    def q(labels):
        return sum(2 * x[3] for x in e if labels[x[0]] == labels[x[1]]) / two_m - sum(sum(degree[n] for n in got if labels[n] == c) ** 2 for c in set(labels.values())) / two_m**2

    best = q(got)
    assert best > 0.3 and all(q(got | {n: c}) <= best + 1e-9 for n in got for c in set(got.values()))


def test_communities_take_few_steps_and_whole_groups(spark, monkeypatch):
    """A network without clear pools: few tables are written, and no single move betters what one group or several groups find."""
    rng = random.Random(9)
    e = [(a, b, 1, round(rng.random(), 3)) for a in range(80) for b in range(a + 1, 80) if rng.random() < 0.4]
    frame = spark.createDataFrame(e, "a long, b long, matches int, weight double")
    two_m, degree, steps, write = 2 * sum(x[3] for x in e), dict.fromkeys(range(80), 0.0), [], graph.written
    for a, b, _, w in e:
        degree[a], degree[b] = degree[a] + w, degree[b] + w
    monkeypatch.setattr(graph, "written", lambda *x: steps.append(1) or write(*x))
    for block, most in ((None, 12), (1000, 60)):
        steps.clear()
        label = {r["player_id"]: r["community"] for r in graph.communities(frame, *([block] if block else [])).collect()}
        assert len(steps) <= most
        for n in label:
            gain = lambda c: sum(x[3] for x in e if n in x[:2] and label[x[0] + x[1] - n] == c) - sum(degree[m] for m in label if m != n and label[m] == c) * degree[n] / two_m  # noqa: B023, E731
            assert max(map(gain, set(label.values()))) <= gain(label[n]) + 1e-6


def test_edges_decay_by_half_life(spark):
    rows = [(1, 2, date(2024, 1, 1)), (2, 1, date(2024, 1, 1) - timedelta(days=730)), (1, 2, date(2019, 1, 1)), (3, 3, date(2024, 1, 1))]
    (r,) = graph.decayed_edges(spark.createDataFrame(rows, "home long, away long, day date")).collect()
    assert (r["a"], r["b"], r["matches"], r["weight"]) == (1, 2, 2, 1.5)


def test_chains_flatten_and_cycles_raise(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "player_id long, next long")
    assert {(r["root"], r["depth"] == r["player_id"]) for r in identity.flatten_chains(chain).collect()} == {(0, True)}
    with pytest.raises(ValueError):
        identity.flatten_chains(spark.createDataFrame([(1, 2), (2, 1)], "player_id long, next long"), 4)


def test_merge_and_watermark(spark):
    old = spark.createDataFrame([(1, "completed", 1), (2, "upcoming", 1)], "k int, status string, v int")
    new = spark.createDataFrame([(1, "upcoming", 9), (3, "upcoming", 3)], "k int, status string, v int")
    got = {tuple(r) for r in merge.latest_wins(old, new, ["k"], {"status": "completed"}).collect()}
    assert got == {(1, "completed", 9), (2, "upcoming", 1), (3, "upcoming", 3)}
    stage = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert tuple(merge.stage_check(stage, ["k"]).first()) == (4, 1, 1)
    t = datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(i, t + timedelta(minutes=30 * i)) for i in range(6)], "id int, ts timestamp")
    got = merge.changed_since(rows, "ts", "id", F.lit(t + timedelta(hours=2)), F.lit(t + timedelta(hours=2)), F.lit(4))
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]


def test_names_scores_and_cells(spark):
    df = spark.createDataFrame([("JOHN SMITH", "Under 15 Open 2* 2023", "U15 - Jane Doe (123) - WINNER", "Cup - 2024-05-06: Men", "a b c", "b c d")], "p string, e string, c string, n string, x string, y string")
    r = df.select(text.person_name(F.col("p")).alias("p"), text.person_name(F.lit("Ann McEvoy")).alias("q"), text.event_name(F.col("e")).alias("e"), text.player_cell(F.col("c")).alias("c"), text.dated_event(F.col("n")).alias("n"), text.dated_event(F.lit("Plain")).alias("m"), text.dice(F.col("x"), F.col("y")).alias("d"), text.valid_game(F.lit(11), F.lit(9)).alias("g"), text.valid_game(F.lit(13), F.lit(10)).alias("h"), text.slug(F.lit("Men's A!")).alias("s")).first()
    assert (r["p"], r["q"], r["e"]) == ("John Smith", "Ann McEvoy", "u15 open 2 star")
    assert tuple(r["c"]) == ("U15", "Jane Doe", "123", True)
    assert tuple(r["n"]) == ("Cup", date(2024, 5, 6), "Men") and tuple(r["m"]) == ("Plain", None, None)
    assert r["d"] == pytest.approx(2 / 3) and r["g"] and not r["h"] and r["s"] == "men-s-a"


def test_payloads(spark):
    good = '{"standings": [{"team_id": "t1", "team": "A", "position": 1, "played": 2, "points": 4}], "matches": [{"id": "m1", "date": "2024-01-02", "home": "A", "away": "B", "sets": [{"home_player": "x", "away_player": "y", "home_games": 3, "away_games": 1}]}, {"id": "m2", "date": null, "home": "A", "away": "B", "sets": []}]}'
    out = payloads.league_bundle(spark.createDataFrame([(1, good), (2, good), (3, "no json")], "payload_id int, payload string"))
    assert {k: v.count() for k, v in out.items()} == {"teams": 1, "fixtures": 2, "rubbers": 1, "rejected": 1}
    html = "<table><tr><th>Pos</th></tr><tr><td>1</td><td><a href='/x'>A &amp; B</a></td><td>3</td><td>2</td><td>1</td><td>0</td><td>5</td></tr></table>"
    (r,) = payloads.standings_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert (r["team"], r["place"], r["points"]) == ("A & B", 1, 5)


def test_stream_merges_once_and_keeps_the_latest(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "k int, at timestamp, v int"
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, 1), (2, t, 1)], schema).write.parquet(src)
    run = lambda: streams.merge_stream(spark.readStream.schema(schema).parquet(src), out, ["k"], "at", ck).awaitTermination()
    run()
    spark.createDataFrame([(1, t + timedelta(days=1), 5), (2, t - timedelta(days=1), 7), (3, t, 3)], schema).write.mode("append").parquet(src)
    run()
    run()
    assert {(r["k"], r["v"]) for r in streams.merged_table(spark, out).collect()} == {(1, 5), (2, 1), (3, 3)}


def test_a_crash_while_writing_loses_nothing(spark, tmp_path):
    """Only complete versions count: with the newest one cut off, and with the last batch delivered again to a new checkpoint, all keys stay."""
    import os
    import shutil

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema, t = "k int, at timestamp, v int", datetime(2024, 1, 1)
    run = lambda check: streams.merge_stream(spark.readStream.schema(schema).parquet(src), out, ["k"], "at", check).awaitTermination()
    spark.createDataFrame([(1, t, 1), (2, t, 1)], schema).write.parquet(src)
    run(ck)
    spark.createDataFrame([(3, t, 3)], schema).write.mode("append").parquet(src)
    run(ck)
    newest = sorted(os.listdir(out))[-1]
    os.remove(f"{out}/{newest}/_SUCCESS")  # as if the write had not ended
    assert {r["k"] for r in streams.merged_table(spark, out).collect()} == {1, 2}
    run(f"{ck}-new")
    assert {(r["k"], r["v"]) for r in streams.merged_table(spark, out).collect()} == {(1, 1), (2, 1), (3, 3)}
    shutil.rmtree(out)
    with pytest.raises(ValueError):
        streams.merged_table(spark, out)


def test_words_for_comparison(spark):
    said = {  # fixed values: what the rules make of names
        "Men's U 15 - Cup 2024": "men s u 15 cup", "Under 15 and under9s Under12": "u15 and under9s u12", "under-15": "under 15", "2 STARS 3-star 4star 12 star 5 - star": "2 star 3 star 4 star 12 star 5 star",
        "1* Open, 2*Cup *x": "1 star open 2 starcup x", "Open Championships 1999 2100 _2001_": "open championship 2100 2001", "Élan Über": "e lan u ber", "under 2024 7": "u7", "": "", " * ": "", "2 stars 3 stars": "2 star 3 star",
    }
    df = spark.createDataFrame([(k,) for k in [*said, None]], "x string").select("x", text.plain_words(F.col("x")).alias("w"))
    assert {r["x"]: r["w"] for r in df.collect()} == {**said, None: None}


def test_event_names_and_decisions_as_in_the_rules(spark):
    """Words that tell events apart stay, generic ones go; marks and years fold; second candidates make a review only when they could be meant."""
    from rallyframe.plans.matching import match_events, match_events_by_meaning

    n = lambda x: spark.range(1).select(text.event_name(F.lit(x))).first()[0]
    assert [n(x) for x in ("2024 Café Open Championships Results", "Under 13 2 Stars", "Grand Prix 3*  Draw")] == ["cafe open championship", "u13 2 star", "grand prix 3 star"]
    schema = "id long, name string, venue string, category string, start_day date, end_day date, vector array<double>"
    d = date(2024, 5, 4)
    cal = [(10, "Spring Open", "Hall A", "u15", d, d, [1.0, 0.0]), (12, "Summer Cup", "Hall B", "u15", d, d, [0.0, 1.0]), (14, "Summer Cup", "Hall B", "u15", d, None, [0.0, 1.0]), (16, "Winter Open", None, None, d + timedelta(days=5), None, None)]
    res = [(1, "Spring Open results", "Hall A", "u15", d, d, [1.0, 0.1]), (3, "Summer Cup", "Hall B", "u15", d, d, [0.0, 1.0]), (5, "Winter Open", None, None, d, d, None), (7, "Other Words", "Hall A", "u15", d, d, [1.0, 0.0])]
    cal, res = (spark.createDataFrame(x, schema) for x in (cal, res))
    got = {r["result_id"]: (r["calendar_id"], r["score"], r["verdict"], r["reason"]) for r in match_events(cal, res).collect()}
    assert got == {1: (10, 1.0, "automatic", "matched"), 3: (12, 1.0, "review", "ambiguous"), 5: (None, None, "none", "below-threshold"), 7: (None, None, "none", "below-threshold")}
    got = {r["result_id"]: (r["calendar_id"], r["verdict"], r["reason"]) for r in match_events_by_meaning(cal, res).collect()}
    # like vectors without a common word are for review at most
    assert got == {1: (10, "automatic", "matched"), 3: (12, "review", "ambiguous"), 5: (None, "none", "below-threshold"), 7: (10, "review", "review-threshold")}


def test_weeks_begin_on_mondays(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 7, 23), 1, "x", 1.0), (datetime(2024, 1, 8, 0), 1, "x", 2.0)], "seen_at timestamp, platform_id int, kind string, value double")
    assert {(r["week"], r["n"]) for r in streams.weekly_counts(e).collect()} == {(date(2024, 1, 1), 1), (date(2024, 1, 8), 1)}
