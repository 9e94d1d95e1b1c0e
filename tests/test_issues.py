"""Findings of an audit, the table of issues over several runs, duplicate groups and what is odd in ratings."""

import datetime
import json

from rallyframe.operators import issues
from rallyframe.plans.quality import filtered, rating_anomalies

DAY = datetime.date
CLASSIFIED = "rubber_id long, fixture_id long, competition_id long, league_id long, effective_day date, date_played date, played_on date, home_player long, away_player long, home_games long, away_games long, is_doubles boolean, outcome string, reason string"


def rubber(i, home, away, reason="eligible", day=DAY(2024, 5, 1), games=(3, 1), league=1, competition=10, doubles=False, outcome="normal", date_played=None, played_on=None):
    return (i, i * 10, competition, league, day, date_played, played_on, home, away, *games, doubles, outcome, reason)


def classified(spark, *rows):
    return spark.createDataFrame(list(rows), CLASSIFIED)


def found(spark, *rows):
    """(type, id, severity) as findings."""
    rows = [(t, "player", i, s, None, None, None, "{}") for t, i, s in rows]
    return spark.createDataFrame(rows, ", ".join(issues.STORED.split(", ")[:8]))


def test_each_category_of_coverage(spark):
    c = classified(
        spark,
        rubber(1, 1, 2),
        rubber(2, 3, None, "doubles", doubles=True),
        rubber(3, 4, None, "non_normal_outcome", outcome="retired"),
        rubber(4, 5, 5, "same_canonical_player"),
        rubber(5, 6, 7, day=DAY(2010, 1, 1)),
    )
    players = spark.createDataFrame([(i,) for i in range(1, 9)], "player_id long")
    ratings = spark.createDataFrame([(1, 4), (7, 1)], "player_id long, rated_matches long")
    got = {r["player_id"]: r for r in issues.player_coverage(c, players, ratings, DAY(2024, 1, 1)).collect()}
    assert {i: r["category"] for i, r in got.items()} == {
        1: "covered", 2: "eligible_in_window_without_rating", 3: "only_doubles", 4: "only_non_normal", 5: "only_invalid_singles",
        6: "only_before_model_window", 7: "rating_without_eligible_evidence", 8: "no_raw_matches",
    }
    assert got[5]["raw_matches"] == 1 and got[1]["unique_opponents_in_window"] == 1 and got[8]["last_match_date"] is None
    kinds = {(r["issue_type"], r["entity_id"], r["severity"]) for r in issues.player_findings(c, issues.player_coverage(c, players, ratings, DAY(2024, 1, 1))).collect()}
    assert kinds == {("eligible_in_window_without_rating", "2", "critical"), ("rating_without_eligible_evidence", "7", "critical"), ("only_invalid_singles", "5", "warning"), ("high_opponent_count", "1", "info"), ("high_opponent_count", "2", "info")}


def test_most_opponents_ties_go_to_the_smaller_id(spark):
    c = classified(spark, *(rubber(i, 2 * i + 1, 2 * i + 2) for i in range(15)))
    players = spark.createDataFrame([(i,) for i in range(1, 31)], "player_id long")
    cover = issues.player_coverage(c, players, spark.createDataFrame([(i, 1) for i in range(1, 31)], "player_id long, rated_matches long"), DAY(2024, 1, 1))
    assert sorted(int(r["entity_id"]) for r in issues.player_findings(c, cover).collect()) == list(range(1, 21))


def test_same_day_on_several_sources(spark):
    other = DAY(2024, 5, 2)
    c = classified(spark, rubber(1, 1, 2), rubber(2, 1, 3, league=2, competition=20), rubber(3, 1, 2, day=other), rubber(4, 2, 1, day=other, league=3, competition=30), rubber(5, 1, 2, day=None))
    none = spark.createDataFrame([], "player_id long, rated_matches long")
    got = [r for r in issues.player_findings(c, issues.player_coverage(c, none, none, DAY(2024, 1, 1))).collect()]
    assert {r["entity_id"]: json.loads(r["details"]) for r in got} == {
        "1": {"affected_days": 2, "latest_date": "2024-05-02", "maximum_platforms": 2, "maximum_competitions": 2},
        "2": {"affected_days": 1, "latest_date": "2024-05-02", "maximum_platforms": 2, "maximum_competitions": 2},
    }


def test_a_rubber_may_have_several_findings(spark):
    c = classified(spark, rubber(1, 1, 2, "tied_score", day=DAY(1970, 3, 1), played_on=DAY(1970, 3, 1), date_played=DAY(2024, 5, 1)), rubber(2, None, 2, "missing_home_player_record", day=DAY(2030, 1, 1)), rubber(3, 1, 2))
    got = {(r["issue_type"], r["entity_id"]): r for r in issues.rubber_findings(c, DAY(1950, 1, 1), DAY(2025, 1, 1)).collect()}
    assert {k: r["severity"] for k, r in got.items()} == {("tied_score", "1"): "warning", ("suspicious_old_date", "1"): "warning", ("fixture_rubber_date_conflict", "1"): "warning", ("missing_home_player_record", "2"): "critical", ("future_match_date", "2"): "critical"}
    assert json.loads(got["missing_home_player_record", "2"]["details"])["home_player"] is None


def test_duplicate_groups_in_either_orientation(spark):
    c = classified(spark, rubber(1, 1, 2, games=(3, 1)), rubber(2, 2, 1, games=(1, 3)), rubber(3, 5, 6, games=(3, 0)), rubber(4, 6, 5, games=(3, 0)), rubber(5, 1, 2, competition=11), rubber(6, 1, 2, "tied_score"))
    got = {r["group_id"]: (r["candidate_type"], r["rubber_ids"], r["score_signatures"]) for r in issues.duplicate_candidates(c).collect()}
    assert got == {"10:2024-05-01:1:2": ("exact_score_candidate", [1, 2], ["3:1"]), "10:2024-05-01:5:6": ("conflicting_score_candidate", [3, 4], ["0:3", "3:0"])}
    assert {(r["issue_type"], r["severity"]) for r in issues.duplicate_findings(issues.duplicate_candidates(c)).collect()} == {("exact_duplicate_candidate", "info"), ("conflicting_duplicate_candidate", "warning")}


def test_issues_over_runs_against_a_loop(spark):
    """Found, gone, found again; types that a run doesn't look for stay as they are."""
    runs = [
        (DAY(2024, 1, 1), None, [("x", "1", "warning"), ("x", "2", "warning"), ("y", "1", "info")]),
        (DAY(2024, 2, 1), None, [("x", "1", "critical"), ("y", "1", "info"), ("x", "3", "info"), ("x", "3", "warning")]),
        (DAY(2024, 3, 1), ["x"], [("x", "2", "warning")]),
        (DAY(2024, 4, 1), None, []),
    ]
    want, stored = {}, spark.createDataFrame([], issues.STORED)
    for at, types, rows in runs:
        for key, row in want.items():
            if row["resolved_at"] is None and (types is None or key[0] in types):
                row["resolved_at"] = at
        for kind, i, severity in sorted(rows, key=lambda r: r[2]):
            row = want.setdefault((kind, i), {"first_seen": at})
            row.update(severity=severity, last_seen=at, resolved_at=None)
        stored = issues.refreshed(stored, found(spark, *rows), at, types)
        got = {(r["issue_type"], r["entity_id"]): {c: r[c] for c in ("first_seen", "severity", "last_seen", "resolved_at")} for r in stored.collect()}
        assert got == want
    assert want["x", "2"]["resolved_at"] == DAY(2024, 4, 1) and want["y", "1"]["last_seen"] == DAY(2024, 2, 1)


def test_filters_of_the_list(spark):
    f = found(spark, ("x", "1", "warning"), ("y", "2", "info"))
    ids = lambda **by: sorted(r["entity_id"] for r in filtered(f, **by).collect())
    assert ids() == ["1", "2"] and ids(kind="y") == ["2"] and ids(severity="warning") == ["1"] and ids(first=DAY(2024, 1, 1)) == []


def test_anomalies_in_order(spark):
    ratings = spark.createDataFrame([(1, 1500.0, 60.0, 30), (2, 1600.0, 120.0, 30), (3, 1400.0, 60.0, 5), (4, 1450.0, 60.0, 30), (5, 1.0, 300.0, 1)], "player_id long, rating double, deviation double, total_matches int")
    degrees = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 2)], "player_id long, unique_opponents long")
    players = spark.createDataFrame([(i, f"p{i}", i == 5) for i in range(1, 6)], "player_id long, name string, deleted boolean")
    assert [(r["player_id"], r["provisional"]) for r in rating_anomalies(ratings, degrees, players).collect()] == [(4, False), (2, True), (3, True)]


def test_empty_tables(spark):
    c = classified(spark)
    none = spark.createDataFrame([], "player_id long, rated_matches long")
    assert issues.player_findings(c, issues.player_coverage(c, none, none, DAY(2024, 1, 1))).count() == 0
    assert issues.duplicate_candidates(c).count() == 0 and issues.rubber_findings(c, DAY(1950, 1, 1), DAY(2025, 1, 1)).count() == 0


def test_model_and_network_agree(spark):
    """The fold rates each match and player of the network once, and every rated player is established or provisional."""
    import os

    import pytest

    from rallyframe.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("shared tables are not here")
    model, network = (catalog.queries()[q](spark, sf).first() for q in ("q78_model_health", "q78_network_health"))
    assert (model["processed_matches"], model["rated_players"]) == (network["eligible_matches"], network["connected_players"]) and model["rated_players"] > 0
    assert (model["first_rated_date"], model["last_processed_date"]) == (network["first_match_date"], network["last_match_date"])
    assert model["established_players"] + model["provisional_players"] == model["rated_players"]


def test_three_audits_classify_once(spark, monkeypatch):
    """What was known at an earlier date is a part of what is known now, so it is not made again."""
    from types import SimpleNamespace

    from rallyframe.plans import quality
    from rallyframe.sources.staging import written

    dates, calls, seen = [datetime.date(y, 1, 1) for y in (1998, 1999, 2000)], [], []

    def known(d, at):
        calls.append(at)
        return written(spark.createDataFrame([(i, x) for i, x in enumerate(dates)], "rubber_id long, updated_on date"))

    def findings(d, c, at):
        seen.append([r["rubber_id"] for r in c.orderBy("rubber_id").collect()])
        return c.selectExpr("'tied_score' issue_type", "'rubber' entity_type", "cast(rubber_id as string) entity_id", "'warning' severity", "1L source_id", "2L competition_id", "updated_on match_day", "'' details").where(f"rubber_id <> 0 or date'{at}' < date'2000-01-01'")

    monkeypatch.setattr(quality, "run_dates", lambda d, runs: dates)
    monkeypatch.setattr(quality, "known", known)
    monkeypatch.setattr(quality, "findings", findings)
    got = {r["entity_id"]: (r["first_seen"], r["last_seen"], r["resolved_at"]) for r in quality.issue_refresh(SimpleNamespace(spark=spark)).collect()}
    assert seen == [[0], [0, 1], [0, 1, 2]]
    assert got == {"0": (dates[0], dates[1], dates[2]), "1": (dates[1], dates[2], None), "2": (dates[2], dates[2], None)}
    assert calls == dates[-1:]
