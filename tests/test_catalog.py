"""Queries against their SQL on the smallest shared tables, and what plans must not hold."""

import os

import pytest

from rallyframe.plans import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
SOME = ["q03_leaders_combined", "q07_profile", "q12_current_streak", "q17_match_list", "q22_rivals", "q25_rating_twelve_weeks", "q38_standings", "q48_classification", "q56_current_rankings", "q67_player_coverage", "q85_flatten_chains", "q89_graph_edges", "q94_event_matching", "q103_retention", "q105_incremental_merge", "s13_upsert", "q14_insight_rivals", "q18_matches_by_team", "q47_event_results", "q54_input_fingerprint", "q61_league_ranking", "q74_issue_lifecycle", "q81_source_snapshot", "q95_embedding_matching", "a11_ordered_json", "f13_months", "s09_turned_away", "s12_event_fixtures", "s16_full_replace", "s17_two_runs", "s21_pruned_months", "s22_manifest_checks", "u15_event_status", "q13_peaks", "q16_milestones", "w13_momentum", "q77_ranking_quality", "q99_overall_state", "t05_exact_page", "q74_issue_refresh", "q75_issue_list", "q76_sources", "q76_competitions", "q78_identity_health", "q78_network_health", "q17_matches_league", "q27_evidence", "q36_season_history", "q97_queue_tasks"]


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from compare import TABLES, plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(x) for x in r]) for r in cur.fetchall())


@needs_data
@pytest.mark.parametrize("name", ["q09_stats", "q88_deleted_aliases", "q10_nemesis", "q44_fixture_rubbers"])
def test_joins_by_slot_are_equi_joins(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_only_one_filter_of_a_match_list(spark):
    from rallyframe.plans.details import filtered_matches

    with pytest.raises(ValueError):
        filtered_matches(None)
    with pytest.raises(ValueError):
        filtered_matches(None, team=spark.range(1), event=spark.range(1))


def test_entry_module_holds_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.FLAGSHIP in e.queries()
