"""What audits find and when it went away, listings of quality, and the health of data, identities, network and model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_name
from ..operators import issues
from ..operators.classify import CLASSIFIED_SQL, classified
from ..operators.paging import exact_page
from ..operators.rating_fold import latest, rating_periods
from ..sources.adapter import Domain
from ..sources.staging import dropped, written
from .audit import BAD_DAY
from .catalog import query
from .players import n_if
from .ratings import eligible

#: Days outside which a date is suspicious; months of the ratings' window.
FIRST_DAY, LAST_DAY, WINDOW_MONTHS = date(1992, 6, 1), date(2001, 6, 1), 36


def run_dates(d: Domain, runs: int) -> list[date]:
    """The last day of the data, and the same day of the years before it, oldest first; none where there are no rubbers."""
    ends = [F.add_months(F.max("updated_on"), -12 * i).alias(f"d{i}") for i in reversed(range(runs))]
    return [x for x in d.rubbers.where("not deleted").agg(*ends).first() if x is not None]


def known(d: Domain, at: date) -> DataFrame:
    """The classified rubbers as known at a date, written, as an audit reads them several times."""
    return written(classified(d).where(F.col("updated_on") <= F.lit(at)))


def findings(d: Domain, c: DataFrame, at: date) -> DataFrame:
    """All that an audit at a date finds in the rubbers known by then; ratings are those of the calculation up to the month before."""
    players = d.players.where("not deleted and coalesce(canonical_id, player_id) = player_id")
    rated = c.where("reason = 'eligible'").where(F.col("effective_day") < F.date_trunc("month", F.lit(at)))
    rated = issues.player_sides(rated).groupBy("player_id").agg(F.count("*").alias("rated_matches"))
    start = d.spark.range(1).select(F.add_months(F.lit(at), -WINDOW_MONTHS)).first()[0]
    coverage = issues.player_coverage(c, players, rated, start)
    of_players = issues.player_findings(c, coverage)
    return issues.rubber_findings(c, FIRST_DAY, LAST_DAY).unionByName(of_players).unionByName(issues.duplicate_findings(issues.duplicate_candidates(c)))


def _runs_sql(runs: int) -> str:
    dates = ", ".join(f"CAST(max(updated_on) - INTERVAL {i} YEAR AS DATE)" for i in range(runs))
    missing = ", ".join(f"'{x}'" for x in issues.MISSING_PLAYERS)
    return f"""WITH {CLASSIFIED_SQL.replace("classified AS (", "classified AS MATERIALIZED (", 1)}, runs AS (SELECT unnest([{dates}]) AS run_at FROM rubbers WHERE NOT deleted), known AS MATERIALIZED (SELECT run_at, classified.* FROM classified JOIN runs ON updated_on <= run_at),
    both_sides AS (SELECT *, home_player AS player_id, away_player AS opponent_id FROM known UNION ALL SELECT *, away_player, home_player FROM known WHERE home_player IS DISTINCT FROM away_player),
    stats AS (SELECT run_at, player_id, count(*) AS raw_matches, count(*) FILTER (WHERE NOT is_doubles) AS singles_matches, count(*) FILTER (WHERE NOT is_doubles AND outcome = 'normal') AS normal_singles_matches, count(*) FILTER (WHERE reason = 'eligible') AS eligible_matches_all_time,
        count(*) FILTER (WHERE reason = 'eligible' AND effective_day >= run_at - INTERVAL {WINDOW_MONTHS} MONTH) AS eligible_matches_in_window, count(DISTINCT opponent_id) FILTER (WHERE reason = 'eligible' AND effective_day >= run_at - INTERVAL {WINDOW_MONTHS} MONTH) AS unique_opponents_in_window,
        min(effective_day) AS first_match_date, max(effective_day) AS last_match_date, nullif(count(*) FILTER (WHERE reason = 'eligible' AND effective_day < date_trunc('month', run_at)), 0) AS rated_matches FROM both_sides WHERE player_id IS NOT NULL GROUP BY ALL),
    covered AS (SELECT r.run_at, p.player_id, coalesce(raw_matches, 0) AS raw_matches, coalesce(singles_matches, 0) AS singles_matches, coalesce(normal_singles_matches, 0) AS normal_singles_matches, coalesce(eligible_matches_all_time, 0) AS eligible_matches_all_time, coalesce(eligible_matches_in_window, 0) AS eligible_matches_in_window, coalesce(unique_opponents_in_window, 0) AS unique_opponents_in_window,
        first_match_date, last_match_date, rated_matches IS NOT NULL AS rating_exists, rated_matches FROM (SELECT * FROM players WHERE NOT deleted AND coalesce(canonical_id, player_id) = player_id) p CROSS JOIN runs r LEFT JOIN stats s ON s.run_at = r.run_at AND s.player_id = p.player_id),
    categories AS (SELECT *, CASE WHEN rating_exists AND eligible_matches_in_window = 0 THEN 'rating_without_eligible_evidence' WHEN NOT rating_exists AND eligible_matches_in_window > 0 THEN 'eligible_in_window_without_rating' WHEN raw_matches = 0 THEN 'no_raw_matches' WHEN singles_matches = 0 THEN 'only_doubles' WHEN normal_singles_matches = 0 THEN 'only_non_normal'
        WHEN eligible_matches_all_time = 0 THEN 'only_invalid_singles' WHEN eligible_matches_in_window = 0 THEN 'only_before_model_window' ELSE 'covered' END AS category FROM covered),
    candidates AS (SELECT *, CASE WHEN len(score_signatures) > 1 THEN 'conflicting_score_candidate' ELSE 'exact_score_candidate' END AS candidate_type, concat_ws(':', competition_id, match_day, player_a, player_b) AS group_id FROM (
        SELECT run_at, competition_id, effective_day AS match_day, least(home_player, away_player) AS player_a, greatest(home_player, away_player) AS player_b, count(*) AS rubber_count, list(rubber_id ORDER BY rubber_id) AS rubber_ids, list_sort(list(DISTINCT league_id)) AS source_ids,
            list_sort(list(DISTINCT CASE WHEN home_player <= away_player THEN home_games || ':' || away_games ELSE away_games || ':' || home_games END)) AS score_signatures FROM known WHERE reason = 'eligible' AND competition_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)),
    crowds AS (SELECT run_at, player_id, effective_day, count(DISTINCT league_id) AS sources, count(DISTINCT competition_id) AS competitions FROM both_sides WHERE player_id IS NOT NULL AND effective_day IS NOT NULL AND league_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT league_id) > 1),
    busy AS (SELECT run_at, player_id, count(*) AS affected_days, max(effective_day) AS latest_date, max(sources) AS maximum_platforms, max(competitions) AS maximum_competitions FROM crowds GROUP BY ALL),
    found AS (
        SELECT run_at, reason AS issue_type, 'rubber' AS entity_type, CAST(rubber_id AS VARCHAR) AS entity_id, CASE WHEN reason LIKE '%_record' OR reason LIKE '%_records' OR reason = 'same_canonical_player' THEN 'critical' ELSE 'warning' END AS severity, league_id AS source_id, competition_id, effective_day AS match_day,
            CAST(to_json({{'fixture_id': fixture_id, 'home_player': home_player, 'away_player': away_player, 'home_games': home_games, 'away_games': away_games}}) AS VARCHAR) AS details FROM known WHERE reason IN ({missing}, 'missing_date', 'same_canonical_player', 'tied_score')
        UNION ALL SELECT run_at, CASE WHEN effective_day > DATE '{LAST_DAY}' THEN 'future_match_date' ELSE 'suspicious_old_date' END, 'rubber', CAST(rubber_id AS VARCHAR), CASE WHEN effective_day > DATE '{LAST_DAY}' THEN 'critical' ELSE 'warning' END, league_id, competition_id, effective_day,
            CAST(to_json({{'fixture_id': fixture_id, 'effective_date': effective_day, 'eligibility_reason': reason}}) AS VARCHAR) FROM known WHERE {BAD_DAY}
        UNION ALL SELECT run_at, 'fixture_rubber_date_conflict', 'rubber', CAST(rubber_id AS VARCHAR), 'warning', league_id, competition_id, played_on, CAST(to_json({{'fixture_id': fixture_id, 'rubber_date': played_on, 'fixture_date': date_played, 'difference_days': abs(datediff('day', date_played, played_on))}}) AS VARCHAR) FROM known WHERE abs(datediff('day', date_played, played_on)) > {issues.CONFLICT_DAYS}
        UNION ALL SELECT run_at, category, 'player', CAST(player_id AS VARCHAR), CASE category WHEN 'only_invalid_singles' THEN 'warning' ELSE 'critical' END, NULL, NULL, last_match_date, CAST(to_json({{'raw_matches': raw_matches, 'singles_matches': singles_matches, 'normal_singles_matches': normal_singles_matches, 'eligible_matches_all_time': eligible_matches_all_time, 'eligible_matches_in_window': eligible_matches_in_window,
            'unique_opponents_in_window': unique_opponents_in_window, 'first_match_date': first_match_date, 'last_match_date': last_match_date, 'rating_exists': rating_exists, 'rated_matches': rated_matches}}) AS VARCHAR) FROM categories WHERE category IN ('eligible_in_window_without_rating', 'rating_without_eligible_evidence', 'only_invalid_singles')
        UNION ALL SELECT run_at, 'high_opponent_count', 'player', CAST(player_id AS VARCHAR), 'info', NULL, NULL, last_match_date, CAST(to_json({{'unique_opponents_in_window': unique_opponents_in_window, 'eligible_matches_in_window': eligible_matches_in_window, 'last_match_date': last_match_date}}) AS VARCHAR)
            FROM (SELECT *, row_number() OVER (PARTITION BY run_at ORDER BY unique_opponents_in_window DESC, player_id) AS k FROM categories WHERE eligible_matches_in_window > 0) WHERE k <= {issues.MOST_OPPONENTS}
        UNION ALL SELECT run_at, 'same_day_cross_platform_activity', 'player', CAST(player_id AS VARCHAR), 'warning', NULL, NULL, latest_date, CAST(to_json({{'affected_days': affected_days, 'latest_date': latest_date, 'maximum_platforms': maximum_platforms, 'maximum_competitions': maximum_competitions}}) AS VARCHAR) FROM busy
        UNION ALL SELECT run_at, CASE candidate_type WHEN 'conflicting_score_candidate' THEN 'conflicting_duplicate_candidate' ELSE 'exact_duplicate_candidate' END, 'duplicate_group', group_id, CASE candidate_type WHEN 'conflicting_score_candidate' THEN 'warning' ELSE 'info' END, NULL, competition_id, match_day,
            CAST(to_json({{'player_a': player_a, 'player_b': player_b, 'rubber_count': rubber_count, 'rubber_ids': rubber_ids, 'source_ids': source_ids, 'score_signatures': score_signatures}}) AS VARCHAR) FROM candidates)"""


@query("q74_issue_refresh", _runs_sql(3) + """, span AS (SELECT issue_type, entity_type, entity_id, min(run_at) AS first_seen, max(run_at) AS last_seen FROM found GROUP BY ALL)
    SELECT f.issue_type, f.entity_type, f.entity_id, f.severity, f.source_id, f.competition_id, f.match_day, f.details, s.first_seen, s.last_seen, (SELECT min(run_at) FROM runs WHERE run_at > s.last_seen) AS resolved_at
    FROM span s JOIN found f ON f.issue_type = s.issue_type AND f.entity_type = s.entity_type AND f.entity_id = s.entity_id AND f.run_at = s.last_seen""")
def issue_refresh(d: Domain) -> DataFrame:
    """Three audits a year apart into one table: what is open, since when, and what went away at which of them."""
    stored, dates = d.spark.createDataFrame([], issues.STORED), run_dates(d, 3)
    if not dates:
        return stored
    every, last = known(d, dates[-1]), None  # what was known earlier is a part of it
    for at in dates:
        c = every.where(F.col("updated_on") <= F.lit(at))
        stored = written(issues.refreshed(stored, findings(d, c, at), at))
        if last is not None:
            dropped(last)
        last = stored
    dropped(every)
    return stored


@query("q69_coverage_issues", _runs_sql(1) + " SELECT issue_type, severity, entity_id, match_day, details FROM found WHERE entity_type = 'player'")
def coverage_issues(d: Domain) -> DataFrame:
    """What the last audit finds of players: those that their matches and rating don't agree on, the twenty with the most opponents, and same-day activity on several sources."""
    return _open(d).where("entity_type = 'player'").select("issue_type", "severity", "entity_id", "match_day", "details")


def _open(d: Domain) -> DataFrame:
    at = (run_dates(d, 1) or [LAST_DAY])[-1]
    return findings(d, known(d, at), at)


LEVEL_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
FILTER_SQL = "source_id IN (1, 3) AND match_day >= DATE '1996-01-01' AND match_day <= DATE '1998-12-31'"


def filtered(found: DataFrame, kind: str | None = None, severity: str | None = None, sources: list[int] | None = None, competition: int | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """Findings by any of the filters that an issue list has; one that isn't given holds for all."""
    for column, value in (("issue_type", kind), ("severity", severity), ("competition_id", competition)):
        found = found if value is None else found.where(F.col(column) == value)
    found = found if sources is None else found.where(F.col("source_id").isin(*sources))
    found = found if first is None else found.where(F.col("match_day") >= F.lit(first))
    return found if last is None else found.where(F.col("match_day") <= F.lit(last))


@query("q75_issue_list", _runs_sql(1) + f""", f AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY {LEVEL_SQL}, match_day DESC NULLS LAST, issue_type, entity_id) AS k FROM found WHERE {FILTER_SQL})
    SELECT k - 20 AS place, total, issue_type, severity, entity_type, entity_id, source_id, league_name AS source_name, competition_id, match_day, details FROM f LEFT JOIN leagues ON league_id = source_id WHERE k > 20 AND k <= 40""")
def issue_list(d: Domain) -> DataFrame:
    """The second page of open issues of two sources and three years, gravest and latest first, with the total."""
    some = filtered(_open(d), sources=[1, 3], first=date(1996, 1, 1), last=date(1998, 12, 31))
    page = exact_page(some, [F.expr(LEVEL_SQL).asc(), F.desc_nulls_last("match_day"), F.asc("issue_type"), F.asc("entity_id")], 20, 20)
    names = d.leagues.select(F.col("league_id").alias("source_id"), F.col("league_name").alias("source_name"))
    return page.join(F.broadcast(names), "source_id", "left").select(F.col("place").cast("bigint").alias("place"), F.col("total").cast("bigint").alias("total"), "issue_type", "severity", "entity_type", "entity_id", "source_id", "source_name", "competition_id", "match_day", "details")


@query("q75_open_issues", _runs_sql(1) + f" SELECT issue_type, severity, count(*) AS n, row_number() OVER (ORDER BY {LEVEL_SQL}, count(*) DESC, issue_type) AS place FROM found WHERE {FILTER_SQL} GROUP BY issue_type, severity")
def open_issues(d: Domain) -> DataFrame:
    """The same issues by type and severity, gravest and most frequent first; a row a type."""
    some = filtered(_open(d), sources=[1, 3], first=date(1996, 1, 1), last=date(1998, 12, 31))
    g = some.groupBy("issue_type", "severity").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.expr(LEVEL_SQL), F.desc("n"), "issue_type")).cast("bigint"))


COUNTED_SQL = f"""count(k.rubber_id) AS total_rubbers, count(k.rubber_id) FILTER (WHERE reason = 'eligible') AS eligible_rubbers, count(k.rubber_id) FILTER (WHERE reason LIKE 'missing_%player%') AS missing_identity_rubbers, count(k.rubber_id) FILTER (WHERE reason = 'missing_date') AS missing_date_rubbers,
        count(k.rubber_id) FILTER (WHERE reason NOT IN ('eligible', 'doubles', 'non_normal_outcome')) AS invalid_single_rubbers, count(k.rubber_id) FILTER (WHERE {BAD_DAY}) AS suspicious_date_rubbers, min(effective_day) AS first_match_date, max(effective_day) AS last_match_date"""
QUALITY = ["total_rubbers", "eligible_rubbers", "missing_identity_rubbers", "missing_date_rubbers", "invalid_single_rubbers", "suspicious_date_rubbers"]
CANDIDATES = ["duplicate_candidate_groups", "conflicting_candidate_groups"]


@query("q76_sources", _runs_sql(1) + f""", q AS (SELECT l.league_id AS source_id, l.league_name AS source_name, {COUNTED_SQL} FROM leagues l LEFT JOIN known k ON k.league_id = l.league_id GROUP BY ALL),
    g AS (SELECT q.*, (SELECT count(*) FROM candidates WHERE list_contains(source_ids, q.source_id)) AS duplicate_candidate_groups, (SELECT count(*) FROM candidates WHERE list_contains(source_ids, q.source_id) AND candidate_type = 'conflicting_score_candidate') AS conflicting_candidate_groups FROM q)
    SELECT *, row_number() OVER (ORDER BY missing_identity_rubbers DESC, invalid_single_rubbers DESC, total_rubbers DESC, source_name) AS place, count(*) OVER () AS total FROM g LIMIT 25""")
def quality_of_sources(d: Domain) -> DataFrame:
    """Every source with its rubbers by fault and the duplicate groups whose list of sources holds it, worst first, first page."""
    c = written(classified(d))
    q = d.leagues.select(F.col("league_id").alias("source_id"), F.col("league_name").alias("source_name")).join(issues.quality_counts(c.withColumnRenamed("league_id", "source_id"), "source_id", F.expr(BAD_DAY)), "source_id", "left").fillna(0, QUALITY)
    q = issues.with_candidates(q, issues.duplicate_candidates(c), "source_id", F.explode("source_ids"))
    page = exact_page(q, [F.desc("missing_identity_rubbers"), F.desc("invalid_single_rubbers"), F.desc("total_rubbers"), F.asc("source_name")], 25)
    return page.drop("has_more").withColumns({x: F.col(x).cast("bigint") for x in ("place", "total")})


@query("q76_competitions", _runs_sql(1) + f""", q AS (SELECT competition_id, league_id AS source_id, {COUNTED_SQL} FROM (SELECT DISTINCT competition_id, league_id FROM fixtures) f LEFT JOIN (SELECT * EXCLUDE (league_id) FROM known) k USING (competition_id) WHERE league_id = 2 AND CAST(competition_id AS VARCHAR) ILIKE '%199%' GROUP BY ALL),
    n AS (SELECT competition_id, count(*) AS duplicate_candidate_groups, count(*) FILTER (WHERE candidate_type = 'conflicting_score_candidate') AS conflicting_candidate_groups FROM candidates GROUP BY competition_id),
    g AS (SELECT q.*, coalesce(duplicate_candidate_groups, 0) AS duplicate_candidate_groups, coalesce(conflicting_candidate_groups, 0) AS conflicting_candidate_groups FROM q LEFT JOIN n USING (competition_id)),
    p AS (SELECT *, row_number() OVER (ORDER BY missing_identity_rubbers DESC, conflicting_candidate_groups DESC, invalid_single_rubbers DESC, total_rubbers DESC, competition_id) AS place, count(*) OVER () AS total FROM g) SELECT * FROM p WHERE place <= 25""")
def quality_of_competitions(d: Domain) -> DataFrame:
    """The competitions of one source whose name (their number) holds a text, with those without rubbers, worst first, first page."""
    some = d.fixtures.select("competition_id", F.col("league_id").alias("source_id")).distinct().where((F.col("source_id") == 2) & F.col("competition_id").cast("string").ilike("%199%"))
    c = written(classified(d))
    q = some.join(issues.quality_counts(c, "competition_id", F.expr(BAD_DAY)), "competition_id", "left").fillna(0, QUALITY)
    q = issues.with_candidates(q, issues.duplicate_candidates(c), "competition_id", F.col("competition_id"))
    page = exact_page(q, [F.desc("missing_identity_rubbers"), F.desc("conflicting_candidate_groups"), F.desc("invalid_single_rubbers"), F.desc("total_rubbers"), F.asc("competition_id")], 25)
    return page.drop("has_more").withColumns({x: F.col(x).cast("bigint") for x in ("place", "total")})


@query("q76_duplicate_candidates", _runs_sql(1) + """, g AS (SELECT *, row_number() OVER (ORDER BY candidate_type, rubber_count DESC, match_day DESC, group_id) AS place, count(*) OVER () AS total FROM candidates)
    SELECT place, total, group_id, candidate_type, competition_id, match_day, player_a, a.name AS player_a_name, player_b, b.name AS player_b_name, rubber_count, CAST(to_json(rubber_ids) AS VARCHAR) AS rubber_ids, CAST(to_json(source_ids) AS VARCHAR) AS source_ids, CAST(to_json(score_signatures) AS VARCHAR) AS score_signatures
    FROM g JOIN players a ON a.player_id = player_a JOIN players b ON b.player_id = player_b WHERE place <= 25""")
def listed_candidates(d: Domain) -> DataFrame:
    """Groups of rubbers that may be one, those with conflicting scores first, with names, first page and total."""
    page = exact_page(issues.duplicate_candidates(classified(d)), [F.asc("candidate_type"), F.desc("rubber_count"), F.desc("match_day"), F.asc("group_id")], 25)
    for side in ("a", "b"):
        page = page.join(d.players.select(F.col("player_id").alias(f"player_{side}"), F.col("name").alias(f"player_{side}_name")), f"player_{side}")
    lists = {x: F.to_json(x) for x in ("rubber_ids", "source_ids", "score_signatures")}
    return page.drop("has_more").withColumns(lists | {x: F.col(x).cast("bigint") for x in ("place", "total")})


@query("q78_data_health", f"""WITH {CLASSIFIED_SQL} SELECT (SELECT count(*) FROM rubbers) AS stored_rubbers, count(*) AS active_rubbers, count(*) FILTER (WHERE reason IN ('eligible', 'fixture_not_completed')) AS eligible_singles, count(*) FILTER (WHERE reason = 'doubles') AS doubles, count(*) FILTER (WHERE reason = 'non_normal_outcome') AS non_normal_outcome,
    count(*) FILTER (WHERE reason = 'missing_date') AS missing_date, count(*) FILTER (WHERE reason LIKE 'missing_%player%') AS missing_identity, count(*) FILTER (WHERE reason = 'same_canonical_player') AS same_canonical_player, count(*) FILTER (WHERE reason = 'tied_score') AS tied_score FROM classified""")
def data_health(d: Domain) -> DataFrame:
    """One row: rubbers stored and active, and the active ones by whether a rating could use them, whatever their fixture's status."""
    r = F.col("reason")
    c = classified(d).agg(
        F.count("*").alias("active_rubbers"), F.count_if(r.isin("eligible", "fixture_not_completed")).alias("eligible_singles"), F.count_if(r.isin(*issues.MISSING_PLAYERS)).alias("missing_identity"),
        *(F.count_if(r == x).alias(x) for x in ("doubles", "non_normal_outcome", "missing_date", "same_canonical_player", "tied_score")),
    )
    return c.crossJoin(F.broadcast(d.rubbers.agg(F.count("*").alias("stored_rubbers"))))


@query("q78_identity_health", """WITH t AS (SELECT p.*, q.player_id AS target_id, q.deleted AS target_deleted, q.canonical_id AS target_canonical FROM players p LEFT JOIN players q ON q.player_id = p.canonical_id)
    SELECT count(*) AS source_records, count(*) FILTER (WHERE NOT deleted) AS active_records, count(*) FILTER (WHERE NOT deleted AND coalesce(canonical_id, player_id) = player_id) AS canonical_players, count(*) FILTER (WHERE canonical_id <> player_id) AS linked_aliases, count(*) FILTER (WHERE canonical_id <> player_id AND NOT deleted) AS active_aliases,
        count(*) FILTER (WHERE canonical_id <> player_id AND deleted) AS soft_deleted_aliases, count(*) FILTER (WHERE canonical_id IS NULL) AS unassigned_records, count(*) FILTER (WHERE canonical_id IS NOT NULL AND target_id IS NULL) AS broken_targets, count(*) FILTER (WHERE canonical_id <> player_id AND target_canonical <> target_id) AS chained_links, count(*) FILTER (WHERE canonical_id IS NOT NULL AND target_deleted) AS deleted_targets,
        (SELECT count(*) FROM (SELECT 1 FROM players WHERE NOT deleted AND coalesce(canonical_id, player_id) = player_id GROUP BY lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) HAVING count(*) > 1)) AS same_name_candidate_groups, (SELECT count(*) FROM (SELECT 1 FROM players GROUP BY coalesce(canonical_id, player_id) HAVING count(DISTINCT platform_id) > 1)) AS multi_source_players FROM t""")
def identity_health(d: Domain) -> DataFrame:
    """One row: records and aliases by their state, links that lead nowhere, to a deleted record or on to another, names that several players have, players of several sources."""
    p = d.players
    target = p.select(F.col("player_id").alias("canonical_id"), F.lit(True).alias("known"), F.col("deleted").alias("target_deleted"), (F.col("canonical_id") != F.col("player_id")).alias("chained"))
    t = p.join(target, "canonical_id", "left")
    own, alias = "coalesce(canonical_id, player_id) = player_id", "canonical_id <> player_id"
    a = t.agg(
        F.count("*").alias("source_records"), n_if("not deleted").alias("active_records"), n_if(f"not deleted and {own}").alias("canonical_players"), n_if(alias).alias("linked_aliases"), n_if(f"{alias} and not deleted").alias("active_aliases"),
        n_if(f"{alias} and deleted").alias("soft_deleted_aliases"), n_if("canonical_id is null").alias("unassigned_records"), n_if("canonical_id is not null and known is null").alias("broken_targets"), n_if(f"{alias} and chained").alias("chained_links"), n_if("target_deleted").alias("deleted_targets"),
    )
    names = p.where(f"not deleted and {own}").groupBy(plain_name(F.col("name")).alias("k")).agg(F.count("*").alias("n")).agg(n_if("n > 1").alias("same_name_candidate_groups"))
    several = p.groupBy(F.coalesce("canonical_id", "player_id").alias("k")).agg(F.countDistinct("platform_id").alias("n")).agg(n_if("n > 1").alias("multi_source_players"))
    return a.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(several))


def _pairings(d: Domain) -> DataFrame:
    """Each pair of players that met in a rated match, once: a < b."""
    e = classified(d).where("reason = 'eligible'")
    return e.groupBy(F.least("home_player", "away_player").alias("a"), F.greatest("home_player", "away_player").alias("b"))


def _degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("player_id")).groupBy("player_id").agg(F.count("*").alias("unique_opponents"))


@query("q78_network_health", f"""WITH {CLASSIFIED_SQL}, e AS MATERIALIZED (SELECT competition_id, effective_day, home_player AS h, away_player AS a FROM classified WHERE reason = 'eligible'), g AS (SELECT p, count(DISTINCT o) AS n FROM (SELECT h AS p, a AS o FROM e UNION ALL SELECT a, h FROM e) GROUP BY p)
    SELECT (SELECT count(*) FROM e) AS eligible_matches, count(*) AS connected_players, (SELECT count(*) FROM (SELECT DISTINCT least(h, a), greatest(h, a) FROM e)) AS unique_pairings, CAST(round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS DOUBLE) AS average_unique_opponents, max(n) AS maximum_unique_opponents,
        count(*) FILTER (WHERE n = 1) AS one_opponent_players, count(*) FILTER (WHERE n <= 3) AS three_or_fewer_opponent_players, (SELECT count(DISTINCT competition_id) FROM e) AS competitions, (SELECT min(effective_day) FROM e) AS first_match_date, (SELECT max(effective_day) FROM e) AS last_match_date FROM g""")
def network_health(d: Domain) -> DataFrame:
    """One row on the network of rated matches: its size, pairs, and how many have few opponents.  Degrees come from the pairs, and the sums from them, in one chain of groupings."""
    pairs = written(_pairings(d).agg(F.count("*").alias("n"), F.min("effective_day").alias("lo"), F.max("effective_day").alias("hi")))
    whole = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_matches"), F.count("*").alias("unique_pairings"), F.min("lo").alias("first_match_date"), F.max("hi").alias("last_match_date"))
    n = F.col("unique_opponents")
    of = _degrees(pairs).agg(F.count("*").alias("connected_players"), F.round(F.sum(n) / F.count("*"), 6).alias("average_unique_opponents"), F.max(n).alias("maximum_unique_opponents"), F.count_if(n == 1).alias("one_opponent_players"), F.count_if(n <= 3).alias("three_or_fewer_opponent_players"))
    held = classified(d).where("reason = 'eligible'").agg(F.countDistinct("competition_id").alias("competitions"))
    return whole.crossJoin(F.broadcast(of)).crossJoin(F.broadcast(held))


#: What a rating needs to be established, and what is worth a look.
PROVISIONAL_MATCHES, PROVISIONAL_DEVIATION, ODD_OPPONENTS, ODD_DEVIATION, ODD_MATCHES, ODD_ROWS = 10, 110, 3, 110, 10, 20


@query("q78_model_health")
def model_health(d: Domain) -> DataFrame:
    """One row on the rating model: how far the fold went, how many players are rated and how surely."""
    p = written(rating_periods(eligible(d)))
    whole = p.agg(F.max("day").alias("last_processed_date"), F.countDistinct("day").alias("processed_periods"), F.coalesce(F.sum("wins"), F.lit(0)).alias("processed_matches"), F.min("day").alias("first_rated_date"))
    r = latest(p)
    unsure = (F.col("total_matches") < PROVISIONAL_MATCHES) | (F.col("deviation") > PROVISIONAL_DEVIATION)
    return whole.crossJoin(F.broadcast(r.agg(F.count("*").alias("rated_players"), F.count_if(~unsure).alias("established_players"), F.count_if(unsure).alias("provisional_players"), F.coalesce(F.avg("deviation"), F.lit(0.0)).alias("average_deviation"))))


def rating_anomalies(ratings: DataFrame, degrees: DataFrame, players: DataFrame) -> DataFrame:
    """The twenty ratings that rest on least: few opponents, wide deviation, few matches, in that order.  ratings: player_id, rating, deviation, total_matches."""
    r = ratings.join(players.where("not deleted").select("player_id", F.col("name").alias("player_name")), "player_id").join(degrees, "player_id", "left").fillna(0, ["unique_opponents"])
    odd = (F.col("unique_opponents") <= ODD_OPPONENTS) | (F.col("deviation") > ODD_DEVIATION) | (F.col("total_matches") < ODD_MATCHES)
    unsure = (F.col("total_matches") < PROVISIONAL_MATCHES) | (F.col("deviation") > PROVISIONAL_DEVIATION)
    order = [F.asc("unique_opponents"), F.desc("rating_deviation"), F.asc("rated_matches"), F.asc("player_name"), F.asc("player_id")]
    rows = r.where(odd).select("player_id", "player_name", "rating", F.col("deviation").alias("rating_deviation"), F.col("total_matches").cast("bigint").alias("rated_matches"), "unique_opponents", unsure.alias("provisional"))
    return rows.orderBy(*order).limit(ODD_ROWS)


@query("q78_rating_anomalies")
def anomalies(d: Domain) -> DataFrame:
    return rating_anomalies(latest(rating_periods(eligible(d))), _degrees(_pairings(d).agg(F.count("*").alias("n"))), d.players)
