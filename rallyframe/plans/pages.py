"""Queries over raw pages: cards, draws and results are written as pages from the match domain, and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.events import event_results, lifecycle
from ..operators.paging import exact_page, fast_page
from ..sources.adapter import Domain
from ..sources.cards import card_violations, match_cards
from ..sources.pages import grid_cells
from ..sources.staging import new_folder, written
from ..sources.tournaments import tournament_matches
from ..streaming.evidence import evidence, keep_batch
from .catalog import query


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _link(player: Column) -> Column:
    return F.when(player.isNotNull(), _cat('<a href="/League/Results/Player/Statistics/S/N/', player.cast("string"), '">P', player.cast("string"), "</a>")).otherwise("")


def _side(side: str) -> Column:
    links = _cat(_link(F.col(f"{side}_1")), _link(F.col(f"{side}_2")))
    return F.when(links == "", "Forfeit").otherwise(links)


def _games(tag: str) -> Column:
    """The scores of the rubber's games, those of the side that won fewer first, each in an element."""
    of = lambda score, n: F.repeat(F.lit(f'<div class="{tag}">{score}</div> '), F.col(n).cast("int"))
    home, away = of("11 - 5", "home_games"), of("7-11", "away_games")
    return F.when(F.col("home_games") >= F.col("away_games"), F.concat(away, home)).otherwise(F.concat(home, away))


def card_pages(d: Domain) -> DataFrame:
    """page_id (the fixture), html: fixtures by turns as a grid, a score card and a table; every seventh final score is wrong."""
    m = d.matches.select("fixture_id", "rubber_id", "home_1", "home_2", "away_1", "away_2", "home_games", "away_games")
    no = F.row_number().over(Window.partitionBy("fixture_id").orderBy("rubber_id"))
    letter = F.chr(64 + F.col("no"))
    pair = F.col("home_2").isNotNull()
    m = m.withColumn("no", no).select(
        "fixture_id", "no", "home_games", "away_games",
        F.when(~pair, _cat("<div>", _side("away"), "</div>")).otherwise("<div></div>").alias("slot"),
        F.when(pair, _cat('<div class="table-row rowX row5"><div><div>', _side("home"), "</div><div>", _side("away"), '</div></div><div class="doublesSet">', _games("gameScore"), "</div></div>")).otherwise(_cat('<div class="table-row rowX"><div>', _side("home"), "</div>", F.repeat(F.lit('<div class="set"></div>'), F.col("no") - 1), '<div class="set">', _games("gameScore"), "</div></div>")).alias("grid"),
        *(_cat('<div class="row cell-border cell-space">', "<strong>Player ", letter, "</strong>", _side(s), "</div>").alias(f"{s}_named") for s in ("home", "away")),
        _cat('<div class="results"><span class="schedule">', letter, " v ", letter, '</span><div class="setResult">', _games("game"), "</div></div>").alias("result"),
        _cat("<tr><td>", _side("home"), "<td>", _side("away"), "</td><td>", _games("x"), "</td><td>", F.col("home_games").cast("string"), "-", F.col("away_games").cast("string"), "</td></tr>").alias("row"),
    )
    rows = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", c))), lambda s: s[c]), "")
    wins = lambda a, b: F.count_if(F.col(f"{a}_games") > F.col(f"{b}_games"))
    card = m.groupBy("fixture_id").agg(*(rows(c).alias(c) for c in ("slot", "grid", "home_named", "away_named", "result", "row")), wins("home", "away").alias("h"), wins("away", "home").alias("a"))
    wrong = (F.col("fixture_id") % 7 == 3).cast("int")
    final = _cat('<table><tr><td class="score result"> ', (F.col("h") + wrong).cast("string"), " - ", F.col("a").cast("string"), "</td></tr></table>")
    body = (
        F.when(F.col("fixture_id") % 3 == 0, _cat('<div id="CardResults"><div class="table-row rowX"><div>Home</div>', F.col("slot"), "</div>", F.col("grid"), "</div>"))
        .when(F.col("fixture_id") % 3 == 1, _cat('<div class="fixtureDetails"><div class="col-lg-6">', F.col("home_named"), '</div><div class="col-lg-6">', F.col("away_named"), '</div></div><div class="resultCard">', F.col("result"), "</div>"))
        .otherwise(_cat("<table><tbody>", F.col("row"), '<tr><td colspan="4">Submitted By: x</td></tr></tbody></table>'))
    )
    return card.select(F.col("fixture_id").alias("page_id"), _cat("<!doctype html><html><body>", body, final, "</body></html>").alias("html"))


def _ids_sql(side: str) -> str:
    return f"concat_ws(',', CAST({side}_1 AS VARCHAR), CAST({side}_2 AS VARCHAR))"


CARDS_SQL = f"""c0 AS (
        SELECT fixture_id, rubber_id, {_ids_sql('home')} AS hp, {_ids_sql('away')} AS ap, home_games AS hg, away_games AS ag, fixture_id % 3 AS layout, home_2 IS NOT NULL AS pair FROM matches
    ), c1 AS (
        SELECT *, hp = '' OR ap = '' AS gone, CASE WHEN hg = 3 AND ag = 3 THEN 0 ELSE hg END AS h, ag AS a,
            CASE layout WHEN 0 THEN pair WHEN 1 THEN FALSE ELSE contains(hp, ',') OR contains(ap, ',') END AS is_doubles
        FROM c0 WHERE layout = 2 OR hg + ag > 0
    ), cards AS (
        SELECT fixture_id AS page_id, CAST(row_number() OVER (PARTITION BY fixture_id ORDER BY rubber_id) AS INTEGER) AS number, is_doubles, hp AS home_players, ap AS away_players,
            CAST(h AS INTEGER) AS home_games, CAST(a AS INTEGER) AS away_games, CASE WHEN gone THEN 'walkover' ELSE 'normal' END AS outcome
        FROM c1
    )"""


@query("s08_match_cards", f"WITH {CARDS_SQL} SELECT * FROM cards")
def cards(d: Domain) -> DataFrame:
    """Every rubber of every fixture's card."""
    rubbers, _ = match_cards(card_pages(d))
    return rubbers.withColumns({c: F.array_join(c, ",") for c in ("home_players", "away_players")})


@query("u19_card_violations", f"""WITH {CARDS_SQL}, f AS (SELECT fixture_id AS page_id, count(*) FILTER (WHERE hg > ag) + CASE WHEN fixture_id % 7 = 3 THEN 1 ELSE 0 END AS fh, count(*) FILTER (WHERE ag > hg) AS fa FROM c0 GROUP BY fixture_id),
    k AS (SELECT page_id, count(*) AS rubbers, count(*) FILTER (WHERE home_games > away_games) AS home_won, count(*) FILTER (WHERE away_games > home_games) AS away_won, count(*) FILTER (WHERE outcome = 'walkover') AS walkovers,
        count(*) FILTER (WHERE list_has_any(string_split(home_players, ','), string_split(away_players, ',')) AND home_players <> '' AND away_players <> '') AS both_sides FROM cards GROUP BY page_id)
    SELECT page_id, coalesce(rubbers, 0) AS rubbers, coalesce(home_won, 0) AS home_won, coalesce(away_won, 0) AS away_won,
        concat_ws(',', CASE WHEN coalesce(home_won, 0) <> fh OR coalesce(away_won, 0) <> fa THEN 'final_score_differs' END, CASE WHEN rubbers > 0 AND walkovers = rubbers THEN 'walkovers_alone' END, CASE WHEN both_sides > 0 THEN 'same_player_twice' END) AS violations
    FROM f LEFT JOIN k USING (page_id)""")
def violations(d: Domain) -> DataFrame:
    """Every card with the rules that it breaks."""
    return card_violations(*match_cards(card_pages(d))).withColumn("violations", F.array_join("violations", ","))


@query("s08_page_grids", """WITH p AS (SELECT home_team AS team, competition_id, count(*) AS played FROM fixtures WHERE NOT deleted GROUP BY home_team, competition_id), r AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY played DESC, team) AS place FROM p)
    SELECT competition_id AS page_id, CAST(place AS INTEGER) AS "row", 'D' || CAST(competition_id % 10 AS VARCHAR) AS division, 'T' || CAST(team AS VARCHAR) AS team, CAST(played AS VARCHAR) AS played FROM r""")
def page_grids(d: Domain) -> DataFrame:
    """Standings pages whose first column is one cell over all rows, read through the full grid: columns by their header."""
    played = d.fixtures.where("not deleted").groupBy("competition_id", F.col("home_team").alias("team")).agg(F.count("*").alias("played"))
    w = Window.partitionBy("competition_id").orderBy(F.desc("played"), "team")
    r = played.withColumn("place", F.row_number().over(w))
    size = F.count("*").over(Window.partitionBy("competition_id"))
    row = _cat("<tr>", F.when(F.col("place") == 1, _cat('<td rowspan="', F.col("size").cast("string"), '">D', (F.col("competition_id") % 10).cast("string"), "</td>")).otherwise(""), "<td>T", F.col("team").cast("string"), "<td>", F.col("played").cast("string"), "</td></tr>")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "html"))), lambda s: s["html"]), "")
    pages = r.withColumn("size", size).withColumn("html", row).groupBy(F.col("competition_id").alias("page_id")).agg(rows.alias("rows"))
    cells = grid_cells(pages.select("page_id", _cat('<table><tr><th>division<th>team</th><th colspan="1">played</th></tr>', F.col("rows"), "</table>").alias("html")))
    return by_header(cells, ["division", "team", "played"])


def by_header(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Grid cells -> page_id, row, columns: the text under each header of the table's first row, for the rows below it."""
    heads = cells.where("`row` = 0").select("page_id", "table", "col", F.lower("text").alias("head"))
    named = cells.where("`row` > 0").join(heads, ["page_id", "table", "col"])
    return named.groupBy("page_id", "table", "row").agg(*(F.max(F.when(F.col("head") == c, F.col("text"))).alias(c) for c in columns)).drop("table")


#: Matches of a round on one page, about: longer rounds are listed over several pages.
PAGE_MATCHES = 200


def tournament_pages(d: Domain) -> DataFrame:
    """page_id (a competition and the page's number), html: its singles by division as draws and by month as rounds, with games to 11; some rows are no matches."""
    m = d.matches.where("not is_doubles").select("rubber_id", "competition_id", "division", F.date_format("updated_on", "yyyy-MM").alias("month"), "home_1", "away_1", F.col("home_games").cast("int").alias("h"), F.col("away_games").cast("int").alias("a"), "outcome", F.date_format("updated_on", "yyyy-MM-dd").alias("on"))
    m = written(m)
    of_round = ["competition_id", "division", "month"]
    long = m.groupBy(*of_round).agg(F.ceil(F.count("*") / PAGE_MATCHES).alias("pages"))
    m = m.join(long, of_round).withColumn("page", F.pmod(F.xxhash64("rubber_id"), F.col("pages")))
    cell = lambda n: f'<li class="points__cell">{n}</li>'
    points = lambda own, opp: _cat(F.repeat(F.lit(cell(11)), F.col(own)), F.repeat(F.lit(cell(6)), F.col(opp)))
    # points of games that the other side won come second on both sides, so that games are told apart by place
    home = points("h", "a")
    away = _cat(F.repeat(F.lit(cell(6)), F.col("h")), F.repeat(F.lit(cell(11)), F.col("a")))
    name = lambda p: F.when(p.isNotNull(), _cat('<a href="/x/player/', p.cast("string"), '">P</a>')).otherwise("")
    side = lambda p, pts, won: _cat('<div class="match__row', F.when(won, " has-won").otherwise(""), '">', name(F.col(p)), "<ul>", pts, "</ul></div>")
    said = F.when(F.col("outcome") == "walkover", "Walkover").when(F.col("outcome") == "retired", "retired").when(F.col("rubber_id") % 31 == 0, "cancelled").otherwise("")
    row = _cat('<div class="match match--list">', "<span>", said, "</span>", side("home_1", home, F.col("h") > F.col("a")), side("away_1", away, F.col("a") > F.col("h")), F.when(F.col("rubber_id") % 2 == 0, _cat('<a href="/match-info/', F.col("rubber_id").cast("string"), '">i</a>')).otherwise(""), '<time datetime="', F.col("on"), '"></time></div>')
    joined = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda s: s[c]), "")
    rounds = m.withColumn("row", row).groupBy(*of_round, "page").agg(joined("row", "rubber_id").alias("rows"))
    rounds = rounds.withColumn("html", _cat('<section class="round"><h4 class="round__name">', F.col("month"), "</h4>", F.col("rows"), "</section>"))
    pages = rounds.groupBy("competition_id", "division", "page").agg(joined("html", "month").alias("rounds"))
    return pages.select(_cat(F.col("competition_id").cast("string"), "/", F.col("page").cast("string")).alias("page_id"), _cat('<main><section class="draw"><a href="/draw/', F.col("division").cast("string"), '">Draw ', F.col("division").cast("string"), "</a>", F.col("rounds"), "</section></main>").alias("html"))


TOURNAMENT_SQL = """t0 AS (
        SELECT rubber_id, competition_id AS page_id, division, strftime(updated_on, '%Y-%m') AS round_name, home_1 AS hp, away_1 AS ap, home_games AS h, away_games AS a,
            CASE WHEN outcome IN ('walkover', 'retired') THEN outcome WHEN rubber_id % 31 = 0 THEN 'cancelled' ELSE 'normal' END AS outcome
        FROM matches WHERE NOT is_doubles
    ), t AS (
        SELECT *, CASE WHEN outcome = 'cancelled' THEN 'cancelled' WHEN outcome = 'normal' AND h + a = 0 AND (hp IS NULL OR ap IS NULL) THEN 'bye' WHEN hp IS NULL AND ap IS NULL OR (hp IS NULL) <> (ap IS NULL) THEN 'missing-player'
            WHEN outcome = 'normal' AND h + a = 0 THEN 'invalid-score' WHEN h = a THEN 'missing-winner' END AS reason
        FROM t0
    )"""


def _competition() -> Column:
    return F.substring_index("page_id", "/", 1).cast("bigint").alias("page_id")


@query("s09_tournament_matches", f"WITH {TOURNAMENT_SQL} SELECT page_id, CAST(division AS VARCHAR) AS draw_id, round_name, CAST(hp AS VARCHAR) AS home_player, CAST(ap AS VARCHAR) AS away_player, outcome, CASE WHEN h > a THEN 'home' ELSE 'away' END AS winner, CASE WHEN h + a > 0 THEN 'games' ELSE 'win_loss_only' END AS score_source, count(*) AS matches, CAST(sum(h) AS BIGINT) AS home_games, CAST(sum(a) AS BIGINT) AS away_games, count(CASE WHEN rubber_id % 2 = 0 THEN 1 END) AS with_id FROM t WHERE reason IS NULL GROUP BY ALL")
def tournaments(d: Domain) -> DataFrame:
    """The matches of all tournament pages by draw, round, players and result."""
    m, _ = tournament_matches(tournament_pages(d))
    by = [_competition(), "draw_id", "round_name", F.col("home_players")[0].alias("home_player"), F.col("away_players")[0].alias("away_player"), "outcome", "winner", "score_source"]
    return m.groupBy(*by).agg(F.count("*").alias("matches"), F.sum("home_games").alias("home_games"), F.sum("away_games").alias("away_games"), F.count_if(F.length("match_id") < 64).alias("with_id"))


@query("s09_turned_away", f"WITH {TOURNAMENT_SQL} SELECT page_id, reason, count(*) AS matches FROM t WHERE reason IS NOT NULL GROUP BY ALL")
def turned_away(d: Domain) -> DataFrame:
    """What tournament pages hold that is no match, by reason."""
    return tournament_matches(tournament_pages(d))[1].groupBy(_competition(), "reason").agg(F.count("*").alias("matches"))


RESULTS_SQL = """r AS (
        SELECT rubber_id AS row_id, league_id * 10000 + year(updated_on) AS event_id, updated_on, home_1 AS h, away_1 AS a, home_games > away_games OR rubber_id % 57 = 0 AS hw, away_games > home_games OR rubber_id % 57 = 0 AS aw,
            CASE rubber_id % 5 WHEN 0 THEN 'final' WHEN 1 THEN 'semi_final' WHEN 2 THEN 'quarter_final' WHEN 3 THEN 'group' END AS round_name
        FROM matches WHERE home_1 IS NOT NULL AND away_1 IS NOT NULL
    ), good AS (SELECT * FROM r WHERE hw <> aw)"""


def result_rows(d: Domain) -> DataFrame:
    """Result rows as a source lists them, from singles and doubles alike: cells with category, name, number and mark of the winner."""
    cell = lambda p, won: _cat("Open - Player ", F.col(p).cast("string"), " (", F.col(p).cast("string"), ")", F.when(won, " - WINNER").otherwise(""))
    both = F.col("rubber_id") % 57 == 0
    r5 = F.col("rubber_id") % 5
    m = d.matches.where("home_1 is not null and away_1 is not null")
    return m.select(
        F.col("rubber_id").alias("row_id"), (F.col("league_id") * 10_000 + F.year("updated_on")).alias("event_id"), _cat("Cup - ", F.date_format("updated_on", "yyyy-MM-dd"), ": Open").alias("event_name"),
        cell("home_1", (F.col("home_games") > F.col("away_games")) | both).alias("home"), cell("away_1", (F.col("away_games") > F.col("home_games")) | both).alias("away"),
        F.when(r5 == 0, "final").when(r5 == 1, "semi_final").when(r5 == 2, " quarter_final ").when(r5 == 3, "unset").alias("round"),
        F.when(F.col("rubber_id") % 3 > 0, F.date_format("updated_on", "yyyy-MM-dd HH:mm")).alias("played_at"),
    )


@query("s12_event_rubbers", f"WITH {RESULTS_SQL} SELECT row_id, 'event:' || event_id || ':round:' || coalesce(round_name, 'unknown') AS fixture_id, CAST(h AS VARCHAR) AS home_player, CAST(a AS VARCHAR) AS away_player, CAST(hw AS INTEGER) AS home_games, CAST(aw AS INTEGER) AS away_games, 'win_loss_only' AS score_source, CASE WHEN row_id % 3 > 0 THEN updated_on END AS played_on FROM good")
def event_rubbers(d: Domain) -> DataFrame:
    return event_results(result_rows(d))["rubbers"]


@query("s12_event_fixtures", f"WITH {RESULTS_SQL} SELECT 'event:' || event_id || ':round:' || coalesce(round_name, 'unknown') AS fixture_id, event_id, round_name, CAST(CASE round_name WHEN 'group' THEN 10 WHEN 'quarter_final' THEN 70 WHEN 'semi_final' THEN 80 WHEN 'final' THEN 90 END AS INTEGER) AS round_order, min_by(updated_on, row_id) AS date_played, count(*) AS rubbers FROM good GROUP BY event_id, round_name")
def event_fixtures(d: Domain) -> DataFrame:
    """One fixture for each event and round."""
    return event_results(result_rows(d))["fixtures"]


@query("s12_quarantined", f"WITH {RESULTS_SQL} SELECT row_id, event_id, CASE WHEN hw THEN 'two winners' ELSE 'no winner' END AS reason FROM r WHERE hw = aw")
def quarantined(d: Domain) -> DataFrame:
    return event_results(result_rows(d))["quarantined"]


@query("u15_event_status", """WITH e AS (SELECT competition_id AS event_id, min(date_played) AS starts, max(date_played) AS ends, max(created_on) AS results_on, competition_id % 19 = 0 AS off FROM fixtures WHERE date_played IS NOT NULL AND NOT deleted GROUP BY competition_id),
    s AS (SELECT DISTINCT date_trunc('month', date_played)::DATE AS as_of FROM fixtures WHERE date_played IS NOT NULL AND NOT deleted),
    x AS (SELECT e.*, as_of, CASE WHEN off AND month(as_of) = 6 THEN 'postponed' WHEN month(as_of) <> 9 AND results_on <= as_of THEN 'completed' WHEN as_of > ends THEN 'awaiting_results' WHEN as_of >= starts THEN 'in_progress' WHEN as_of <= starts - 14 THEN 'entries_open' ELSE 'entries_closed' END AS status FROM e JOIN s ON as_of BETWEEN starts - 90 AND ends + 400),
    p AS (SELECT *, list_position(['upcoming', 'entries_open', 'entries_closed', 'in_progress', 'awaiting_results', 'completed'], status) AS place FROM x),
    f AS (SELECT *, max(coalesce(place, 0)) OVER (PARTITION BY event_id ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS far FROM p)
    SELECT event_id, as_of, CASE WHEN far < 6 AND status = 'postponed' THEN status ELSE ['upcoming', 'entries_open', 'entries_closed', 'in_progress', 'awaiting_results', 'completed'][CAST(greatest(far, 1) AS BIGINT)] END AS status FROM f""")
def event_status(d: Domain) -> DataFrame:
    """Competitions as events, their status in each monthly snapshot; in September results are unknown, and some are postponed in June."""
    f = d.fixtures.where("date_played is not null and not deleted")
    e = f.groupBy(F.col("competition_id").alias("event_id")).agg(F.min("date_played").alias("starts"), F.max("date_played").alias("ends"), F.max("created_on").alias("results_on"))
    months = f.select(F.to_date(F.date_trunc("month", "date_played")).alias("as_of")).distinct()
    x = e.join(F.broadcast(months), F.col("as_of").between(F.date_sub("starts", 90), F.date_add("ends", 400)))  # months: a row a month of the calendar
    x = x.withColumns({"deadline": F.date_sub("starts", 14), "published": F.when((F.col("event_id") % 19 == 0) & (F.month("as_of") == 6), "postponed"), "results_on": F.when(F.month("as_of") != 9, F.col("results_on"))})
    return lifecycle(x)


EVENTS_SQL = "ev AS (SELECT fixture_id, competition_id, date_played, status FROM fixtures WHERE NOT deleted AND date_played IS NOT NULL AND status = 'completed')"


def _completed(d: Domain) -> tuple[DataFrame, list[Column]]:
    rows = d.fixtures.where("not deleted and date_played is not null and status = 'completed'").select("fixture_id", "competition_id", "date_played", "status")
    return rows, [F.desc("date_played"), F.asc("fixture_id")]


@query("t05_fast_page", f"WITH {EVENTS_SQL} SELECT fixture_id, competition_id, date_played, status, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM ev) > 90 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY date_played DESC, fixture_id) - 60 AS place FROM ev) WHERE place BETWEEN 1 AND 30")
def fast_events(d: Domain) -> DataFrame:
    """The third page of completed fixtures, without a total."""
    rows, order = _completed(d)
    return fast_page(rows, order, 30, 60)


@query("t05_exact_page", f"WITH {EVENTS_SQL} SELECT fixture_id, competition_id, date_played, status, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM ev) AS total, (SELECT count(*) FROM ev) > 90 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY date_played DESC, fixture_id) - 60 AS place FROM ev) WHERE place BETWEEN 1 AND 30")
def exact_events(d: Domain) -> DataFrame:
    """The same page with the total."""
    rows, order = _completed(d)
    return exact_page(rows, order, 30, 60)


@query("s06_evidence", """WITH l AS (SELECT 'platform:' || platform_id AS scope, md5(CAST(resource_id AS VARCHAR)) AS fingerprint, sha256(kind) AS sha256, kind AS payload, seen_at, CAST(event_id % 3 AS INTEGER) * 100 + 200 AS http_status FROM log)
    SELECT scope, fingerprint, sha256, payload, min(seen_at) AS first_at, max(seen_at) AS last_at, max(http_status) FILTER (WHERE seen_at = top) AS http_status FROM (SELECT *, max(seen_at) OVER (PARTITION BY scope, fingerprint, sha256) AS top FROM l) GROUP BY ALL""")
def evidence_rows(d: Domain) -> DataFrame:
    """Payloads of the scrape log as kept by the sink, in three batches in order of time, the second of which comes twice."""
    e = d.events.select(F.concat(F.lit("platform:"), "platform_id").alias("scope"), F.md5(F.col("resource_id").cast("string")).alias("fingerprint"), F.col("kind").alias("payload"), F.col("seen_at").cast("timestamp").alias("scraped_at"), ((F.col("event_id") % 3).cast("int") * 100 + 200).alias("http_status"))
    at = F.unix_micros("scraped_at")
    third = e.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    dealt = written(e.crossJoin(F.broadcast(third)).withColumn("batch", F.least(F.lit(2), F.floor((at - F.col("low")) * 3 / (F.col("high") - F.col("low") + 1)))).drop("low", "high"))
    target = new_folder(d.spark, "evidence")
    for batch in (0, 1, 1, 2):
        keep_batch(dealt.where(F.col("batch") == batch).drop("batch"), batch, target)
    return evidence(d.spark, target).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})
