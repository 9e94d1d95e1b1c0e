"""Raw pages: elements, grids, match cards, tournaments, results, status, pages of lists, evidence."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from rallyframe.functions.text import dated_event, outcome_of, player_cell
from rallyframe.operators.events import event_results, lifecycle
from rallyframe.operators.paging import exact_page, fast_page
from rallyframe.plans import pages as plans
from rallyframe.sources.adapter import Domain
from rallyframe.sources.cards import card_violations, game_counts, match_cards
from rallyframe.sources.pages import Mark, elements, grid_cells
from rallyframe.sources.tournaments import tournament_matches
from rallyframe.streaming.evidence import evidence, evidence_stream


def pages_of(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")


def player(n):
    return f'<a href="/X/Results/Player/Statistics/S/Some_One/{n}/">Some One</a>'


def test_elements_know_what_they_stand_in(spark):
    html = '<div class="a b"><p>one<br>two &amp; <b>three</b></p><div class=a>in&nbsp; ner</div></i><a HREF="/Q/player/7">L</a>'
    e = elements(pages_of(spark, html, None, ""), {"a": Mark(cls="a"), "b": Mark("b"), "child": Mark("div", parent="a"), "link": Mark("a", href="/PLAYER/")})
    got = {(r["page_id"], r["mark"], r["text"], r["href"]): r["inside"] for r in e.collect()}
    outer = next(r["at"] for r in e.collect() if r["mark"] == "a" and "one" in r["text"])
    assert got[(0, "b", "three", None)] == {"a": outer}
    assert got[(0, "child", "in ner", None)]["a"] == outer and got[(0, "a", "in ner", None)]["a"] == outer
    assert got[(0, "link", "L", "/Q/player/7")] == {"a": outer}
    assert got[(0, "a", "onetwo & three in nerL".replace(" in", "in"), None)] == {}
    assert len(got) == 5


def test_grids_are_whole(spark):
    html = """<table><tr><th colspan=2>both<th rowspan="2">tall</tr><tr><td>x<td><table><tr><td>deep</table>y</tr>
        <tr><td rowspan=0 colspan="many"><a href="/1">z</a></table>"""
    got = {(r["table"], r["row"], r["col"]): (r["text"], r["header"], r["spans"]) for r in grid_cells(pages_of(spark, html)).collect()}
    assert got == {
        (0, 0, 0): ("both", True, True), (0, 0, 1): ("both", True, True), (0, 0, 2): ("tall", True, True), (0, 1, 2): ("tall", True, True),
        (0, 1, 0): ("x", False, False), (0, 1, 1): ("y", False, False), (0, 2, 0): ("z", False, False), (1, 0, 0): ("deep", False, False),
    }


def test_games_are_counted_to_the_third(spark):
    cases = {"11-9 9-11 11-7 11-8": (3, 1, 4), "11 - 9, 11-2 11-3 11-4": (3, 0, 3), "": (0, 0, 0), "4-4": (0, 0, 1), "no": (0, 0, 0), None: None, "007-1": (1, 0, 1)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", game_counts(F.col("t")).alias("g"))
    assert {r["t"]: r["g"] and tuple(r["g"]) for r in df.collect()} == cases


def test_the_three_layouts(spark):
    scores = lambda *s: "".join(f'<span class="gameScore">{x}</span> ' for x in s)
    grid = f"""<div id="CardResults"><div class="table-row rowX"><div>Home</div><div>{player(11)}</div><div>Forfeit</div></div>
        <div class="table-row rowX"><div>{player(1)}</div><div class="set">{scores("11-3", "11-4", "11-5")}</div><div class="set">{scores("11-0")}</div></div>
        <div class="table-row rowX"><div>{player(2)}</div><div class="set">{scores("3-11", "11-9", "4-11", "5-11")}</div><div class="set"></div></div>
        <div class="table-row rowX row5"><div><div>{player(1)}{player(2)}</div><div></div></div><div class="doublesSet">{scores("11-1", "11-1", "11-1")}</div></div></div>
        <table><tr><td class="big result"> 3 - 1 </td></tr></table>"""
    game = lambda *s: '<div class="setResult">' + "".join(f'<i class="game">{x}</i>' for x in s) + "</div>"
    named = lambda label, *p: f'<div class="row cell-border cell-space{" doubles" if label == "Doubles" else ""}"><strong>{label}</strong>{"".join(map(player, p))}</div>'
    card = f"""<div class="fixtureDetails"><div class="col-lg-6">{named("Player A", 1)}{named("Player B")}{named("Doubles", 1, 2)}</div><div class="col-lg-6">{named("Player X", 8)}{named("Player y", 9)}{named("Doubles", 8, 9)}{named("Final Score", 77)}</div></div>
        <div class="resultCard"><div class="results"><b class="schedule">A v X</b>{game("11-4", "11-5", "9-11", "11-1")}</div><div class="results"><b class="schedule">b v Y</b>{game("1-11", "2-11", "3-11")}</div>
        <div class="results"><b class="schedule">Dbls</b>{game("12-10")}</div><div class="results"><b class="schedule">A v X</b>{game("later")}</div><div class="results"><b class="schedule">friendly</b>{game("11-1")}</div></div>"""
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    table = f"<table><tbody>{row(player(1), player(5), '11-3 11-4 11-5', '9-9')}{row(player(1) + player(2), player(5), '', '4 - 0')}{row('Forfeit', player(5), '', '0-3')}{row('Submitted By: me', '', '', '')}{row('short', 'row')}</tbody></table>"
    rubbers, finals = match_cards(pages_of(spark, grid, card, table, "<p>nothing</p>", None))
    got = [tuple(r) for r in rubbers.orderBy("page_id", "number").collect()]
    assert got == [
        (0, 1, False, ["1"], ["11"], 3, 0, "normal"), (0, 2, False, ["1"], [], 1, 0, "walkover"), (0, 3, False, ["2"], ["11"], 1, 3, "normal"), (0, 4, True, ["1", "2"], [], 3, 0, "walkover"),
        (1, 1, False, ["1"], ["8"], 3, 1, "normal"), (1, 2, False, [], ["9"], 0, 3, "walkover"), (1, 3, True, ["1", "2"], ["8", "9"], 1, 0, "normal"),
        (2, 1, False, ["1"], ["5"], 3, 0, "normal"), (2, 2, True, ["1", "2"], ["5"], 4, 0, "normal"), (2, 3, False, [], ["5"], 0, 3, "walkover"),
    ]
    assert [tuple(r) for r in finals.collect()] == [(0, 3, 1)]
    assert {r["page_id"]: r["violations"] for r in card_violations(rubbers, finals).collect()} == {0: [], 1: [], 2: ["impossible_score"]}


def test_every_violation_is_named(spark):
    schema = "page_id long, home_players array<string>, away_players array<string>, home_games int, away_games int, outcome string"
    rubbers = spark.createDataFrame([(1, ["a"], ["a", "b"], 4, 0, "walkover"), (2, ["a"], ["b"], 3, 0, "normal")], schema)
    finals = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 2, 2)], "page_id long, home_rubbers int, away_rubbers int")
    got = {r["page_id"]: r["violations"] for r in card_violations(rubbers, finals).collect()}
    assert got == {1: ["impossible_score", "final_score_differs", "walkovers_alone", "same_player_twice"], 2: [], 3: ["final_score_differs"]}


def test_tournament_pages(spark):
    def match(home, away, points=(), won=None, text="", more=""):
        side = lambda ids, k: f'<div class="match__row{" has-won" if won == k else ""}">' + "".join(f'<a href="/t/player/{i}">P</a>' for i in ids) + "".join(f'<li class="points__cell">{p[k]}</li>' for p in points) + "</div>"
        return f'<div class="match match--list">{text}{side(home, 0)}{side(away, 1)}{more}</div>'

    link = '<a href="/t/draw/5">Singles</a>'
    html = f"""<section class="draw">{link}<section class="round"><b class="round__name">Final</b>
        {match([1], [2], [(11, 5), (9, 11), (12, 10)], more='<a href="/t/match-info/77">i</a><time datetime="2024-05-01T10:00"></time>')}
        {match([1, 3], [2, 4], [(5, 11), (5, 11)])}{match([1], [2], won=1, text="Walkover")}{match([1], [2], [(11, 4)], text="retired")}</section>
        {match([1], [], text="Bye")}{match([1], [])}{match([1], [2], text="cancelled")}{match([1, 2], [3], [(11, 1)])}{match([1], [2], [(11, 10)])}{match([1], [2])}{match([1], [2], [(11, 5), (5, 11)])}
        {match([8], [9], [(11, 2)], more='<b class="round__name">Own</b>')}</section>{match([1], [2], [(11, 5)])}"""
    kept, away = tournament_matches(pages_of(spark, html, "", None))
    got = sorted(((r["draw_id"], r["draw_name"], r["round_name"], r["is_doubles"], r["home_games"], r["away_games"], r["winner"], r["outcome"], r["score_source"]) for r in kept.collect()), key=str)
    assert got == sorted([
        ("5", "Singles", "Final", False, 2, 1, "home", "normal", "games"), ("5", "Singles", "Final", True, 0, 2, "away", "normal", "games"), ("5", "Singles", "Final", False, 0, 1, "away", "walkover", "win_loss_only"),
        ("5", "Singles", "Final", False, 1, 0, "home", "retired", "games"), ("5", "Singles", "Own", False, 1, 0, "home", "normal", "games"),
    ], key=str)
    ids = [r["match_id"] for r in kept.collect()]
    # two matches of the same players in one round without an id of their own are one match told twice
    assert "77" in ids and len(set(ids)) == 4 and kept.where("match_id = '77'").first()["played_at"] == "2024-05-01T10:00"
    assert [r["reason"] for r in away.orderBy("at").collect()] == ["bye", "bye", "cancelled", "missing-player", "invalid-score", "invalid-score", "missing-winner"]


def test_cells_names_and_outcomes(spark):
    one = spark.range(1)
    cell = lambda s: tuple(one.select(player_cell(F.lit(s)).alias("c")).first()["c"])
    assert cell("Mens  Singles - Ann  Lee (123) - WINNER") == ("Mens Singles", "Ann Lee", "123", True)
    assert cell("Ann Lee winner ") == (None, "Ann Lee", None, True) and cell("U13 - Bo (7)") == ("U13", "Bo", "7", False)
    event = lambda s: tuple(one.select(dated_event(F.lit(s)).alias("e")).first()["e"])
    assert event("Big Cup - 2024-05-06: Open") == ("Big Cup", date(2024, 5, 6), "Open") and event("Cup - 2024-05-06") == ("Cup", date(2024, 5, 6), None)
    assert event(" Just  a name ") == ("Just a name", None, None) and event("Cup - 2024-15-06: A")[1] is None
    said = {"a bye": "bye", "goodbye": "normal", "CANCELED": "cancelled", "w.o.": "walkover", "rtd": "retired", "not played": "void", None: "normal", "3-0": "normal"}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", outcome_of(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in got.collect()} == said


def test_results_and_quarantine_add_up(spark):
    rows = [
        (1, 9, "Cup - 2024-05-06: Open", "A - X (1) - WINNER", "A - Y (2)", "final", "2024-05-07 10:00"), (2, 9, "Cup - 2024-05-06: Open", "X (1)", "Z z WINNER", None, None), (3, 9, "Cup - 2024-05-06: Open", "X (1)", "Y (2) - WINNER", "unset", "soon"),
        (4, 9, "Cup", "X - WINNER", "Y - WINNER", "final", None), (5, 9, "Cup", "X", "Y", "final", None), (None, 9, "Cup", "X WINNER", "Y", "final", None), (1, 10, "Cup", "Q WINNER", "Y", "final", None), (6, 9, "Cup", "X WINNER", None, "final", None),
    ]
    df = spark.createDataFrame(rows, "row_id long, event_id long, event_name string, home string, away string, round string, played_at string")
    out = event_results(df)
    assert out["rubbers"].count() + out["quarantined"].count() == len(rows)
    assert sorted((r["row_id"] or 0, r["reason"]) for r in out["quarantined"].collect()) == [(0, "no id"), (1, "repeated id"), (4, "two winners"), (5, "no winner"), (6, "no player")]
    assert {(r["fixture_id"], r["round_order"], r["date_played"]) for r in out["fixtures"].collect()} == {("event:9:round:final", 90, date(2024, 5, 7)), ("event:9:round:unknown", None, date(2024, 5, 6)), ("event:9:round:group", 10, date(2024, 5, 6))}
    assert {(r["row_id"], r["home_player"], r["away_player"], r["home_games"], r["away_games"]) for r in out["rubbers"].collect()} == {(1, "1", "2", 1, 0), (2, "1", "z z", 0, 1), (3, "1", "2", 0, 1)}
    assert all(x.count() == 0 for x in event_results(df.limit(0)).values())


def test_status_goes_forward_only(spark):
    d = lambda m, day: date(2024, m, day)
    snap = lambda e, on, starts, ends=None, deadline=None, results=None, published=None: (e, on, published, starts, ends, deadline, results)
    rows = [
        snap(1, d(1, 1), d(3, 1), d(3, 2), d(2, 1)), snap(1, d(2, 10), d(3, 1), d(3, 2), d(2, 1)), snap(1, d(3, 1), d(3, 1), d(3, 2)), snap(1, d(3, 3), d(3, 1), d(3, 2)), snap(1, d(3, 9), d(3, 1), d(3, 2), None, d(3, 8)),
        snap(1, d(4, 1), d(6, 1), d(6, 2), d(5, 1)), snap(1, d(4, 2), d(6, 1), None, None, None, "cancelled"),
        snap(2, d(1, 1), d(3, 1)), snap(2, d(1, 2), d(3, 1), None, None, None, "postponed"), snap(2, d(1, 3), d(3, 1)), snap(2, d(3, 1), d(3, 1)), snap(2, d(3, 2), d(5, 1), None, d(4, 1)),
    ]
    df = spark.createDataFrame(rows, "event_id int, as_of date, published string, starts date, ends date, deadline date, results_on date")
    got = [r["status"] for r in lifecycle(df).orderBy("event_id", "as_of").collect()]
    assert got == ["entries_open", "entries_closed", "in_progress", "awaiting_results", "completed", "completed", "completed", "upcoming", "postponed", "upcoming", "in_progress", "in_progress"]


def test_pages_of_a_list(spark):
    rows = spark.range(0, 95).selectExpr("id", "id % 7 as k").repartition(6)
    order = [F.desc("k"), F.asc("id")]
    want = sorted(((i % 7, i) for i in range(95)), key=lambda x: (-x[0], x[1]))
    for limit, offset in ((10, 0), (10, 30), (10, 90), (95, 0), (10, 95), (10, 200)):
        expect = [i for _, i in want[offset : offset + limit]]
        fast = fast_page(rows, order, limit, offset).orderBy("place").collect()
        exact = exact_page(rows, order, limit, offset).orderBy("place").collect()
        assert [r["id"] for r in fast] == [r["id"] for r in exact] == expect
        assert all(r["has_more"] == (offset + limit < 95) for r in fast + exact) and all(r["total"] == 95 for r in exact)
    plan = fast_page(rows, order, 10, 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=41" in plan and "Aggregate" not in plan


def test_evidence_is_kept_once(spark, tmp_path):
    schema = "scope string, fingerprint string, payload string, scraped_at timestamp, http_status int"
    at = lambda h: datetime(2024, 1, 1, h)
    batches = [[("s", "f", "one", at(1), 200), ("s", "f", "one", at(2), 304), ("s", "g", None, at(1), 200)], [("s", "f", "one", at(5), 500), ("s", "f", "two", at(5), 200)], [("s", "f", "one", at(3), 200), (None, "f", "one", at(6), 200)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        evidence_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
        if i == 1:  # the batch comes again, as after a crash before its commit
            (tmp_path / "c/commits/1").unlink()
            (tmp_path / "c/commits/.1.crc").unlink(missing_ok=True)
    rows = {(r["scope"], r["fingerprint"], r["payload"]): (r["first_at"], r["last_at"], r["http_status"]) for r in evidence(spark, f"{tmp_path}/t").collect()}
    assert rows == {("s", "f", "one"): (at(1), at(5), 500), ("s", "g", ""): (at(1), at(1), 200), ("s", "f", "two"): (at(5), at(5), 200), ("", "f", "one"): (at(6), at(6), 200)}


def test_long_rounds_are_listed_over_several_pages(spark, monkeypatch):
    """No page grows with the matches of a round, and all matches stand on some page."""
    monkeypatch.setattr(plans, "PAGE_MATCHES", 1)
    d = Domain(spark, "/root/testdata/sf0.001")
    html = [(r["page_id"], r["html"]) for r in plans.tournament_pages(d).collect()]
    singles = d.matches.where("not is_doubles")
    assert sum(h.count("match--list") for _, h in html) == singles.count()
    assert len({p for p, _ in html}) == len(html)
    assert max(h.count("match--list") for _, h in html) < singles.groupBy("competition_id").count().agg(F.max("count")).first()[0]
    assert {int(p.split("/")[0]) for p, _ in html} == {r[0] for r in singles.select("competition_id").distinct().collect()}


def test_cells_are_read_by_plain_searches_first_as_by_patterns_alone(spark):
    draw = random.Random(3)
    parts = ["A", "b-", "-", " - ", " ", "  ", "(1)", "(", ")", "(x2)", "12", "WINNER", " - Winner", "\t", "\n", "\u2028", "\u0085", "\r", "é", "\u212a", "winn", "(07) "]
    texts = {"".join(draw.choice(parts) for _ in range(draw.randrange(7))) for _ in range(20_000)} | {"Open - Ann (1) - WINNER", "A - B - C (3)"}
    df = spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "t string")
    won, c = r"(?i)(\s*-\s*)?WINNER\s*$", F.col("t")
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), won, ""))
    category = F.nullif(F.regexp_extract(text, r"^([^-]+?)\s+-\s+.+$", 1), F.lit(""))
    named = F.when(category.isNotNull(), F.regexp_extract(text, r"^[^-]+?\s+-\s+(.+)$", 1)).otherwise(text)
    by_patterns = F.struct(category.alias("category"), F.trim(F.regexp_replace(named, r"\s*\(\d+\)\s*$", "")).alias("name"), F.nullif(F.regexp_extract(named, r"\((\d+)\)\s*$", 1), F.lit("")).alias("id"), c.rlike(won).alias("won"))
    read = df.select("t", player_cell(c).alias("c"))
    rows = read.join(df.select("t", by_patterns.alias("want")), "t").collect()
    assert len(rows) == len(texts) and not [(r["t"], r["c"], r["want"]) for r in rows if r["c"] != r["want"]][:3]
    assert tuple(read.where("t is null").first()["c"]) == (None, None, None, None)
