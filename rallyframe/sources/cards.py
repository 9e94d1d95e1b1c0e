"""Match cards: rubbers from the three layouts of a card, and what is wrong with a card.

Layouts: a grid (away players above, home players on the left, a cell for each pairing, doubles in
a row of their own), a score card (players by letter on either side, results by pairing of
letters), and a plain table.  A card of several layouts is read by the first that has results.

A rubber's games are counted from its game scores up to the third game of a side; without
any game score it is no rubber in the grid and the score card, and has the rubbers' own score in the
table.  A player is known by the last part of the link to them.  A side without a player makes a
walkover in score cards and doubles, and in singles of grids and tables where its cell says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import Mark, elements
from .staging import written

#: Links, words, tags and class names of the pages.
PLAYER = "/results/player/statistics/"
FORFEIT = "(?i)forfeit"
MARKS = {
    "grid": Mark(cls="rowX"), "grid_cell": Mark("div", parent="grid"), "block": Mark("div", parent="grid_cell"), "pair_score": Mark(cls="doublesSet"), "game_score": Mark(cls="gameScore"),
    "side": Mark(cls="col-lg-6"), "named": Mark(cls="cell-space"), "label": Mark("strong"), "result": Mark(cls="results"), "schedule": Mark(cls="schedule"), "game": Mark(cls="game"),
    "body": Mark("tbody"), "row": Mark("tr"), "cell": Mark("td"), "final": Mark("td", "result"), "player": Mark("a", href=PLAYER),
}
RUBBER = ["page_id", "number", "is_doubles", "home_players", "away_players", "home_games", "away_games", "outcome"]


def game_counts(text: Column) -> Column:
    """"11-9 9-11 ..." -> struct of home, away (games won, up to a side's third) and games (scores read)."""
    a, b = (F.regexp_extract_all(text, F.lit(p), 1) for p in (r"(\d+)\s*-\s*\d+", r"\d+\s*-\s*(\d+)"))
    none = F.struct(F.lit(0).alias("home"), F.lit(0).alias("away"), F.lit(0).alias("games"))

    def add(acc: Column, g: Column) -> Column:
        x, y = (g[k].try_cast("decimal(38,0)") for k in ("a", "b"))
        new = F.struct((acc["home"] + F.coalesce((x > y).cast("int"), F.lit(0))).alias("home"), (acc["away"] + F.coalesce((x < y).cast("int"), F.lit(0))).alias("away"), (acc["games"] + 1).alias("games"))
        return F.when((acc["home"] >= 3) | (acc["away"] >= 3), acc).otherwise(new)

    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), none, add)


def last_part(href: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(href, r"/+$", ""), "/"), -1)


def _within(e: DataFrame, mark: str, holder: str, name: str, value: Column) -> DataFrame:
    """page_id, `holder` (place), `name`: the values of the marked elements in each holder, in their order."""
    some = e.where((F.col("mark") == mark) & F.col("inside").getItem(holder).isNotNull())
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", value.alias("v")))), lambda s: s["v"])
    return some.groupBy("page_id", F.col("inside").getItem(holder).alias(holder)).agg(listed.alias(name))


def _marked(e: DataFrame, mark: str, *inside: str) -> DataFrame:
    """The elements of a mark: page_id, `mark` (place), text, classes and the places of what they stand in."""
    return e.where(F.col("mark") == mark).select("page_id", F.col("at").alias(mark), "text", "classes", *(F.col("inside").getItem(i).alias(i) for i in inside))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _numbered(rubbers: DataFrame, layout: int, *order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).cast("int")
    return rubbers.select(F.lit(layout).alias("layout"), *(number.alias(c) if c == "number" else c for c in RUBBER))


def _outcome(walkover: Column) -> Column:
    return F.when(walkover, "walkover").otherwise("normal").alias("outcome")


def _grid_rubbers(e: DataFrame) -> DataFrame:
    in_order = lambda *by: Window.partitionBy("page_id", *by)
    rows = _marked(e, "grid").withColumn("no", F.row_number().over(in_order().orderBy("grid")))
    scored = _marked(e, "pair_score", "grid").select("page_id", "grid", F.lit(True).alias("scored")).distinct()
    rows = rows.join(scored, ["page_id", "grid"], "left").select("page_id", "grid", "no", (F.coalesce("scored", F.lit(False)) | F.array_contains(F.split("classes", r"\s+"), "row5")).alias("pairs"))
    players = _within(e, "player", "grid_cell", "ids", last_part(F.col("href")))
    games = _within(e, "game_score", "grid_cell", "scores", F.col("text"))
    cells = _marked(e, "grid_cell", "grid").join(players, ["page_id", "grid_cell"], "left").join(games, ["page_id", "grid_cell"], "left").join(rows, ["page_id", "grid"])
    is_set = F.array_contains(F.split("classes", r"\s+"), "set")
    cells = cells.withColumns({
        "col": F.row_number().over(in_order("grid").orderBy("grid_cell")) - 1,
        "slot": F.when(is_set, F.count_if(is_set).over(in_order("grid").orderBy("grid_cell"))),
        "forfeit": (F.size(_empty("ids")) == 0) & F.col("text").rlike(FORFEIT),
        "g": game_counts(F.array_join(F.coalesce("scores", F.array().cast("array<string>")), " ")),
    })
    away = cells.where("no = 1 and col > 0").select("page_id", F.col("col").cast("long").alias("slot"), _empty("ids").alias("away_players"), F.col("forfeit").alias("away_forfeit"))
    home = cells.where("no > 1 and not pairs and col = 0").select("page_id", "grid", _empty("ids").alias("home_players"), F.col("forfeit").alias("home_forfeit"))
    singles = cells.where("no > 1 and not pairs and slot is not null and g.games > 0").select("page_id", "grid", "slot", "g").join(away, ["page_id", "slot"]).join(home, ["page_id", "grid"])
    singles = singles.select("page_id", "grid", "slot", F.lit(False).alias("is_doubles"), "home_players", "away_players", F.col("g.home").alias("home_games"), F.col("g.away").alias("away_games"), _outcome(F.col("home_forfeit") | F.col("away_forfeit")))
    first_cell = cells.where("pairs and no > 1 and col = 0").select("page_id", "grid", "grid_cell")
    blocks = _marked(e, "block", "grid_cell").join(_within(e, "player", "block", "ids", last_part(F.col("href"))), ["page_id", "block"], "left")
    blocks = blocks.join(first_cell, ["page_id", "grid_cell"]).withColumn("b", F.row_number().over(in_order("grid").orderBy("block")))
    pick = lambda n: F.coalesce(F.max(F.when(F.col("b") == n, F.col("ids"))), F.array().cast("array<string>"))
    sides = blocks.groupBy("page_id", "grid").agg(pick(1).alias("home_players"), pick(2).alias("away_players"))
    one_score = _marked(e, "pair_score", "grid").groupBy("page_id", "grid").agg(F.min("pair_score").alias("pair_score"))
    pair_games = one_score.join(_within(e, "game_score", "pair_score", "scores", F.col("text")), ["page_id", "pair_score"]).withColumn("g", game_counts(F.array_join("scores", " "))).where("g.games > 0")
    pairs = pair_games.join(rows.where("pairs and no > 1"), ["page_id", "grid"]).join(sides, ["page_id", "grid"], "left")
    pairs = pairs.select("page_id", "grid", F.lit(0).cast("long").alias("slot"), F.lit(True).alias("is_doubles"), _empty("home_players").alias("home_players"), _empty("away_players").alias("away_players"), F.col("g.home").alias("home_games"), F.col("g.away").alias("away_games"))
    pairs = pairs.withColumn("outcome", _outcome((F.size("home_players") == 0) | (F.size("away_players") == 0)))
    return _numbered(singles.unionByName(pairs), 1, "grid", "slot")


def _card_rubbers(e: DataFrame) -> DataFrame:
    sides = _marked(e, "side").withColumn("no", F.row_number().over(Window.partitionBy("page_id").orderBy("side")))
    last = F.max("no").over(Window.partitionBy("page_id"))
    sides = sides.withColumn("last", last).where("no = 1 or no = last").select("page_id", "side", F.when(F.col("no") == 1, "home").otherwise("away").alias("who"))
    label = e.where("mark = 'label'").groupBy("page_id", F.col("inside").getItem("named").alias("named")).agg(F.min_by("text", "at").alias("label"))
    named = _marked(e, "named", "side").join(label, ["page_id", "named"], "left").join(_within(e, "player", "named", "ids", last_part(F.col("href"))), ["page_id", "named"]).join(sides, ["page_id", "side"])
    pair_row = F.array_contains(F.split("classes", r"\s+"), "doubles")
    letter = F.when(pair_row, "DBLS").otherwise(F.upper(F.trim(F.regexp_replace("label", "Player ", ""))))
    skipped = ~pair_row & F.coalesce(F.lower("label").rlike("^(doubles|final score)"), F.lit(False))
    known = named.where(~skipped).groupBy("page_id", "who", letter.alias("letter")).agg(F.max_by("ids", "named").alias("ids"))
    result = _marked(e, "result").join(e.where("mark = 'schedule'").groupBy("page_id", F.col("inside").getItem("result").alias("result")).agg(F.min_by("text", "at").alias("schedule")), ["page_id", "result"])
    result = result.join(_within(e, "game", "result", "scores", F.col("text")), ["page_id", "result"]).withColumn("g", game_counts(F.array_join("scores", " "))).where("g.games > 0")
    form = r"(?i)^([A-Z])\s+v\s+([A-Z])$"
    pairs = F.col("schedule").rlike("(?i)^dbls$")
    of = lambda k: F.when(pairs, "DBLS").otherwise(F.upper(F.regexp_extract("schedule", form, k)))
    out = result.where(pairs | F.col("schedule").rlike(form)).select("page_id", "result", pairs.alias("is_doubles"), of(1).alias("h"), of(2).alias("a"), F.col("g.home").alias("home_games"), F.col("g.away").alias("away_games"))
    side = lambda who, k: known.where(F.col("who") == who).select("page_id", F.col("letter").alias(k), F.col("ids").alias(f"{who}_players"))
    out = out.join(side("home", "h"), ["page_id", "h"], "left").join(side("away", "a"), ["page_id", "a"], "left").withColumns({"home_players": _empty("home_players"), "away_players": _empty("away_players")})
    out = out.withColumn("outcome", _outcome((F.size("home_players") == 0) | (F.size("away_players") == 0)))
    return _numbered(out, 2, "result")


def _table_rubbers(e: DataFrame) -> DataFrame:
    cells = _marked(e, "cell", "row", "body").where("body is not null").join(_within(e, "player", "cell", "ids", last_part(F.col("href"))), ["page_id", "cell"], "left")
    cells = cells.withColumn("col", F.row_number().over(Window.partitionBy("page_id", "row").orderBy("cell")) - 1)
    at = lambda n: F.max(F.when(F.col("col") == n, F.struct(F.col("text").alias("text"), _empty("ids").alias("ids")))).alias(f"c{n}")
    rows = cells.groupBy("page_id", "row").agg(F.count("*").alias("n"), *(at(i) for i in range(4))).where("n >= 4 and not contains(c0.text, 'Submitted By')").withColumn("g", game_counts(F.col("c2.text")))
    score = lambda n: F.coalesce(F.expr(f"try_cast(trim(get(split(c3.text, '-'), {n})) as int)"), F.lit(0))
    won = lambda side, n: F.when(F.col("g.games") > 0, F.col(f"g.{side}")).otherwise(score(n)).alias(f"{side}_games")
    gone = lambda c: (F.size(f"{c}.ids") == 0) & F.col(f"{c}.text").rlike(FORFEIT)
    out = rows.select("page_id", "row", ((F.size("c0.ids") > 1) | (F.size("c1.ids") > 1)).alias("is_doubles"), F.col("c0.ids").alias("home_players"), F.col("c1.ids").alias("away_players"), won("home", 0), won("away", 1), _outcome(gone("c0") | gone("c1")))
    return _numbered(out, 3, "row")


def match_cards(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_id, html -> (RUBBER, a row for each rubber; page_id, home_rubbers, away_rubbers: the card's final score, where it has one)."""
    e = written(elements(pages, MARKS), "mark")
    every = _grid_rubbers(e).unionByName(_card_rubbers(e)).unionByName(_table_rubbers(e))
    first = F.min("layout").over(Window.partitionBy("page_id"))
    rubbers = every.withColumn("first", first).where("layout = first").select(*RUBBER)
    form = r"^(\d+)\s*-\s*(\d+)$"
    final = e.where((F.col("mark") == "final") & F.col("text").rlike(form)).groupBy("page_id").agg(F.min_by("text", "at").alias("t"))
    return rubbers, final.select("page_id", *(F.regexp_extract("t", form, k).cast("int").alias(f"{s}_rubbers") for k, s in ((1, "home"), (2, "away"))))


#: What a card must not be: name -> condition over the card's summary.
RULES = {
    "impossible_score": "most_games > 3",
    "final_score_differs": "home_rubbers is not null and (home_won <> home_rubbers or away_won <> away_rubbers)",
    "walkovers_alone": "rubbers > 0 and walkovers = rubbers",
    "same_player_twice": "both_sides > 0",
}


def card_violations(rubbers: DataFrame, finals: DataFrame) -> DataFrame:
    """page_id, rubbers, home_won, away_won, violations: every rule of RULES that a card breaks, in one grouping of its rubbers."""
    won = lambda a, b: F.count_if(F.col(f"{a}_games") > F.col(f"{b}_games"))
    card = rubbers.groupBy("page_id").agg(F.count("*").alias("rubbers"), won("home", "away").alias("home_won"), won("away", "home").alias("away_won"), F.max(F.greatest("home_games", "away_games")).alias("most_games"), F.count_if(F.col("outcome") == "walkover").alias("walkovers"), F.count_if(F.arrays_overlap("home_players", "away_players")).alias("both_sides"))
    card = card.join(finals, "page_id", "full").fillna(0, ["rubbers", "home_won", "away_won", "most_games", "walkovers", "both_sides"])
    named = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items())))
    return card.select("page_id", "rubbers", "home_won", "away_won", named.alias("violations"))
