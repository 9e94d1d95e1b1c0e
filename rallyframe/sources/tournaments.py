"""Tournament pages: matches from the sections they stand in, and what was turned away, with its reason.

A page nests sections: a draw, within it rounds, within those matches with two sides.  The parser's
stack tells of each match which draw and round it is in; a match may also name both itself.

Defined cases: a match without a draw is no match and is passed over; byes, cancelled matches, sides
without the same number of players (one or two each), games that no game can end with and matches without a winner are turned away
with a reason; a match without any score has a winner by its mark alone (win_loss_only); without an id of
its own a match is known by a hash of all that tells it from others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import outcome_of, valid_game
from .cards import last_part
from .pages import Mark, elements
from .staging import written

#: Tags, class names and links of the pages.
MARKS = {
    "draw": Mark("section", "draw"), "round": Mark("section", "round"), "match": Mark(cls="match--list"), "side": Mark(cls="match__row"),
    "draw_link": Mark("a", href="/draw/"), "round_name": Mark(cls="round__name"), "player": Mark("a", href="/player/"), "points": Mark(cls="points__cell"),
    "info": Mark("a", href="/match-info/"), "time": Mark("time"),
}
MATCH = ["page_id", "match_id", "draw_id", "draw_name", "round_name", "played_at", "is_doubles", "home_players", "away_players", "home_games", "away_games", "winner", "outcome", "score_source"]


def _nearest(e: DataFrame, mark: str, value, name: str) -> DataFrame:
    """page_id, match, name: the value of the match's own element of a mark, else of its round's, else of its draw's; the first of several."""
    some = e.where(F.col("mark") == mark).select("page_id", "at", value.alias("v"), *(F.col("inside").getItem(i).alias(i) for i in ("match", "round", "draw")))
    matches = e.where("mark = 'match'").select("page_id", F.col("at").alias("m"), F.col("inside").getItem("round").alias("r"), F.col("inside").getItem("draw").alias("d"))
    own = some.where("match is not null").groupBy("page_id", F.col("match").alias("m")).agg(F.min_by("v", "at").alias("own"))
    of_round = some.where("match is null and round is not null").groupBy("page_id", F.col("round").alias("r")).agg(F.min_by("v", "at").alias("of_round"))
    of_draw = some.where("match is null and round is null and draw is not null").groupBy("page_id", F.col("draw").alias("d")).agg(F.min_by("v", "at").alias("of_draw"))
    out = matches.join(own, ["page_id", "m"], "left").join(of_round, ["page_id", "r"], "left").join(of_draw, ["page_id", "d"], "left")
    return out.select("page_id", F.col("m").alias("match"), F.coalesce("own", "of_round", "of_draw").alias(name))


def tournament_matches(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_id, html -> (MATCH, a row a match; page_id, at, reason, text: matches turned away)."""
    e = written(elements(pages, MARKS), "mark")
    inside = lambda k: F.col("inside").getItem(k).alias(k)
    listed = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("at", v.alias("v")))), lambda s: s["v"])
    players = e.where("mark = 'player'").groupBy("page_id", inside("side")).agg(listed(last_part(F.col("href"))).alias("ids"))
    points = e.where("mark = 'points'").groupBy("page_id", inside("side")).agg(listed(F.expr("try_cast(text as int)")).alias("points"))
    side = e.where("mark = 'side'").select("page_id", F.col("at").alias("side"), inside("match"), F.array_contains(F.split("classes", r"\s+"), "has-won").alias("won"))
    side = side.where("match is not null").join(players, ["page_id", "side"], "left").join(points, ["page_id", "side"], "left").withColumn("no", F.row_number().over(Window.partitionBy("page_id", "match").orderBy("side")))
    none, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    of = lambda n: F.max(F.when(F.col("no") == n, F.struct(F.coalesce("ids", none).alias("ids"), F.coalesce("points", numbers).alias("points"), "won"))).alias("home" if n == 1 else "away")
    sides = side.groupBy("page_id", "match").agg(F.max("no").alias("sides"), of(1), of(2))
    m = e.where("mark = 'match'").select("page_id", F.col("at").alias("match"), "text").join(sides, ["page_id", "match"], "left")
    for mark, value, name in (("draw_link", F.struct(last_part(F.col("href")).alias("id"), F.col("text").alias("name")), "drawn"), ("round_name", F.col("text"), "round_name"), ("info", last_part(F.col("href")), "info"), ("time", F.col("stamp"), "played_at")):
        m = m.join(_nearest(e, mark, value, name), ["page_id", "match"], "left")
    m = m.where("drawn is not null and drawn.id <> '' and drawn.name <> ''").withColumn("outcome", outcome_of(F.col("text")))
    games = F.filter(F.arrays_zip(F.col("home.points").alias("a"), F.col("away.points").alias("b")), lambda g: g["a"].isNotNull() & g["b"].isNotNull())
    m = m.withColumn("games", F.coalesce(games, F.array().cast("array<struct<a:int,b:int>>")))
    won = lambda up: F.size(F.filter("games", lambda g: (g["a"] > g["b"]) if up else (g["b"] > g["a"])))
    m = m.withColumns({"h": won(True), "a": won(False), "hp": F.coalesce("home.ids", none), "ap": F.coalesce("away.ids", none)})
    by_mark = F.when(F.col("home.won") & ~F.col("away.won"), "home").when(F.col("away.won") & ~F.col("home.won"), "away")
    m = m.withColumn("winner", F.when(F.col("h") > F.col("a"), "home").when(F.col("a") > F.col("h"), "away").otherwise(by_mark))
    scored = F.size("games") > 0
    played = F.col("outcome") == "normal"
    reason = (
        F.when(F.col("outcome").isin("bye", "cancelled"), F.col("outcome"))
        .when(played & ~scored & ((F.size("hp") == 0) | (F.size("ap") == 0)), "bye")
        .when((F.size("hp") != F.size("ap")) | ~F.size("hp").isin(1, 2) | (F.coalesce("sides", F.lit(0)) != 2), "missing-player")
        .when(played & (~scored | F.exists("games", lambda g: ~valid_game(g["a"], g["b"]))), "invalid-score")
        .when(F.col("winner").isNull(), "missing-winner")
    )
    m = written(m.withColumn("reason", reason))
    known = F.coalesce("info", F.sha2(F.to_json(F.struct("page_id", "drawn.id", "round_name", "played_at", "hp", "ap"), {"ignoreNullFields": "false"}), 256))
    n = lambda side, c: F.when(scored, F.col(c)).otherwise((F.col("winner") == side).cast("int")).alias(f"{side}_games")
    kept = m.where("reason is null").select("page_id", known.alias("match_id"), F.col("drawn.id").alias("draw_id"), F.col("drawn.name").alias("draw_name"), "round_name", "played_at", (F.size("hp") == 2).alias("is_doubles"), F.col("hp").alias("home_players"), F.col("ap").alias("away_players"), n("home", "h"), n("away", "a"), "winner", "outcome", F.when(scored, "games").otherwise("win_loss_only").alias("score_source"))
    return kept.select(*MATCH), m.where("reason is not null").select("page_id", F.col("match").alias("at"), "reason", "text")
