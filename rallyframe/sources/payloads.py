"""Payload parsing: JSON bundles with a schema, HTML tables by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUNDLE = "standings array<struct<team_id: string, team: string, position: int, played: int, points: int>>, matches array<struct<id: string, date: string, home: string, away: string, sets: array<struct<home_player: string, away_player: string, home_games: int, away_games: int>>>>"


def league_bundle(payloads: DataFrame) -> dict[str, DataFrame]:
    """(payload_id, payload JSON) -> teams, fixtures and rubbers, each row once; payloads that don't parse in `rejected`."""
    p = payloads.withColumn("b", F.from_json("payload", BUNDLE))
    bad = F.col("b").isNull() | (F.col("b.standings").isNull() & F.col("b.matches").isNull())
    m = p.where(~bad).select("payload_id", F.explode("b.matches").alias("m"))
    sets = m.select(F.col("m.id").alias("fixture_id"), F.posexplode("m.sets").alias("position", "s"))
    return {
        "teams": p.where(~bad).select(F.inline("b.standings")).dropDuplicates(["team_id"]),
        "fixtures": m.select(F.col("m.id").alias("fixture_id"), F.to_date("m.date").alias("date_played"), F.col("m.home").alias("home"), F.col("m.away").alias("away"), F.when(F.size("m.sets") > 0, "completed").otherwise("upcoming").alias("status")).dropDuplicates(["fixture_id"]),
        "rubbers": sets.select(F.concat_ws("-", "fixture_id", F.col("position").cast("string")).alias("rubber_id"), "fixture_id", "s.*").dropDuplicates(["rubber_id"]),
        "rejected": p.where(bad).select("payload_id"),
    }


class _Tables(HTMLParser):
    """Cells of every table row, as text."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, list[str]]] = []
        self.table, self.cell = -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self.rows.append((self.table, []))
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1][1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> page_id, table (from 0), row (from 0), cells: every row of every table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                p = _Tables()
                p.feed(html or "")
                out += [(page_id, t, i, cells) for i, (t, cells) in enumerate(p.rows) if cells]
            yield pd.DataFrame(out, columns=["page_id", "table", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table int, row int, cells array<string>")


def standings_rows(pages: DataFrame) -> DataFrame:
    """Rows of seven cells or more that begin with a position: page_id, place, team, played, won, drawn, lost, points; the first row of each team."""
    number = lambda i: F.expr(f"try_cast(cells[{i}] as int)")
    r = table_rows(pages).where((F.size("cells") >= 7) & number(0).isNotNull())
    named = r.select("page_id", "row", number(0).alias("place"), F.col("cells")[1].alias("team"), *(number(i).alias(n) for i, n in ((2, "played"), (3, "won"), (4, "drawn"), (5, "lost"), (6, "points"))))
    first = named.groupBy("page_id", "team").agg(F.min_by(F.struct(*(c for c in named.columns if c not in ("page_id", "team", "row"))), "row").alias("r"))
    return first.select("page_id", "team", "r.*")
