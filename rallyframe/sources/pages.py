"""Raw pages as tables: marked elements with what they stand in, and table cells on their full grid.

The standard library's parser runs over each page once, as a stream of tags with a stack of open
elements; it only says what stands where.  What that means (rubbers, draws, standings) is
said by joins and groupings over these tables, in `cards` and `tournaments`.

Defined cases: a null page has no elements; tags that are never closed end with the element around
them, end tags without a beginning are passed over; white space of any kind and length is one space;
class names are told apart by whole words, links by a part of them in any case; rows of
pages that share an id are pages of their own only if a caller makes their ids differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Open elements that a tag ends by beginning.
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",), "option": ("option",)}
ELEMENTS = "mark string, at int, text string, href string, classes string, stamp string, inside map<string,int>"
BATCH_ROWS = 10_000
CELLS = "`table` int, `row` int, `col` int, text string, href string, header boolean, spans boolean"


@dataclass(frozen=True)
class Mark:
    """Elements by tag, a class of theirs, a part of their link, and the mark of the element that they are children of."""

    tag: str | None = None
    cls: str | None = None
    href: str | None = None
    parent: str | None = None


def _text(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Stack(HTMLParser):
    """Open elements as a stack; `opened` may give what is to be kept of one, `closed` gets it back."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, object]] = []

    def opened(self, tag: str, attrs: dict[str, str]) -> object:
        raise NotImplementedError

    def closed(self, kept: object) -> None:
        raise NotImplementedError

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ())
        around = [t for t, _ in self.open] if ends else []
        for other in ends:
            if other in around and around[::-1].index(other) < (around[::-1].index("table") if "table" in around else len(around)):
                self.handle_endtag(other)
                around = [t for t, _ in self.open]
        kept = self.opened(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.closed(kept)
        else:
            self.open.append((tag, kept))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            self.closed(self.open.pop()[1])
        elif any(t == tag for t, _ in self.open):
            while True:
                t, kept = self.open.pop()
                self.closed(kept)
                if t == tag:
                    break

    def whole(self, html: str) -> None:
        self.feed(html)
        self.close()
        while self.open:
            self.closed(self.open.pop()[1])


class _Marked(_Stack):
    def __init__(self, marks: dict[str, Mark]) -> None:
        super().__init__()
        self.marks, self.at, self.out = marks, 0, []
        self.around: dict[str, list[int]] = {m: [] for m in marks}

    def opened(self, tag, attrs):
        self.at += 1
        classes, href = attrs.get("class", ""), attrs.get("href", "")
        above = self.open[-1][1]["names"] if self.open else ()
        words, link = classes.split(), href.lower()
        names = [n for n, m in self.marks.items() if (not m.tag or m.tag == tag) and (not m.cls or m.cls in words) and (not m.href or m.href.lower() in link) and (not m.parent or m.parent in above)]
        inside = [(n, s[-1]) for n, s in self.around.items() if s] if names else []
        for n in names:
            self.around[n].append(self.at)
        return {"names": names, "at": self.at, "href": href or None, "classes": classes, "stamp": attrs.get("datetime") or None, "inside": inside, "text": []}

    def closed(self, kept):
        for n in kept["names"]:
            self.around[n].pop()
            self.out.append((n, kept["at"], _text(kept["text"]), kept["href"], kept["classes"], kept["stamp"], kept["inside"]))

    def handle_data(self, data):
        for _, kept in self.open:
            if kept["names"]:
                kept["text"].append(data)


class _Grid(_Stack):
    """Cells at every place of the grid that they span, tables within tables apart."""

    def __init__(self) -> None:
        super().__init__()
        self.tables, self.now, self.out = 0, [], []

    def opened(self, tag, attrs):
        if tag == "table":
            self.now.append({"no": self.tables, "row": -1, "col": 0, "taken": set()})
            self.tables += 1
            return self.now[-1]
        if not self.now:
            return None
        table = self.now[-1]
        if tag == "tr":
            table["row"] += 1
            table["col"] = 0
        if tag in ("td", "th") and table["row"] >= 0:
            while (table["row"], table["col"]) in table["taken"]:
                table["col"] += 1
            size = [min(1000, int(v)) if (v := attrs.get(k, "")).isascii() and v.isdigit() and int(v) else 1 for k in ("rowspan", "colspan")]
            places = [(table["row"] + r, table["col"] + c) for r in range(size[0]) for c in range(size[1])]
            table["taken"].update(places)
            table["col"] += size[1]
            return {"table": table["no"], "places": places, "header": tag == "th", "text": [], "href": None}
        if tag == "a":
            for _, kept in reversed(self.open):
                if kept and "places" in kept:
                    kept["href"] = kept["href"] or attrs.get("href")
                    break
        return None

    def closed(self, kept):
        if kept and "taken" in kept:
            self.now.remove(kept)
        elif kept:
            text = _text(kept["text"])
            self.out += [(kept["table"], r, c, text, kept["href"], kept["header"], len(kept["places"]) > 1) for r, c in kept["places"]]

    def handle_data(self, data):
        for _, kept in reversed(self.open):
            if kept and "places" in kept:
                kept["text"].append(data)
                break


def _over(pages: DataFrame, make: Callable[[], _Stack], schema: str) -> DataFrame:
    """The rows that a fresh parser gives for each page, behind the page's id, in batches of BATCH_ROWS over pages."""
    whole = f"page_id {pages.schema['page_id'].dataType.simpleString()}, {schema}"

    arrow = to_arrow_schema(StructType.fromDDL(whole))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for page, html in zip(batch["page_id"].to_pylist(), batch["html"]):
                p = make()
                p.whole(html.as_py() or "")
                rows += [(page, *row) for row in p.out]
                while len(rows) >= BATCH_ROWS:
                    yield batch_of(rows[:BATCH_ROWS])
                    rows = rows[BATCH_ROWS:]
        if rows:
            yield batch_of(rows)

    return pages.select("page_id", "html").mapInArrow(run, whole)


def elements(pages: DataFrame, marks: dict[str, Mark]) -> DataFrame:
    """page_id, html -> a row for each mark of each element: at (its place in the page), text, href, classes, stamp, inside (mark -> place of the nearest element around it)."""
    return _over(pages, lambda: _Marked(marks), ELEMENTS)


def grid_cells(pages: DataFrame) -> DataFrame:
    """page_id, html -> every place of every table's grid, with the cell that covers it."""
    return _over(pages, _Grid, CELLS)
