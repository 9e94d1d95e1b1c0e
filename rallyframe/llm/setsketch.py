"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles, as 64-bit hashes.  Each of
REGISTERS registers holds the smallest of one exponential variate a member, as
floor(1 - log_b) of it: exponentially spaced, truncated, mergeable by maximum,
and equal in two sketches with a chance that grows with the sets' similarity.
Bands of ROWS registers give keys; sets that share a key are candidates.  A
candidate pair's similarity is first estimated by maximum likelihood from how
many registers are equal, larger and smaller together with both set sizes, and
what may reach the threshold is verified on full sets.

With 42 bands of 6, a pair at similarity 0.8 is missed with a chance of 3e-6, one
at 0.9 with 3e-14, and an unrelated pair meets with a chance of about 1e-6.

Links, not pairs, are kept whole.  Equal sets are one node from the start.  In
each bucket all members are first verified against one leader, the member with
the most company over all its buckets, so that large groups collapse to stars.
Members of one bucket that are then still in different components, such as texts
that share a long passage, are not paired off one by one: two sets at the
threshold must share one of their rarest members, early enough in both to leave
room for all that they must have in common, so only those that do are verified.  So every link between members of a bucket is verified or within a
component already.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole sequence as the one
member; rows with one doc_id are one node, with the links of any of its texts;
rows with a null doc_id take no part and are kept, with a null component; an
empty table gives an empty result; other columns are passed over (`near_copies`)
or kept (`drop_near_copies`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, rows_of, rows_without, staged
from .components import components

BASE, RATE, TOP = 1.02, 20.0, 2**16 - 2
BANDS, ROWS = 42, 6
REGISTERS = 256
#: How far below the threshold an estimate may lie: five standard errors at 256 registers.
MARGIN = 0.13
#: Bytes of text hashed at once.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20))
_SPACE = bytes(c in (9, 10, 11, 12, 13, 32) for c in range(256))
_MULTIPLY = _rng.integers(0, 2**32, REGISTERS, np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, REGISTERS, np.uint32)
_P = 0x9FB21C651E98DF25
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i modulo 2 ** 64 for i < n at least."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for p in (_P, pow(_P, -1, 2**64)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[size] = tuple(out)
    return _powers[size]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, in order."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):  # cut at white space; a longer word is one piece
            spaces = [i for i in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
            end = min(spaces, default=len(data))
        piece = data[at:end].translate(LOWER_BYTES)
        b = np.frombuffer(piece, np.uint8)
        at = end
        gap = np.frombuffer(b"\x01" + piece.translate(_SPACE) + b"\x01", np.uint8)
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = _power_tables(len(b))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)], dtype=np.uint64)])
            out.append(_mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, len(words) if len(words) < width else 0, np.uint64)
    for i in range(min(width, len(words))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def least_hashes(members: np.ndarray) -> np.ndarray:
    """For each register the smallest 32-bit hash of a member."""
    x = (members ^ (members >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 128):
        y = x[i : i + 128, None] ^ _XOR
        y *= _MULTIPLY
        np.minimum(least, y.min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Sketches of sets (one a row) from their least hashes: REGISTERS 16-bit values each; sketches merge by maximum."""
    variate = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """BANDS keys for each sketch (one a row)."""
    h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sketches), 1))
    bands = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return h.view(np.int64)


def likely_similarity(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from both set sizes and the numbers of registers where a is larger and smaller."""
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps + 1)[None, :]
    ahead = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    up, down = ahead(u - v * j), ahead(v - u * j)
    same = np.clip(1 - up - down, 1e-12, 1)
    equal = (REGISTERS - larger - smaller)[:, None]
    ll = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal * np.log(same)
    return j[np.arange(len(j)), ll.argmax(axis=1)]


SKETCHES = "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>, sketch binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """SKETCHES: set size, a 128-bit print of the set, band keys and sketch of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, least = [], [], [], np.empty((len(batch), REGISTERS), np.uint32)
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py(), width)
                sizes.append(len(s))
                a.append(np.bitwise_xor.reduce(_mix(s + np.uint64(1))) if len(s) else 0)
                b.append(s.sum(dtype=np.uint64) if len(s) else 0)
                least[i] = least_hashes(s)
            sketch = registers(least)
            keys = band_keys(sketch)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), signed(a), signed(b), keys, pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "n_shingles", "print_a", "print_b", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCHES)


@F.pandas_udf(T.DoubleType())
def _estimate(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
    return pd.Series(likely_similarity(n_a.to_numpy(float), n_b.to_numpy(float), (x > y).sum(axis=1), (x < y).sum(axis=1)))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    of = lambda x: np.frombuffer(x, np.uint64)
    return pd.Series([len(np.intersect1d(of(x), of(y), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, members (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "members"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, members binary")


def set_members(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, members (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            sizes = np.array([len(s) for s in sets], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "n", "members"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, members array<long>")


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """sets: doc_id, component, n, members -> pairs (a, b) of different components that share one of their rarest members.

    At the threshold, sets of x <= y members have at least percent / (100 + percent)
    of x + y in common, so the rarest common member lies among the first
    x - ceil(2 * percent * x / (100 + percent)) + 1 of the smaller set and the first
    y - ceil(percent * y / 100) + 1 of the larger, with enough members left behind
    it in both.  Members that no other set has come first in the order and match
    nothing, so they only use up places.
    """
    named = sets.select("doc_id", "component", "n", F.xxhash64("members").alias("set_id"), "members")
    rows = named.select("doc_id", "component", "n", "set_id", F.explode("members").alias("member"))
    often = rows.groupBy("member").agg(F.count("*").alias("found")).where("found > 1")
    shared = rows.join(often, "member").groupBy("doc_id", "component", "n", "set_id").agg(F.sort_array(F.collect_list(F.struct("found", "member"))).alias("order"))
    exact = lambda top, under: F.ceil(F.col("n").cast("decimal(18,0)") * top / F.lit(under).cast("decimal(4,0)")).cast("long")
    alone = F.col("n") - F.size("order")
    places = F.greatest(F.col("n") - exact(percent, 100) + 1 - alone, F.lit(0)).cast("int")
    first = shared.select("doc_id", "component", "n", alone.alias("alone"), F.posexplode(F.slice("order", 1, places)).alias("at", "o"))
    first = first.select("doc_id", "component", "n", "o.member", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))  # rest: members from this one on
    x, y = first.where(F.col("rest") >= exact(2 * percent, 100 + percent)).alias("x"), first.alias("y")
    near = x.join(y, "member").where("x.component <> y.component and (x.n < y.n or x.n = y.n and x.doc_id < y.doc_id)")
    near = near.where(100 * F.col("x.n") >= percent * F.col("y.n")).where((100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.n") + F.col("y.n")))
    return near.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def verified(docs: DataFrame, marks: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * common >= percent * union."""
    side = lambda c: marks.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    near = staged(near.where(_estimate("n_a", "n_b", "s_a", "s_b") >= percent / 100 - MARGIN).select("a", "b", "n_a", "n_b"))
    ids = staged(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = full_sets(rows_of(docs, ids, "doc_id"), width)
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    common = both.select("a", "b", (F.length("x") / 8).cast("long").alias("n_a"), (F.length("y") / 8).cast("long").alias("n_b"), _common("x", "y").alias("common"))
    return common.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b").distinct()


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is its own component's id); a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = staged(sketches(docs, width))
    full = marks.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("print_a", "print_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    copies = staged(full.select("doc_id", "print_a", "print_b", "n_shingles").join(reps, ["print_a", "print_b", "n_shingles"]).select("doc_id", "rep").distinct())
    nodes = copies.select(F.col("rep").alias("doc_id")).distinct()
    keyed = full.select("doc_id", "keys").join(nodes, "doc_id", "left_semi").select(F.explode("keys").alias("key"), "doc_id").distinct()
    met = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    live = staged(keyed.join(met, "key"))
    company = live.groupBy("doc_id").agg(F.sum("met").alias("company"))
    leaders = live.join(company, "doc_id").groupBy("key").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("o"))).alias("top")).select("key", (-F.col("top.o")).alias("leader"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = staged(live.join(leaders, "key").where("doc_id <> leader").select(*pair("doc_id", "leader")).distinct())
    marks_of_nodes = full.select("doc_id", "n_shingles", "sketch").join(nodes, "doc_id", "left_semi")
    links = verified(docs, marks_of_nodes, stars, width, percent)
    own = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = staged(links.unionByName(own))
    found = staged(components(links))
    # buckets of more than two whose members are not all connected by now
    placed = live.where("met > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    apart = staged(placed.join(apart, "key", "left_semi").select("doc_id", "component").distinct())
    sets = staged(set_members(rows_of(docs, apart.select("doc_id"), "doc_id"), width).distinct().join(apart, "doc_id"))
    rest = rare_pairs(sets, percent).join(stars, ["a", "b"], "left_anti")
    rest = staged(rest)
    if rest.take(1):
        links = links.unionByName(verified(docs, marks_of_nodes, rest, width, percent))
        found = staged(components(links))
    out = marks.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are near copies of one with a smaller doc_id in their component; columns stay."""
    gone = staged(near_copies(docs, width, percent).where("not kept").select("doc_id").distinct())
    return rows_without(docs.withColumn("doc_id", F.col("doc_id").cast("long")), gone, "doc_id").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
