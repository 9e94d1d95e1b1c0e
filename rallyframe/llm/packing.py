"""Packing by cutting-stock column generation.

A document's tokens are cut at every `size` tokens; full pieces are sequences of
their own, and the rest, shorter than a sequence, is packed.  How many rests
there are of each length, rounded up to `grain` tokens, is a histogram of at most
size / grain numbers.  A linear program over patterns (how many rests of each
length share a sequence) minimises the number of sequences; a knapsack by
dynamic programming prices new patterns until none helps or the bound is within
GAP.  The solution is rounded down, the few rests left over (fewer than there
are patterns in use times the largest pattern) fill up by best fit decreasing,
and each pattern takes its rests by their rank within their length.

Only the histogram reaches the driver and only the plan, bounded by the number
of lengths, is broadcast.  Ranks come from counts of each input partition, so no
length is sorted in one task, and token ids are not shuffled.

A sequence is padded to `size`, except at a power of two, where it ends.

Defined cases: a null text counts as empty and has the end token alone; rows are
packed one by one, so repeated rows and ids are packed again; an empty table
gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SIZE, GRAIN, GAP, END_TOKEN = 1024, 4, 0.001, 0


# ---- the plan, from a histogram alone


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best total of values of lengths 1..capacity (repeats allowed) within the capacity, and how often each is taken."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        with_last = best[c - 1 :: -1][:c] + values[:c]  # length l leaves c - l
        at = int(with_last.argmax())
        best[c], taken[c] = (with_last[at], at + 1) if with_last[at] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if taken[c]:
            counts[taken[c] - 1] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, gap: float = GAP, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """demand[l - 1]: pieces of length l = 1..len(demand), the capacity.  Patterns (one a row) and how often each is used, fractionally."""
    capacity = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return np.zeros((0, capacity), np.int64), np.zeros(0)
    n, need = len(used), demand[used].astype(float)
    basis = np.diag(capacity // (used + 1)).astype(float)  # columns are patterns of one length
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        x = inverse @ need
        price = np.ones(n) @ inverse
        values = np.zeros(capacity)
        values[used] = price
        worth, counts = knapsack(np.maximum(values, 0), capacity)
        if worth <= 1 + 1e-9 or x.sum() <= (1 + gap) * (price @ need) / worth:
            break
        column = counts[used].astype(float)
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    x = np.maximum(np.linalg.solve(basis, need), 0)
    patterns = np.zeros((n, capacity), np.int64)
    patterns[:, used] = basis.T.round().astype(np.int64)
    return patterns, x


@dataclass(frozen=True)
class Plan:
    """Rows of (length class, first rank, ranks, first sequence, of one sequence, first slot); offsets of slots by (first sequence, slot)."""

    takes: list  # (length, rank_from, rank_to, sequence_from, each, slot_from)
    sequences: int


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """histogram: length class (1..capacity) -> pieces."""
    demand = np.zeros(capacity, np.int64)
    for length, n in histogram.items():
        demand[length - 1] = n
    patterns, x = column_generation(demand)
    whole = np.floor(x + 1e-6).astype(np.int64)
    rank, takes, sequence = np.zeros(capacity, np.int64), [], 0

    def use(counts: np.ndarray, times: int) -> None:
        nonlocal sequence
        slot = 0
        for i in np.flatnonzero(counts)[::-1]:
            each = int(counts[i])
            takes.append((int(i) + 1, int(rank[i]), int(rank[i]) + each * times, sequence, each, slot))
            rank[i] += each * times
            slot += each
        sequence += times

    for counts, times in zip(patterns, whole):
        # never more than there are: patterns may serve a length beyond its need
        times = int(min([int(times), *((demand[i] - rank[i]) // counts[i] for i in np.flatnonzero(counts))])) if counts.any() else 0
        if times > 0:
            use(counts, times)
    left = [i + 1 for i in range(capacity) for _ in range(int(demand[i] - rank[i]))][::-1]
    bins: list[list[int]] = []
    room: list[int] = []
    for length in left:
        fits = [(r, b) for b, r in enumerate(room) if r >= length]
        if fits:
            r, b = min(fits)
            bins[b].append(length)
            room[b] -= length
        else:
            bins.append([length])
            room.append(capacity - length)
    for b in bins:
        use(np.bincount(np.array(b) - 1, minlength=capacity), 1)
    return Plan(takes, sequence)


# ---- Spark


class TokenIds:
    """Token ids of texts by a byte-level BPE file of `tokenizers`, as little-endian 32-bit bytes.

    With the same vocabulary as a file of ranks, `tiktoken` gives the same ids
    several times faster; a text that spells a special token is left to `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"


def pieces(docs: DataFrame, path: str, ranks: str | None, size: int, grain: int, with_ids: bool) -> DataFrame:
    """PIECES: every document's pieces; rank counts, within the partition `part`, full pieces and rests of each length class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = TokenIds(path, ranks), TaskContext.get().partitionId()
        rank = np.zeros(size // grain + 2, np.int64)
        for whole_batch in batches:
            for begin in range(0, len(whole_batch), 256):
                batch = whole_batch.slice(begin, 256)
                rows = []
                end = np.array([END_TOKEN], "<u4").tobytes()
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        length = len(piece) // 4
                        k = -(-length // grain) if length < size else 0
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, part, int(rank[k]), piece if with_ids else None))
                        rank[k] += 1
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_ARROW = pa.schema([(n, pa.int64()) for n in _NAMES[:5]] + [("part", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, path: str, ranks: str | None = None, size: int = SIZE, grain: int = GRAIN, with_ids: bool = True) -> DataFrame:
    """path: a `tokenizers` file; ranks: the same vocabulary for `tiktoken`, if there is one.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (tokens of its sequence with padding), ids (array, if with_ids)."""
    assert size % grain == 0
    cut = staged(pieces(docs, path, ranks, size, grain, with_ids))
    k = F.when(F.col("length") < size, F.ceil(F.col("length") / grain)).otherwise(0).cast("int")
    cut = cut.withColumn("k", k)
    # first rank of each (partition, class): partitions times classes rows
    here = cut.groupBy("part", "k").agg(F.count("*").alias("n"))
    before = here.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = staged(before)
    totals = {r["k"]: r["n"] for r in before.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most size / grain + 1 rows
    full = totals.pop(0, 0)
    plan = make_plan(totals, size // grain)
    spark = docs.sparkSession
    takes = spark.createDataFrame(plan.takes or [(0, 0, 0, 0, 1, 0)], "k int, rank_from long, rank_to long, sequence_from long, each long, slot_from long")
    ranked = cut.join(before.select("part", "k", "before"), ["part", "k"]).withColumn("rank", F.col("rank") + F.col("before"))
    rests = ranked.where("k > 0").join(F.broadcast(takes), "k").where("rank >= rank_from and rank < rank_to")
    rests = rests.withColumn("q", F.col("rank") - F.col("rank_from")).withColumn("sequence_id", F.col("sequence_from") + full + F.floor(F.col("q") / F.col("each"))).withColumn("slot", F.col("slot_from") + F.col("q") % F.col("each"))
    # a sequence holds at most size pieces
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("filled", F.sum("length").over(Window.partitionBy("sequence_id")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filled", "ids"]
    whole = ranked.where("k = 0").withColumns({"sequence_id": F.col("rank"), "offset": F.lit(0).cast("long"), "filled": F.col("length")})
    out = whole.select(columns).unionByName(rests.select(columns))
    padded = F.when(F.bit_count("filled") == 1, F.col("filled")).otherwise(size).cast("long")
    out = out.withColumn("padded", padded).drop("filled")
    return out.withColumn("ids", token_ids("ids")) if with_ids else out.drop("ids")


def token_ids(column: str):
    """Little-endian 32-bit binary -> array of ints."""
    at = lambda i, j: F.conv(F.hex(F.substring(F.col(column), i * 4 + 4 - j, F.lit(1))), 16, 10).cast("int") * (1 << 8 * (3 - j))
    n = (F.length(column) / 4).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, 3) + at(i, 2) + at(i, 1) + at(i, 0))
