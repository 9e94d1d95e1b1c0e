"""Phrase collocations by Suffix-sigma.

Every word occurrence sends the suffix of its piece that begins there, cut to max_n
words, to the task of its language, first word and a salt of the second; equal
suffixes are summed before they are sent.  A task reads its suffixes in reverse
lexicographic order (Spark sorts them, spilling where it must) and counts all their
prefixes with one stack of max_n counters.  Phrases of two words or more are complete
in their task, as the salt hangs on the first two words only; single words are summed over the
salts.  Counts of parts are joined to the candidates afterwards.

A suffix is also cut where a pair of neighbouring words cannot be frequent: pairs are
first counted in hashed slots, and a slot's count is never less than that of any of its pairs, so a phrase that reaches min_count is never cut.  The slots grow
with the input up to MOST_SLOTS, which is 2**30 bits, 128 MB, to every task.  Beyond some 17 GB of text
the slots fill up and cut less and less, until all suffixes travel, some three times as many as are sent
with empty slots; the result is the same.

Defined cases: a null text has no words, a null language is `und`; texts with one doc_id
are texts of their own; a piece is what stands between two characters of PIECE_ENDS and
a phrase never crosses one; an empty table gives an empty result; other columns are
passed over.  Counts are 64-bit, and products of them are taken as decimals.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote, unquote
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Fixed values of the contract: what ends a piece, and A-Z as a-z, for bytes.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
TO_PIECES = bytes(10 if chr(c) in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text for a slot of pairs; fewest and most slots.
SLOT_BYTES, FEWEST_SLOTS, MOST_SLOTS = 16, 1 << 16, 1 << 30
#: Salts of a first word; suffixes that are cut out at once; bytes of text that are counted together, and of a block of hashing.
SALTS, HELD, AT_ONCE, HASHED = 16, 200_000, 1 << 23, 1 << 18
BITMAP = 32_768


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """Language and texts of it with their piece ends as \n, about AT_ONCE bytes at a time, each text whole."""
    held: dict[bytes, list[bytes]] = defaultdict(list)
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            lang = quote(lang, "").encode()
            held[lang].append(text.as_buffer().to_pybytes())
            size[lang] += len(held[lang][-1])
            if size[lang] >= AT_ONCE or sum(size.values()) >= 3 * AT_ONCE:
                most = max(size, key=size.get)
                yield most, b"\n".join([*held.pop(most), b""]).translate(TO_PIECES)
                del size[most]
    for lang, texts in held.items():
        yield lang, b"\n".join([*texts, b""]).translate(TO_PIECES)


def _words(texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, a space behind each, as bytes; where each begins and the last ends; whether each has its right neighbour in the same piece."""
    b = np.frombuffer(texts, np.uint8)
    apart = (b == 10) | (b == 32) | (b == 9)
    after = np.concatenate(([True], apart[:-1]))
    starts, ends = np.flatnonzero(~apart & after), np.flatnonzero(apart & ~after)
    pieces = np.cumsum(b == 10, dtype=np.int32)
    near = np.zeros(len(starts), bool)
    near[:-1] = pieces[starts[1:]] == pieces[starts[:-1]]
    letters = b[~(apart & after)].copy()
    letters[apart[~(apart & after)]] = 32
    return letters, np.concatenate(([0], np.cumsum(ends - starts + 1))), near


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, as 64-bit numbers that wrap."""
    base = 0x9E3779B97F4A7C15

    def power(x: int) -> np.ndarray:
        factors = np.full(HASHED + 1, x, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return power(base), power(pow(base, -1, 1 << 64))


def _hashes(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each word, the same wherever it stands: sums of letters times powers, divided by the power that the word begins with."""
    power, inverse = _powers()
    out, first = np.zeros(len(at) - 1, np.uint64), 0
    while first < len(out):
        last = int(np.searchsorted(at, at[first] + HASHED, side="right")) - 1
        if last <= first:  # a word longer than a block
            out[first], first = crc32(letters[at[first] : at[first + 1]].tobytes()), first + 1
            continue
        begin = at[first : last + 1] - at[first]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[at[first] : at[last]].astype(np.uint64) * power[: begin[-1]])))
        out[first:last] = (sums[begin[1:]] - sums[begin[:-1]]) * inverse[begin[:-1]]
        first = last
    return (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)


def _pair_slots(lang: bytes, h: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each word with its right neighbour; slots is a power of two."""
    mixed = (h[:-1] ^ h[:-1] >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) + h[1:] + np.uint64(crc32(lang))
    return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24) & np.uint64(slots - 1)).astype(np.int64)


def _slot_counts(slots: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            letters, at, near = _words(texts)
            if len(near) > 1:
                slot, n = np.unique(_pair_slots(lang, _hashes(letters, at), slots)[near[:-1]].astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n, pa.int64())], ["slot", "n"])

    return run


def frequent_pairs(texts: DataFrame, min_count: int, slots: int) -> bytes:
    """A bit for each slot: whether the pairs of words that hash to it occur min_count times or more together."""
    full = texts.mapInArrow(_slot_counts(slots), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    parts = staged(full.groupBy(F.floor(F.col("slot") / BITMAP).alias("no")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("bits")))
    out = bytearray(slots // 8)
    for r in parts.collect():  # slots / 8 bytes, MOST_SLOTS / 8 at most
        out[r["no"] * (BITMAP // 8) : (r["no"] + 1) * (BITMAP // 8)] = r["bits"]
    return bytes(out)


def _suffixes(frequent, slots: int, max_n: int) -> Callable:
    def cut(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The stretches of letters as strings of bytes."""
        size = end - begin
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = letters[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8)
        for lang, texts in _by_language(batches):
            letters, at, near = _words(texts)
            n = len(near)
            if not n:
                continue
            h = _hashes(letters, at)
            reach = np.ones(n, np.int64)  # words of the suffix from each, as far as its pairs are frequent
            part = h + np.uint64(crc32(lang))
            if n > 1:
                slot = _pair_slots(lang, h, slots)
                on = near[:-1] & (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                for _ in range(max_n - 1):
                    reach[:-1] = 1 + on * reach[1:]
                part[:-1] += np.where(on, (h[1:] >> np.uint64(32)) % np.uint64(SALTS) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
            part = (part >> np.uint64(33)).astype(np.int32)
            found = []
            for i in range(0, n, HELD):
                j = np.arange(i, min(n, i + HELD))
                found.append(pa.table({"part": part[j], "suffix": cut(letters, at[j], at[j + reach[j]])}))
            counted = pa.concat_tables(found).group_by(["part", "suffix"], use_threads=False).aggregate([([], "count_all")]).sort_by("suffix")  # in order, as that packs better
            named = pc.binary_join_element_wise(pa.scalar(lang + b"\n", pa.binary()), counted["suffix"], pa.scalar(b"", pa.binary()))
            yield from pa.table({"part": counted["part"], "suffix": named, "n": counted["count_all"]}).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def _prefix_counts(min_count: int) -> Callable:
    """Sorted suffixes -> their prefixes with counts: single words as far as they are here, longer ones that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lru_cache(1024)(unquote)
        stack: list[bytes] = []  # prefixes of the suffix at hand, each a word longer than the one below
        counts: list[int] = []
        phrases: list[bytes] = []
        words: list[int] = []
        found: list[int] = []

        def pop() -> None:
            k, n, s = len(stack), counts.pop(), stack.pop()
            if n >= min_count or k == 1:
                phrases.append(s[:-1])
                words.append(k)
                found.append(n)
            if k > 1:
                counts[-1] += n

        def rows() -> pa.RecordBatch:
            parts = [p.split(b"\n") for p in phrases]
            columns = [pa.array([name(x) for x, _ in parts], pa.string()), pa.array([x for _, x in parts], pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(found, pa.int64())]
            for x in (phrases, words, found):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])

        for batch in batches:
            for s, n in zip(batch["suffix"].to_pylist(), batch["n"].to_pylist()):
                while stack and not s.startswith(stack[-1]):
                    if counts[-1] < min_count and len(stack) > 1:  # mostly
                        stack.pop()
                        m = counts.pop()
                        counts[-1] += m
                    else:
                        pop()
                end = len(stack[-1]) if stack else 0
                while end < len(s):
                    end = s.index(b" ", end) + 1
                    stack.append(s[:end])
                    counts.append(0)
                counts[-1] += n
            if phrases:
                yield rows()
        while stack:
            pop()
        if phrases:
            yield rows()

    return run


def phrase_counts(docs: DataFrame, max_n: int = 4, min_count: int = 30) -> tuple[DataFrame, DataFrame]:
    """docs: lang, text -> (lang, phrase, words, n: every phrase of up to max_n words found min_count times or more), (lang, total: its words)."""
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (size // SLOT_BYTES).bit_length()))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pairs(texts, min_count, slots))
    sent = texts.mapInArrow(_suffixes(frequent, slots, max_n), "part int, suffix binary, n long")
    dealt = sent.repartition("part").drop("part").sortWithinPartitions(F.desc("suffix"))
    found = staged(dealt.mapInArrow(_prefix_counts(min_count), "lang string, phrase string, words int, n long"))
    single = found.where("words = 1").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return found.where("words > 1").unionByName(single.where(F.col("n") >= min_count)), found.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _inner(max_n: int) -> Column:
    """The phrases of two words or more that lie in the words w, w itself aside."""
    spans = [(at, k) for k in range(2, max_n) for at in range(max_n - k + 1)]
    parts = [F.when((F.size("w") > k) & (F.size("w") >= at + k), _joined(F.slice("w", at + 1, k))) for at, k in spans]
    return F.array_distinct(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<string>")


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` best phrases of 2 to max_n words.

    a, l and r are the counts of the phrase and of its parts at the cut with the lowest
    score floor(2000000 * a / (l + r)), the first of equals.  A phrase that lies in a longer
    candidate with at least `covered` percent of its count is left out.
    """
    counts, totals = phrase_counts(docs, max_n, min_count)
    counts = staged(counts)
    found = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    over = found.select("lang", F.explode(_inner(max_n)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = found.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a"))).drop("over")
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "a", "w", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.slice("w", F.lit(1), F.col("k"))).alias("left"), _joined(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(2000000 as decimal(7, 0)) * {wide('a')} div ({wide('l')} + {wide('r')})")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within shares of a language, then among the best of all its shares: at most 1024 * top rows
    first = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    best = first(first(best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(1024))), "lang", "share").drop("rank"), "lang")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
