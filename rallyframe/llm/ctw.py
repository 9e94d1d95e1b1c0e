"""Language-model scoring by context-tree weighting over bytes.

The model predicts the A-Z-lower-cased text, as UTF-8 bytes and one end mark, bit
by bit.  A bit's contexts are the bits before it in its byte together with the
last 0, 1, ..., DEPTH bytes; each context keeps how many zeros and ones followed
it in the training texts and gives a Krichevsky-Trofimov estimate.  Weighting
mixes the estimates of all depths: a node's weighted probability is half its own
estimate's and half the product of its children's, and the prediction at a node
is its estimate and its child's prediction in the same posterior proportion.

Spark side: texts are dealt to groups of about GROUP_BYTES by a hash.  Each group
asks for the distinct (DEPTH + 1)-byte strings and words that it holds, with
their training counts; requests are summed by key, the trees below each last byte
are built as one bounded group (DEPTH + 1 bytes with one fixed: at most
256 ** DEPTH rows), and the answers are sent back to the groups, whose texts are
then scored in a stream.  The model grows with the corpus and is never collected;
only the root's 256 rows for each last byte (65,280 rows at most) and a few totals
reach the driver.

Beside it the base score: add-half smoothed unigram log10 probabilities of the
words and one end token a text.

Words are counted by 64-bit hashes.

Defined cases: a null text counts as empty and still has its end; a null doc_id
counts as the empty text in the split; repeated rows are scored, and learnt from,
one by one; with no training text counts are zero and estimates are one half; an
empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, staged
from .setsketch import word_hashes

DEPTH, END = 6, 0xFF
#: Context bytes of the trees that are built at one place.
TOP = 3
GROUP_BYTES = 64 << 20
WORD, GRAM = 0, 1
#: Bytes after which a task's requests are summed.
FLUSH = 4 << 20


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 1


def grams(text: str) -> np.ndarray:
    """For each byte of the text and its end: the DEPTH bytes before it and itself, as one number, first byte highest."""
    b = np.frombuffer(bytes([END] * DEPTH) + text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES) + bytes([END]), np.uint8)
    n = len(b) - DEPTH
    out = b[:n].astype(np.int64)
    for i in range(1, DEPTH + 1):
        out <<= 8
        out |= b[i : i + n]
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


def _bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its 8 nodes (1 and the bits so far) and bits: two arrays of (n, 8)."""
    k = np.arange(8)
    return (1 << k) | (byte[:, None] >> (8 - k)), (byte[:, None] >> (7 - k)) & 1


def subtree(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """All strings with some last TOP context bytes: the chance of each of their 8 bits by depths TOP to DEPTH; and the nodes of depth TOP: node (context and bits so far), zeros, ones, log_weighted."""
    node, bit = _bits(keys & 255)
    n = np.repeat(counts, 8)
    flat = bit.ravel().astype(bool)
    chance, weighted = None, None
    estimates = []
    child_of = None
    for depth in range(DEPTH, TOP - 1, -1):
        context = (keys >> 8) & ((1 << 8 * depth) - 1)
        nodes, at = np.unique((context[:, None] << 8 | node).ravel(), return_inverse=True)
        zeros, ones = np.bincount(at, n * ~flat, len(nodes)), np.bincount(at, n * flat, len(nodes))
        own = log_kt(zeros, ones)
        if depth == DEPTH:
            weighted, share = own, np.ones(len(nodes))
        else:
            weighted, share = _mixed(own, np.bincount(child_of(at), weighted, len(nodes)))
        first = np.zeros(len(nodes), np.int64)
        first[at] = np.arange(len(at))
        child_of = lambda at_above, first=first: at_above[first]  # noqa: E731  node of this depth -> its parent
        estimates.append((share[at], (np.where(flat, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)))
    for share, estimate in estimates:
        chance = estimate if chance is None else share * estimate + (1 - share) * chance
    return chance.reshape(-1, 8), pd.DataFrame({"node": nodes, "zeros": zeros, "ones": ones, "log_weighted": weighted})


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the node's own share in it."""
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def weighed(nodes: pd.DataFrame) -> pd.DataFrame:
    """node, zeros, ones, log_weighted (the sum of the children's) -> the node's own log_weighted; with share and one, its chance of a one."""
    zeros, ones = (nodes[c].to_numpy(float) for c in ("zeros", "ones"))
    weighted, share = _mixed(log_kt(zeros, ones), nodes["log_weighted"].to_numpy(float))
    return pd.DataFrame({"node": nodes["node"], "zeros": zeros, "ones": ones, "log_weighted": weighted, "share": share, "one": (ones + 0.5) / (zeros + ones + 1)})


def with_nodes(chance: np.ndarray, keys: np.ndarray, depth: int, nodes: np.ndarray, share: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The chances of the strings' bits with the nodes of `depth` context bytes (ascending) mixed in."""
    node, bit = _bits(keys & 255)
    at = np.searchsorted(nodes, ((keys >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8 | node)
    own = np.where(bit == 1, one[at], 1 - one[at])
    return share[at] * own + (1 - share[at]) * chance


def _whole(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The rows of frames sorted by column, cut so that equal values are together."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        values = pdf[column].to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if held and (cut or held[-1][column].iloc[-1] != values[0]):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield pdf.iloc[:cut]
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


REQUESTS = "kind int, key long, g int, n long"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _counted(parts: list[np.ndarray], weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of many arrays, each with how often it is found times weight."""
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts].astype(np.int64), weight * np.diff(np.append(starts, len(keys)))


class _Asked:
    """The keys of one kind and group: raw ones of the last texts, and the sums so far."""

    def __init__(self) -> None:
        self.raw: tuple[list, list] = ([], [])
        self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.sums, _counted(self.raw[0], 0), _counted(self.raw[1], 1)]
        self.raw = ([], [])
        self.sums = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        return self.sums


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, training, text) -> REQUESTS: the distinct keys of each group with their training counts."""
    held: dict[tuple[int, int], _Asked] = {}
    size = 0
    for batch in batches:
        for g, training, text in zip(*(batch.column(i) for i in range(3))):
            g, training, text = g.as_py(), training.as_py(), text.as_py() or ""
            for kind, keys in ((WORD, word_hashes(text).view(np.int64)), (GRAM, grams(text))):
                held.setdefault((kind, g), _Asked()).raw[training].append(keys)
            size += len(text)
            if size > FLUSH:
                for asked in held.values():
                    asked.fold()
                size = 0
    for (kind, g), asked in held.items():
        keys, counts = asked.fold()
        for i in range(0, len(keys), 100_000):
            n = len(keys[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys[i : i + n]), pa.array(np.full(n, g, np.int32)), pa.array(counts[i : i + n])], ["kind", "key", "g", "n"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"
ANSWERS = "kind int, key long, value double"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, answers before texts) -> SCORES but for the end tokens."""
    now, answers = None, {}
    names = [x.split()[0] for x in SCORES.split(", ")]
    for batch in batches:
        g, is_text = batch.column("g").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (is_text[1:] != is_text[:-1])])) if len(g) else []
        for a, b in zip(edge, [*edge[1:], len(g)]):
            if g[a] != now:
                now, answers = g[a], {WORD: [], GRAM: []}
            part = batch.slice(a, b - a)
            if not is_text[a]:
                kind, key, value = (part.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "value"))
                for k in (WORD, GRAM):
                    answers[k].append((key[kind == k], value[kind == k]))
                continue
            for k in (WORD, GRAM):
                if isinstance(answers[k], list):
                    keys, values = (np.concatenate([x[i] for x in answers[k]]) if answers[k] else np.zeros(0) for i in (0, 1))
                    order = np.argsort(keys, kind="stable")
                    answers[k] = keys[order].astype(np.int64), values[order]
            rows = []
            for doc_id, held_out, text in zip(part.column("doc_id"), part.column("held_out"), part.column("text")):
                text = text.as_py() or ""
                words, strings = np.sort(word_hashes(text).view(np.int64)), np.sort(grams(text))  # the sums need no order, and sorted keys are found faster
                known = answers[WORD][1][np.searchsorted(answers[WORD][0], words)] if len(words) else np.zeros(0)
                score = answers[GRAM][1][np.searchsorted(answers[GRAM][0], strings)].sum()
                rows.append((doc_id.as_py(), held_out.as_py(), len(words), int((known > 0).sum()), float(np.log10(known + 0.5).sum()), float(score), len(strings)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names).cast(pa.schema([(n, {"boolean": pa.bool_(), "double": pa.float64()}.get(t, pa.int64())) for n, t in (x.split() for x in SCORES.split(", "))]))


def scores(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), bits_per_byte; a row for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~(is_training(F.col("doc_id")) if training is None else training)).alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    groups = max(1, -(-(size["bytes"] or 0) // GROUP_BYTES))
    grouped = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    asked = staged(grouped.select("g", (~F.col("held_out")).alias("training"), "text").repartition(groups, "g").mapInArrow(_ask, REQUESTS))

    # sums by key
    totals = asked.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    words = totals.where(F.col("kind") == WORD)
    seen = words.agg(F.sum("n").alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("types")).first()
    ends = size["ends"]
    tokens, types = (seen["tokens"] or 0) + ends, seen["types"] + (ends > 0)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(frames, "context"):
            keys = pdf["key"].to_numpy()
            chance, nodes = subtree(keys, pdf["n"].to_numpy())
            # no missing whole numbers, which pandas would round to doubles
            yield pd.DataFrame({"is_string": True, "key": keys, "chance": [x.tobytes() for x in chance], "zeros": 0.0, "ones": 0.0, "log_weighted": 0.0})
            yield pd.DataFrame({"is_string": False, "key": nodes["node"], "chance": b"", "zeros": nodes["zeros"], "ones": nodes["ones"], "log_weighted": nodes["log_weighted"]})

    last = lambda key, n: F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))  # noqa: E731  the last n context bytes
    above = lambda nodes, n: nodes.groupBy(F.col("node").bitwiseAND(F.lit((1 << 8 * (n + 1)) - 1).cast("long")).alias("node")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_weighted")))
    dealt = totals.where(F.col("kind") == GRAM).select("key", "n", last("key", TOP).alias("context")).repartition("context").sortWithinPartitions("context")
    trees = staged(dealt.mapInPandas(build, "is_string boolean, key long, chance binary, zeros double, ones double, log_weighted double"))
    weigh = lambda frames: map(weighed, frames)
    nodes = staged(above(trees.where("not is_string").withColumnRenamed("key", "node"), 2).mapInPandas(weigh, "node long, zeros double, ones double, log_weighted double, share double, one double"))
    low = weighed(above(nodes, 1).toPandas().sort_values("node", ignore_index=True))
    top = weighed(low.assign(node=low["node"] & 255).groupby("node", as_index=False)[["zeros", "ones", "log_weighted"]].sum())
    low, top = ([x[c].to_numpy() for c in ("node", "share", "one")] for x in (low, top))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # nodes of the context that the last frame ended in
        for pdf in frames:
            is_string = pdf["is_string"].to_numpy(bool)
            own = pdf.loc[~is_string, ["key", "share", "one"]]
            held = (own if held is None else pd.concat([held, own], ignore_index=True)).sort_values("key")
            if is_string.any():
                keys = pdf.loc[is_string, "key"].to_numpy(np.int64)
                chance = np.frombuffer(b"".join(pdf.loc[is_string, "chance"]), np.float64).reshape(-1, 8)
                for depth, level in ((2, (held["key"].to_numpy(np.int64), held["share"].to_numpy(), held["one"].to_numpy())), (1, low), (0, top)):
                    chance = with_nodes(chance, keys, depth, *level)
                yield pd.DataFrame({"key": keys, "value": np.log10(chance).sum(axis=1)})
            if len(pdf):
                held = held[held["key"].to_numpy(np.int64) >> 8 == pdf["context"].iloc[-1]]

    none = lambda t: F.lit(None).cast(t)
    level = nodes.select(F.shiftright("node", 8).alias("context"), F.lit(False).alias("is_string"), F.col("node").alias("key"), none("binary").alias("chance"), "share", "one")
    strings = trees.where("is_string").select(last(F.col("key"), 2).alias("context"), "is_string", "key", "chance", none("double").alias("share"), none("double").alias("one"))
    both = level.unionByName(strings).repartition("context").sortWithinPartitions("context", "is_string")
    strings = both.mapInPandas(finish, "key long, value double").select(F.lit(GRAM).alias("kind"), "key", "value")
    values = words.select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(strings)
    answers = asked.select("kind", "key", "g").join(values, ["kind", "key"]).select("g", F.lit(False).alias("is_text"), "kind", "key", "value", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    texts = grouped.select("g", F.lit(True).alias("is_text"), none("int").alias("kind"), none("long").alias("key"), none("double").alias("value"), "doc_id", "held_out", "text")
    scored = answers.unionByName(texts).repartition(groups, "g").sortWithinPartitions("g", "is_text").mapInArrow(_score, SCORES)
    log_all = float(np.log10(tokens + 0.5 * (types + 1)))
    n_tokens = F.col("n_tokens") + 1
    return scored.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + float(np.log10(ends + 0.5)) - n_tokens * log_all).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
