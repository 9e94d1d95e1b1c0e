"""Secret scans: base rules and a linear-chain conditional random field.

The base rules find assignments, access keys and long hexadecimal runs.  The
field then tags the tokens of each line as begin, inside or outside of a secret, from
the token's shape, the words beside it and features of its line and file, decoded by
Viterbi; what it finds beside the base spans is added as kind "crf".

Every token of every line may be tagged: tokens are runs of characters other than
white space, quotes and brackets, with any `.`, `=`, `/` and the like in them (a name
before `=` or `:` is a token of its own), and length and digits are features only.  A
line is decoded whole.  Most tokens need no search, as their best tag is certain
whatever stands beside them (`Tagger.certain`, an exact bound); Viterbi runs over the
stretches between.

The field is trained at each run on lines of the texts themselves, labelled by the base
rules, without the neighbouring words as features of half of them, so that it learns
shapes as well as neighbours.  Training takes, of lines with a secret, of lines with
another long token that holds a digit, and of other lines, TRAIN_LINES each with the
smallest hashes, in windows of at most TRAIN_TOKENS tokens: a bounded sample that depends
on the rows alone, not on their order.

Defined cases: null text counts as empty and has no span; matches of one kind do
not overlap, of different kinds they may; repeated rows are scanned alike; with
no line to learn from nothing is added; an empty table gives an empty result;
other columns are passed over (`scan`) or kept (`redact`).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

TRAIN_LINES, TRAIN_TOKENS = 1500, 32
KINDS = ("assign", "access", "hex")
# The words of the assignment rule.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as [0-9a-f]+ of 24 and more
BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind number, start of the secret itself), by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- tokens and features

TOKEN = re.compile(r"""\n|[A-Za-z_][A-Za-z0-9_-]{0,31}[=:](?=[^\s=:/"'])|[^\s"'`<>(){}\[\],;]+|[^\s]""")
DIGIT = re.compile(r"[0-9]")
HEX_LETTERS = frozenset("abcdefABCDEF")
BESIDE = (-3, -2, -1, 1)  # the tokens beside one that features look at
BUCKETS = 1 << 13


def bare(token: str) -> str:
    """The end of a sentence is no part of its last word."""
    return token.rstrip(".:!?") or token


def tokens_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens in order, their starts, and the number of the line each is in."""
    words, starts, lines, line = [], [], [], 0
    for m in TOKEN.finditer(text):
        t = m[0]
        if t == "\n":
            line += 1
            continue
        words.append(bare(t))
        starts.append(m.start())
        lines.append(line)
    return words, np.array(starts, np.int64), np.array(lines, np.int64)


def _feature(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def shape(token: str) -> list[str]:
    digits = sum(map(str.isdigit, token))
    lower, upper = any(map(str.islower, token)), any(map(str.isupper, token))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    variety = len(set(token)) / min(len(token), 20)
    hexa = all(c in "0123456789abcdefABCDEF" for c in token)
    return [
        f"len={min(len(token) // 4, 12)}",
        f"case={lower}{upper}&len={min(len(token) // 4, 6)}",
        f"digits={digits * 5 // len(token)}&len={min(len(token) // 8, 3)}",
        f"turns={turns * 5 // len(token)}",
        f"variety={int(variety * 5)}",
        f"hex={hexa}&len={min(len(token) // 8, 6)}&case={lower}{upper}&digit={digits > 0}",
        f"marks={any(c in '_+/-=' for c in token)}&dots={'.' in token}&at={'@' in token}",
    ]


def beside(words: list[str]) -> np.ndarray:
    """The feature number of each word (a row) at each place of BESIDE; words with digits are alike."""
    h = np.array([xxhash.xxh32_intdigest("digits" if DIGIT.search(w) else w.lower()) for w in words], np.uint32)
    return ((h[:, None] ^ np.array([0x9E3779B9 * (k + 1) % 2**32 for k in range(len(BESIDE))], np.uint32)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(words: list[str], lines: np.ndarray, file: tuple[int, int], neighbours: bool = True) -> list[list[int]]:
    """Feature numbers of each token.  file: buckets of the text's share of digits and of its length."""
    out, theirs, size = [], beside(words).tolist(), np.bincount(lines) if len(lines) else []
    for i, word in enumerate(words):
        own = [_feature(n) for n in ("token", f"file={file[0]}", f"file_len={file[1]}", f"line={min(size[lines[i]] // 16, 5)}", *shape(word))]
        for k, d in enumerate(BESIDE):
            inside = 0 <= i + d < len(words) and lines[i + d] == lines[i]
            if neighbours:
                own.append(theirs[i + d][k] if inside else _feature(f"{d}:none"))
        out.append(own)
    return out


def file_features(text: str) -> tuple[int, int]:
    digits = sum(map(text.count, "0123456789"))
    return min(9, digits * 100 // max(1, len(text))), min(6, len(str(len(text))))


def labels(words: list[str], starts: np.ndarray, spans: list[tuple[int, int, int, int]]) -> list[int]:
    """Tags by the base spans: a token that overlaps a secret is begin, or inside if the one before is of the same secret."""
    out, last = [], None
    for word, start in zip(words, starts):
        span = next(((s[3], s[1]) for s in spans if s[3] < start + len(word) and start < s[1]), None)
        out.append(OUTSIDE if span is None else INSIDE if span == last else BEGIN)
        last = span
    return out


# ---- the field

FORBIDDEN = -1e9


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # (BUCKETS, 3)
    moves: np.ndarray  # (3, 3)

    def viterbi(self, emit: np.ndarray, goes_on: bool = False) -> list[int]:
        """The best tags of a chain with such scores (a row a token) that starts outside; goes_on: a token outside follows."""
        score, back = np.array([FORBIDDEN, FORBIDDEN, 0.0]), []
        for e in emit:
            step = score[:, None] + self.moves
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + e
        if goes_on:
            score = score + self.moves[:, OUTSIDE]
        tags, tag = [], int(score.argmax())
        for b in reversed(back):
            tags.append(tag)
            tag = int(b[tag])
        return tags[::-1]


class Tagger:
    """A field with the scores of the tokens that it has seen, LIMIT of them at most."""

    LIMIT = 400_000

    def __init__(self, field: Field) -> None:
        self.field = field
        self._forget()
        of = lambda name: field.weights[_feature(name)]
        self.none = np.array([of(f"{d}:none") for d in BESIDE])
        self.of_file = [of("token") + of(f"file={i}") for i in range(10)]
        self.of_size = [of(f"file_len={i}") for i in range(7)]
        self.of_line = np.array([of(f"line={i}") for i in range(6)])
        m, free = field.moves, lambda p, x: not (p == OUTSIDE and x == INSIDE)
        # what a tag of a secret can gain by the moves into it and out of it, over outside in its place (a secret that went on then begins behind it)
        into = max(m[p, x] - m[p, OUTSIDE] for p in range(3) for x in (BEGIN, INSIDE) if free(p, x))
        out = max(m[x, n] - m[OUTSIDE, BEGIN if n == INSIDE else n] for x in (BEGIN, INSIDE) for n in range(3))
        self.bound = into + out + max(0.0, max(m[INSIDE, y] - m[BEGIN, y] for y in range(3)))

    def _forget(self) -> None:
        """Number 0 is the line's end; shapes: what shape() looks at -> its score."""
        self.number, self.scores, self.shapes = {"\n": 0}, np.zeros((1024, 1 + len(BESIDE), 3), np.float64), {}

    def _shape(self, word: str) -> np.ndarray:
        """The score of a word's shape; words of letters that agree in what shape() looks at share it."""
        case = 1 if word.islower() else 2 if word.isupper() else 3 if word.istitle() else 0
        key = (len(word), case, len(set(word)), HEX_LETTERS.issuperset(word)) if case and word.isalpha() and len(word) < 64 else word
        score = self.shapes.get(key)
        if score is None:
            score = self.shapes[key] = self.field.weights[[_feature(n) for n in shape(word)]].sum(axis=0)
        return score

    def ids(self, tokens: list[str]) -> np.ndarray:
        """The row of scores of each token as found, line ends among them."""
        number = self.number
        new = [t for t in set(tokens) if t not in number]
        if len(number) + len(new) > self.LIMIT:
            self._forget()
            number = self.number
            new = [t for t in set(tokens) if t not in number]
        if new:
            n, first = len(new), len(number)
            if first + n > len(self.scores):
                self.scores = np.concatenate([self.scores[:first], np.zeros((first + n, 1 + len(BESIDE), 3))])
            words = [bare(t) for t in new]
            self.scores[first : first + n, 0] = [self._shape(w) for w in words]
            self.scores[first : first + n, 1:] = self.field.weights[beside(words)]
            number.update(zip(new, range(first, first + n)))
        return np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, ids: np.ndarray, lines: np.ndarray, file: tuple[int, int]) -> np.ndarray:
        """The score of each tag of each token: the sums of its features' weights."""
        n = len(ids)
        own = self.scores[:, 0][ids] + (self.of_file[file[0]] + self.of_size[file[1]])
        own += self.of_line[np.minimum(np.bincount(lines)[lines] // 16, 5)]
        for k, d in enumerate(BESIDE):
            own[max(0, -d) : n - max(0, d)] += self.scores[:, 1 + k][ids[max(0, d) : n + min(0, d)]]
            edge = np.flatnonzero(np.concatenate([np.full(min(n, max(0, -d)), True), lines[max(0, d) : n + min(0, d)] != lines[max(0, -d) : n - max(0, d)], np.full(min(n, max(0, d)), True)]) if n > abs(d) else np.full(n, True))
            inside = edge[(edge + d >= 0) & (edge + d < n)]
            own[inside] -= self.scores[:, 1 + k][ids[inside + d]]
            own[edge] += self.none[k]
        return own

    def certain(self, emit: np.ndarray) -> np.ndarray:
        """Tokens that are outside in the best tags whatever stands beside them: outside scores above what any moves and the next token could make up for."""
        ahead = np.append(np.maximum(0.0, emit[1:, INSIDE] - emit[1:, BEGIN]), 0.0)
        return emit[:, OUTSIDE] - np.maximum(emit[:, BEGIN], emit[:, INSIDE]) > self.bound + ahead

    def tags(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Line and tag of each token of a text."""
        ids = self.ids(TOKEN.findall(text))
        ends = ids == 0
        lines, ids = np.cumsum(ends)[~ends], ids[~ends]
        tags = np.full(len(ids), OUTSIDE)
        if len(ids):
            emit = self.emissions(ids, lines, file_features(text))
            open_ = np.flatnonzero(~self.certain(emit))
            for run in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(lines[open_]) > 0)) + 1) if len(open_) else []:
                a, b = run[0], run[-1] + 1
                tags[a:b] = self.field.viterbi(emit[a:b], bool(b < len(ids) and lines[b] == lines[b - 1]))
        return lines, tags


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(chains: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps (Adam) over all chains at once."""
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = FORBIDDEN
    weights = np.zeros((BUCKETS, 3))
    if not chains:
        weights[:, OUTSIDE] = 1.0
        return Field(weights, moves)
    n, length = len(chains), max(len(c[0]) for c in chains)
    width = max(len(f) for c in chains for f in c[0])
    idx = np.full((n, length, width), BUCKETS)
    real, tags = np.zeros((n, length), bool), np.full((n, length), OUTSIDE)
    for i, (own, y) in enumerate(chains):
        for j, f in enumerate(own):
            idx[i, j, : len(f)] = f
        real[i, : len(own)], tags[i, : len(own)] = True, y
    gold = np.zeros((n, length, 3))
    np.put_along_axis(gold, tags[:, :, None], 1.0, axis=2)
    before = np.concatenate([np.full((n, 1), OUTSIDE), tags[:, :-1]], axis=1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (before[real], tags[real]), 1)
    parameters = np.zeros(BUCKETS * 3 + 9)
    m = v = np.zeros_like(parameters)
    closed = np.array([FORBIDDEN, FORBIDDEN, 0.0])
    for t in range(1, rounds + 1):
        w, free = parameters[:-9].reshape(BUCKETS, 3), parameters[-9:].reshape(3, 3) + moves
        padded = np.vstack([w, np.zeros((1, 3))])
        emit = np.where(real[:, :, None], sum(padded[idx[:, :, k]] for k in range(width)), closed)
        forward, score = [], np.tile(closed, (n, 1))
        for j in range(length):
            score = _logsumexp(score[:, :, None] + free, 1) + emit[:, j]
            forward.append(score)
        backward, score = [None] * length, np.zeros((n, 3))
        for j in range(length - 1, -1, -1):
            backward[j] = score
            score = _logsumexp(free[None] + (emit[:, j] + score)[:, None, :], 2)
        z = _logsumexp(forward[-1], 1)
        share = np.stack([np.exp(np.clip(f + b - z[:, None], -700, 0)) for f, b in zip(forward, backward)], axis=1)
        expected_moves = np.zeros((3, 3))
        for j in range(length):
            prior = np.tile(closed, (n, 1)) if j == 0 else forward[j - 1]
            pair = np.exp(np.clip(prior[:, :, None] + free + (emit[:, j] + backward[j])[:, None, :] - z[:, None, None], -700, 0))
            expected_moves += pair[real[:, j]].sum(axis=0)
        diff = (gold - share) * real[:, :, None]
        gradient = np.stack([np.bincount(idx.ravel(), np.repeat(diff[:, :, s].ravel(), width), BUCKETS + 1)[:BUCKETS] for s in range(3)], axis=1)
        g = np.concatenate([gradient.ravel(), (gold_moves - expected_moves).ravel()]) / n - penalty * parameters
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        parameters = parameters + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(parameters[:-9].reshape(BUCKETS, 3), parameters[-9:].reshape(3, 3) + moves)


def _windows(text: str) -> Iterator[tuple[int, int, str, int, str]]:
    """(hash, stratum, line, bucket of digits, bucket of length) of each line of a text: 0 with a secret, 1 with a long token that holds a digit, 2 others."""
    spans, file, at = base_spans(text), None, 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            stratum = 0 if any(s[3] < end and at < s[1] for s in spans) else 1 if any(len(w) >= 8 and DIGIT.search(w) for w in (line.split() if DIGIT.search(line) else ())) else 2
            file = file or file_features(text)
            yield xxhash.xxh64_intdigest(line) >> 1, stratum, line, *file
        at = end + 1


def chain(line: str, file: tuple[int, int]) -> tuple[list[list[int]], list[int]]:
    """Features and tags of one line for training, in a window of TRAIN_TOKENS tokens about its first secret, or from a place by its hash."""
    words, starts, lines = tokens_of(line)
    tags = labels(words, starts, base_spans(line))
    h = xxhash.xxh32_intdigest(line)
    first = next((i for i, t in enumerate(tags) if t != OUTSIDE), h % max(1, len(words)))
    a = max(0, min(first - TRAIN_TOKENS // 2, len(words) - TRAIN_TOKENS))
    own = features(words, lines, file, (h >> 8) % 2 == 0)
    return own[a : a + TRAIN_TOKENS], tags[a : a + TRAIN_TOKENS]


def fit(docs: DataFrame) -> Field:
    """The field trained on the sample of lines of docs' texts."""
    columns = ["hash", "stratum", "line", "digits", "size"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[int, tuple]] = [{}, {}, {}]  # by hash; cut back to the smallest
        for pdf in batches:
            for text in pdf["text"]:
                for row in _windows(text or ""):
                    own = held[row[1]]
                    own[row[0]] = min(own.get(row[0], row), row)
                    if len(own) >= 4 * TRAIN_LINES:
                        held[row[1]] = {h: own[h] for h in heapq.nsmallest(TRAIN_LINES, own)}
        rows = [own[h] for own in held for h in heapq.nsmallest(TRAIN_LINES, own)]
        yield pd.DataFrame([(*r[:2], r[2] if len(r[2]) <= 8 * 1024 else _shortened(r[2]), *r[3:]) for r in rows], columns=columns)

    found = staged(docs.select("text").where("text is not null").mapInPandas(run, "hash long, stratum int, line string, digits int, size int").distinct())
    sample = []
    for stratum, n in sorted((r["stratum"], r["count"]) for r in found.groupBy("stratum").count().collect()):
        rows = found.where(F.col("stratum") == stratum)
        # hashes are even, so twice the share leaves more than are needed, and few of them; the number of rows that reach the driver does not grow
        few = rows.where(F.col("hash") < int(2.0**63 * min(1.0, 2 * TRAIN_LINES / n)) if n > 4 * TRAIN_LINES else F.lit(True))
        for part in (few, rows):
            got = part.orderBy("hash", "line", "digits", "size").limit(TRAIN_LINES).collect()
            if len(got) >= min(n, TRAIN_LINES):
                break
        sample += got
    return train([c for c in (chain(r["line"], (r["digits"], r["size"])) for r in sample) if c[0]] if any(r["stratum"] == 0 for r in sample) else [])


def _shortened(line: str) -> str:
    """A very long line for training: what stands about its first secret, or its beginning."""
    spans = base_spans(line)
    at = max(0, spans[0][0] - 4096) if spans else 0
    return line[at : at + 8 * 1024]


def added_spans(text: str, base: list[tuple[int, int, int, int]], tagger: Tagger) -> list[tuple[int, int, int, int]]:
    """Spans of the field that meet no base span; kind number 3."""
    lines, tags = tagger.tags(text)
    begins = np.flatnonzero(tags == BEGIN).tolist()
    if not begins:
        return []
    words, starts, _ = tokens_of(text)
    out = []
    for i in begins:
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE and lines[j] == lines[i]:
            j += 1
        start, end = int(starts[i]), int(starts[j - 1]) + len(words[j - 1])
        if not any(s[0] < end and start < s[1] for s in base):
            out.append((start, end, 3, start))
    return out


def all_spans(text: str | None, tagger: Tagger) -> tuple[list, list]:
    """Base spans; base and added spans, by start, then kind."""
    base = base_spans(text or "")
    return base, sorted(base + added_spans(text or "", base, tagger), key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'crf')[k]}:{a}:{b}" for a, b, k, _ in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("secret_start", T.LongType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("joined", T.StringType())])


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end, secret_start), n_assign, n_access, n_hex, base_sha256, joined; a row for each row of docs."""
    field = field or fit(docs)

    @F.pandas_udf(FOUND)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field)
        for batch in texts:
            rows = []
            for text in batch:
                base, both = all_spans(text, tagger)
                kinds = [s[2] for s in base]
                spans = [{"kind": (*KINDS, "crf")[k], "start": a, "end": b, "secret_start": c} for a, b, k, c in both]
                rows.append((spans, *(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both)))
            yield pd.DataFrame(rows, columns=FOUND.names)

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mark (of an assignment, the value alone); columns stay, n_chars follows the text."""
    field = field or fit(docs)

    @F.pandas_udf(T.StringType())
    def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(field)
        for batch in texts:
            yield pd.Series([redacted(t, all_spans(t, tagger)[1], mark) for t in batch], dtype=object)

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def redacted(text: str | None, spans: list[tuple[int, int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for _, end, _, start in sorted(spans, key=lambda s: (s[3], s[1])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
