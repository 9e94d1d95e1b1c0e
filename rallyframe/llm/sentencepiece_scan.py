"""SentencePiece encoding and decoding as a max-plus scan.

A text's best segmentation is the path of largest summed piece scores through its
characters, as in a SentencePiece unigram model, over the pieces and scores of a
given model file (tokenizers are not trained here).  For a model made by merging,
whose scores are ranks, this is the best-scored segmentation, which need not be
the one that the library's merge order gives.

The state between two characters is how far the piece that covers them reaches
on, so a chunk of characters is a matrix of best scores from each entering to
each leaving state, and chunks combine by max-plus products, in any grouping.
Documents longer than GIANT characters are split to chunks; each chunk gives its
matrix, the matrices are combined by a scan for the state at every boundary, and
each chunk is then traced back on its own.  No piece crosses the border before a
word mark, so within a chunk all states meet there: between two such borders the
best path is found once (and kept for the word), whatever the entering state.

Scores are whole numbers in this file's model; they are added exactly.  At equal
scores the longer last piece wins, in chunks as in whole texts.

Defined cases: a null text counts as empty and has no pieces; characters without
a piece are written as their UTF-8 bytes, each character at UNKNOWN below the
worst score; a space is written as U+2581, and U+2581 in a text decodes as a
space; repeated rows are encoded alike; an empty table gives an empty result;
other columns are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GIANT, CHUNK = 32_768, 8_192
UNKNOWN = 10.0
MARK = "▁"
NEVER = -(2.0**52)


_MUL, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x1234567)


def _hash(text: str) -> int:
    h = int(_SEED)
    for c in text:
        h = (h * int(_MUL) + ord(c)) % 2**64
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)


class Pieces:
    """The pieces of a model file, and best segmentations by them."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.text = [p.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        usable = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        # runs of marks stand outside the ranks
        self.score = {self.text[i]: (i, p.get_score(i)) for i in usable if p.get_score(i) > -1e8}
        self.reach = max(map(len, self.score))
        self.unknown = min(s for _, s in self.score.values()) - UNKNOWN
        assert not any(MARK in t[1:] for t in self.score), "a piece crosses a word border"
        self.words: dict[str, tuple[float, list[int]]] = {}
        self.limit = limit
        self._fill_table()

    def edges(self, text: str, end: int) -> Iterator[tuple[int, int, float, list[int]]]:
        """(start, width, score, ids) of every piece that ends at `end`, longest first."""
        for width in range(min(self.reach, end), 0, -1):
            t = text[end - width : end]
            if t in self.score:
                i, s = self.score[t]
                yield end - width, width, s, [i]
            elif width == 1:
                yield end - 1, 1, self.unknown, [self.byte[b] for b in t.encode("utf-8", "surrogatepass")]

    def best(self, text: str, first: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """Best score of reaching each character border of text (starting scores of the first ones given), and the edge taken."""
        n = len(text)
        score, edge = [NEVER] * (n + 1), [None] * (n + 1)
        if first is None:
            score[0] = 0.0
        else:
            for i, s in enumerate(first[: n + 1]):
                score[i] = s
        for end in range(1, n + 1):
            for start, _, s, ids in self.edges(text, end):
                if score[start] + s > score[end] and score[start] > NEVER / 2:
                    score[end], edge[end] = score[start] + s, (start, ids)
        return np.array(score), edge

    @staticmethod
    def trace(edge: list, end: int, begin: int) -> list[int]:
        out = []
        while end > begin:
            start, ids = edge[end]
            out.append(ids)
            end = start
        return [i for ids in reversed(out) for i in ids]

    def _fill_table(self) -> None:
        """Pieces and their prefixes by the hash of their characters, in slots of some entries each, for look-ups in numpy."""
        names = list(self.score)
        prefixes = sorted({t[:i] for t in names for i in range(1, len(t))} - set(names))
        keys = np.array([_hash(t) for t in names + prefixes], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        rows = [np.full(1 << 20, -1, np.int32)]
        for k, slot in enumerate(_slot(keys).tolist()):
            free = next((r for r in rows if r[slot] < 0), None)
            if free is None:
                free = np.full(1 << 20, -1, np.int32)
                rows.append(free)
            free[slot] = k
        self.table = np.stack(rows)
        # a last row for what is neither
        self.keys = np.append(keys, np.uint64(0))
        self.scores = np.array([self.score[t][1] for t in names] + [NEVER] * (len(prefixes) + 1))
        self.ids = [self.score[t][0] for t in names]
        self.id_of = np.array(self.ids)

    def _found(self, h: np.ndarray) -> np.ndarray:
        """For each hash the number of its piece or prefix; -1, the row of neither, if there is none."""
        slot = _slot(h)
        first = self.table[0, slot]
        out = np.where(self.keys[first] == h, first, -1)
        shared = np.flatnonzero((first >= 0) & (out < 0))  # entries are filled in order: only these may stand further down
        for row in self.table[1:]:
            at = row[slot[shared]]
            out[shared] = np.where((at >= 0) & (self.keys[at] == h[shared]), at, out[shared])
        return out

    def learn(self, words: list[str]) -> None:
        """Finds the best segmentation of many stretches that no piece crosses into or out of, all of one length at once."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            if n > 64 or len(same) < 4:
                for w in same:
                    score, edge = self.best(w)
                    self.words[w] = float(score[-1]), self.trace(edge, n, 0)
                continue
            c = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
            score = np.full((n + 1, len(same)), NEVER)
            score[0] = 0.0
            width, piece = np.zeros((n + 1, len(same)), np.int8), np.zeros((n + 1, len(same)), np.int32)
            every = np.arange(len(same))
            live: list[tuple[int, np.ndarray, np.ndarray]] = []  # start; words in which a piece may go on from there; hashes
            for end in range(1, n + 1):
                live.append((end - 1, every, np.full(len(same), _SEED)))
                going = []
                for start, at, h in live:  # longest first
                    h = h * _MUL + c[at, end - 1]
                    k = self._found(h)
                    s = self.scores[k]
                    if end - start == 1:
                        s = np.where(s == NEVER, self.unknown, s)
                    s = score[start, at] + s
                    better = np.flatnonzero(s > score[end, at])
                    to = at[better]
                    score[end, to], width[end, to], piece[end, to] = s[better], end - start, k[better]
                    on = np.flatnonzero(k >= 0)
                    if len(on):
                        going.append((start, at[on], h[on]))
                live = going
            # all words are traced back together, piece by piece; -1: no piece any more
            end, steps, bare = np.full(len(same), n), [], np.zeros(len(same), bool)
            while (end > 0).any():
                k = np.where(end > 0, piece[end, every], -1)
                bare |= (end > 0) & ((k < 0) | (k >= len(self.ids)))
                steps.append(np.where((k >= 0) & (k < len(self.ids)), k, -1))
                end = end - np.where(end > 0, width[end, every], 0)
            k = np.stack(steps[::-1], axis=1)
            rows, scores = np.where(k >= 0, self.id_of[k], -1).tolist(), score[n].tolist()
            for i, w in enumerate(same):
                self.words[w] = scores[i], [x for x in rows[i] if x >= 0]
            for i in np.flatnonzero(bare).tolist():  # with characters that have no piece
                w, ids, end = same[i], [], n
                while end > 0:
                    k, size = int(piece[end, i]), int(width[end, i])
                    ids.append([self.ids[k]] if 0 <= k < len(self.ids) else [self.byte[b] for b in w[end - 1].encode("utf-8", "surrogatepass")])
                    end -= size
                self.words[w] = scores[i], [x for part in reversed(ids) for x in part]

    @staticmethod
    def stretches(marked: str) -> list[str]:
        first, *rest = marked.split(MARK)
        return [first, *(MARK + w for w in rest)] if first else [MARK + w for w in rest]

    def word(self, word: str) -> tuple[float, list[int]]:
        """Score and ids of one stretch."""
        if word not in self.words:
            self.learn([word])
        return self.words[word]

    def encode(self, marked: str) -> tuple[float, list[int]]:
        """Score and ids of a whole marked text."""
        return self.encode_all([marked])[0]

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The stretches of each text, all of them learnt."""
        parts = [self.stretches(t) if t else [] for t in texts]
        new = {w for p in parts for w in p if w not in self.words}
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
            new = {w for p in parts for w in p}
        self.learn(list(new))
        return parts

    def encode_all(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        parts = self.prepare(texts)
        out = []
        for p in parts:
            total, ids = 0.0, []
            for w in p:
                s, own = self.words[w]
                total += s
                ids += own
            out.append((total, ids))
        return out

    # ---- chunks: text is the chunk with up to `reach` characters behind it

    def _cut(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and last border in the chunk that no piece crosses."""
        a, b = text.find(MARK, self.reach, size - self.reach), text.rfind(MARK, self.reach, size - self.reach)
        return (a, b) if a >= 0 else None

    def matrix(self, text: str, size: int) -> np.ndarray:
        """[i, j]: best score from i characters into the chunk to j characters behind its end.

        What lies between the first and the last border that no piece crosses is the same for
        all states, so it tells nothing about them and counts as 0 here; `chunk_ids` has the
        whole score.
        """
        r = self.reach
        out = np.full((r, r), NEVER)
        cut = self._cut(text, size)
        starts = [i for i in range(r) if i <= len(text)]

        def leave(piece: str, begin: int, first: int) -> np.ndarray:
            """From `first` in piece (which begins at `begin` of the chunk) to each state behind the chunk's end."""
            start = np.full(len(piece) + 1, NEVER)
            start[first] = 0.0
            inside = size - begin
            row = np.full(r, NEVER)
            if first >= inside:
                row[first - inside] = 0.0
                return row
            score = list(self.best(piece[:inside], start[: inside + 1])[0])
            for j in range(min(r, len(piece) - inside + 1)):
                if j == 0:
                    row[0] = score[inside]
                    continue
                end = inside + j
                for at, _, s, _ in self.edges(piece, end):
                    if at < inside and score[at] > NEVER / 2:  # the piece that crosses the chunk's end
                        row[j] = max(row[j], score[at] + s)
            return row

        if cut is None:
            for i in starts:
                out[i] = leave(text, 0, i)
            return out
        a, b = cut
        tail = leave(text[b:], b, 0)
        for i in starts:
            start = np.full(a + 1, NEVER)
            start[i] = 0.0
            head = self.best(text[:a], start)[0][a]
            if head > NEVER / 2:
                out[i] = np.where(tail > NEVER / 2, head + tail, NEVER)
        return out

    def chunk_ids(self, text: str, size: int, enter: int, leave: int) -> tuple[float, list[int]]:
        """Score and ids of the best path from state `enter` to state `leave`: of the pieces that begin in the chunk."""
        cut = self._cut(text, size)
        if cut is None:
            return self._path(text, size, enter, leave)
        a, b = cut
        parts = [self._path(text[:a], a, enter, 0), self.encode(text[a:b]) if b > a else (0.0, []), self._path(text[b:], size - b, 0, leave)]
        return sum(p[0] for p in parts), [i for p in parts for i in p[1]]

    def _path(self, text: str, size: int, enter: int, leave: int) -> tuple[float, list[int]]:
        if enter >= size:
            return 0.0, []
        start = np.full(size + 1, NEVER)
        start[enter] = 0.0
        score, edge = self.best(text[:size], start)
        if not leave:
            return float(score[size]), self.trace(edge, size, enter)
        best, taken = NEVER, None
        for at, _, s, ids in self.edges(text, size + leave):
            if at < size and score[at] > NEVER / 2 and score[at] + s > best:
                best, taken = score[at] + s, (at, ids)
        return float(best), self.trace(edge, taken[0], enter) + taken[1]

    def decode(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.text.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "surrogatepass"))
                held = bytearray()
            out.append(self.text[i])
        text = "".join(out) + held.decode("utf-8", "surrogatepass")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out < NEVER / 2, NEVER, out)


def scan_states(matrices: list[np.ndarray]) -> list[int]:
    """The state of the best whole path at every chunk boundary, the first and last being 0: prefixes forwards, then the best states backwards."""
    r = len(matrices[0])
    front = np.full((1, r), NEVER)
    front[0, 0] = 0.0
    prefixes = [front]
    for m in matrices:
        prefixes.append(combine(prefixes[-1], m))
    states = [0]
    for prefix, m in zip(prefixes[-2::-1], matrices[::-1]):
        total = prefix[0] + m[:, states[-1]]
        states.append(int(np.flatnonzero(total == total.max())[0]))
    return states[::-1]


ENCODED = "doc_id long, row long, chunk int, ids array<int>, score double"


DIGESTS = "doc_id long, n_chars long, n_pieces long, score double, ids_crc32 long, text_sha256 string"


def digests(own: Pieces, pdf: pd.DataFrame) -> pd.DataFrame:
    """DIGESTS of encoded rows: the crc32 of their ids (little-endian 32-bit) and the sha256 of the text decoded again."""
    return pd.DataFrame({
        "doc_id": pdf["doc_id"].astype("Int64"),
        "n_chars": pdf["n_chars"],
        "n_pieces": [len(i) for i in pdf["ids"]],
        "score": pdf["score"],
        "ids_crc32": [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in pdf["ids"]],
        "text_sha256": [hashlib.sha256(own.decode(np.asarray(i).tolist()).encode("utf-8", "surrogatepass")).hexdigest() for i in pdf["ids"]],
    })


def encode(docs: DataFrame, path: str, only_digests: bool = False) -> DataFrame:
    """doc_id, n_chars, ids (array<int>), score, or DIGESTS in their place; a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.length(F.coalesce("text", F.lit("")))

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(path)
        for pdf in batches:
            for i in range(0, len(pdf), 2048):  # words of many texts are learnt together, and ids leave in batches that are not too large
                part = pdf.iloc[i : i + 2048]
                coded = own.encode_all([marked(t) for t in part["text"]])
                rows = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_chars": [len(t or "") for t in part["text"]], "ids": [np.array(c[1], np.int32) for c in coded], "score": [c[0] for c in coded]})
                yield digests(own, rows) if only_digests else rows

    out = "doc_id long, n_chars long, ids array<int>, score double"
    plain = docs.where(size <= GIANT).mapInPandas(small, DIGESTS if only_digests else out)

    # giant documents: a row for each chunk, with the characters that a piece may reach into
    text = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    giant = docs.where(size > GIANT).select("doc_id", F.sha2("text", 256).alias("print"), F.length("text").cast("long").alias("n_chars"), text.alias("text")).distinct()
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(CHUNK))
    chunks = giant.select("doc_id", "print", "n_chars", F.length("text").alias("all"), F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("text", s + 1, F.lit(CHUNK + 64)).alias("text")))).alias("chunk", "c"))
    chunks = chunks.select("doc_id", "print", "n_chars", "chunk", F.least(F.lit(CHUNK), F.col("all") - F.col("c.start")).cast("int").alias("size"), "c.text")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(path)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(doc_id=pdf["doc_id"].astype("Int64"), matrix=[own.matrix(t[: n + own.reach], n).tobytes() for t, n in zip(pdf["text"], pdf["size"])])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        r = int(np.sqrt(len(pdf["matrix"].iloc[0]) // 8))
        at = scan_states([np.frombuffer(m).reshape(r, r) for m in pdf["matrix"]])
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "print": pdf["print"], "chunk": pdf["chunk"], "enter": at[:-1], "leave": at[1:]})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(path)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                # words of many chunks are learnt together
                cuts = [own._cut(t[: n + own.reach], n) for t, n in zip(part["text"], part["size"])]
                own.prepare([t[c[0] : c[1]] for t, c in zip(part["text"], cuts) if c and c[1] > c[0]])
                coded = [own.chunk_ids(t[: n + own.reach], n, a, b) for t, n, a, b in zip(part["text"], part["size"], part["enter"], part["leave"])]
                yield part[["print", "n_chars", "chunk"]].assign(score=[c[0] for c in coded], doc_id=part["doc_id"].astype("Int64"), ids=[np.array(c[1], np.int32) for c in coded])

    # a document's matrices, one row for CHUNK characters, meet in one group; its text does not
    scanned = chunks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print", "chunk").mapInPandas(matrices, "doc_id long, print string, n_chars long, chunk int, size int, matrix binary").groupBy("doc_id", "print").applyInPandas(states, "doc_id long, print string, chunk int, enter int, leave int")
    same = chunks["doc_id"].eqNullSafe(scanned["doc_id"]) & (chunks["print"] == scanned["print"]) & (chunks["chunk"] == scanned["chunk"])
    # chunks are much work and few bytes: as many tasks as a shuffle may have
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = chunks.join(scanned, same).select(chunks["doc_id"], chunks["print"], "n_chars", chunks["chunk"], "size", "text", "enter", "leave").repartition(tasks, "print", "chunk")
    coded = both.mapInPandas(traced, "print string, n_chars long, chunk int, score double, doc_id long, ids array<int>")
    whole = coded.groupBy("doc_id", "print", "n_chars").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("c"), F.sum("score").alias("score"))
    whole = whole.select("doc_id", "print", "n_chars", F.flatten(F.col("c.ids")).alias("ids"), "score")
    times = docs.where(size > GIANT).groupBy("doc_id", F.sha2("text", 256).alias("print")).agg(F.count("*").cast("int").alias("times"))
    again = whole.alias("w").join(times.alias("t"), F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.print") == F.col("t.print"))).select("w.doc_id", "n_chars", "ids", "score", F.explode(F.sequence(F.lit(1), "times")))
    again = again.select("doc_id", "n_chars", "ids", "score")

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(path)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                yield digests(own, pdf.iloc[i : i + 256])

    return plain.unionByName(again.mapInPandas(digested, DIGESTS) if only_digests else again)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows with ids -> the same with text."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def text_of(ids: pd.Series) -> pd.Series:
        own = pieces(path)
        return pd.Series([None if i is None else own.decode(list(i)) for i in ids], dtype=object)

    return encoded.withColumn("text", text_of("ids"))


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, score, ids_crc32 (little-endian 32-bit ids), text_sha256 (of the text decoded again)."""
    return encode(docs, path, only_digests=True)
