import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import sentencepiece_scan as S

pytest.importorskip("sentencepiece")
PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def whole(own, text):
    """One lattice over the whole text."""
    m = S.marked(text)
    score, edge = own.best(m)
    return float(score[-1]), own.trace(edge, len(m), 0)


def texts():
    rng = random.Random(4)
    bits = ["the", "Étion", " ", " ", "\n", "日本", "𝒳", "ing", "x9", ".", "\x00", "   "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", " ", "a", "nospaces" * 60, "同" * 300, "tail end "]


def test_chunks_equal_one_lattice(spark, monkeypatch):
    own = S.pieces(PATH)
    monkeypatch.setattr(S, "GIANT", 40)
    monkeypatch.setattr(S, "CHUNK", 37)
    data = list(enumerate(texts())) + [(4, texts()[4]), (None, "of nothing " * 9)]
    df = spark.createDataFrame(data, DOCS).withColumn("chunk", F.lit("clash")).withColumn("print", F.lit(1))
    got = S.decode(S.encode(df, PATH), PATH).collect()
    assert len(got) == len(data)
    want = {d: (t or "", *whole(own, t)) for d, t in data}
    for r in got:
        text, score, ids = want[r["doc_id"]]
        assert (r["n_chars"], r["text"]) == (len(text), text)
        assert r["score"] == score
        # the ids are a segmentation of that score: equal to one lattice's, or another one of the same score where pieces tie over a chunk's border
        known = sum(own.score[own.text[i]][1] for i in r["ids"] if own.text[i] in own.score)
        bare = len(bytes(own.byte_of[i] for i in r["ids"] if i in own.byte_of).decode("utf-8"))
        assert known + own.unknown * bare == r["score"]
        assert list(r["ids"]) == ids or len(S.marked(text)) > 40


def test_scan_is_associative():
    own = S.pieces(PATH)
    text = S.marked("thingsandothersthatgoon" * 20 + " and more of " * 10)
    a, b, c = (own.matrix(text[i * 60 : i * 60 + 60 + own.reach], 60) for i in range(3))
    assert (S.combine(S.combine(a, b), c) == S.combine(a, S.combine(b, c))).all()
    assert (S.combine(a, b) == own.matrix(text[: 120 + own.reach], 120)).all()


def test_best_score_equals_all_segmentations():
    own = S.pieces(PATH)
    rng = random.Random(2)
    for _ in range(200):
        word = S.MARK + "".join(rng.choice("thearnd") for _ in range(rng.randrange(1, 9)))
        best = [-np.inf] * (len(word) + 1)
        best[0] = 0
        for e in range(1, len(word) + 1):
            for s in range(e):
                if word[s:e] in own.score:
                    best[e] = max(best[e], best[s] + own.score[word[s:e]][1])
        assert own.word(word)[0] == best[-1]


def test_empty_table(spark):
    assert S.encoding_digests(spark.createDataFrame([], DOCS), PATH).count() == 0
