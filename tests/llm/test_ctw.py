import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rallyframe.llm import ctw

SCHEMA = "doc_id long, text string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class Tree:
    """The same weighting, node by node."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            for context, node, bit in self.steps(t):
                for d in range(ctw.DEPTH + 1):
                    self.n.setdefault((context[ctw.DEPTH - d :], node), [0, 0])[bit] += 1
        self.w = {}

    @staticmethod
    def steps(t):
        data = bytes([ctw.END] * ctw.DEPTH) + lower(t).encode() + bytes([ctw.END])
        for i in range(ctw.DEPTH, len(data)):
            for k in range(8):
                yield data[i - ctw.DEPTH : i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    def weighted(self, context, node):
        if (context, node) not in self.n:
            return 0.0
        if (context, node) not in self.w:
            own = log_kt(*self.n[context, node])
            if len(context) < ctw.DEPTH:
                below = sum(self.weighted(bytes([c]) + context, node) for c in range(256))
                own = np.logaddexp(own, below) - math.log(2)
            self.w[context, node] = own
        return self.w[context, node]

    def score(self, t):
        total = 0.0
        for context, node, bit in self.steps(t):
            p = None
            for d in range(ctw.DEPTH, -1, -1):
                c = context[ctw.DEPTH - d :]
                n = self.n.get((c, node), [0, 0])
                estimate = (n[bit] + 0.5) / (sum(n) + 1)
                share = math.exp(log_kt(*n) - math.log(2) - self.weighted(c, node)) if (c, node) in self.n else 0.5
                p = estimate if p is None else share * estimate + (1 - share) * p
            total += math.log10(p)
        return total


def rows():
    rng = random.Random(8)
    words = ["the", "Thing", "onre", "é", "ering", "x9", "of.", "AND"]
    out = [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(40)]
    return out + [(50, None), (51, ""), (52, "  \n"), (None, "the of."), (3, out[3][1]), (53, "unseen Wörter 𝒳"), (54, "long " * 3000)]


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctw, "GROUP_BYTES", 3000)
    monkeypatch.setattr(ctw, "FLUSH", 500)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("g", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    train = [t for d, t in data if not held_out(d)]
    counts = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\nend"])
    n, v = sum(counts.values()), len(counts)
    tree = Tree(train)
    want = []
    for d, t in data:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\nend"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((str(d), held_out(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6), round(tree.score(t), 6)))
    got = [(str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in ctw.scores(df).collect()]
    key = lambda r: (r[0], r[2], r[3])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-4
    assert len(got) == len(want)


def test_held_out_texts_cost_less_than_without_context(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(80)], SCHEMA)
    out = ctw.scores(df).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert out < 1.6  # about 3 bits without context


def test_empty_table_and_no_training(spark):
    assert ctw.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    d = next(i for i in range(100) if held_out(i))
    (r,) = ctw.scores(spark.createDataFrame([(d, "ab")], SCHEMA)).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"] + 3 * 8 * math.log10(2)) < 1e-9


def test_repeated_words_cost_less_than_their_unigram_score(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(8)) for _ in range(60)]
    phrases = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(phrases) for _ in range(40))) for i in range(150)], SCHEMA)
    r = ctw.scores(df).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert ctw.DEPTH >= 6 and r["score"] > r["base"]


def test_contexts_that_go_on_over_batches(spark):
    rows = [(i, t) for i, t in rows_of_many_contexts()]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r["doc_id"]: r["score"] for r in ctw.scores(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["doc_id"]: r["score"] for r in ctw.scores(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def rows_of_many_contexts():
    rng = random.Random(4)
    return [(i, "".join(rng.choice("abé ") for _ in range(30))) for i in range(20)]
