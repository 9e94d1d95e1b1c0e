import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(6)
    words = ["the", "Étion", "don't", "x1y2", "…", "naïve", "100,000", "end.\nNew", "𝒳", "a\tb", "_"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 400))) for _ in range(150)]
    return out + [None, "", " ", "  two  spaces ", "a \nb", "a\n b", "tail ", " head", "<|endoftext|> x", "word " * 20_000, "same", "same", "x  y", "a　b c", "\x1c a"]


def test_ids_are_those_of_tokenizers():
    t = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(2)
    some = [x or "" for x in texts()] + ["".join(rng.choice(["a", "B", " ", " ", "\n", "\u00a0", "1", "!", "é", "'s", "𝒳", "\x1c", "\u3000", "_", "\ud7ff"]) for _ in range(30)) for _ in range(3000)]
    for encode in (P.TokenIds(PATH, RANKS), P.TokenIds(PATH, None)):
        for x in some:
            assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_pieces_are_whole_and_sequences_gapless(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("k", F.lit(9)).repartition(5)
    got = P.pack(df, PATH, RANKS).collect()
    t = tokenizers.Tokenizer.from_file(PATH)
    for d, text in data:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert [i for r in mine for i in r["ids"]] == ids
        at = 0
        for r in mine:
            assert (r["start"], r["length"], r["doc_tokens"]) == (at, len(r["ids"]), len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded"]))
    total = padded = 0
    for rows in by.values():
        at = 0
        for offset, length, _ in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
        assert {p for *_, p in rows} == {at if at & (at - 1) == 0 else 1024}
        total, padded = total + at, padded + rows[0][2]
    assert padded <= 1.02 * total + 4 * 1024
    plain = P.pack(df, PATH, RANKS, with_ids=False)
    assert "ids" not in plain.columns and plain.count() == len(got)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v = rng.random(8)
        best = max(sum(v[i] for i in c) for k in range(9) for c in combinations_with_replacement(range(8), k) if sum(i + 1 for i in c) <= 8)
        worth, counts = P.knapsack(v, 8)
        assert abs(worth - best) < 1e-9 and abs((counts * v).sum() - best) < 1e-9 and (counts * np.arange(1, 9)).sum() <= 8


def test_plans_are_near_the_bound_and_take_every_piece_once():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 5000, 10**6):
        lengths = np.minimum(rng.integers(1, 257, 300), 256)
        histogram = {int(x): int(rng.integers(0, 2 * n // 300 + 2)) for x in lengths} if n else {}
        plan = P.make_plan(histogram, 256)
        taken, fill = {}, {}
        for k, a, b, sequence, each, slot in plan.takes:
            taken.setdefault(k, []).append((a, b))
            assert (b - a) % each == 0
            for s in (sequence, sequence + (b - a) // each - 1):
                fill[s] = fill.get(s, 0) + k * each * (1 if s != sequence or b - a > each else 1)
        for k, count in histogram.items():
            at = 0
            for a, b in sorted(taken.get(k, [])):
                assert a == at
                at = b
            assert at == count
        total = sum(k * c for k, c in histogram.items())
        large = sum(c for k, c in histogram.items() if k > 128)  # no two of them share a sequence
        assert plan.sequences <= 1.04 * max(total / 256, large) + 60
