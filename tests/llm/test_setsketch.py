import random
import re

import numpy as np
from pyspark.sql import functions as F

from rallyframe.llm import setsketch as S

DOCS = "doc_id long, text string"


def brute_set(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(brute_set(t, width))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(brute_set(t, width)), None if d is None else find(d)) for d, t in rows]


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def table():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows, d = [], 0
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((d, rng.choice([" ", "\n"]).join(edit(rng, base, rng.randrange(0, 1 + len(base) // 12)))))
            d += 1
    chain = [f"c{i}" for i in range(100)]  # each is near the next only
    for i in range(8):
        chain = chain[4:] + [f"d{i}{j}" for j in range(4)]
        rows.append((100 + i, " ".join(chain)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "  \n"), (205, "big " * 100_000), (206, "big " * 90_000), (207, "É é"), (208, "é é"), (None, rows[0][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("sketch", F.lit(1))
    for width in (5,):
        want = brute(rows, width, 80)
        got = S.near_copies(df, width, 80).collect()
        assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(map(str, want))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = S.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _, c in want if d == c)


def test_empty_table(spark):
    assert S.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_hashes_follow_words_and_pieces(monkeypatch):
    text = "Ab cd\tef é\n\nab CD " * 50
    whole = S.word_hashes(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    assert len(whole) == len(words)
    seen = {}
    for w, h in zip(words, whole.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(S, "PIECE", 7)
    assert (S.word_hashes(text) == whole).all()


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    errors, equal = [], []
    for _ in range(60):
        x = rng.integers(0, 2**64, 1000, np.uint64)
        a, b = x[:900], x[100:]
        s, t = S.registers(S.least_hashes(a)), S.registers(S.least_hashes(b))
        assert (np.maximum(s, t) == S.registers(S.least_hashes(x))).all()
        errors.append(S.likely_similarity(np.array([900.0]), np.array([900.0]), np.array([(s > t).sum()]), np.array([(s < t).sum()]))[0] - 0.8)
        equal.append((s == t).mean())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04 and abs(np.mean(equal) - 0.8) < 0.02
