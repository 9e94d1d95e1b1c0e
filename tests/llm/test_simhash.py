import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from rallyframe.llm import simhash

xxhash = pytest.importorskip("xxhash")
SCHEMA = "doc_id long, text string"
M = (1 << 64) - 1


def chained(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p, seed=seed).intdigest()
    return seed


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.split(r"[\x20\x09-\x0d]+", text.strip(" \t\n\x0b\x0c\r"))
    votes = [0] * 128
    for i, w in enumerate(words):
        h = chained(*(x.encode() for x in words[i : i + 2]))
        g = chained(struct.pack("<Q", h))
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
            votes[64 + b] += 1 if g >> b & 1 else -1
    bits = [sum((votes[s + b] > 0) << b for b in range(64)) for s in (0, 64)]
    return f"{bits[0]:016x}{bits[1]:016x}"


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, struct.unpack("<q", struct.pack("<Q", chained(r[1].encode())))[0], r[1].encode()))
    prints = [brute_print(t) for _, t in rows]
    gap = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edit = t[: len(t) - q] + nxt[:q]
        near = [rows[j][0] for j, p in enumerate(prints) if j != k and gap(p, prints[k]) <= 3]
        asked = i is not None and i % 10 == 0
        others = [x for x in near if x is not None and x != i]
        e = brute_print(edit)
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), prints[k], e, 1 - gap(prints[k], e) / 128, 1 - gap(prints[k], prints[(k + 1) % len(rows)]) / 128, len(near) if asked else None, min(others, default=None) if asked else None))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in simhash.document_fingerprints(df, F.col("doc_id") % 10 == 0).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 7)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcDEé√𝄞x") for _ in range(rng.randrange(1, 6)))
    prose = lambda n: "".join(word() + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(n))
    rows = [(i, prose(rng.randrange(0, 60))) for i in range(0, 300, 3)]
    rows += [(1000 + i, rows[9][1]) for i in range(12)] + [(2000 + i, rows[20][1] + " " + word()) for i in range(15)]
    rows += [(None, prose(5)), (None, None), (7, None), (8, ""), (9, " \n"), (10, "A"), (30, rows[10][1]), (30, "b c"), (30, "b c"), (5000, "q" * 50_000 + " " + prose(3000))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"range": F.lit(1), "at": F.lit("x"), "guest": F.lit(None).cast("string"), "High": F.lit(2)})
    assert got(df) == brute(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(5, "one two three four")], SCHEMA)
    assert got(df) == brute([(5, "one two three four")])
    assert got(df.limit(0)) == []


def test_near_finds_all_within_the_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(6)]
    some = set()
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.sample(range(128), rng.randrange(0, 6)):
                x ^= 1 << bit
            some.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pair = lambda v: (signed(v >> 64), signed(v & M))
    df = spark.createDataFrame([pair(v) for v in some], "high long, low long")
    for radius in (1, 3):
        found = [(r["q_high"], r["q_low"], r["high"], r["low"], r["bits"]) for r in simhash.near(df, df, radius).collect()]
        want = {(*pair(a), *pair(b), bin(a ^ b).count("1")) for a in some for b in some if 0 < bin(a ^ b).count("1") <= radius}
        assert len(found) == len(set(found)) and set(found) == want
    with pytest.raises(ValueError):
        simhash.near(df, df, 4)


def test_no_python_in_the_plan(spark):
    df = simhash.document_fingerprints(spark.createDataFrame([(1, "a b c"), (2, "d")], SCHEMA), F.col("doc_id") % 10 == 0)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
