import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rallyframe.llm import collocations

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, min_count, top, max_n=4):
    counts = Counter()
    for _, lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            counts.update(("und" if lang is None else lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    total = Counter()
    for (lang, w), n in counts.items():
        total[lang] += n * (len(w) == 1)
    best = {}
    cands = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= min_count}
    dropped = set()
    for (lang, w), n in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * n >= 80 * cands.get((lang, w[i : i + k]), 10**9):
                    dropped.add((lang, w[i : i + k]))
    for (lang, w), a in cands.items():
        if (lang, w) not in dropped:
            cut = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            best.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), " ".join(w), a, cut[2], cut[3], total[lang], cut[0]))
    return sorted((lang, r, *x[3:]) for lang, of in best.items() for r, x in enumerate(sorted(of)[:top], 1))


def rows_of(seed, n=250):
    rng = random.Random(seed)
    words = ["a", "A", "b", "\x01", "c\x02", "é", "𝄞", "z z", "the", "of", "=", "b b b"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " ", "!"]
    text = lambda k: "".join(rng.choice(words[: rng.randrange(2, 13)]) + rng.choice(ends) for _ in range(k))
    rows = [(i, rng.choice(["en", "pt br", None, "und", ""]), text(rng.randrange(0, 40))) for i in range(n)]
    return rows + [(1, "en", None), (1, "en", ""), (None, "en", " . \t"), (7, "en", "the of " * 3000), (8, "xx", "only twice only twice")]


def test_equals_brute_force(spark, monkeypatch):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"Phrase": F.lit("x"), "n": F.lit(1), "part": F.lit(None).cast("int"), "w": F.lit(2)})
    got = lambda **k: sorted(map(tuple, collocations.collocations(df, **k).collect()))
    assert got(min_count=30) == brute(rows, 30, 2000)
    # slots that many pairs share, suffixes sent in small parts, three words, few ranks
    monkeypatch.setattr(collocations, "FEWEST_SLOTS", 1 << 15)
    monkeypatch.setattr(collocations, "SLOT_BYTES", 1 << 30)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "AT_ONCE", 300)
    assert got(min_count=5, top=20) == brute(rows, 5, 20)
    assert got(min_count=5, max_n=3) == brute(rows, 5, 2000, 3)


def test_counts_of_phrases(spark):
    rows = rows_of(8)
    counts, totals = collocations.phrase_counts(spark.createDataFrame(rows, SCHEMA), min_count=40)
    want = Counter()
    for _, lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").replace("A", "a")):
            w = re.findall(r"[^ \t]+", piece)
            want.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert {(r["lang"], r["phrase"]): r["n"] for r in counts.collect()} == {x: n for x, n in want.items() if n >= 40}
    assert sum(r["total"] for r in totals.collect()) == sum(n for (_, p), n in want.items() if " " not in p)


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 5 * 10**13
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 2 * big)], "lang string, phrase string, words int, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: (counts, counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))))
    (row,) = collocations.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert tuple(row) == ("en", 1, "a b", big, big + 1, 2 * big, 3 * big + 1, 2000000 * big // (3 * big + 1))


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
