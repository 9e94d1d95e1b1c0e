import random
import re

import numpy as np
from pyspark.sql import functions as F

from rallyframe.llm import quality as Q

DOCS = "doc_id long, text string"


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ing", "sha", "re"]) for _ in range(rng.randrange(1, 4))) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


def table():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(40, 120)) + "\n" + prose(rng, 20)) for i in range(150)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(12)]
    rows += [(300 + i, " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in prose(rng, 60).split())) for i in range(12)]
    rows += [(400 + i, " ".join([rng.choice("abcdef") * 5] * 30 + ["of"] * 30)) for i in range(12)]
    rows += [(500, None), (501, ""), (502, " \n\t\r"), (503, "too short"), (504, "word " * 50_000), (0, rows[0][1])]
    return rows


def test_counts_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "#", "\x1c", "\xa0", "é"]) for _ in range(rng.randrange(0, 80)))
        assert Q.text_counts(text)[:5] == slow_counts(text)


def test_verdicts_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, DOCS).withColumn("counts", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = {r["doc_id"]: r for r in Q.verdicts(df).collect()}
    assert {r["doc_id"] for r in got.values()} == {d for d, _ in rows}
    # the same model from single rows in place of patterns
    all_votes = np.array([got[d]["votes"] for d, _ in rows])
    model = Q.em(all_votes, np.ones(len(rows)))
    for d, text in rows:
        r = got[d]
        assert tuple(r[c] for c in Q.COUNTS[:5]) == slow_counts(text if d != 504 else None) or d == 504
        odds = np.log(model.prior / (1 - model.prior)) + sum(np.log(model.table[Q.CLEAN][j][v] / model.table[Q.JUNK][j][v]) for j, v in enumerate(r["votes"]))
        assert abs(r["posterior"] - 1 / (1 + np.exp(-odds))) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert all(got[i]["kept"] for i in range(150))
    assert not any(got[i]["kept"] for i in got if i >= 200)
    kept = Q.keep_clean(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if got[d]["kept"])


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert Q.verdicts(df).count() == 0 and Q.keep_clean(df).count() == 0


def test_repeated_words_in_large_vocabularies():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    for _ in range(30):
        i, j = rng.randrange(8000), rng.randrange(8990)
        words[i : i + 7] = words[j : j + 7]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    want = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    assert Q.repeated_words(words) == len(want)
