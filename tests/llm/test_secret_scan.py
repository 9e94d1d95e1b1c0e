import hashlib
import random
import re

from pyspark.sql import functions as F

from rallyframe.llm import secret_scan as S

DOCS = "doc_id long, text string, n_chars long"


def brute_base(text):
    out = []
    keys = ["password", "passwd", "secret", "token", "api_?key"]
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in keys)
    for kind, pattern, least, group in ((0, rf"({either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2), (1, r"AKIA[A-Z0-9]+", 20, 0), (2, r"[0-9a-f]+", 24, 0)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], s[2]))


def rows():
    rng = random.Random(3)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: rng.choice(["thing", "onre", "ering", "É", "and"])
    some = lambda: " ".join(word() for _ in range(rng.randrange(1, 12)))
    made = [lambda: f'token = "{hexa(40)}"', lambda: f"password={hexa(18)}", lambda: "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), lambda: "+1 555-0199", lambda: "10.20.30.40", lambda: "4111111111111111", lambda: "ab12@mail3.example.com"]
    out = [(i, f"{some()} {rng.choice(made)()} {some()}\n{some()}", 0) for i in range(300)]
    out += [(400, None, 0), (401, "", 0), (402, "PassWord: 'abc.def'", 0), (403, "toKen=abc", 0), (404, "AKIAAKIA" + "X" * 15, 0), (405, "f" * 24, 0), (406, "x " * 100_000 + "secret=abcdef", 0), (407, f"key {hexa(20)} on", 0), (0, out[0][1], 0)]
    return out


def test_base_spans_equal_brute_force_and_stay(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS).withColumn("spans", F.lit("clash")).withColumn("f", F.lit(1))
    got = S.scan(df).collect()
    assert len(got) == len(data)
    text = {d: t or "" for d, t, _ in data}
    for r in got:
        want = brute_base(text[r["doc_id"]])
        named = [f"{S.KINDS[k]}:{a}:{b}" for a, b, k in want]
        assert [r[f"n_{k}"] for k in S.KINDS] == [sum(s[2] == i for s in want) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [x for x in r["joined"].split(",") if x and not x.startswith("crf")] == named
    assert S.scan(df.limit(0)).count() == 0


def test_random_texts_base():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["token", "ToKen", "api_key", "apikey", "=", ":", " ", '"', "'", "ab", "AKIA", "Q2", "0f" * 6, "ſecret", "toKen", "é", "."]) for _ in range(rng.randrange(0, 14)))
        assert [s[:3] for s in S.base_spans(t)] == brute_base(t)


def test_viterbi_equals_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    moves = rng.normal(size=(3, 3))
    moves[S.OUTSIDE, S.INSIDE] = S.FORBIDDEN
    field = S.Field(rng.normal(size=(S.BUCKETS, 3)), moves)
    for goes_on in (False, True) * 30:
        emit = rng.normal(size=(int(rng.integers(1, 6)), 3))

        def worth(tags):
            return sum(e[t] + moves[a, t] for e, a, t in zip(emit, (S.OUTSIDE, *tags), tags)) + goes_on * moves[tags[-1], S.OUTSIDE]

        assert tuple(field.viterbi(emit, goes_on)) == max(itertools.product(range(3), repeat=len(emit)), key=worth)


def test_tags_equal_whole_lines_and_summed_features():
    """The bound for certain tokens cuts nothing: tags are those of Viterbi over each whole line, on weights of many sizes."""
    import numpy as np

    rng = np.random.default_rng(2)
    text = "\n".join(t for _, t, _ in rows()[:40] if t)
    shares = []
    for scale in (0.1, 0.5, 1.5):
        moves = rng.normal(size=(3, 3))
        moves[S.OUTSIDE, S.INSIDE] = S.FORBIDDEN
        weights = rng.normal(size=(S.BUCKETS, 3)) * scale
        weights[:, S.OUTSIDE] += scale / 2
        field = S.Field(weights, moves)
        tagger = S.Tagger(field)
        words, starts, lines = S.tokens_of(text)
        same, tags = tagger.tags(text)
        assert lines.tolist() == same.tolist() and all(text[a : a + len(w)] == w for w, a in zip(words, starts))
        file = S.file_features(text)
        emit = tagger.emissions(tagger.ids(words), lines, file)
        assert np.allclose(emit, np.array([weights[f].sum(axis=0) for f in S.features(words, lines, file)]))
        want = [t for n in range(lines.max() + 1) if (lines == n).any() for t in field.viterbi(emit[lines == n])]
        assert tags.tolist() == want
        shares.append(tagger.certain(emit).mean())
    assert any(0.1 < x < 1 for x in shares)


def test_training_gradient_raises_the_likelihood():
    """On a tiny chain the trained field gives its labels more of the mass of all tag sequences than an untrained one."""
    import itertools

    import numpy as np

    own, tags = [[1, 2], [3], [4, 2]], [2, 0, 1]

    def share(field):
        emit = np.array([field.weights[f].sum(axis=0) for f in own])
        worth = {t: np.exp(sum(e[x] + field.moves[a, x] for e, a, x in zip(emit, (S.OUTSIDE, *t), t))) for t in itertools.product(range(3), repeat=3)}
        return worth[tuple(tags)] / sum(worth.values())

    shares = [share(S.train([(own, tags)] * 3, rounds=r)) for r in (1, 5, 40)]
    assert shares[0] < shares[1] < shares[2] and shares[2] > 0.9


def test_field_on_held_out_lines(spark):
    data = rows()
    tagger = S.Tagger(S.fit(spark.createDataFrame(data[:200], DOCS)))
    right = total = extra = 0
    for _, text, _ in data[200:300]:
        words, starts, _ = S.tokens_of(text)
        tags = tagger.tags(text)[1]
        want = S.labels(words, starts, S.base_spans(text))
        right += sum(a == b for a, b in zip(tags, want) if b != S.OUTSIDE)
        total += sum(b != S.OUTSIDE for b in want)
        extra += sum(a != S.OUTSIDE for a, b in zip(tags, want) if b == S.OUTSIDE)
    assert total > 30 and right / total > 0.9 and extra < 0.2 * total


def test_secrets_without_digits_or_short_can_be_found(spark):
    """Any token may be tagged: where the words beside it tell, a secret of letters, a short one, and one with dots and = inside."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    made = [f'secret {rng.choice(["and", "of"])} more\npassword = {letters(rng.randrange(6, 18))} end' for _ in range(150)] + [" ".join(letters(rng.randrange(2, 9)) for _ in range(12)) for _ in range(150)]
    field = S.fit(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    tagger = S.Tagger(field)
    assert S.tokens_of("a eyJh.b-c_d/e+f== (x), k=v1.")[0] == ["a", "eyJh.b-c_d/e+f==", "(", "x", ")", ",", "k=", "v1"]
    words, _, lines = S.tokens_of("password = correcthorse end")
    emit = tagger.emissions(tagger.ids(words), lines, S.file_features("x"))
    assert emit.shape == (4, 3) and not tagger.certain(emit).all()
    assert tagger.tags("password = correcthorsebattery end")[1].tolist()[2] == S.BEGIN


def test_redaction(spark):
    df = spark.createDataFrame(rows(), DOCS)
    out = S.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["text"] is None or (not brute_base(r["text"]) and len(r["text"]) == r["n_chars"])
    assert S.redacted("a password=abcdef12 b", [(2, 19, 0, 11)], "[SECRET]") == "a password=[SECRET] b"
