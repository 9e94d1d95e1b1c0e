import hashlib
import random

from pyspark.sql import functions as F

from rallyframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rows():
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant", "<\\|", "<\\\\|x", "\n", "é𝒳", "hi ", "<", "|", "\\"]
    out = []
    for c in range(30):
        for t in range(rng.randrange(1, 7)):
            out.append((c, t, rng.choice(["user", "assistant", "system"]) if c % 3 else ["user", "assistant"][t % 2], "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))))
    out += [(50, 0, "user", None), (50, 1, "assistant", ""), (51, None, None, "x"), (52, 0, "a\n<|b", "y"), (53, 0, "user", "same"), (53, 0, "user", "same"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (54, 0, "user", "long " * 50_000), (54, 1, "assistant", "<|im_end|>" * 20_000)]
    out += [(60, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(3000)]
    rng.shuffle(out)
    return out


def test_read_back_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("loss", F.lit("clash")).withColumn("state", F.lit(1)).repartition(5)
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    convs = {}
    for c, t, role, text in data:
        convs.setdefault(c, []).append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert set(got) == set(convs)
    whole = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    for c, turns in convs.items():
        turns = [(role[1], text[1]) for _, role, text in sorted(turns)]
        loss = "".join(x for role, x in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[c]["text"]
        assert r["formatted_chars"] == len(text) and chat.parse(text) == turns
        assert "".join(chat.unescape(text[s["start"] : s["end"]]) for s in whole[c]["loss_spans"]) == loss
        roles = [a for a, _ in turns]
        body = roles[1:] if roles[0] == "system" else roles
        assert r["valid"] == (len(body) >= 2 and len(body) % 2 == 0 and all(x == ["user", "assistant"][i % 2] for i, x in enumerate(body)))


def test_escaped_texts_hold_no_mark_and_round_trip():
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice("<|\\ni\n") for _ in range(rng.randrange(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_empty_table(spark):
    assert chat.conversation_digests(spark.createDataFrame([], SCHEMA)).count() == 0
