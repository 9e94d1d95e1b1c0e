"""The thin queries and the pipeline on a small fixture in the shape of the shared tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rallyframe.llm import secret_scan
from rallyframe.llm.queries import ORACLES, QUERIES

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    parts = ["the", "and", "of", "thing", "er", "on", "re", "sha", "é", "reed", "ist"]
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(3))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(14)) + "." for _ in range(n))
    docs = [(i, prose(rng.randrange(3, 9)), "en", f"src{i % 3}") for i in range(60)]
    docs += [(60 + i, docs[i][1], "en", "src0") for i in range(5)]
    docs += [(70 + i, docs[i + 9][1].replace("the ", "they ", 1), "en", "src0") for i in range(5)]
    docs += [(80 + i, " ".join(w.upper() + "!!" for w in prose(4).split()), "en", "src0") for i in range(5)]
    docs += [(90, prose(3) + "\npassword=0123456789abcdef01 end of it.", "en", "src0"), (91, None, None, None), (92, "", "en", "src1")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 0.2) for _ in range(8)], 0) for i in range(100)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://www.{rng.choice(['a.com', 'example.com', 'b.net'])}/{rng.choice(['en', 'de'])}/{i}?x", "") for i in range(50)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i // 2, i % 2, ["user", "assistant"][i % 2], prose(1)) for i in range(40)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


def test_pipeline_stages_equal_their_parts(spark, sf):
    """Each stage on its own input, against what its operator's own tests hold against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, inputs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append({(r["doc_id"], r["text"]) for r in docs.collect()} if "text" in docs.columns else None)
        last = docs
        docs = corpus_pipeline.staged(stage(spark, docs, sf))
        if stage is not corpus_pipeline.packed:
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    raw, good, lines, single, clean = inputs
    assert good < raw and not any(80 <= d < 92 and d != 90 for d, _ in good)
    assert {d for d, _ in lines} <= {d for d, _ in good} and len({d for d, _ in single}) == len(single)
    assert not any(secret_scan.base_spans(t) for _, t in clean) and any("[SECRET]" in t for _, t in clean)
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in last.collect()}
    assert docs.columns == QUERIES["op9_packing"](spark, sf).columns
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_quality_rules", "op4_sentencepiece", "op5_lm_scores", "op10_secret_scan", "op12_fingerprints"])
def test_whole_tables(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, sf, stage):
    """No rows; columns with names that operators use inside; texts of more than a megabyte among short ones."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert stage(spark, docs.limit(0), sf).count() == 0
    odd = {c: F.lit(1) for c in ("slot", "id", "line", "n", "words", "kept", "component", "start", "Key")}
    long = spark.createDataFrame([(900, "a word or two of it\n" * 60_000, "en", "src0", 1_200_000)], docs.schema)
    some = docs.where("doc_id < 12 or doc_id > 88").unionByName(long).withColumns(odd)
    out = corpus_pipeline.staged(stage(spark, some, sf))
    if stage is not corpus_pipeline.packed:
        assert out.columns == some.columns
    else:
        assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in some.select("doc_id").collect()}
