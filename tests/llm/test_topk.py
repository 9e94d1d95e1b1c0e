import math
import random

import numpy as np
from pyspark.sql import functions as F

from rallyframe.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ints = {}
    for i, v, _ in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        w = [math.floor(64 * float(np.float32(c))) for c in v]
        ints[i] = min(w, ints.get(i, w))
    out = set()
    for q, x in ints.items():
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints.items() if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BATCH_QUERIES", 7)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], 1) for i in range(300)]
    rows += [(i, [0.5] * 8, 2) for i in range(300, 420)]  # many ties
    rows += [(500, None, 0), (520, [None] + [1.0] * 7, 0), (540, [float("nan")] * 8, 0), (560, [float("inf")] + [0.0] * 7, 0), (None, [1.0] * 8, 0), (580, [0.3] * 3, 0), (600, [], 0), (20, [1.0] * 8, 0), (20, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    got = topk.top_k(topk.quantized(df), F.col("id") % 20 == 0, 20)
    assert {tuple(r) for r in got.collect()} == brute(rows, 20)


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(topk.quantized(few), F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(topk.quantized(few.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 32)) * 20
    x = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(size=(4096, 32)) * 2).astype(np.int64)
    ids = np.arange(4096)
    x, ids = topk._ordered(x, ids)
    *_, scored = topk.block_search(ids[:10], x[:10], ids, x, 20)
    assert scored < 10 * 64 / 2


def test_repeated_ids_equal_the_sql(spark, monkeypatch, tmp_path):
    import duckdb

    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BATCH_QUERIES", 3)
    rng = random.Random(5)
    rows = [(i % 90, [rng.gauss(0, 0.4) for _ in range(6)], 1) for i in range(240)]
    rows += [(20, [0.5] * 6, 0), (20, [0.5] * 6, 0), (7, [1.0] * 6, 0), (7, [1.0] * 6, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.sql(queries.ORACLES["op3_top_k"]).fetchall())
    assert sorted(tuple(r) for r in queries.op3_top_k(spark, str(tmp_path)).collect()) == want
    assert len({v for _, _, v, _ in want}) < len(want)
