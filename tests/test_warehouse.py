"""Declared tables: rules, full replacement, incremental runs, pruning and buckets."""

import os
import random
import time
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rallyframe.sources import warehouse
from rallyframe.sources.warehouse import TableSpec, Watermark, between, bucketed, checked, merged, misfits, parts, replaced, table_of, violations

LOG = TableSpec("log", "key long NOT NULL, at timestamp, id long, value string", ("key",), "incremental-merge", Watermark("at", "id", 60), "at", "MONTH", ("value",))
START = datetime(2024, 1, 1)


def log_rows(n=200, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(40), START + timedelta(hours=7 * i), i, rng.choice("abc")) for i in range(n)]


def df_of(spark, rows, spec=LOG):
    return spark.createDataFrame(rows, spec.columns.replace(" NOT NULL", ""))


def latest(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[1], r[2]) > best[r[0]][1:3]:
            best[r[0]] = r
    return sorted(best.values())


def held(spec, spark, target):
    return sorted(tuple(r)[:-1] for r in table_of(spec, spark, target).collect())


@pytest.mark.parametrize(
    ("change", "column", "what"),
    [
        ({"name": "Log"}, None, "unsafe table name"),
        ({"mode": "sometimes"}, None, "unknown mode"),
        ({"file_rows": 0}, None, "files without rows"),
        ({"keys": ()}, None, "no key"),
        ({"keys": ("nokey",)}, "nokey", "key is not a column"),
        ({"cluster": ("gone",)}, "gone", "cluster column is not a column"),
        ({"partition": "gone"}, "gone", "partition column is not a column"),
        ({"partition": "value"}, "value", "no date or timestamp"),
        ({"grain": "WEEK"}, "at", "unknown grain"),
        ({"watermark": None}, None, "without a watermark"),
        ({"watermark": Watermark("gone", "id")}, "gone", "watermark is not a column"),
        ({"watermark": Watermark("at", "gone")}, "gone", "tie-breaker is not a column"),
        ({"watermark": Watermark("value", "id")}, "value", "watermark is no timestamp"),
        ({"watermark": Watermark("at", "at")}, "at", "tie-breaker is no string"),
        ({"watermark": Watermark("at", "id", -1)}, "at", "overlap"),
        ({"columns": "key long, at timestamp, id long, value string, `Bad Name` int"}, "Bad Name", "unsafe column name"),
        ({"columns": "key long, at timestamp, id long, value string, extra array<int>"}, "extra", "unsupported type"),
    ],
)
def test_each_violation_names_its_column(spark, change, column, what):
    found = violations([replace(LOG, **change)])
    assert any(c == column and what in w for _, c, w in found)
    with pytest.raises(ValueError, match=column or LOG.name if "name" not in change else "Log"):
        checked(replace(LOG, **change))


def test_declarations_that_are_right(spark):
    assert violations([LOG, replace(LOG, name="other")]) == []
    assert [w for *_, w in violations([LOG, LOG])] == ["declared twice"]
    assert misfits(LOG, df_of(spark, []).drop("id").withColumn("value", F.lit(1))) == [("log", "id", "is missing"), ("log", "value", "is int, declared string")]


def test_runs_over_a_growing_log_give_the_table_of_one_run(spark, tmp_path):
    rows = log_rows()
    for k, cut in enumerate((60, 61, 130, 200, 200)):
        merged(LOG, df_of(spark, rows[:cut]), f"{tmp_path}/many")
        if k == 1:  # a key that moves on leaves the month it was in
            assert held(LOG, spark, f"{tmp_path}/many") == latest(rows[:61])
    merged(LOG, df_of(spark, rows), f"{tmp_path}/one")
    assert held(LOG, spark, f"{tmp_path}/many") == held(LOG, spark, f"{tmp_path}/one") == latest(rows)
    assert merged(LOG, df_of(spark, rows), f"{tmp_path}/many") != []  # the overlap is read again and changes nothing
    assert held(LOG, spark, f"{tmp_path}/many") == latest(rows)
    assert parts(LOG, spark, f"{tmp_path}/many") == sorted({f"{r[1]:%Y-%m}" for r in latest(rows)})


def test_only_touched_partitions_are_written_again(spark, tmp_path):
    rows = [(i, START + timedelta(days=10 * i), i, "a") for i in range(12)]
    merged(LOG, df_of(spark, rows[:11]), f"{tmp_path}/t")
    files = lambda part: {p.name for p in (tmp_path / "t/data" / f"part={part}").iterdir()}
    january = files("2024-01")
    assert merged(LOG, df_of(spark, [*rows, (3, rows[11][1], 99, "b")]), f"{tmp_path}/t") == ["2024-01", "2024-04"]
    assert files("2024-01") != january  # key 3 lay there
    january = files("2024-01")
    assert merged(LOG, df_of(spark, [*rows, (50, rows[11][1], 120, "b")]), f"{tmp_path}/t") == ["2024-04"]
    assert files("2024-01") == january


def test_a_crash_before_the_watermark_loses_nothing(spark, tmp_path, monkeypatch):
    rows, target = log_rows(), f"{tmp_path}/t"
    merged(LOG, df_of(spark, rows[:100]), target)
    monkeypatch.setattr(warehouse, "dropped", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # the data is there, the watermark isn't
        merged(LOG, df_of(spark, rows[:150]), target)
    monkeypatch.undo()
    assert warehouse.watermark_of(LOG, spark, target).first()["id"] == 99
    merged(LOG, df_of(spark, rows), target)
    assert held(LOG, spark, target) == latest(rows)


def test_full_replacement_swaps_versions(spark, tmp_path):
    spec = replace(LOG, mode="full-replace", watermark=None)
    for k in range(3):
        assert replaced(spec, df_of(spark, latest(log_rows(50, k))), f"{tmp_path}/t") == k
    assert held(spec, spark, f"{tmp_path}/t") == latest(log_rows(50, 2))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v000000001", "v000000002"]
    (tmp_path / "t/v000000003").mkdir()  # a version that broke off is no version
    assert held(spec, spark, f"{tmp_path}/t") == latest(log_rows(50, 2))
    assert replaced(spec, df_of(spark, []), f"{tmp_path}/t") == 3 and held(spec, spark, f"{tmp_path}/t") == []
    with pytest.raises(ValueError, match="1 rows without a key"):
        replaced(spec, df_of(spark, [(None, START, 1, "a")]), f"{tmp_path}/t")


def test_odd_rows(spark, tmp_path):
    t = f"{tmp_path}/t"
    assert merged(LOG, df_of(spark, []), t) == []
    rows = [(1, None, 5, "a"), (2, START, None, "b"), (2, START, 1, "c"), (3, START, 2, None), (3, START, 2, "z"), (3, START, 2, "z")]
    merged(LOG, df_of(spark, rows).withColumns({"part": F.lit("x"), "Extra": F.lit(1)}), t)
    assert sorted(held(LOG, spark, t), key=str) == [(1, None, 5, "a"), (2, START, 1, "c"), (3, START, 2, "z")]
    merged(LOG, df_of(spark, [(3, START - timedelta(seconds=30), 9, "old"), (4, START + timedelta(1), 1, "n")]), t)
    assert (3, START, 2, "z") in held(LOG, spark, t)
    with pytest.raises(ValueError, match="without a key"):
        merged(LOG, df_of(spark, [(None, START + timedelta(2), 1, "n")]), t)


def test_reads_are_pruned(spark, tmp_path):
    rows = log_rows()
    merged(LOG, df_of(spark, rows), f"{tmp_path}/t")
    some = between(LOG, table_of(LOG, spark, f"{tmp_path}/t"), "2024-02-10", "2024-02-20")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "2024-02" in plan
    assert sorted(r["id"] for r in some.collect()) == sorted(r[2] for r in latest(rows) if datetime(2024, 2, 10) <= r[1] < datetime(2024, 2, 21))


def test_joins_and_groupings_by_bucket_need_no_exchange(spark):
    a = bucketed(spark.range(300).selectExpr("id % 40 as k", "id as v"), ["k"], 4)
    b = bucketed(spark.range(60).selectExpr("id as k", "id * 2 as w"), ["k"], 4)
    out = a.hint("merge").join(b, "k").groupBy("k").agg(F.sum("v").alias("v"), F.max("w").alias("w"))
    rows = {tuple(r) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("Initial Plan")[0]
    assert rows == {(k, sum(v for v in range(300) if v % 40 == k), 2 * k) for k in range(40)}


def test_files_are_bounded_and_in_cluster_order(spark, tmp_path):
    spec = replace(LOG, mode="full-replace", watermark=None, file_rows=7)
    rows = [(i, START + timedelta(days=i), i, "cab"[i % 3]) for i in range(60)]
    replaced(spec, df_of(spark, rows), f"{tmp_path}/t")
    files = list((tmp_path / "t/v000000000").glob("part=*/*.parquet"))
    each = [[r["value"] for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert sum(map(len, each)) == 60 and max(map(len, each)) == 7 and all(v == sorted(v) for v in each)


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    def files():
        tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for top in tops for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}

    rows = spark.range(1000).selectExpr("id", "id % 7 as n")
    before = files()
    warehouse.written(rows.repartition(4, "n").groupBy("id").count())
    replaced(TableSpec("numbers", "id bigint NOT NULL, n bigint", ("id",)), rows, f"{tmp_path}/numbers")
    for _ in range(20):  # they go shortly after
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before
