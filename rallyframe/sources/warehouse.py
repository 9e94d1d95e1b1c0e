"""Tables for analysts: declared, checked, partitioned by day or month, replaced whole or merged by a stored watermark.

A declaration (`TableSpec`) names a table's columns, keys, mode, watermark, partition and
cluster columns; `violations` holds declarations against the rules, and `misfits` holds a
DataFrame against its declaration, before anything is read or written.

Files: a table is partitioned by `part` (yyyy-MM-dd or yyyy-MM of the partition column), its
rows lie in the order of the cluster columns within each file, so both a filter on `part`
(which `between` derives from one on the column) and the files' minima and maxima prune reads.
`bucketed` writes a table whose joins and groupings by its bucket columns need no exchange.

Full replacement writes a new version beside the one before; the newest complete version is
the table, so readers never meet half of one.  An incremental run reads the source from an overlap
before the stored watermark to the present highest one, keeps the latest row of each key,
replaces the partitions that those keys lie in now or lay in before, and stores the new
watermark last: a run that breaks off in between is done again by the next one, with the same result.

Defined cases: rows with a null key are refused (ValueError, nothing written); of several rows with one key the
largest by (watermark, tie-breaker, all columns) stays, and never one older than the table's;
a null watermark is never read by a later run, and in the first run it counts as oldest; a null partition value has a partition of its own; an
empty source changes nothing (incremental) or empties the table (full); columns
that aren't declared are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import changed_since, first_of_each
from .staging import dropped, found, new_folder, parts_of, removed, swept, version_path, versions, written

MODES, GRAINS = ("full-replace", "incremental-merge"), {"DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM"}
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
FLAT = (*TIMES, T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)
NAME = re.compile(r"[a-z_][a-z0-9_]*")


@dataclass(frozen=True)
class Watermark:
    column: str
    tie: str
    overlap_seconds: int = 3600


@dataclass(frozen=True)
class TableSpec:
    """columns: a DDL string, with NOT NULL where nulls are refused.  file_rows: the most rows of one file, so that no write is unbounded."""

    name: str
    columns: str
    keys: tuple[str, ...]
    mode: str = "full-replace"
    watermark: Watermark | None = None
    partition: str | None = None
    grain: str = "MONTH"
    cluster: tuple[str, ...] = ()
    file_rows: int = 5_000_000

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


def violations(specs: Sequence[TableSpec]) -> list[tuple[str, str | None, str]]:
    """(table, column, what is wrong) of every rule that declarations break."""
    out = []
    for at, s in enumerate(specs):
        say = lambda column, what, s=s: out.append((s.name, column, what))
        if not NAME.fullmatch(s.name):
            say(None, "unsafe table name")
        if any(o.name == s.name for o in specs[:at]):
            say(None, "declared twice")
        if s.mode not in MODES:
            say(None, f"unknown mode {s.mode}")
        fields = {}
        for f in s.schema:
            if not NAME.fullmatch(f.name):
                say(f.name, "unsafe column name")
            if f.name.lower() in fields:
                say(f.name, "declared twice")
            if not isinstance(f.dataType, FLAT):
                say(f.name, f"unsupported type {f.dataType.simpleString()}")
            fields[f.name.lower()] = f
        if not s.keys:
            say(None, "no key")
        for role, names in (("key", s.keys), ("cluster column", s.cluster), ("partition column", (s.partition,) if s.partition else ())):
            for c in names:
                if c not in fields:
                    say(c, f"{role} is not a column")
        if s.partition in fields and not isinstance(fields[s.partition].dataType, TIMES):
            say(s.partition, "partition column is no date or timestamp")
        if s.grain not in GRAINS:
            say(s.partition, f"unknown grain {s.grain}")
        if s.file_rows < 1:
            say(None, "files without rows")
        if s.mode == "incremental-merge" and not s.watermark:
            say(None, "incremental without a watermark")
        if s.watermark:
            for role, c in (("watermark", s.watermark.column), ("tie-breaker", s.watermark.tie)):
                if c not in fields:
                    say(c, f"{role} is not a column")
            if s.watermark.column in fields and not isinstance(fields[s.watermark.column].dataType, TIMES[1:]):
                say(s.watermark.column, "watermark is no timestamp")
            if s.watermark.tie in fields and not isinstance(fields[s.watermark.tie].dataType, (T.StringType, T.IntegralType)):
                say(s.watermark.tie, "tie-breaker is no string or whole number")
            if isinstance(s.watermark.overlap_seconds, bool) or not isinstance(s.watermark.overlap_seconds, int) or s.watermark.overlap_seconds < 0:
                say(s.watermark.column, "overlap is no whole number of seconds")
    return out


def misfits(spec: TableSpec, df: DataFrame) -> list[tuple[str, str | None, str]]:
    """(table, column, what is wrong) of a DataFrame that a declaration doesn't fit: by its schema alone."""
    have = {f.name: f for f in df.schema}
    out = []
    for f in spec.schema:
        if f.name not in have:
            out.append((spec.name, f.name, "is missing"))
        elif have[f.name].dataType != f.dataType:
            out.append((spec.name, f.name, f"is {have[f.name].dataType.simpleString()}, declared {f.dataType.simpleString()}"))
    return out


def checked(spec: TableSpec, df: DataFrame | None = None) -> TableSpec:
    """The declaration, if nothing is wrong with it (nor with df under it); else a ValueError that names table and column."""
    wrong = violations([spec]) or (misfits(spec, df) if df is not None else [])
    if wrong:
        raise ValueError("; ".join(": ".join(filter(None, w)) for w in wrong))
    return spec


def part_of(spec: TableSpec, value: Column) -> Column:
    return F.coalesce(F.date_format(value, GRAINS[spec.grain]), F.lit("none"))


def _rows(spec: TableSpec, df: DataFrame) -> DataFrame:
    rows = df.select(*(f.name for f in spec.schema))
    return rows.withColumn("part", part_of(spec, F.col(spec.partition)) if spec.partition else F.lit("all"))


def _write(spec: TableSpec, rows: DataFrame, path: str, **options: str) -> None:
    """rows with their part, one set of files a part, in cluster order.  A part that is large is dealt over files by key, not one task."""
    dealt = rows.hint("rebalance", "part")
    order = ["part", *spec.cluster, *(k for k in spec.keys if k not in spec.cluster)]
    with swept(rows.sparkSession):
        dealt.sortWithinPartitions(*order).write.partitionBy("part").mode("overwrite").options(maxRecordsPerFile=spec.file_rows, **options).parquet(path)


def _stored(spec: TableSpec, spark: SparkSession, path: str) -> DataFrame:
    schema = f"{spec.columns.replace(' NOT NULL', '').replace(' not null', '')}, part string"
    if not found(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _refuse_null_keys(spec: TableSpec, rows: DataFrame) -> None:
    null = reduce(Column.__or__, (F.col(k).isNull() for k in spec.keys))
    with swept(rows.sparkSession):
        nulls = rows.where(null).count()
    if nulls:
        raise ValueError(f"{spec.name}: {nulls} rows without a key")


def replaced(spec: TableSpec, source: DataFrame, target: str) -> int:
    """Puts source in the place of the whole table; the number of the new version.  The two newest versions stay."""
    spark, rows = source.sparkSession, _rows(checked(spec, source), source)
    _refuse_null_keys(spec, rows)
    one = first_of_each(rows, list(spec.keys), [F.desc(c) for c in rows.columns if c not in spec.keys])
    done = versions(spark, target)
    new = done[-1] + 1 if done else 0
    _write(spec, one, version_path(target, new))
    for v in done[:-1]:
        removed(spark, version_path(target, v))
    return new


def watermark_of(spec: TableSpec, spark: SparkSession, target: str) -> DataFrame:
    """The stored watermark: one row of the run, the watermark column and its tie-breaker, or none."""
    w, types = spec.watermark, {f.name: f.dataType.simpleString() for f in spec.schema}
    schema = f"run long, {w.column} {types[w.column]}, {w.tie} {types[w.tie]}"
    if not found(spark, f"{target}/watermark"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/watermark").orderBy(F.desc("run")).limit(1)


def merged(spec: TableSpec, source: DataFrame, target: str) -> list[str]:
    """One incremental run; the partitions it replaced."""
    spark, w = source.sparkSession, checked(spec, source).watermark
    if spec.mode != "incremental-merge":
        raise ValueError(f"{spec.name} is not merged")
    data, rows = f"{target}/data", _rows(spec, source)
    low, high = watermark_of(spec, spark, target).first(), rows.agg(F.max(F.struct(w.column, w.tie)).alias("m")).first()["m"]
    if high is None or high[w.column] is None:
        return []
    at = lambda row, c: F.lit(row[c]).cast(spec.schema[c].dataType)
    if low is not None:  # both bounds are literals, so the scan of the source gets them
        rows = changed_since(rows, w.column, w.tie, at(low, w.column), at(high, w.column), at(high, w.tie), w.overlap_seconds)
    else:
        rows = rows.where(F.col(w.column).isNull() | (F.struct(w.column, w.tie) <= F.struct(at(high, w.column).alias(w.column), at(high, w.tie).alias(w.tie))))
    _refuse_null_keys(spec, rows)
    keys = list(spec.keys)
    order = [F.desc_nulls_last(w.column), F.desc_nulls_last(w.tie), *(F.desc(f.name) for f in spec.schema if f.name not in keys)]
    stage = written(first_of_each(rows, keys, order))
    table = _stored(spec, spark, data)
    before = table.join(stage.select(*keys), keys, "left_semi").select("part")  # keys and parts alone are read
    touched = sorted(r["part"] for r in stage.select("part").union(before).distinct().collect())  # a row a day or month
    if touched:
        old = table.where(F.col("part").isin(touched))
        new = written(first_of_each(old.unionByName(stage), keys, order))
        _write(spec, new, data, partitionOverwriteMode="dynamic")
        left = {r["part"] for r in new.select("part").distinct().collect()}
        for part in touched:
            if part not in left:
                removed(spark, f"{data}/part={part}")
        dropped(new)
    dropped(stage)
    mark = spark.range(1).select(F.lit(0 if low is None else low["run"] + 1).cast("long").alias("run"), at(high, w.column).alias(w.column), at(high, w.tie).alias(w.tie))
    mark.write.mode("append").parquet(f"{target}/watermark")
    return touched


def table_of(spec: TableSpec, spark: SparkSession, target: str) -> DataFrame:
    """The table as it is, with its part."""
    if spec.mode == "incremental-merge":
        return _stored(spec, spark, f"{target}/data")
    done = versions(spark, target)
    if not done:
        raise ValueError(f"no complete version in {target}")
    return _stored(spec, spark, version_path(target, done[-1]))


def between(spec: TableSpec, table: DataFrame, first: str, last: str) -> DataFrame:
    """Rows whose partition column lies between two days, both included; only their partitions are read."""
    days = [F.lit(x).cast("date") for x in (first, last)]
    return table.where(F.col("part").between(*(part_of(spec, d) for d in days)) & F.to_date(spec.partition).between(*days))


def bucketed(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """df as a table in buckets by columns, sorted by them: joins and groupings by all of them with tables of as many buckets need no exchange."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).option("path", new_folder(spark, "bucketed")).format("parquet").saveAsTable(name)
    return spark.table(name)


def parts(spec: TableSpec, spark: SparkSession, target: str) -> list[str]:
    """The table's partitions."""
    top = f"{target}/data" if spec.mode == "incremental-merge" else version_path(target, versions(spark, target)[-1])
    return parts_of(spark, top, "part")
