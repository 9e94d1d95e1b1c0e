"""Intermediate tables in the folder that driver and executors share, and what files of tables need besides."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, an own folder, on a single machine only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_rallyframe_steps", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rallyframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = sc._rallyframe_steps = f"file://{folder}"
    return named.rstrip("/")


def new_folder(spark: SparkSession, stem: str) -> str:
    """The path of a folder that isn't there yet, in the shared one."""
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


#: Removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: disk is held by the largest step, not by all that the driver hasn't collected yet."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df written and read again: lineage ends there, and a lost executor loses nothing.  by: columns that divide the files, so that a reader of some values reads no others."""
    path = new_folder(df.sparkSession, "step")
    with swept(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    at, files = _files(spark, path)
    files.delete(at, True)


def dropped(table: DataFrame) -> None:
    """Deletes a table that `written` gave and that nothing will read again."""
    removed(table.sparkSession, table._written_path)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order."""
    at, files = _files(spark, pattern)
    return sorted(m.getPath().toString() for m in files.globStatus(at) or [])


def parts_of(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of the first partition column of a table, in order."""
    return [p.rsplit(f"{column}=", 1)[1] for p in found(spark, f"{path}/{column}=*")]


def versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a table that is written as a whole each time, oldest first."""
    return sorted(int(p.rsplit("/v", 1)[1].split("/")[0]) for p in found(spark, f"{target}/v*/_SUCCESS"))


def version_path(target: str, version: int) -> str:
    return f"{target}/v{version:09d}"
