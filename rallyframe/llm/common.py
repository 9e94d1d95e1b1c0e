"""What the operators share: reading tables, words, written intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(r"[^ \t-\r]+")
#: A-Z to a-z and nothing else, for bytes.translate.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str) -> list[str]:
    """The words of a text, in order: WORD_RE.findall(text), but faster."""
    for c in "\n\r\t\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return list(filter(None, text.split(" ")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, an own one, on a single machine only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_rallyframe_dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rallyframe-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        named = sc._rallyframe_dir = f"file://{named}"
    return named.rstrip("/")


#: Removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing.

    Row order within a file is that of the partition; the files stay as long as
    the folder does, or until `unstaged`.  What the writing shuffled is not needed
    any more once it is written, so those files go at once: disk is held by the
    largest step, not by the sum of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Deletes tables that `staged` gave and that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Slots of a key's hash that a semi-join is first cut by: the bound of what is broadcast.
SLOTS = 1 << 19


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def rows_of(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of table whose key is in ids (one column of that name).

    A first cut by the slots that the ids' hashes fall into, SLOTS numbers at most whatever
    the input, leaves most other rows, with their texts, out of the shuffle.
    """
    slot = free_name(table, "slot")
    slots = F.broadcast(ids.select(_slot(key).alias(slot)).distinct())
    return table.join(slots, _slot(key) == F.col(slot), "left_semi").join(ids, key, "left_semi")


def rows_without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of table whose key is null or not in ids; only those of slots that the ids' hashes fall into are shuffled."""
    slot = free_name(table, "slot")
    slots = F.broadcast(ids.select(_slot(key).alias(slot)).distinct())
    apart = table.join(slots, _slot(key) == F.col(slot), "left_anti")
    near = table.join(slots, _slot(key) == F.col(slot), "left_semi")
    return apart.unionByName(near.join(ids, key, "left_anti"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (case aside)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
