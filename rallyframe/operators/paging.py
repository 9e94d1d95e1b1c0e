"""Two shapes of one page: a fast one that knows if more follows, and an exact one that knows the total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fast_page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """The page's rows, their place in it and has_more, by one row of look-ahead: nothing is counted, each task keeps offset + limit + 1 rows."""
    ahead = rows.orderBy(*order).limit(offset + limit + 1).offset(offset)
    place = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows
    return ahead.withColumns({"place": place, "has_more": F.count("*").over(Window.partitionBy()) > limit}).where(F.col("place") <= limit)


def exact_page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """The page's rows, their place in it, the total and has_more, from one scan.

    Each task orders its own rows, and hands on the first offset + limit of them with its count; counts
    are summed over one row a task.  A page beyond the end has no rows.
    """
    own = Window.partitionBy("_task")
    dealt = rows.withColumn("_task", F.spark_partition_id()).withColumns({"_at": F.row_number().over(own.orderBy(*order)), "_n": F.count("*").over(own)})
    few = dealt.where(F.col("_at") <= offset + limit)
    every = Window.partitionBy()  # over offset + limit rows a task at most
    few = few.withColumns({"total": F.sum(F.when(F.col("_at") == 1, F.col("_n"))).over(every), "place": F.row_number().over(Window.orderBy(*order)) - offset})
    page = few.where((F.col("place") > 0) & (F.col("place") <= limit))
    return page.withColumn("has_more", F.lit(offset) + limit < F.col("total")).drop("_task", "_at", "_n")
