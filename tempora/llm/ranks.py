"""Ranks of rows in a group without the group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: list[str], cell: str, order: list[str], rank: str, total: str) -> DataFrame:
    """Rank from 0 by ``cell``, then ``order``, within ``group``, and the group's size.

    ``cell`` cuts a group into ranges: rows are counted in each and sorted only
    inside one.  Neither may be null.
    """
    counts = rows.groupBy(*group, cell).agg(F.count("*").alias("_in_cell"))
    over = Window.partitionBy(*group)
    before = over.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group,
        cell,
        F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_start"),
        F.sum("_in_cell").over(over).alias(total),
    )
    inside = Window.partitionBy(*group, cell).orderBy(*order)
    place = F.col("_start") + F.row_number().over(inside) - 1
    return rows.join(starts, [*group, cell]).withColumn(rank, place).drop("_start", cell)
