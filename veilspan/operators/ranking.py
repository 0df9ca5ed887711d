"""Dense positions in a sorted table, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.scratch import Scratch

#: A group of so many rows may be numbered by a window.
WINDOW_ROWS = 200_000


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, rows_per_group: int) -> DataFrame:
    """Adds name: 0-based position inside the group."""
    if rows_per_group <= WINDOW_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows_per_group // WINDOW_ROWS)
    return _dense(df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order), group, name)


def in_order(df: DataFrame, name: str) -> DataFrame:
    """Adds name: 0-based position in the order of the source's partitions and rows."""
    return _dense(df, [], name)


def _dense(df: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Positions from a row's place in its partition and the numbers of rows in the partitions before.

    Rows are written once with their places, as these don't outlive a rerun; there are as many counts as partitions
    times the groups that each of them holds a part of.
    """
    held = Scratch(df.sparkSession, "ranked").save(df.withColumn("_mid", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_mid", 33)
    counts = held.groupBy(*group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    both = held.withColumn("_part", part).join(F.broadcast(counts), [*group, "_part"])
    return both.withColumn(name, (F.col("_mid") - F.col("_first") + F.col("_before")).cast("bigint")).drop("_part", "_mid", "_first", "_before")
