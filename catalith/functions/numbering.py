"""Row numbers in large groups: a group is cut into ranges of ids, so that no task orders more than a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a range.
WIDTH = 1_000_000


def numbered(rows: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """Adds k: a row's number, from 1, in order of id among the rows of equal `by` (none of it null).

    Ranges are counted first, map-side; a number is its place in its range added to what lies before that range.
    """
    rows = rows.withColumn("_range", F.floor(F.col("id") / width))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_range").orderBy("id")
    placed = rows.withColumn("k", F.row_number().over(inside)).join(counts, [*by, "_range"])
    return placed.withColumn("k", F.col("k") + F.col("_ahead")).drop("_range", "_ahead")
