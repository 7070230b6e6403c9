"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize

#: Steps after which something is wrong: the number of steps grows with the logarithm of the longest path.
MOST_STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). node, root: every node of an edge and the least node of its component.

    Loops and repeated edges add nothing; an empty table gives an empty result; null ends are not allowed.
    Each step tells an edge the least neighbour of its end. That is aggregated map-side first and then looked up; hubs,
    whose edges would meet in one task, are looked up by a bounded broadcast. Each step's edges are written to the
    shared folder, so a lost executor costs one step at most, and deleted once the next step is written.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "cc")
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MOST_STEPS):
        # large star: a node's larger neighbours go to the least node around it
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "cc-least")
        large = lookup(both.filter("v > u"), least, ["u"], "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "cc-large")
        # small star: a node and its smaller neighbours go to the least of these
        fewer = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        small = lookup(large, fewer, ["u"], "n", large.count()).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        old, before = now, mark
        now = materialize(small, "cc")
        mark = _mark(now)
        for table in (old, least, large, fewer):
            discard(table)
        if mark == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and an order-free checksum: equal marks mean that a step changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
