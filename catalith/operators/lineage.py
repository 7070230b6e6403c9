"""Closures over the file forest and chains of content changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.stored import kept

#: Levels of a closure that are read as tables of their own.
MOST_LEVELS = 8


def roots(origins: DataFrame, rounds: int = 41) -> DataFrame:
    """file_id, root, depth: every file's topmost origin, by pointer doubling.

    Each round joins the pointers with themselves and doubles the distance they span; it stops when no pointer moves.
    A cycle never stops moving, and is an error after `rounds`. Every round is written, so a lost executor costs a round.
    """
    up = origins.select("file_id", F.col("origin_file_id").alias("root"), F.lit(1).cast("bigint").alias("depth"))
    for spent in range(rounds + 1):
        if spent == rounds:
            raise ValueError(f"a file is its own origin, or lies deeper than 2 to the {rounds}")
        step = up.select(F.col("file_id").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = up.join(step, "root", "left").withColumn("moved", F.col("above").isNotNull())
        up = kept(joined.select("file_id", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "moved"), "lineage")
        if not up.filter("moved").limit(1).count():
            break
        up = up.drop("moved")
    return up.select("file_id", "root", "depth")


@query("lineage_roots", """
, up(file_id, root, depth) AS (SELECT file_id, origin_file_id, 1 FROM origins UNION ALL SELECT u.file_id, o.origin_file_id, u.depth + 1 FROM up u JOIN origins o ON o.file_id = u.root)
SELECT file_id, arg_max(root, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY file_id""")
def lineage_roots(origins: DataFrame) -> DataFrame:
    return roots(origins)


@query("lineage_closure", """
, down(id) AS (SELECT CAST(3 AS BIGINT) UNION SELECT o.file_id FROM down d JOIN origins o ON o.origin_file_id = d.id) SELECT id FROM down""")
def lineage_closure(origins: DataFrame, start: int = 3) -> DataFrame:
    return closure(origins, start)


def closure(origins: DataFrame, start: int | DataFrame, together: DataFrame | None = None) -> DataFrame:
    """id: a file, or several (id), everything made from them, and whatever one operation of `together` (op, file_id) joined with any of these.

    A frontier grows by a level a round and never meets a file twice. Each level is written on its own, and what was seen is read as one table of the levels, so plans don't nest.
    """
    spark = origins.sparkSession
    first = spark.range(start, start + 1).select("id") if isinstance(start, int) else start.select("id").distinct()
    frontier = kept(first, "closure")
    levels = [frontier]
    while True:
        seen = reduce(DataFrame.union, levels)
        found = origins.join(frontier, origins["origin_file_id"] == frontier["id"]).select(F.col("file_id").alias("id"))
        if together is not None:
            ops = together.join(frontier.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("op").distinct()
            found = found.union(together.join(ops, "op", "left_semi").select("file_id"))
        found = found.distinct().join(seen, "id", "left_anti")
        frontier = kept(found, "closure")
        if not frontier.limit(1).count():
            return seen
        levels.append(frontier)
        if len(levels) > MOST_LEVELS:  # a deep forest: earlier levels become one table
            levels = [kept(reduce(DataFrame.union, levels[:-1]), "closure"), frontier]


@query("lineage_assembly", """
SELECT o.origin_file_id AS id, count(*) AS made, min(p.name) AS first_name, count(DISTINCT p.sha1_hash) AS contents, coalesce(max(q.n), 0) AS operations FROM origins o JOIN photos p ON p.id = o.file_id LEFT JOIN (SELECT photo_id, count(*) AS n FROM operations GROUP BY photo_id) q ON q.photo_id = o.file_id GROUP BY 1""")
def lineage_assembly(origins: DataFrame, photos: DataFrame, operations: DataFrame) -> DataFrame:
    """What was made from each file, and how often its makings were worked on."""
    n = operations.groupBy(F.col("photo_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = origins.join(photos.select(F.col("id").alias("file_id"), "name", "sha1_hash"), "file_id").join(n, "file_id", "left")
    return rows.groupBy(F.col("origin_file_id").alias("id")).agg(F.count(F.lit(1)).alias("made"), F.min("name").alias("first_name"), F.countDistinct("sha1_hash").alias("contents"), F.coalesce(F.max("n"), F.lit(0)).alias("operations"))


@query("image_chain", """
SELECT photo_id, id, k AS after, before, coalesce(before = (k + 1) % 100, false) AS verified FROM (SELECT photo_id, id, k, lag(k) OVER (PARTITION BY photo_id ORDER BY id) AS before FROM review_events)""")
def image_chain(review_events: DataFrame) -> DataFrame:
    """Each change's state before it in event order, and whether the recorded step accounts for it."""
    from pyspark.sql import Window

    order = Window.partitionBy("photo_id").orderBy("id")
    rows = review_events.withColumn("before", F.lag("k").over(order))
    return rows.select("photo_id", "id", F.col("k").alias("after"), "before", F.coalesce(F.col("before") == (F.col("k") + 1) % 100, F.lit(False)).alias("verified"))
