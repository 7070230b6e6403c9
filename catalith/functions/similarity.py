"""Relations that look-alike operators share: hashes, available pictures, buckets, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..plans.similarity_index import neighbour_sums


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hashes(contents: DataFrame, column: str = "h62") -> DataFrame:
    return contents.filter(F.col(column).isNotNull()).select(F.col(column).alias("h")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("low").alias("h"), F.col("high").alias("other"), "distance").union(pairs.select("high", "low", "distance"))


def available(photos: DataFrame, contents: DataFrame, column: str = "h62") -> DataFrame:
    """content_id, h, photo_id: one delivered photo for each content that has a hash."""
    held = photos.filter(F.col("status").isin(*schema.DELIVERED)).groupBy("sha1_hash").agg(F.min("id").alias("photo_id"))
    return contents.filter(F.col(column).isNotNull()).join(held, "sha1_hash").select("content_id", F.col(column).alias("h"), "photo_id", "mean_brightness", "mean_gradient")


def buckets(avail: DataFrame) -> DataFrame:
    return avail.groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def count_matches(avail: DataFrame, sizes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """photo_id, at_75 to at_100: look-alikes at each threshold, its bucket's others and its neighbours' buckets, in one aggregation.

    edges: those of a kept index that reaches as far; without them buckets are added up where their tiles meet, and no pair is stored.
    """
    levels = {t: d for t, d in schema.THRESHOLDS.items() if d}
    if edges is None:
        per = neighbour_sums(sizes, list(levels.values())).withColumnsRenamed({f"s{k}": f"near_{t}" for k, t in enumerate(levels)})
    else:
        near = both_ways(edges).join(sizes.select(F.col("h").alias("other"), "n"), "other")
        per = near.groupBy("h").agg(*[F.sum(F.when(F.col("distance") <= d, F.col("n"))).alias(f"near_{t}") for t, d in levels.items()])
    out = avail.join(sizes, "h").join(per, "h", "left")
    return out.select("photo_id", *[(F.col("n") - 1 + (F.coalesce(F.col(f"near_{t}"), F.lit(0)) if d else F.lit(0))).alias(f"at_{t}") for t, d in schema.THRESHOLDS.items()])
