"""Selections of ids as files: written with their count and digest, refused when either is off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one part of a seal.
PART_IDS = 100_000


def _digest(ids: DataFrame) -> tuple[int, str]:
    """The count, and a SHA-256 of the ids in order: of the digests of its parts, so that no array holds all ids."""
    listed = lambda row, line: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), line), ","), 256)
    part = F.floor(F.col("id") / PART_IDS).alias("part")
    per = ids.groupBy(part).agg(F.count(F.lit(1)).alias("n"), listed(F.col("id"), lambda x: x.cast("string")).alias("d"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), listed(F.struct("part", "d"), lambda x: F.concat_ws(":", x["part"].cast("string"), x["d"])).alias("d"))
    return tuple(one.first())


def write(ids: DataFrame, path: str) -> None:
    """ids: id (long), each once."""
    rows = ids.select(F.col("id").cast("long").alias("id"))
    n, digest = _digest(rows)
    if rows.distinct().count() != n:
        raise ValueError("a selection names each id once")
    rows.write.parquet(f"{path}/ids")
    rows.sparkSession.createDataFrame([(n, digest)], "n long, digest string").coalesce(1).write.parquet(f"{path}/seal")


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id long").parquet(f"{path}/ids")
    if tuple(spark.read.parquet(f"{path}/seal").first()) != _digest(rows):
        raise ValueError("the selection does not match its seal")
    return rows
