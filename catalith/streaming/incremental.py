"""Incremental indexing and, as an extension, event-time windows over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query


def index_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Indexes the files that arrived since the last call: contents appended once a digest, exactly once a file.

    A batch's new digests are those that the target does not hold; the checkpoint remembers which files were read.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = batch.select(F.sha1("text").alias("sha1_hash"), "doc_id").groupBy("sha1_hash").agg(F.min("doc_id").alias("first_id"))
        try:
            held = spark.read.schema("sha1_hash string, first_id long").parquet(target)
            new = new.join(held.select("sha1_hash"), "sha1_hash", "left_anti")
        except Exception as e:  # the first batch finds no target yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by event type in tumbling windows; on a stream, rows later than the watermark are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def event_windows(events: DataFrame) -> DataFrame:
    return windowed(events)


@query("new_contents", "SELECT sha1(text) AS sha1_hash, min(doc_id) AS first_id FROM documents WHERE doc_id % 4 = 0 AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 4 <> 0) GROUP BY 1")
def new_contents(documents: DataFrame) -> DataFrame:
    """The batch form of an index step: contents of the last quarter of files that the rest does not hold."""
    rows = documents.select("doc_id", F.sha1("text").alias("sha1_hash"))
    held = rows.filter("doc_id % 4 <> 0").select("sha1_hash")
    return rows.filter("doc_id % 4 = 0").join(held, "sha1_hash", "left_anti").groupBy("sha1_hash").agg(F.min("doc_id").alias("first_id"))
