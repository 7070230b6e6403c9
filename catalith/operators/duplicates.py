"""Exact duplicates: representatives, normalisation, anchors, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..registry import query


def with_content(photos: DataFrame, per: DataFrame) -> DataFrame:
    """photos with what is known of their content; rows without a hash are a group of their own, as in a window."""
    per = per.withColumnRenamed("sha1_hash", "of")
    return photos.join(per, photos["sha1_hash"].eqNullSafe(per["of"])).drop("of")


@query("duplicate_counts", "SELECT id, count(*) OVER (PARTITION BY sha1_hash) - 1 AS copies FROM photos QUALIFY copies > 0")
def duplicate_counts(photos: DataFrame) -> DataFrame:
    """Photos that have other rows of the same content. Contents are counted map-side before rows meet them."""
    n = photos.groupBy("sha1_hash").agg((F.count(F.lit(1)) - 1).alias("copies")).filter("copies > 0")
    return with_content(photos, n).select("id", "copies")


@query("content_representatives", "SELECT sha1_hash, min(id) AS id, arg_min(name, id) AS name FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination') GROUP BY sha1_hash")
def content_representatives(photos: DataFrame) -> DataFrame:
    return photos.filter(F.col("status").isin(*schema.DELIVERED)).groupBy("sha1_hash").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"))


@query("exact_matches", "SELECT id, matches FROM (SELECT id, count(*) OVER (PARTITION BY sha1_hash) - 1 AS matches FROM photos WHERE status <> 'Failed') WHERE matches > 0")
def exact_matches(photos: DataFrame) -> DataFrame:
    return duplicate_counts(photos.filter("status <> 'Failed'")).withColumnRenamed("copies", "matches")


@query("normalize_duplicates", """
SELECT id, status, CASE WHEN status IN ('Pending', 'Duplicate') THEN CASE WHEN closed THEN 'Duplicate' WHEN id = keep THEN 'Pending' ELSE 'Duplicate' END ELSE status END AS new_status FROM (
  SELECT id, status, bool_or(status NOT IN ('Pending', 'Duplicate')) OVER w AS closed, coalesce(min(CASE WHEN status = 'Pending' THEN id END) OVER w, min(CASE WHEN status = 'Duplicate' THEN id END) OVER w) AS keep
  FROM photos WHERE status NOT IN ('Failed', 'Removed_Duplicate') WINDOW w AS (PARTITION BY sha1_hash))""")
def normalize_duplicates(photos: DataFrame) -> DataFrame:
    """One open row a content stays Pending unless the content is closed; all other open rows are Duplicate."""
    rows = photos.filter(F.col("status").isin(*schema.OPEN, *schema.CLOSED))
    least = lambda s: F.min(F.when(F.col("status") == s, F.col("id")))
    per = rows.groupBy("sha1_hash").agg(F.bool_or(~F.col("status").isin(*schema.OPEN)).alias("closed"), F.coalesce(least("Pending"), least("Duplicate")).alias("keep"))
    new = F.when(~F.col("status").isin(*schema.OPEN), F.col("status")).when(~F.col("closed") & (F.col("id") == F.col("keep")), "Pending").otherwise("Duplicate")
    return with_content(rows, per).select("id", "status", new.alias("new_status"))


@query("repoint_duplicates", """
SELECT d.id, a.anchor, a.dest FROM photos d JOIN (SELECT sha1_hash, min(id) AS anchor, arg_min(dest_path, id) AS dest FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination') GROUP BY sha1_hash) a USING (sha1_hash) WHERE d.status IN ('Duplicate', 'Removed_Duplicate')""")
def repoint_duplicates(photos: DataFrame) -> DataFrame:
    """Each copy with the delivered row that it points to: the one of the least id."""
    anchors = photos.filter(F.col("status").isin(*schema.DELIVERED)).groupBy("sha1_hash").agg(F.min("id").alias("anchor"), F.min_by("dest_path", "id").alias("dest"))
    return photos.filter(F.col("status").isin(*schema.COPIES)).join(anchors, "sha1_hash").select("id", "anchor", "dest")


@query("skip_reason", """
SELECT d.id, CASE WHEN a.delivered IS NOT NULL THEN 'delivered as ' || a.delivered WHEN a.rejected IS NOT NULL THEN 'rejected as ' || a.rejected ELSE 'no copy is held' END AS reason
FROM photos d LEFT JOIN (SELECT sha1_hash, min(CASE WHEN status IN ('Completed', 'Copied', 'Found_At_Destination') THEN id END) AS delivered, max(CASE WHEN status IN ('Rejected', 'Rejected_Copied') THEN id END) AS rejected FROM photos GROUP BY sha1_hash) a USING (sha1_hash)
WHERE d.status = 'Duplicate'""")
def skip_reason(photos: DataFrame) -> DataFrame:
    per = photos.groupBy("sha1_hash").agg(F.min(F.when(F.col("status").isin(*schema.DELIVERED), F.col("id"))).alias("delivered"), F.max(F.when(F.col("status").isin(*schema.IN_REJECTS), F.col("id"))).alias("rejected"))
    reason = F.when(F.col("delivered").isNotNull(), F.concat(F.lit("delivered as "), "delivered")).when(F.col("rejected").isNotNull(), F.concat(F.lit("rejected as "), "rejected")).otherwise("no copy is held")
    return photos.filter("status = 'Duplicate'").join(per, "sha1_hash", "left").select("id", reason.alias("reason"))


@query("duplicate_stats", """
SELECT count(*) AS copies, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE status = 'Duplicate') AS waiting, count(*) FILTER (WHERE status = 'Removed_Duplicate') AS removed, count(DISTINCT sha1_hash) AS contents FROM photos WHERE status IN ('Duplicate', 'Removed_Duplicate')""")
def duplicate_stats(photos: DataFrame) -> DataFrame:
    return photos.filter(F.col("status").isin(*schema.COPIES)).agg(
        F.count(F.lit(1)).alias("copies"), F.sum("file_size").alias("bytes"), F.count_if(F.col("status") == "Duplicate").alias("waiting"), F.count_if(F.col("status") == "Removed_Duplicate").alias("removed"), F.countDistinct("sha1_hash").alias("contents")
    )


@query("saved_at_destination", """
SELECT count(*) AS copies, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS saved FROM photos WHERE status IN ('Duplicate', 'Removed_Duplicate') AND sha1_hash IN (SELECT sha1_hash FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination'))""")
def saved_at_destination(photos: DataFrame) -> DataFrame:
    held = photos.filter(F.col("status").isin(*schema.DELIVERED)).select("sha1_hash").distinct()
    return photos.filter(F.col("status").isin(*schema.COPIES)).join(held, "sha1_hash", "left_semi").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("saved"))


@query("duplicates_by_folder", "SELECT camera AS folder, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM photos WHERE status IN ('Duplicate', 'Removed_Duplicate') GROUP BY 1")
def duplicates_by_folder(photos: DataFrame, root: str = "/src/") -> DataFrame:
    top = F.element_at(F.split(F.substring("source_path", len(root) + 1, 10_000), "/"), 1)
    return photos.filter(F.col("status").isin(*schema.COPIES)).groupBy(top.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


@query("insert_time_duplicates", "SELECT id, CASE WHEN id > min(id) OVER (PARTITION BY sha1_hash) THEN 'Duplicate' ELSE 'Pending' END AS at_insert FROM photos")
def insert_time_duplicates(photos: DataFrame) -> DataFrame:
    """A row whose content an earlier row holds already comes in as a duplicate."""
    first = photos.groupBy("sha1_hash").agg(F.min("id").alias("first"))
    return with_content(photos, first).select("id", F.when(F.col("id") > F.col("first"), "Duplicate").otherwise("Pending").alias("at_insert"))


@query("rejected_promotion", """
SELECT id, sha1_hash FROM (SELECT id, sha1_hash, row_number() OVER (PARTITION BY sha1_hash ORDER BY id) AS k FROM photos WHERE status = 'Removed_Duplicate' AND sha1_hash NOT IN (SELECT sha1_hash FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination'))) WHERE k = 1""")
def rejected_promotion(photos: DataFrame) -> DataFrame:
    """The first removed copy of each content that is held nowhere."""
    held = photos.filter(F.col("status").isin(*schema.DELIVERED)).select("sha1_hash")
    order = Window.partitionBy("sha1_hash").orderBy("id")
    free = photos.filter("status = 'Removed_Duplicate'").join(held, "sha1_hash", "left_anti")
    return free.withColumn("k", F.row_number().over(order)).filter("k = 1").select("id", "sha1_hash")
