"""Scans and merges as dataflow: change detection, upserts as latest-per-key, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query


@query("change_detection", """
SELECT p.id, CASE WHEN o.path IS NULL THEN 'absent' WHEN o.size = p.file_size AND o.sha1_hash = p.sha1_hash THEN 'unchanged' ELSE 'to_scan' END AS verdict FROM photos p LEFT JOIN observed o ON o.path = p.dest_path WHERE p.dest_path IS NOT NULL""")
def change_detection(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Which known files a walk need not read again."""
    rows = photos.filter("dest_path is not null").join(observed.select(F.col("path").alias("dest_path"), "size", F.col("sha1_hash").alias("seen")), "dest_path", "left")
    return rows.select("id", F.when(F.col("seen").isNull(), "absent").when((F.col("size") == F.col("file_size")) & (F.col("seen") == F.col("sha1_hash")), "unchanged").otherwise("to_scan").alias("verdict"))


@query("discovery_accounting", r"""
SELECT ext, count(*) AS found, count(*) FILTER (WHERE ext IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'cr2', 'nef', 'arw', 'dng')) AS eligible, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT regexp_extract(path, '\.([^./]*)$', 1) AS ext, size FROM observed) GROUP BY ext""")
def discovery_accounting(observed: DataFrame) -> DataFrame:
    ext = X.extension(F.col("path"))
    return observed.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("found"), F.count_if(ext.isin(*schema.RASTER, *schema.RAW)).alias("eligible"), F.sum("size").alias("bytes"))


@query("content_upsert", """
SELECT photo_id, arg_max(k, id) FILTER (WHERE k >= 10) AS k, arg_max(action, id) FILTER (WHERE action <> 'error') AS action, max(id) AS last FROM review_events GROUP BY photo_id""")
def content_upsert(review_events: DataFrame) -> DataFrame:
    """Per key and column the newest value that says something: a later, poorer row erases nothing."""
    known = lambda c, p: F.max_by(F.when(p, F.col(c)), F.when(p, F.col("id"))).alias(c)
    return review_events.groupBy("photo_id").agg(known("k", F.col("k") >= 10), known("action", F.col("action") != "error"), F.max("id").alias("last"))


@query("first_and_current_observation", "SELECT photo_id, min(id) AS first, arg_min(action, id) AS first_action, max(id) AS current, arg_max(action, id) AS current_action, count(*) AS observations FROM review_events GROUP BY photo_id")
def first_and_current(review_events: DataFrame) -> DataFrame:
    return review_events.groupBy("photo_id").agg(
        F.min("id").alias("first"), F.min_by("action", "id").alias("first_action"), F.max("id").alias("current"), F.max_by("action", "id").alias("current_action"), F.count(F.lit(1)).alias("observations")
    )


@query("live_path_violations", "SELECT camera || '/' || lens || '/' || (id % 100) AS path, count(*) AS rows FROM photos WHERE status NOT IN ('Removed_Duplicate', 'Rejected_Emptied') GROUP BY 1 HAVING count(*) > 1")
def live_path_violations(photos: DataFrame) -> DataFrame:
    """Live paths that more than one row claims (here paths are cut short so that some clash)."""
    path = F.concat_ws("/", "camera", "lens", (F.col("id") % 100).cast("string"))
    live = photos.filter(~F.col("status").isin("Removed_Duplicate", "Rejected_Emptied"))
    return live.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


@query("open_issues", "SELECT photo_id, category FROM issues WHERE NOT resolved AND photo_id NOT IN (SELECT photo_id FROM review_events WHERE action = 'purchase')")
def open_issues(issues: DataFrame, review_events: DataFrame) -> DataFrame:
    """Issues that neither their row nor a later event resolved."""
    done = review_events.filter("action = 'purchase'").select("photo_id")
    return issues.filter("not resolved").join(done, "photo_id", "left_anti").select("photo_id", "category")


@query("settings_conflicts", "SELECT photo_id, count(*) FILTER (WHERE k <> r) AS conflicts, count(*) AS patches FROM (SELECT photo_id, k % 3 AS k, (row_number() OVER (PARTITION BY photo_id ORDER BY id) - 1) % 3 AS r FROM review_events) GROUP BY photo_id")
def settings_conflicts(review_events: DataFrame) -> DataFrame:
    """Patches whose expected revision is not the one they meet."""
    from pyspark.sql import Window

    r = (F.row_number().over(Window.partitionBy("photo_id").orderBy("id")) - 1) % 3
    return review_events.withColumn("r", r).groupBy("photo_id").agg(F.count_if(F.col("k") % 3 != F.col("r")).alias("conflicts"), F.count(F.lit(1)).alias("patches"))


@query("answer_fanout", "SELECT p.id, a.action AS answer FROM photos p JOIN (SELECT q.sha1_hash, arg_max(r.action, r.id) AS action FROM review_events r JOIN photos q ON q.id = r.photo_id GROUP BY q.sha1_hash) a USING (sha1_hash)")
def answer_fanout(photos: DataFrame, review_events: DataFrame) -> DataFrame:
    """The newest answer on any copy of a content holds for all its copies."""
    per = review_events.join(photos.select(F.col("id").alias("photo_id"), "sha1_hash"), "photo_id").groupBy("sha1_hash").agg(F.max_by("action", review_events["id"]).alias("answer"))
    return photos.join(per, "sha1_hash").select("id", "answer")
