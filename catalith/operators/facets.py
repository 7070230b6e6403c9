"""Counts beside a list: views, chips, timeline, types, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query


def count_where(predicates: dict) -> list:
    return [F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in predicates.items()]


@query("place_counts", """
SELECT count(*) AS every, count(*) FILTER (WHERE status IN ('Completed', 'Copied', 'Found_At_Destination')) AS organized, count(*) FILTER (WHERE status IN ('Pending', 'Processing', 'Failed')) AS unorganized,
  count(*) FILTER (WHERE status IN ('Rejected', 'Rejected_Copied')) AS rejects, count(*) FILTER (WHERE status IN ('Duplicate', 'Removed_Duplicate')) AS copies FROM photos""")
def place_counts(photos: DataFrame) -> DataFrame:
    """All views counted in one pass."""
    s = F.col("status")
    return photos.agg(*count_where({"every": F.lit(True), "organized": s.isin(*schema.DELIVERED), "unorganized": s.isin(*schema.NOT_ORGANIZED), "rejects": s.isin(*schema.IN_REJECTS), "copies": s.isin(*schema.COPIES)}))


@query("facet_chips", """
SELECT count(*) FILTER (WHERE coalesce(CAST(substr(date_taken, 1, 4) AS INTEGER) < 1800, false) AND status <> 'Failed') AS suspicious, count(*) FILTER (WHERE status <> 'Failed' AND (date_taken IS NULL OR date_source = 'file_mtime')) AS undated,
  count(*) FILTER (WHERE status <> 'Failed' AND least(width, height) < 1000) AS small, count(*) FILTER (WHERE p.id IN (SELECT photo_id FROM issues WHERE category = 'unestablished_outcome' AND NOT resolved)) AS attention
FROM photos p LEFT JOIN contents USING (sha1_hash) WHERE name LIKE '%.jpg'""")
def facet_chips(photos: DataFrame, contents: DataFrame, issues: DataFrame, ext: str = "jpg") -> DataFrame:
    """Each chip's count under the other filters that are on."""
    open_ids = issues.filter("category = 'unestablished_outcome' and not resolved").select(F.col("photo_id").alias("id"), F.lit(True).alias("open")).distinct()
    rows = photos.filter(X.extension(F.col("source_path")) == ext).join(contents.select("sha1_hash", "width", "height"), "sha1_hash", "left").join(open_ids, "id", "left")
    d, s = F.col("date_taken"), F.col("status")
    return rows.agg(*count_where({"suspicious": X.suspicious(d, s), "undated": X.undated(d, F.col("date_source"), s), "small": (s != "Failed") & (F.least("width", "height") < 1000), "attention": F.col("open")}))


@query("index_summary", """
SELECT count(*) AS indexed, count(*) FILTER (WHERE p.status = 'Pending') AS waiting, count(*) FILTER (WHERE p.status = 'Failed') AS failed, count(*) FILTER (WHERE c.h62 IS NULL) AS unknown_hash,
  count(*) FILTER (WHERE p.status IN ('Duplicate', 'Removed_Duplicate')) AS identical, CAST(sum(p.file_size) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE p.status = 'Duplicate' AND p.sha1_hash IN (SELECT sha1_hash FROM photos WHERE status = 'Pending')) AS waiting_copies FROM photos p LEFT JOIN contents c USING (sha1_hash)""")
def index_summary(photos: DataFrame, contents: DataFrame) -> DataFrame:
    waiting = photos.filter("status = 'Pending'").select("sha1_hash", F.lit(True).alias("has_waiting")).distinct()
    s = F.col("status")
    rows = photos.join(contents.select("sha1_hash", "h62"), "sha1_hash", "left").join(waiting, "sha1_hash", "left")
    named = {"indexed": F.lit(True), "waiting": s == "Pending", "failed": s == "Failed", "unknown_hash": F.col("h62").isNull(), "identical": s.isin(*schema.COPIES)}
    return rows.agg(*count_where(named), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), *count_where({"waiting_copies": (s == "Duplicate") & F.col("has_waiting")}))


@query("timeline_months", "SELECT coalesce(substr(date_taken, 1, 7), 'undated') AS month, count(*) AS n FROM photos GROUP BY 1")
def timeline_months(photos: DataFrame) -> DataFrame:
    return photos.groupBy(F.coalesce(F.substring("date_taken", 1, 7), F.lit("undated")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("types_histogram", r"SELECT regexp_extract(name, '\.([^.]*)$', 1) AS type, count(*) AS n FROM photos WHERE status <> 'Failed' GROUP BY 1")
def types_histogram(photos: DataFrame) -> DataFrame:
    return photos.filter("status <> 'Failed'").groupBy(X.extension(F.col("source_path")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_status", "SELECT status, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE date_taken IS NULL) AS held FROM photos GROUP BY status")
def catalog_status(photos: DataFrame) -> DataFrame:
    return photos.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"), F.count_if(F.col("date_taken").isNull()).alias("held"))


@query("action_counts", """
SELECT count(*) FILTER (WHERE status = 'Pending') AS copy_ready, count(*) FILTER (WHERE status IN ('Pending', 'Copied', 'Rejected_Copied')) AS move_ready,
  count(*) FILTER (WHERE status IN ('Completed', 'Copied', 'Found_At_Destination')) AS rejectable, count(*) FILTER (WHERE status IN ('Rejected', 'Rejected_Copied')) AS returnable FROM photos""")
def action_counts(photos: DataFrame) -> DataFrame:
    s = F.col("status")
    return photos.agg(*count_where({"copy_ready": s.isin(*schema.ELIGIBLE["COPY"]), "move_ready": s.isin(*schema.ELIGIBLE["MOVE"]), "rejectable": s.isin(*schema.DELIVERED), "returnable": s.isin(*schema.IN_REJECTS)}))


@query("folder_tree", """
SELECT folder, count(*) AS photos, count(*) FILTER (WHERE status = 'Pending') AS copy_ready, count(*) FILTER (WHERE status IN ('Pending', 'Copied', 'Rejected_Copied')) AS move_ready, count(*) FILTER (WHERE own) AS top_files
FROM (SELECT status, unnest(['/src', '/src/' || camera, '/src/' || camera || '/' || lens]) AS folder, unnest([false, false, true]) AS own FROM photos) GROUP BY folder""")
def folder_tree(photos: DataFrame) -> DataFrame:
    """Every ancestor folder with its photos, counted downwards. Depth bounds the explode; counts combine map-side."""
    parts = F.split(X.folder(F.col("source_path")), "/")
    rows = photos.select("status", parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.size(parts))).alias("k"))
    rows = rows.select("status", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("folder"), (F.col("k") == F.size("parts")).alias("own"))
    s = F.col("status")
    return rows.groupBy("folder").agg(*count_where({"photos": F.lit(True), "copy_ready": s.isin(*schema.ELIGIBLE["COPY"]), "move_ready": s.isin(*schema.ELIGIBLE["MOVE"]), "top_files": F.col("own")}))


@query("rejects_summary", """
SELECT count(*) AS rejected, count(*) FILTER (WHERE status = 'Rejected_Copied') AS copied, CAST(sum(file_size) AS BIGINT) AS bytes, min(last) AS oldest
FROM photos p LEFT JOIN (SELECT photo_id, max(created_at) AS last FROM review_events WHERE action = 'error' GROUP BY photo_id) r ON r.photo_id = p.id WHERE status IN ('Rejected', 'Rejected_Copied')""")
def rejects_summary(photos: DataFrame, review_events: DataFrame) -> DataFrame:
    """What lies in the rejects, and since when the longest: the least of each photo's latest rejection."""
    last = review_events.filter("action = 'error'").groupBy(F.col("photo_id").alias("id")).agg(F.max("created_at").alias("last"))
    rows = photos.filter(F.col("status").isin(*schema.IN_REJECTS)).join(last, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.col("status") == "Rejected_Copied").alias("copied"), F.sum("file_size").alias("bytes"), F.min("last").alias("oldest"))


@query("name_clash_labels", r"""
SELECT p.id, p.label FROM (SELECT id, sha1_hash, right(name, 6) AS label FROM photos) p WHERE label IN (SELECT right(name, 6) FROM photos GROUP BY 1 HAVING count(DISTINCT sha1_hash) > 1)""")
def name_clash_labels(photos: DataFrame) -> DataFrame:
    """Photos whose short name stands for more than one content."""
    rows = photos.select("id", "sha1_hash", F.expr("right(name, 6)").alias("label"))
    clash = rows.groupBy("label").agg(F.min("sha1_hash").alias("a"), F.max("sha1_hash").alias("b")).filter("a <> b").select("label")
    return rows.join(clash, "label", "left_semi").select("id", "label")
