"""Integrity checks: what a walk of the destination found against what the catalog expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query

CHECK_SQL = """
SELECT coalesce(e.path, o.path) AS path, e.id, e.sha1_hash AS expected, o.sha1_hash AS observed, o.size, CASE WHEN o.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unknown' WHEN e.sha1_hash = o.sha1_hash THEN 'ok' ELSE 'changed' END AS kind
FROM (SELECT id, dest_path AS path, sha1_hash FROM photos WHERE dest_path IS NOT NULL) e FULL JOIN observed o ON o.path = e.path"""


@query("destination_check", CHECK_SQL)
def destination_check(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Every expected or found path: ok, missing, changed or unknown."""
    e = photos.filter("dest_path is not null").select("id", F.col("dest_path").alias("path"), F.col("sha1_hash").alias("expected"))
    rows = e.join(observed.withColumnRenamed("sha1_hash", "observed"), "path", "full")
    kind = F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "unknown").when(F.col("expected") == F.col("observed"), "ok").otherwise("changed")
    return rows.select("path", "id", "expected", "observed", "size", kind.alias("kind"))


@query("unknown_kind", f"""
SELECT path, CASE WHEN size = 0 THEN 'empty' WHEN ext = '' THEN 'unrecognised' WHEN ext NOT IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'cr2', 'nef', 'arw', 'dng') THEN 'other_type' ELSE 'photo' END AS file_kind
FROM (SELECT path, size, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM ({CHECK_SQL}) WHERE kind = 'unknown')""")
def unknown_kind(photos: DataFrame, observed: DataFrame) -> DataFrame:
    ext = X.extension(F.col("path"))
    kind = F.when(F.col("size") == 0, "empty").when(ext == "", "unrecognised").when(~ext.isin(*schema.RASTER, *schema.RAW), "other_type").otherwise("photo")
    return destination_check(photos, observed).filter("kind = 'unknown'").select("path", kind.alias("file_kind"))


@query("locate_missing", f"""
SELECT m.id, m.path, min(u.path) AS found, count(*) AS places FROM ({CHECK_SQL}) m JOIN ({CHECK_SQL}) u ON u.observed = m.expected AND u.kind = 'unknown' WHERE m.kind = 'missing' GROUP BY 1, 2""")
def locate_missing(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Where the content of a missing file turned up; the first path wins."""
    rows = destination_check(photos, observed)
    places = rows.filter("kind = 'unknown'").groupBy(F.col("observed").alias("expected")).agg(F.min("path").alias("found"), F.count(F.lit(1)).alias("places"))
    return rows.filter("kind = 'missing'").join(places, "expected").select("id", "path", "found", "places")


@query("detect_renames", f"""
SELECT m.id, m.path AS before, u.path AS after FROM ({CHECK_SQL}) m JOIN (SELECT *, count(*) OVER (PARTITION BY observed) AS n FROM ({CHECK_SQL}) WHERE kind = 'unknown') u ON u.observed = m.expected AND u.n = 1 AND regexp_extract(u.path, '^(.*)/[^/]*$', 1) = regexp_extract(m.path, '^(.*)/[^/]*$', 1) WHERE m.kind = 'missing'""")
def detect_renames(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """A missing file and the only unknown of its content in the same folder."""
    rows = destination_check(photos, observed)
    once = rows.filter("kind = 'unknown'").groupBy(F.col("observed").alias("expected")).agg(F.min("path").alias("after"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    found = rows.filter("kind = 'missing'").join(once, "expected").filter(X.folder(F.col("after")) == X.folder(F.col("path")))
    return found.select("id", F.col("path").alias("before"), "after")


@query("unknown_groups", f"SELECT observed, count(*) AS paths, observed IN (SELECT sha1_hash FROM photos) AS known FROM ({CHECK_SQL}) WHERE kind = 'unknown' GROUP BY observed HAVING count(*) > 1 OR observed IN (SELECT sha1_hash FROM photos)")
def unknown_groups(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Unknown contents that stand in several places or that the catalog knows."""
    held = photos.select(F.col("sha1_hash").alias("observed"), F.lit(True).alias("known")).distinct()
    per = destination_check(photos, observed).filter("kind = 'unknown'").groupBy("observed").agg(F.count(F.lit(1)).alias("paths"))
    return per.join(held, "observed", "left").withColumn("known", F.coalesce("known", F.lit(False))).filter("paths > 1 or known")


@query("check_report", f"""
SELECT lost, damaged, attention, CASE WHEN lost > 0 OR damaged > 0 THEN 'bad' WHEN attention > 0 THEN 'warn' ELSE 'plain' END AS tone FROM (
  SELECT count(*) FILTER (WHERE kind = 'missing' AND NOT coalesce(expected IN (SELECT observed FROM ({CHECK_SQL}) WHERE kind = 'unknown'), false)) AS lost, count(*) FILTER (WHERE kind = 'changed') AS damaged, count(*) FILTER (WHERE kind = 'unknown') AS attention FROM ({CHECK_SQL}))""")
def check_report(photos: DataFrame, observed: DataFrame) -> DataFrame:
    rows = destination_check(photos, observed)
    seen = rows.filter("kind = 'unknown'").select(F.col("observed").alias("expected"), F.lit(True).alias("elsewhere")).distinct()
    k = F.col("kind")
    out = rows.join(seen, "expected", "left").agg(F.count_if((k == "missing") & F.col("elsewhere").isNull()).alias("lost"), F.count_if(k == "changed").alias("damaged"), F.count_if(k == "unknown").alias("attention"))
    return out.withColumn("tone", F.when((F.col("lost") > 0) | (F.col("damaged") > 0), "bad").when(F.col("attention") > 0, "warn").otherwise("plain"))


@query("missing_folder_groups", f"""
SELECT folder, count(*) AS missing, CASE WHEN count(DISTINCT to_folder) = 1 AND count(to_folder) = count(*) THEN min(to_folder) END AS moved_to FROM (
  SELECT m.path, regexp_extract(m.path, '^(.*)/[^/]*$', 1) || '/' || m.id % 5 AS folder, regexp_extract(u.found, '^(.*)/[^/]*$', 1) AS to_folder FROM ({CHECK_SQL}) m LEFT JOIN (SELECT observed, min(path) AS found FROM ({CHECK_SQL}) WHERE kind = 'unknown' GROUP BY 1) u ON u.observed = m.expected WHERE m.kind = 'missing') GROUP BY folder""")
def missing_folder_groups(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing files by folder, and where the whole folder went if all its files turned up in one other."""
    rows = destination_check(photos, observed)
    places = rows.filter("kind = 'unknown'").groupBy(F.col("observed").alias("expected")).agg(X.folder(F.min("path")).alias("to_folder"))
    miss = rows.filter("kind = 'missing'").join(places, "expected", "left").withColumn("folder", F.concat(X.folder(F.col("path")), F.lit("/"), (F.col("id") % 5).cast("string")))
    whole = (F.count("to_folder") == F.count(F.lit(1))) & (F.min("to_folder") == F.max("to_folder"))
    return miss.groupBy("folder").agg(F.count(F.lit(1)).alias("missing"), F.when(whole, F.min("to_folder")).alias("moved_to"))


@query("repair_plan", f"""
SELECT m.path, CASE WHEN m.kind = 'changed' THEN 'keep_new' WHEN u.found IS NULL THEN 'advice' WHEN u.found LIKE '/dst/moved/%' THEN 'move_back' ELSE 'copy_back' END AS fix FROM ({CHECK_SQL}) m LEFT JOIN (SELECT observed, min(path) AS found FROM ({CHECK_SQL}) WHERE kind = 'unknown' GROUP BY 1) u ON m.kind = 'missing' AND u.observed = m.expected WHERE m.kind IN ('missing', 'changed')""")
def repair_plan(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """What would repair each finding; a plan, nothing is moved."""
    rows = destination_check(photos, observed)
    places = rows.filter("kind = 'unknown'").groupBy(F.col("observed").alias("expected")).agg(F.min("path").alias("found"))
    out = rows.filter(F.col("kind").isin("missing", "changed")).join(places, "expected", "left")
    fix = F.when(F.col("kind") == "changed", "keep_new").when(F.col("found").isNull(), "advice").when(F.col("found").startswith("/dst/moved/"), "move_back").otherwise("copy_back")
    return out.select("path", fix.alias("fix"))


GONE_FOLDER_SQL = """
SELECT p.id, CASE WHEN NOT EXISTS (SELECT 1 FROM photos q WHERE q.camera = p.camera AND (q.dest_path IS NULL OR q.dest_path IN (SELECT path FROM observed))) THEN '/src/' || camera
  WHEN NOT EXISTS (SELECT 1 FROM photos q WHERE q.camera = p.camera AND q.lens = p.lens AND (q.dest_path IS NULL OR q.dest_path IN (SELECT path FROM observed))) THEN '/src/' || camera || '/' || lens END AS gone FROM photos p WHERE dest_path IS NOT NULL AND dest_path NOT IN (SELECT path FROM observed)"""


@query("gone_folder", GONE_FOLDER_SQL)
def gone_folder(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """The outermost folder of each file that a walk did not meet, where no file left holds that folder."""
    parts = F.split(X.folder(F.col("source_path")), "/")
    up = lambda df: df.select("id", F.explode(F.sequence(F.lit(3), F.size(parts))).alias("k"), parts.alias("parts")).select("id", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("folder"))
    there = observed.select(F.col("path").alias("dest_path"), F.lit(True).alias("there")).distinct()
    rows = photos.join(there, "dest_path", "left")
    lost = rows.filter("dest_path is not null and there is null")
    left = up(rows.filter("dest_path is null or there")).select("folder").distinct()
    gone = up(lost).join(left, "folder", "left_anti").groupBy("id").agg(F.min_by("folder", "k").alias("gone"))
    return lost.select("id").join(gone, "id", "left")


VANISHED_SQL = """
SELECT id, CASE WHEN sha1_hash IN (SELECT sha1_hash FROM observed) THEN 'Found_At_Destination' ELSE 'Failed' END AS outcome FROM photos
WHERE status IN ('Completed', 'Copied', 'Found_At_Destination') AND dest_path NOT IN (SELECT path FROM observed)"""


@query("vanished", VANISHED_SQL)
def vanished(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Every settled photo that a walk did not meet at its place: its content found elsewhere there, or failed."""
    lost = photos.filter(F.col("status").isin(*schema.DELIVERED) & F.col("dest_path").isNotNull()).join(observed.select(F.col("path").alias("dest_path")), "dest_path", "left_anti")
    held = observed.select("sha1_hash", F.lit(True).alias("held")).distinct()
    return lost.join(held, "sha1_hash", "left").select("id", F.when(F.col("held"), "Found_At_Destination").otherwise("Failed").alias("outcome"))


@query("reconcile_outcomes", """
SELECT op, CASE WHEN s = 'unreadable' OR d = 'unreadable' OR (s = 'absent' AND d = 'absent') OR d = 'mismatch' THEN 'Failed' WHEN d = 'match' AND s = 'absent' THEN 'Completed' WHEN d = 'match' THEN 'Pending/incomplete' ELSE 'Pending/not_started' END AS outcome
FROM (SELECT op, source_state AS s, dest_state AS d FROM ends WHERE status = 'Pending')""")
def reconcile_outcomes(ends: DataFrame) -> DataFrame:
    """Interrupted operations settled by a decision table over the states of both sides."""
    s, d = F.col("source_state"), F.col("dest_state")
    failed = (s == "unreadable") | (d == "unreadable") | ((s == "absent") & (d == "absent")) | (d == "mismatch")
    outcome = F.when(failed, "Failed").when((d == "match") & (s == "absent"), "Completed").when(d == "match", "Pending/incomplete").otherwise("Pending/not_started")
    return ends.filter("status = 'Pending'").select("op", outcome.alias("outcome"))


@query("ranked_findings", f"""
SELECT path, kind, k FROM (SELECT path, kind, row_number() OVER (PARTITION BY kind ORDER BY path) AS k FROM ({CHECK_SQL}) WHERE kind <> 'ok') WHERE k <= 20""")
def ranked_findings(photos: DataFrame, observed: DataFrame, most: int = 20) -> DataFrame:
    """The first findings of each kind, for a report's head."""
    order = Window.partitionBy("kind").orderBy("path")
    return destination_check(photos, observed).filter("kind <> 'ok'").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("path", "kind", "k")
