"""Writes as dataflow: deliveries, audit rows, caches, settlements and retention, each as the rows that would be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..registry import query


@query("deliveries", """
SELECT o.op, CASE WHEN o.status = 'Completed' THEN p.id ELSE NULL END AS kept_identity, CASE WHEN s.path IS NOT NULL AND o.status IN ('Copied', 'Completed') THEN 'superseded' WHEN s.path IS NULL THEN 'free' ELSE 'retained' END AS occupant, CASE WHEN o.status IN ('Copied', 'Completed') THEN 'destination' ELSE 'retained_copy' END AS role, o.status IN ('Completed', 'Duplicate') AS source_removed
FROM operations o JOIN photos p ON p.id = o.photo_id LEFT JOIN (SELECT DISTINCT path FROM observed) s ON s.path = p.dest_path WHERE o.status IN ('Copied', 'Completed', 'Duplicate')""")
def deliveries(operations: DataFrame, photos: DataFrame, observed: DataFrame) -> DataFrame:
    """What a verified transfer writes: the identity that moves along, what becomes of a recorded occupant, and its role.

    A file that was published anew proves a recorded occupant absent; one that was there already keeps its identity.
    """
    there = observed.select(F.col("path").alias("dest_path"), F.lit(True).alias("there")).distinct()
    known = photos.select(F.col("id").alias("photo_id"), "dest_path").join(there, "dest_path", "left")
    rows = operations.filter(F.col("status").isin("Copied", "Completed", "Duplicate")).join(known, "photo_id")
    created = F.col("status").isin("Copied", "Completed")
    return rows.select(
        "op", F.when(F.col("status") == "Completed", F.col("photo_id")).alias("kept_identity"), F.when(F.col("there") & created, "superseded").when(F.col("there").isNull(), "free").otherwise("retained").alias("occupant"),
        F.when(created, "destination").otherwise("retained_copy").alias("role"), F.col("status").isin("Completed", "Duplicate").alias("source_removed"),
    )


@query("audit_rows", "SELECT o.op, o.run_id, p.sha1_hash, o.status FROM operations o LEFT JOIN photos p ON p.id = o.photo_id")
def audit_rows(operations: DataFrame, photos: DataFrame) -> DataFrame:
    """The log with the content that each row was about at the time; rows of no known photo stay."""
    return operations.join(photos.select(F.col("id").alias("photo_id"), "sha1_hash"), "photo_id", "left").select("op", "run_id", "sha1_hash", "status")


@query("progress_last", "SELECT photo_id, action AS phase, max(id) AS id, arg_max(k, id) AS done FROM review_events GROUP BY 1, 2")
def progress_last(review_events: DataFrame) -> DataFrame:
    """Upserts by key, the last one winning."""
    return review_events.groupBy("photo_id", F.col("action").alias("phase")).agg(F.max("id").alias("id"), F.max_by("k", "id").alias("done"))


@query("count_cache", """
SELECT a.photo_id, count(*) FILTER (WHERE bit_count(xor(a.h, b.h)) <= 16) - 1 AS count_75, count(*) FILTER (WHERE bit_count(xor(a.h, b.h)) <= 6) - 1 AS count_90, a.photo_id IN (SELECT photo_id FROM review_events GROUP BY photo_id HAVING arg_max(action, id) = 'purchase') AS dirty FROM available a CROSS JOIN available b GROUP BY a.photo_id""")
def count_cache(match_cache: DataFrame, review_events: DataFrame) -> DataFrame:
    """The published counts of look-alikes, and which of them later changes made dirty."""
    changed = review_events.groupBy("photo_id").agg(F.max_by("action", "id").alias("last")).filter("last = 'purchase'").select("photo_id", F.lit(True).alias("changed"))
    rows = match_cache.join(changed, "photo_id", "left")
    return rows.select("photo_id", F.col("at_75").alias("count_75"), F.col("at_90").alias("count_90"), F.coalesce("changed", F.lit(False)).alias("dirty"))


@query("settled_findings", """
SELECT f.run_id, f.path, coalesce(f.settled_by, o.id) AS settled_by FROM findings f LEFT JOIN (SELECT photo_id, max(id) AS id FROM review_events WHERE action = 'purchase' GROUP BY photo_id) o ON o.photo_id = f.photo_id WHERE f.settled_by IS NOT NULL OR o.id IS NOT NULL""")
def settled_findings(findings: DataFrame, review_events: DataFrame) -> DataFrame:
    """Findings that an operation settled, by the row or by a later receipt."""
    later = review_events.filter("action = 'purchase'").groupBy("photo_id").agg(F.max("id").alias("later"))
    by = F.coalesce("settled_by", "later")
    return findings.join(later, "photo_id", "left").select("run_id", "path", by.alias("settled_by")).filter("settled_by is not null")


@query("read_receipts", "SELECT DISTINCT photo_id AS reader, k AS notice FROM review_events WHERE action IN ('view', 'click')")
def read_receipts(review_events: DataFrame) -> DataFrame:
    """Receipts only ever add up; a repeated one changes nothing."""
    return review_events.filter(F.col("action").isin("view", "click")).select(F.col("photo_id").alias("reader"), F.col("k").alias("notice")).distinct()


@query("sidecar_versions", "SELECT sha256(props) AS sha256, count(*) AS arrivals, count(DISTINCT user_id) AS owners, min(event_id) AS first, octet_length(encode(any_value(props))) AS size FROM events GROUP BY props")
def sidecar_versions(events: DataFrame) -> DataFrame:
    """Retained sidecars by content: one version however often it arrives, with its arrivals and owners."""
    per = events.groupBy(F.sha2("props", 256).alias("sha256"))
    return per.agg(F.count(F.lit(1)).alias("arrivals"), F.countDistinct("user_id").alias("owners"), F.min("event_id").alias("first"), F.max(F.octet_length("props")).cast("bigint").alias("size"))


@query("arrival_conflicts", """
SELECT user_id AS run, event_type AS path, count(*) AS arrivals, count(DISTINCT props) AS versions, CASE WHEN count(DISTINCT props) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replay' ELSE 'new' END AS verdict FROM events GROUP BY 1, 2""")
def arrival_conflicts(events: DataFrame) -> DataFrame:
    """Arrivals of one run and path must bring the same bytes: equal ones replay the first, others conflict."""
    per = events.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("arrivals"), F.countDistinct("props").alias("versions"))
    return per.withColumn("verdict", F.when(F.col("versions") > 1, "conflict").when(F.col("arrivals") > 1, "replay").otherwise("new"))


@query("verified_chain", """
, steps AS (SELECT photo_id, id, k // 10 AS before, k % 10 AS after FROM review_events), walked(photo_id, state, id, n) AS (SELECT DISTINCT photo_id, CAST(1 AS INTEGER), CAST(-1 AS BIGINT), 0 FROM steps UNION SELECT w.photo_id, CAST(s.after AS INTEGER), s.id, w.n + 1 FROM walked w JOIN steps s ON s.photo_id = w.photo_id AND s.before = w.state AND s.id > w.id)
SELECT photo_id, state, min(id) AS reached_at FROM walked WHERE id >= 0 GROUP BY 1, 2""")
def verified_chain(review_events: DataFrame) -> DataFrame:
    """The states of a picture that verified changes connect with its first one, walked in event order.

    A photo's changes are folded one after another over a set of reached states; here a state is a digit, and a change
    leads from the first digit of its number to the second.
    """
    steps = review_events.select("photo_id", F.struct("id", F.floor(F.col("k") / 10).cast("int").alias("before"), (F.col("k") % 10).cast("int").alias("after")).alias("s"))
    per = steps.groupBy("photo_id").agg(F.sort_array(F.collect_list("s")).alias("steps"))
    start = F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(-1).cast("bigint")))
    # a state's first arrival decides what it can reach later, so each state is kept once, with the least id that reached it
    walked = F.aggregate("steps", start, lambda reached, s: F.when(F.map_contains_key(reached, s["before"]) & ~F.map_contains_key(reached, s["after"]), F.map_concat(reached, F.map_from_arrays(F.array(s["after"]), F.array(s["id"])))).otherwise(reached))
    again = F.aggregate("steps", F.struct(walked.alias("reached"), F.lit(None).cast("bigint").alias("back")), lambda a, s: F.struct(a["reached"].alias("reached"), F.coalesce(a["back"], F.when((s["after"] == 1) & F.map_contains_key(a["reached"], s["before"]) & (s["id"] > a["reached"][s["before"]]), s["id"])).alias("back")))
    rows = per.select("photo_id", again.alias("w")).select("photo_id", F.col("w.back").alias("back"), F.explode("w.reached").alias("state", "reached_at"))
    at = F.when(F.col("reached_at") == -1, F.col("back")).otherwise(F.col("reached_at"))
    return rows.select("photo_id", "state", at.alias("reached_at")).filter("reached_at is not null")


@query("status_legality", f"SELECT photo_id, count(*) AS rows, count(DISTINCT status) AS statuses, bool_and(status IN {tuple([*schema.DELIVERED, 'Failed', 'Skipped', 'Duplicate', 'Pending'])!r}) AS legal FROM operations GROUP BY photo_id")
def status_legality(operations: DataFrame) -> DataFrame:
    """Whether every status that a photo's log rows carry is one that the schema allows."""
    legal = F.col("status").isin(*schema.DELIVERED, "Failed", "Skipped", "Duplicate", "Pending")
    return operations.groupBy("photo_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("status").alias("statuses"), F.bool_and(legal).alias("legal"))
