"""The operation log and the runs: filters, facets, exports, verdicts, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as X
from ..registry import query


@query("oplog_page", "SELECT op, run_id, photo_id, o.status, r.mode FROM operations o LEFT JOIN runs r ON r.id = o.run_id WHERE o.status IN ('Failed', 'Copied') AND timestamp >= TIMESTAMP '1995-01-01' AND timestamp < TIMESTAMP '1996-01-01' ORDER BY run_id DESC, op LIMIT 100")
def oplog_page(operations: DataFrame, runs: DataFrame, size: int = 100) -> DataFrame:
    """A page of the log, newest run first; rows without a run survive."""
    rows = operations.filter(F.col("status").isin("Failed", "Copied") & (F.col("timestamp") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("timestamp") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return rows.join(runs.select(F.col("id").alias("run_id"), "mode"), "run_id", "left").select("op", "run_id", "photo_id", "status", "mode").orderBy(F.desc("run_id"), "op").limit(size)


STATUS_FACETS_SQL = "SELECT status, count(*) AS n FROM operations GROUP BY status"


@query("oplog_status_facets", STATUS_FACETS_SQL)
def oplog_status_facets(operations: DataFrame) -> DataFrame:
    """Counts by status under every filter but the status itself: here over the whole log."""
    return operations.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("oplog_run_facets", "SELECT run_id, count(*) AS n FROM operations WHERE status = 'Failed' GROUP BY run_id")
def oplog_run_facets(operations: DataFrame) -> DataFrame:
    return operations.filter("status = 'Failed'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("oplog_export", "SELECT op, CASE WHEN regexp_matches(cell, '^[=+@-]') THEN '''' || cell ELSE cell END AS cell, message FROM (SELECT op, message, CASE WHEN photo_id % 3 = 0 THEN '=' || status ELSE status END AS cell FROM operations WHERE status = 'Failed')")
def oplog_export(operations: DataFrame) -> DataFrame:
    """The log's rows as they are exported: cells that a spreadsheet would run are quoted."""
    rows = operations.filter("status = 'Failed'").withColumn("cell", F.when(F.col("photo_id") % 3 == 0, F.concat(F.lit("="), "status")).otherwise(F.col("status")))
    return rows.select("op", X.csv_safe(F.col("cell")).alias("cell"), "message")


@query("run_verdict", """
SELECT id, mode, CASE WHEN status = 'Running' THEN 'running' WHEN status = 'Cancelled' THEN 'cancelled' WHEN kept > 0 AND bad = 0 THEN 'originals_kept' WHEN good > 0 AND bad = 0 THEN 'success' WHEN bad > 0 AND (good > 0 OR kept > 0 OR skipped > 0) THEN 'partial' WHEN bad > 0 THEN 'none_succeeded' ELSE 'no_change' END AS verdict
FROM (SELECT r.id, r.mode, r.status, count(*) FILTER (WHERE o.status IN ('Completed', 'Duplicate') OR (o.status = 'Copied' AND r.mode <> 'MOVE')) AS good, count(*) FILTER (WHERE o.status = 'Copied' AND r.mode = 'MOVE') AS kept, count(*) FILTER (WHERE o.status = 'Failed') AS bad, count(*) FILTER (WHERE o.status = 'Skipped') AS skipped
FROM runs r LEFT JOIN operations o ON o.run_id = r.id GROUP BY 1, 2, 3)""")
def run_verdict(runs: DataFrame, operations: DataFrame) -> DataFrame:
    """How each run ended, as an ordered list of cases over its counts."""
    s = F.col("status")
    n = operations.groupBy(F.col("run_id").alias("id")).agg(F.count_if(s.isin("Completed", "Duplicate")).alias("good"), F.count_if(s == "Copied").alias("copied"), F.count_if(s == "Failed").alias("bad"), F.count_if(s == "Skipped").alias("skipped"))
    rows = runs.select("id", "mode", "status").join(n, "id", "left").fillna(0, ["good", "copied", "bad", "skipped"])
    move = F.col("mode") == "MOVE"
    kept, good, bad = F.when(move, F.col("copied")).otherwise(0), F.col("good") + F.when(move, 0).otherwise(F.col("copied")), F.col("bad")
    verdict = (
        F.when(s == "Running", "running").when(s == "Cancelled", "cancelled").when((kept > 0) & (bad == 0), "originals_kept").when((good > 0) & (bad == 0), "success")
        .when((bad > 0) & ((good > 0) | (kept > 0) | (F.col("skipped") > 0)), "partial").when(bad > 0, "none_succeeded").otherwise("no_change")
    )
    return rows.select("id", "mode", verdict.alias("verdict"))


@query("skip_histogram", "SELECT mode, o.status, count(DISTINCT photo_id) AS photos FROM operations o JOIN runs r ON r.id = o.run_id WHERE o.status IN ('Skipped', 'Failed', 'Duplicate') GROUP BY 1, 2")
def skip_histogram(operations: DataFrame, runs: DataFrame) -> DataFrame:
    rows = operations.filter(F.col("status").isin("Skipped", "Failed", "Duplicate")).join(runs.select(F.col("id").alias("run_id"), "mode"), "run_id")
    return rows.groupBy("mode", "status").agg(F.countDistinct("photo_id").alias("photos"))


@query("unbacked", "SELECT kind, count(*) AS n FROM (SELECT 'operation' AS kind FROM operations WHERE run_id > 1200 UNION ALL SELECT 'review' FROM review_events WHERE id > 700 UNION ALL SELECT 'run' FROM runs WHERE id > 1200) GROUP BY kind")
def unbacked(operations: DataFrame, review_events: DataFrame, runs: DataFrame, run_mark: int = 1200, event_mark: int = 700) -> DataFrame:
    """Changes since a backup, by the marks that it recorded."""
    parts = (("operation", operations.filter(F.col("run_id") > run_mark)), ("review", review_events.filter(F.col("id") > event_mark)), ("run", runs.filter(F.col("id") > run_mark)))
    rows = [df.select(F.lit(kind).alias("kind")) for kind, df in parts]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("unread", "SELECT id, status FROM runs WHERE status <> 'Running' AND id NOT IN (SELECT id FROM review_events WHERE action = 'view') ORDER BY id DESC LIMIT 40")
def unread(runs: DataFrame, review_events: DataFrame, size: int = 40) -> DataFrame:
    """Ended runs without a read receipt, newest first."""
    return runs.filter("status <> 'Running'").join(review_events.filter("action = 'view'").select("id"), "id", "left_anti").select("id", "status").orderBy(F.desc("id")).limit(size)


@query("illegal_transitions", """
SELECT photo_id, before, action AS now, count(*) AS n FROM (SELECT photo_id, action, lag(action) OVER (PARTITION BY photo_id ORDER BY created_at, id) AS before FROM review_events) WHERE (before, action) IN (('purchase', 'signup'), ('signup', 'signup')) GROUP BY 1, 2, 3""")
def illegal_transitions(review_events: DataFrame, forbidden: tuple = (("purchase", "signup"), ("signup", "signup"))) -> DataFrame:
    """Steps of a state machine that its table does not allow."""
    order = Window.partitionBy("photo_id").orderBy("created_at", "id")
    rows = review_events.withColumn("before", F.lag("action").over(order))
    bad = F.lit(False)
    for before, now in forbidden:
        bad = bad | ((F.col("before") == before) & (F.col("action") == now))
    return rows.filter(bad).groupBy("photo_id", "before", F.col("action").alias("now")).agg(F.count(F.lit(1)).alias("n"))


@query("request_replay", """
SELECT photo_id, k, min(id) AS accepted, count(*) - 1 AS replays, count(DISTINCT action) > 1 AS conflict FROM review_events GROUP BY photo_id, k""")
def request_replay(review_events: DataFrame) -> DataFrame:
    """Requests of one key: the first is accepted, equal ones replay it, others conflict."""
    return review_events.groupBy("photo_id", "k").agg(F.min("id").alias("accepted"), (F.count(F.lit(1)) - 1).alias("replays"), (F.min("action") != F.max("action")).alias("conflict"))


@query("retry_photo_ids", "SELECT DISTINCT photo_id FROM operations WHERE status = 'Failed' AND photo_id NOT IN (SELECT photo_id FROM operations WHERE status = 'Completed')")
def retry_photo_ids(operations: DataFrame) -> DataFrame:
    failed = operations.filter("status = 'Failed'").select("photo_id").distinct()
    return failed.join(operations.filter("status = 'Completed'").select("photo_id"), "photo_id", "left_anti")
