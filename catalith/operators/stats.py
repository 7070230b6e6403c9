"""Library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query


@query("stats_formats", r"SELECT regexp_extract(name, '\.([^.]*)$', 1) AS format, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination') GROUP BY 1")
def stats_formats(photos: DataFrame) -> DataFrame:
    return photos.filter(F.col("status").isin(*schema.DELIVERED)).groupBy(X.extension(F.col("source_path")).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


@query("stats_top_names", """
(SELECT 'camera' AS kind, camera AS name, count(*) AS n FROM photos GROUP BY 2 ORDER BY n DESC, name LIMIT 8) UNION ALL (SELECT 'lens', lens, count(*) AS n FROM photos GROUP BY 2 ORDER BY n DESC, lens LIMIT 8)""")
def stats_top_names(photos: DataFrame, most: int = 8) -> DataFrame:
    def top(kind: str) -> DataFrame:
        return photos.groupBy(F.col(kind).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most).select(F.lit(kind).alias("kind"), "name", "n")

    return top("camera").union(top("lens"))


@query("stats_megapixels", """
SELECT CASE WHEN mp < 1 THEN '<1' WHEN mp < 4 THEN '1-4' WHEN mp < 12 THEN '4-12' WHEN mp < 24 THEN '12-24' ELSE '>=24' END AS band, CASE WHEN w = h THEN 'square' WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation, count(*) AS n
FROM (SELECT width * height / 1e6 AS mp, CASE WHEN content_id % 5 = 0 THEN height ELSE width END AS w, CASE WHEN content_id % 5 = 0 THEN width ELSE height END AS h FROM contents) GROUP BY 1, 2""")
def stats_megapixels(contents: DataFrame) -> DataFrame:
    """Bands of megapixels by orientation; quarter turns swap the sides."""
    turned = F.col("content_id") % 5 == 0
    w, h = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    mp = F.col("width") * F.col("height") / 1e6
    band = F.when(mp < 1, "<1").when(mp < 4, "1-4").when(mp < 12, "4-12").when(mp < 24, "12-24").otherwise(">=24")
    return contents.groupBy(band.alias("band"), F.when(w == h, "square").when(w > h, "landscape").otherwise("portrait").alias("orientation")).agg(F.count(F.lit(1)).alias("n"))


@query("stats_dates", "SELECT substr(date_taken, 1, 4) AS year, count(*) AS n, min(date_taken) AS oldest, max(date_taken) AS newest, count(*) FILTER (WHERE date_source = 'file_mtime') AS by_file_time FROM photos GROUP BY 1")
def stats_dates(photos: DataFrame) -> DataFrame:
    return photos.groupBy(F.substring("date_taken", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("date_taken").alias("oldest"), F.max("date_taken").alias("newest"), F.count_if(F.col("date_source") == "file_mtime").alias("by_file_time"))


@query("stats_busiest_day", "SELECT substr(date_taken, 1, 10) AS day, count(*) AS n FROM photos WHERE date_taken IS NOT NULL GROUP BY 1 ORDER BY n DESC, day DESC LIMIT 1")
def stats_busiest_day(photos: DataFrame) -> DataFrame:
    """The day of the most photos; of equal days the later."""
    per = photos.filter("date_taken is not null").groupBy(F.substring("date_taken", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max(F.struct("n", "day")).alias("x")).select("x.day", "x.n")


@query("stats_ops_by_mode", "SELECT mode, o.status, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM operations o JOIN runs r ON r.id = o.run_id GROUP BY 1, 2")
def stats_ops_by_mode(operations: DataFrame, runs: DataFrame) -> DataFrame:
    return operations.join(runs.select(F.col("id").alias("run_id"), "mode"), "run_id").groupBy("mode", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("stats_throughput", """
SELECT mode, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(days) AS BIGINT) AS days, CASE WHEN sum(days) > 0 THEN CAST(sum(bytes) AS BIGINT) // CAST(sum(days) AS BIGINT) END AS per_day FROM (
  SELECT r.mode, r.id, sum(o.amount) AS bytes, date_diff('day', min(o.timestamp), max(o.timestamp)) AS days FROM operations o JOIN runs r ON r.id = o.run_id WHERE o.status IN ('Copied', 'Completed') GROUP BY 1, 2) WHERE days > 0 GROUP BY mode""")
def stats_throughput(operations: DataFrame, runs: DataFrame) -> DataFrame:
    """What runs of some duration moved, and how much of it a day."""
    moved = operations.filter(F.col("status").isin("Copied", "Completed")).join(runs.select(F.col("id").alias("run_id"), "mode"), "run_id")
    per = moved.groupBy("mode", "run_id").agg(F.sum("amount").alias("bytes"), F.datediff(F.max("timestamp"), F.min("timestamp")).cast("bigint").alias("days")).filter("days > 0")
    return per.groupBy("mode").agg(F.sum("bytes").alias("bytes"), F.sum("days").alias("days")).withColumn("per_day", F.expr("bytes div days"))


@query("stats_failure_kinds", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN h LIKE '%hash%' THEN 'hash' WHEN h LIKE '%permission%' THEN 'permission' WHEN h LIKE '%space%' THEN 'space' WHEN h LIKE '%missing%' OR h LIKE '%no such%' THEN 'missing' ELSE 'other' END AS kind
FROM (SELECT lower(substr(message, 1, 60)) AS h FROM operations WHERE status = 'Failed')) GROUP BY kind""")
def stats_failure_kinds(operations: DataFrame) -> DataFrame:
    return operations.filter("status = 'Failed'").groupBy(X.failure_kind(F.col("message")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("failure_reason_normalise", r"""
SELECT reason, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '^[A-Za-z]*(Error|Exception):\s*', ''), '\[Errno \d+\]\s*', '', 'g'), ':?\s*''[^'']*''', '', 'g'), '\s+', ' ', 'g')) AS reason FROM operations WHERE status = 'Failed') GROUP BY reason""")
def failure_reasons(operations: DataFrame) -> DataFrame:
    return operations.filter("status = 'Failed'").groupBy(X.plain_reason(F.col("message")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("coverage", """
SELECT target, max(id) AS last_run, count(*) FILTER (WHERE newer) AS since FROM (SELECT target, id, status, mode, id > coalesce(max(CASE WHEN mode = 'INDEX' AND status = 'Completed' THEN id END) OVER (PARTITION BY target), -1) AS newer FROM runs) GROUP BY target""")
def coverage(runs: DataFrame) -> DataFrame:
    """Each target's last run, and the runs since its last complete index."""
    done = runs.filter("mode = 'INDEX' and status = 'Completed'").groupBy("target").agg(F.max("id").alias("done"))
    rows = runs.join(done, "target", "left")
    return rows.groupBy("target").agg(F.max("id").alias("last_run"), F.count_if(F.col("id") > F.coalesce("done", F.lit(-1))).alias("since"))


@query("stats_cumulative_months", "SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS total FROM (SELECT substr(date_taken, 1, 7) AS month, count(*) AS n FROM photos WHERE date_taken IS NOT NULL GROUP BY 1)")
def stats_cumulative_months(photos: DataFrame) -> DataFrame:
    """The library's growth by month: months are counted first, so the ordered window sees a row a month."""
    per = photos.filter("date_taken is not null").groupBy(F.substring("date_taken", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.orderBy("month")))
