"""Browsing: views, filters, orders, paging and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..functions.numbering import WIDTH
from ..registry import query

CARD = ("id", "status", "file_size", "sha1_hash", "date_taken", "date_source", "filename")


def cards(photos: DataFrame) -> DataFrame:
    """The list projection; the file name is the destination's where the photo was delivered or rejected."""
    return photos.withColumn("filename", X.basename(X.current_path(F.col("dest_path"), F.col("source_path"), F.col("status")))).select(*CARD)


def newest() -> list[Column]:
    return [F.col("date_taken").isNull(), F.col("date_taken").desc(), F.col("id")]


@query("gallery_page_newest", """
SELECT id, status, file_size, sha1_hash, date_taken, date_source, name AS filename FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination') ORDER BY date_taken IS NULL, date_taken DESC, id LIMIT 60 OFFSET 60""")
def gallery_page_newest(photos: DataFrame, page: int = 2, size: int = 60) -> DataFrame:
    return cards(photos.filter(F.col("status").isin(*schema.DELIVERED))).orderBy(*newest()).offset((page - 1) * size).limit(size)


@query("search_name", """
SELECT id, name FROM photos WHERE name ILIKE '%7.j%' OR sha1_hash IN (SELECT sha1_hash FROM photos WHERE name ILIKE '%7.j%')""")
def search_name(photos: DataFrame, term: str = "7.J") -> DataFrame:
    """Photos whose own name, or any name of the same content, holds the term; folders never count."""
    own = F.coalesce(F.ilike("name", F.lit(X.escape_like(term)), F.lit("\\")), F.lit(False))
    named = photos.filter(own & F.col("sha1_hash").isNotNull()).select("sha1_hash", F.lit(True).alias("twin")).distinct()
    return photos.join(named, "sha1_hash", "left").filter(own | F.col("twin")).select("id", "name")


@query("undated", "SELECT id, date_taken, date_source FROM photos WHERE status <> 'Failed' AND (date_taken IS NULL OR date_source = 'file_mtime')")
def undated(photos: DataFrame) -> DataFrame:
    return photos.filter(X.undated(F.col("date_taken"), F.col("date_source"), F.col("status"))).select("id", "date_taken", "date_source")


@query("filter_dates", "SELECT id, date_taken FROM photos WHERE substr(date_taken, 1, 4) IN ('1997', '2003') OR substr(date_taken, 1, 7) IN ('2010-05') OR date_taken IS NULL")
def filter_dates(photos: DataFrame, years: tuple = ("1997", "2003"), months: tuple = ("2010-05",), none: bool = True) -> DataFrame:
    d = F.col("date_taken")
    return photos.filter(F.substring(d, 1, 4).isin(*years) | F.substring(d, 1, 7).isin(*months) | (d.isNull() if none else F.lit(False))).select("id", "date_taken")


@query("filter_types", "SELECT id, name FROM photos WHERE name LIKE '%.jpg' OR name LIKE '%.cr2'")
def filter_types(photos: DataFrame, types: tuple = ("jpg", "cr2")) -> DataFrame:
    return photos.filter(X.extension(F.col("source_path")).isin(*types)).select("id", "name")


@query("filter_folders", "SELECT id, source_path FROM photos WHERE source_path LIKE '/src/src1/%' OR source_path LIKE '/src/src2/de/%'")
def filter_folders(photos: DataFrame, folders: tuple = ("/src/src1", "/src/src2/de")) -> DataFrame:
    keep = F.lit(False)
    for one in folders:
        keep = keep | X.under(F.col("source_path"), one)
    return photos.filter(keep).select("id", "source_path")


@query("filter_job", "SELECT id, status FROM photos WHERE id IN (SELECT photo_id FROM operations WHERE run_id BETWEEN 100 AND 199 UNION SELECT origin_file_id FROM origins WHERE file_id BETWEEN 100 AND 199)")
def filter_job(photos: DataFrame, operations: DataFrame, origins: DataFrame, first: int = 100, last: int = 199) -> DataFrame:
    """Photos that some jobs touched, or that survive what they consolidated."""
    ids = operations.filter(F.col("run_id").between(first, last)).select("photo_id").union(origins.filter(F.col("file_id").between(first, last)).select("origin_file_id")).distinct()
    return photos.join(ids, photos["id"] == ids["photo_id"], "left_semi").select("id", "status")


@query("size_below", "SELECT p.id, c.width, c.height FROM photos p JOIN contents c USING (sha1_hash) WHERE p.status <> 'Failed' AND least(c.width, c.height) < 1000")
def size_below(photos: DataFrame, contents: DataFrame, least: int = 1000) -> DataFrame:
    known = contents.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.least("width", "height") < least))
    return photos.filter("status <> 'Failed'").join(known, "sha1_hash").select("id", "width", "height")


@query("suspicious_dates", "SELECT id, date_taken, 'year ' || substr(date_taken, 1, 4) AS note FROM photos WHERE status <> 'Failed' AND (CAST(substr(date_taken, 1, 4) AS INTEGER) < 1800 OR CAST(substr(date_taken, 1, 4) AS INTEGER) > 2027)")
def suspicious_dates(photos: DataFrame) -> DataFrame:
    return photos.filter(X.suspicious(F.col("date_taken"), F.col("status"))).select("id", "date_taken", F.concat(F.lit("year "), F.substring("date_taken", 1, 4)).alias("note"))


@query("source_filters", """
SELECT f AS filter, count(*) AS n FROM (
  SELECT p.id, unnest([CASE WHEN p.status = 'Pending' THEN 'ready' END, CASE WHEN p.status <> 'Failed' THEN 'indexed' END, CASE WHEN p.status IN ('Duplicate', 'Removed_Duplicate') THEN 'identical' END,
    CASE WHEN c.h62 IS NULL THEN 'unknown_hash' END, CASE WHEN p.status IN ('Processing') THEN 'unfinished' END, CASE WHEN p.status = 'Failed' THEN 'failed' END]) AS f
  FROM photos p LEFT JOIN contents c USING (sha1_hash)) WHERE f IS NOT NULL GROUP BY f""")
def source_filters(photos: DataFrame, contents: DataFrame) -> DataFrame:
    """How many photos each named filter of the source view keeps."""
    s = F.col("status")
    named = {"ready": s == "Pending", "indexed": s != "Failed", "identical": s.isin(*schema.COPIES), "unknown_hash": F.col("h62").isNull(), "unfinished": s == "Processing", "failed": s == "Failed"}
    rows = photos.join(contents.select("sha1_hash", "h62"), "sha1_hash", "left").select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))).alias("filter"))
    return rows.groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query("sort_largest", "SELECT id, file_size FROM photos ORDER BY file_size DESC NULLS LAST, id LIMIT 50")
def sort_largest(photos: DataFrame, n: int = 50) -> DataFrame:
    return photos.select("id", "file_size").orderBy(F.col("file_size").desc_nulls_last(), "id").limit(n)


@query("sort_name", "SELECT id, name FROM photos ORDER BY lower(name), id LIMIT 50")
def sort_name(photos: DataFrame, n: int = 50) -> DataFrame:
    """By name without regard to ASCII case."""
    folded = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return photos.select("id", "name").orderBy(folded, "id").limit(n)


@query("keyset_page", "SELECT id, run_id, status FROM (SELECT op AS id, run_id, status FROM operations) WHERE (run_id, id) > (500, '500-3') ORDER BY run_id, id LIMIT 41")
def keyset_page(operations: DataFrame, run: int = 500, op: str = "500-3", size: int = 40) -> DataFrame:
    """The rows after a key, one more than a page so that the caller knows whether more follow."""
    after = (F.col("run_id") > run) | ((F.col("run_id") == run) & (F.col("op") > op))
    return operations.filter(after).select(F.col("op").alias("id"), "run_id", "status").orderBy("run_id", "id").limit(size + 1)


@query("photo_position", """
SELECT id, position, before, after, position // 60 + 1 AS page FROM (
  SELECT id, row_number() OVER o - 1 AS position, lag(id) OVER o AS before, lead(id) OVER o AS after FROM photos WINDOW o AS (ORDER BY date_taken IS NULL, date_taken DESC, id))""")
def photo_position(photos: DataFrame, size: int = 60) -> DataFrame:
    """Every photo's place in the newest-first order, its neighbours and its page.

    The order is cut into days first, and into ranges of ids where there is no date: these are counted, and places
    inside one are added to what lies ahead, so that no task orders more than a day or a range.
    """
    day = F.coalesce(F.substring("date_taken", 1, 10), F.lit(""))
    rows = photos.select("id", "date_taken", day.alias("day"), F.when(F.col("date_taken").isNull(), F.floor(F.col("id") / WIDTH)).otherwise(0).alias("span"))
    inside = Window.partitionBy("day", "span").orderBy(F.desc("date_taken"), "id")
    placed = rows.withColumn("k", F.row_number().over(inside)).withColumn("before", F.lag("id").over(inside)).withColumn("after", F.lead("id").over(inside))
    order = Window.orderBy(F.desc("day"), "span")
    ends = placed.groupBy("day", "span").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "k").alias("first"), F.max_by("id", "k").alias("last"))
    ends = ends.withColumn("ahead", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("earlier", F.lag("last").over(order)).withColumn("later", F.lead("first").over(order)).drop("n", "first", "last")
    out = placed.join(ends, ["day", "span"]).withColumn("position", F.col("ahead") + F.col("k") - 1)
    return out.select("id", "position", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"), (F.floor(F.col("position") / size) + 1).alias("page"))


@query("selection_missing", "SELECT DISTINCT photo_id AS id FROM operations WHERE photo_id NOT IN (SELECT id FROM photos)")
def selection_missing(operations: DataFrame, photos: DataFrame) -> DataFrame:
    """Selected ids that the catalog does not hold."""
    wanted = operations.select(F.col("photo_id").alias("id")).distinct()
    return wanted.join(photos, "id", "left_anti")


@query("inspect_photo", """
SELECT p.id, p.name, c.width, c.height, (SELECT count(*) FROM photos q WHERE q.sha1_hash = p.sha1_hash AND q.id <> p.id) AS copies, coalesce(o.n, 0) AS operations, coalesce(o.kinds, '') AS kinds
FROM photos p LEFT JOIN contents c USING (sha1_hash) LEFT JOIN (SELECT photo_id, count(*) AS n, string_agg(DISTINCT status, ',' ORDER BY status) AS kinds FROM operations GROUP BY photo_id) o ON o.photo_id = p.id""")
def inspect_photo(photos: DataFrame, contents: DataFrame, operations: DataFrame) -> DataFrame:
    """The inspector's record of each photo: dimensions, copies, and its operations' number and kinds."""
    same = photos.filter("sha1_hash is not null").groupBy("sha1_hash").agg((F.count(F.lit(1)) - 1).alias("copies"))
    ops = operations.groupBy(F.col("photo_id").alias("id")).agg(F.count(F.lit(1)).alias("operations"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("kinds"))
    out = photos.join(contents.select("sha1_hash", "width", "height"), "sha1_hash", "left").join(same, "sha1_hash", "left").join(ops, "id", "left")
    return out.select("id", "name", "width", "height", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("operations", F.lit(0)).alias("operations"), F.coalesce("kinds", F.lit("")).alias("kinds"))
