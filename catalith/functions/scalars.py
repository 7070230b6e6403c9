"""Queries that show the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from . import paths as X


@query("scalar_paths", r"""
SELECT id, regexp_extract(source_path, '[^/]*$') AS base, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS ext, regexp_extract(name, '^(.+)\.[^.]+$', 1) AS stem, regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS folder,
  source_path LIKE '/src/src1/%' AS in_root FROM photos""")
def scalar_paths(photos: DataFrame) -> DataFrame:
    p = F.col("source_path")
    return photos.select("id", X.basename(p).alias("base"), X.extension(p).alias("ext"), X.stem(p).alias("stem"), X.folder(p).alias("folder"), X.under(p, "/src/src1").alias("in_root"))


@query("scalar_dates", """
SELECT id, CAST(TRY_CAST(substr(date_taken, 1, 10) AS DATE) AS VARCHAR) AS day, TRY_CAST(substr(date_taken, 1, 4) AS INTEGER) AS year,
  CASE WHEN date_taken IS NULL THEN 'library/Unsorted' WHEN date_source = 'file_mtime' THEN 'library/Undated/' || substr(date_taken, 1, 4) ELSE 'library/' || replace(substr(date_taken, 1, 10), '-', '/') END AS filed FROM photos""")
def scalar_dates(photos: DataFrame) -> DataFrame:
    d = F.col("date_taken")
    return photos.select("id", F.substring(d, 1, 10).try_cast("date").cast("string").alias("day"), F.substring(d, 1, 4).try_cast("int").alias("year"), X.filing_folder(d, F.col("date_source")).alias("filed"))


@query("scalar_match", """
SELECT content_id, CAST(bit_count(h62) AS INTEGER) AS bits, CAST(floor((100 - content_id % 101) * 64 / 100.0) AS INTEGER) AS distance_max, round_even((64 - CAST(bit_count(h62) AS BIGINT)) * 100 / 64.0, 2)::DOUBLE AS score FROM contents""")
def scalar_match(contents: DataFrame) -> DataFrame:
    bits = F.bit_count("h62")
    return contents.select("content_id", bits.alias("bits"), X.distance_for(F.col("content_id") % 101).alias("distance_max"), X.score(bits).alias("score"))


@query("csv_cells", """
SELECT id, CASE WHEN regexp_matches(cell, '^[=+@\\t\\r-]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT id, CASE WHEN id % 4 = 0 THEN '=' || name WHEN id % 4 = 1 THEN '-' || name ELSE name END AS cell FROM photos)""")
def csv_cells(photos: DataFrame) -> DataFrame:
    cell = F.when(F.col("id") % 4 == 0, F.concat(F.lit("="), "name")).when(F.col("id") % 4 == 1, F.concat(F.lit("-"), "name")).otherwise(F.col("name"))
    return photos.select("id", X.csv_safe(cell).alias("cell"))


@query("json_values", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS valid, json_extract(props, '$.none') IS NULL AS absent FROM events""")
def json_values(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.none").isNull().alias("absent"))


@query("exif_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN '.5' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '+02:00' ELSE '' END AS composed FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0""")
def exif_dates(orders: DataFrame) -> DataFrame:
    """Camera dates with a fraction and an offset put behind them; what does not parse has none."""
    i = F.col("o_orderkey")
    raw = F.when(i % 7 == 0, F.lit("0000:00:00 00:00:00")).otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    day = F.try_to_timestamp(F.substring(raw, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))
    text = F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 3 == 0, ".5").otherwise(""), F.when(i % 2 == 0, "+02:00").otherwise(""))
    return orders.select(i, text.alias("composed"))


@query("partial_dates", r"""
SELECT id, part, part IS NOT NULL AND regexp_full_match(part, '\d{4}(-\d{2}(-\d{2})?)?') AND (length(part) < 7 OR TRY_CAST(substr(part, 6, 2) AS INTEGER) BETWEEN 1 AND 12) AND (length(part) < 10 OR TRY_CAST(part AS DATE) IS NOT NULL) AS valid
FROM (SELECT id, CASE id % 4 WHEN 0 THEN substr(date_taken, 1, 4) WHEN 1 THEN substr(date_taken, 1, 7) WHEN 2 THEN substr(date_taken, 1, 10) ELSE '2001-02-30' END AS part FROM photos)""")
def partial_dates(photos: DataFrame) -> DataFrame:
    """Whether a date of a year, a month or a day is one of the calendar."""
    i, d = F.col("id") % 4, F.col("date_taken")
    part = F.when(i == 0, F.substring(d, 1, 4)).when(i == 1, F.substring(d, 1, 7)).when(i == 2, F.substring(d, 1, 10)).otherwise("2001-02-30")
    rows = photos.select("id", part.alias("part"))
    p = F.col("part")
    valid = p.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & ((F.length(p) < 7) | F.substring(p, 6, 2).try_cast("int").between(1, 12)) & ((F.length(p) < 10) | p.try_cast("date").isNotNull())
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


@query("turned_sizes", "SELECT content_id, (content_id % 8) + 1 AS orientation, CASE WHEN content_id % 8 >= 4 THEN height ELSE width END AS w, CASE WHEN content_id % 8 >= 4 THEN width ELSE height END AS h FROM contents")
def turned_sizes(contents: DataFrame) -> DataFrame:
    """Width and height as seen: orientations 5 to 8 are quarter turns."""
    o = F.col("content_id") % 8 + 1
    return contents.select("content_id", o.alias("orientation"), F.when(o >= 5, F.col("height")).otherwise(F.col("width")).alias("w"), F.when(o >= 5, F.col("width")).otherwise(F.col("height")).alias("h"))
