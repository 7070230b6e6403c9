"""Metadata as readers give it: qualified tags, typed values, sources, conflicts, and the report of a capture.

One pass interprets all tags: a broadcast dimension says of each known tag what source, field and part it is, one
aggregation lays a source's parts side by side, and column expressions read them. A source is taken whole or not at
all: its first value that is wrong, in a fixed order, is its issue, and nothing falls back to another source silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..registry import query

# Tags that are read, as source, tag and part. Of XMP-dc texts a language may follow the name.
TAGS = [
    ("exif", "IFD0:Make", "camera_make"), ("exif", "IFD0:Model", "camera_model"), ("exif", "IFD0:Orientation", "orientation"), ("exif", "IFD0:XPTitle", "title"), ("exif", "IFD0:ImageDescription", "caption"), ("exif", "IFD0:Copyright", "rights"), ("exif", "IFD0:Artist", "creators"),
    ("exif", "IFD0:XPKeywords", "keywords"), ("exif", "IFD0:Rating", "rating"), ("exif", "ExifIFD:DateTimeOriginal", "date_taken"), ("exif", "ExifIFD:SubSecTimeOriginal", "fraction"), ("exif", "ExifIFD:OffsetTimeOriginal", "zone"),
    ("exif", "GPS:GPSLatitude", "latitude"), ("exif", "GPS:GPSLongitude", "longitude"), ("exif", "GPS:GPSAltitude", "altitude"), ("exif", "GPS:GPSAltitudeRef", "altitude_ref"), ("exif", "GPS:GPSLatitudeRef", "latitude_ref"), ("exif", "GPS:GPSLongitudeRef", "longitude_ref"),
    ("embedded_xmp", "XMP-exif:DateTimeOriginal", "date_taken"), ("embedded_xmp", "XMP-tiff:Make", "camera_make"), ("embedded_xmp", "XMP-tiff:Model", "camera_model"), ("embedded_xmp", "XMP-tiff:Orientation", "orientation"), ("embedded_xmp", "XMP-xmp:Rating", "rating"),
    ("embedded_xmp", "XMP-dc:Title", "title"), ("embedded_xmp", "XMP-dc:Description", "caption"), ("embedded_xmp", "XMP-dc:Rights", "rights"), ("embedded_xmp", "XMP-dc:Subject", "keywords"), ("embedded_xmp", "XMP-dc:Creator", "creators"),
    ("embedded_xmp", "XMP-exif:GPSLatitude", "latitude"), ("embedded_xmp", "XMP-exif:GPSLongitude", "longitude"), ("embedded_xmp", "XMP-exif:GPSAltitude", "altitude"), ("embedded_xmp", "XMP-exif:GPSAltitudeRef", "altitude_ref"),
]
DATE, FRACTION, OFFSET = "ExifIFD:DateTimeOriginal", "ExifIFD:SubSecTimeOriginal", "ExifIFD:OffsetTimeOriginal"
PARTS = sorted({part for _, _, part in TAGS})
FIELDS = ("date_taken", "orientation", "rating", "camera_make", "camera_model", "title", "caption", "rights", "keywords", "creators", "latitude", "longitude", "altitude", "altitude_ref")
_DIMENSION = ", ".join(f"('{s}', '{t}', '{p}')" for s, t, p in TAGS)

#: One row a photo and canonical tag: numbered copies collapse, and conflict where they differ; any other part between family and name is a conflict too.
CANONICAL_SQL = r"""
SELECT photo_id, canon AS tag, min(value) FILTER (WHERE plain) AS value, coalesce(count(DISTINCT value) FILTER (WHERE plain) > 1, false) OR NOT bool_and(plain) AS conflict, count(*) AS copies FROM (
  SELECT photo_id, split_part(tag, ':', 1) || ':' || split_part(tag, ':', -1) AS canon, regexp_full_match(tag, '[^:]*(:Copy[0-9]+)*:[^:]*') AS plain, value FROM image_tags WHERE tag LIKE '%:%') GROUP BY 1, 2"""


@query("canonical_tags", CANONICAL_SQL)
def canonical_tags(image_tags: DataFrame) -> DataFrame:
    """Tags by family and name; numbered copies of a tag collapse into it and conflict where their values differ."""
    parts = F.split("tag", ":")
    canon, plain = F.concat_ws(":", F.element_at(parts, 1), F.element_at(parts, -1)), F.col("tag").rlike("^[^:]*(:Copy[0-9]+)*:[^:]*$")
    rows = image_tags.filter(F.col("tag").contains(":")).select("photo_id", canon.alias("tag"), F.when(plain, F.col("value")).alias("value"), plain.alias("plain"))
    differ = F.coalesce(F.min("value") != F.max("value"), F.lit(False)) | ~F.bool_and("plain")
    return rows.groupBy("photo_id", "tag").agg(F.min("value").alias("value"), differ.alias("conflict"), F.count(F.lit(1)).alias("copies"))


_PART_SQL = ", ".join(f"max(CASE WHEN part = '{p}' AND lang IS NULL THEN value END) AS {p}" for p in PARTS)
_LOCAL_SQL = ", ".join(f"string_agg(coalesce(lang, 'x-default') || '=' || value, ',' ORDER BY coalesce(lang, 'x-default')) FILTER (part = '{p}') AS local_{p}, count(lang) FILTER (part = '{p}') AS n_{p}" for p in ("title", "caption", "rights"))
WIDE_SQL = rf"""
SELECT photo_id, source, bool_or(conflict) AS conflict, {_PART_SQL}, {_LOCAL_SQL} FROM (
  SELECT c.photo_id, c.value, c.conflict, d.source, d.part, c.lang FROM (SELECT *, CASE WHEN regexp_matches(tag, '^XMP-dc:(Title|Description|Rights)-') THEN regexp_extract(tag, '^XMP-dc:[A-Za-z]+-(.*)$', 1) END AS lang, CASE WHEN regexp_matches(tag, '^XMP-dc:(Title|Description|Rights)-') THEN regexp_extract(tag, '^(XMP-dc:[A-Za-z]+)-', 1) ELSE tag END AS known FROM ({CANONICAL_SQL})) c
  JOIN (VALUES {_DIMENSION}) d(source, tag, part) ON d.tag = c.known) GROUP BY photo_id, source"""


def sources(image_tags: DataFrame) -> DataFrame:
    """One row a photo and source with its parts side by side: one scan and two aggregations, whatever the number of fields."""
    rows, spark = canonical_tags(image_tags), image_tags.sparkSession
    local = F.regexp_extract("tag", "^XMP-dc:(?:Title|Description|Rights)-(.*)$", 1)
    rows = rows.withColumn("lang", F.when(F.col("tag").rlike("^XMP-dc:(Title|Description|Rights)-"), local)).withColumn("tag", F.when(F.col("lang").isNotNull(), F.regexp_extract("tag", "^(XMP-dc:[A-Za-z]+)-", 1)).otherwise(F.col("tag")))
    known = spark.createDataFrame(TAGS, "source string, tag string, part string")
    rows = rows.join(F.broadcast(known), "tag")  # the tags that are read: a fixed list
    part = lambda p: F.max(F.when((F.col("part") == p) & F.col("lang").isNull(), F.col("value"))).alias(p)
    text = F.struct(F.coalesce("lang", F.lit("x-default")).alias("lang"), "value")
    texts = [c for p in ("title", "caption", "rights") for c in (F.collect_list(F.when(F.col("part") == p, text)).alias(f"local_{p}"), F.count(F.when(F.col("part") == p, F.col("lang"))).alias(f"n_{p}"))]
    wide = rows.groupBy("photo_id", "source").agg(F.bool_or("conflict").alias("conflict"), *map(part, PARTS), *texts)
    for p in ("title", "caption", "rights"):  # a photo has few languages
        wide = wide.withColumn(f"local_{p}", F.array_join(F.transform(F.sort_array(f"local_{p}"), lambda x: F.concat_ws("=", x["lang"], x["value"])), ","))
    return wide


def _gps_sql(axis: str, most: int, ends: str) -> str:
    value, ref = axis, f"{axis}_ref"
    number = f"try_cast(regexp_extract({value}, '^[+-]?([0-9]+)', 1) AS HUGEINT)"
    beyond = rf"({number} IS NULL OR {number} > {most} OR ({number} = {most} AND regexp_matches({value}, '\.[0-9]*[1-9]')) OR length(regexp_extract({value}, '\.([0-9]+)$', 1)) > 36)"
    return rf"""CASE WHEN {value} <> '' THEN CASE WHEN source = 'exif' AND {ref} IS NULL THEN 'gps_coordinate_without_reference' WHEN NOT regexp_full_match({value}, '[+-]?[0-9]+(\.[0-9]+)?') THEN 'invalid_gps_{axis}'
      WHEN source = 'exif' AND {ref} NOT IN ('{ends[0]}', '{ends[1]}') THEN 'invalid_gps_reference' WHEN source = 'exif' AND {value} LIKE '-%' AND regexp_matches({value}, '[1-9]') THEN 'negative_exif_coordinate' WHEN {beyond} THEN 'invalid_gps_{axis}' END
    WHEN source = 'exif' AND {ref} IS NOT NULL THEN 'gps_reference_without_coordinate' END"""


def _minutes_sql(axis: str, ends: str) -> str:
    digits = rf"regexp_extract({axis}, '\.([0-9]+)$', 1)"
    times = f"CAST(try_cast({digits} AS HUGEINT) * 60 AS VARCHAR)"
    scaled = f"lpad({times}, CAST(greatest(length({digits}) + 1, length({times})) AS INTEGER), '0')"
    return f"""CASE WHEN {axis} <> '' THEN CAST(try_cast(regexp_extract({axis}, '^[+-]?([0-9]+)', 1) AS HUGEINT) AS VARCHAR) || ',' || CASE WHEN {digits} = '' THEN '0' ELSE left({scaled}, length({scaled}) - length({digits})) || '.' || right({scaled}, length({digits})) END
      || CASE WHEN source = 'exif' THEN {axis}_ref WHEN {axis} LIKE '-%' THEN '{ends[1]}' ELSE '{ends[0]}' END ELSE {axis} END"""


_CLOCK = r"[0-9]{4}(-(0[1-9]|1[0-2])(-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?)?)?"
READ_SQL = rf"""
SELECT *, CASE WHEN conflict THEN 'ambiguous_embedded_' || CASE source WHEN 'exif' THEN 'exif' ELSE 'xmp' END
    WHEN gps1 IS NOT NULL THEN gps1 WHEN gps2 IS NOT NULL THEN gps2 WHEN altitude <> '' AND (NOT regexp_full_match(altitude, '[0-9]+(\.[0-9]+)?(/[0-9]+)?') OR regexp_matches(altitude, '/0+$')) THEN 'invalid_gps_altitude' WHEN altitude_ref NOT IN ('', '0', '1') THEN 'invalid_gps_altitude_ref'
    WHEN source = 'exif' AND date_taken IS NULL AND (fraction IS NOT NULL OR zone IS NOT NULL) THEN 'date_components_without_date' WHEN source = 'exif' AND date_taken <> '' AND NOT regexp_full_match(date_taken, '[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN 'invalid_date_taken'
    WHEN source = 'exif' AND date_taken <> '' AND NOT regexp_full_match(fraction, '[0-9]+') THEN 'invalid_date_fraction' WHEN source = 'exif' AND date_taken <> '' AND NOT regexp_full_match(zone, '[+-][0-9]{{2}}:[0-9]{{2}}') THEN 'invalid_date_offset'
    WHEN dated <> '' AND (NOT regexp_full_match(dated, '{_CLOCK}') OR (length(dated) >= 10 AND TRY_CAST(left(dated, 10) AS DATE) IS NULL)) THEN 'invalid_date_taken' WHEN orientation <> '' AND NOT regexp_full_match(orientation, '\+?0*[1-8]') THEN 'invalid_orientation'
    WHEN rating <> '' AND NOT regexp_full_match(rating, '-0*1(\.0*)?|[+-]?0*\.?0*|\+?0*[0-4]?\.[0-9]+|\+?0*[0-5](\.0*)?') OR rating IN ('+', '-', '.', '+.', '-.') OR rating LIKE '%.' THEN 'invalid_rating' END AS issue FROM (
  SELECT *, {_gps_sql('latitude', 90, 'NS')} AS gps1, {_gps_sql('longitude', 180, 'EW')} AS gps2,
    CASE WHEN date_taken = '' THEN '' WHEN source = 'exif' THEN replace(left(date_taken, 10), ':', '-') || 'T' || substr(date_taken, 12) || coalesce('.' || fraction, '') || coalesce(zone, '') ELSE replace(left(date_taken, 10), ':', '-') || CASE WHEN substr(date_taken, 11, 1) = ' ' THEN 'T' ELSE substr(date_taken, 11, 1) END || substr(date_taken, 12) END AS dated FROM ({WIDE_SQL}))"""

_RATED_SQL = r"CASE WHEN rating = '' THEN '' ELSE CASE WHEN rating LIKE '-%' AND regexp_matches(rating, '[1-9]') THEN '-' ELSE '' END || coalesce(nullif(ltrim(regexp_extract(rating, '^[+-]?([0-9]*)', 1), '0'), ''), '0') || CASE WHEN regexp_matches(rating, '\.[0-9]*[1-9]') THEN '.' || rtrim(regexp_extract(rating, '\.([0-9]*)$', 1), '0') ELSE '' END END"
_VALUES_SQL = {
    "date_taken": "CASE WHEN dated LIKE '%Z' THEN rtrim(dated, 'Z') || '+00:00' ELSE dated END", "orientation": "right(orientation, 1)", "rating": _RATED_SQL, "keywords": "CASE WHEN source = 'exif' THEN replace(keywords, ';', '|') ELSE keywords END",
    "latitude": _minutes_sql("latitude", "NS"), "longitude": _minutes_sql("longitude", "EW"), **{p: f"CASE WHEN n_{p} > 0 THEN local_{p} ELSE {p} END" for p in ("title", "caption", "rights")},
}
EXIF_FIELDS_SQL = f"""
SELECT photo_id, source, x.field AS field, x.value AS value, issue FROM (SELECT photo_id, source, issue, unnest(CASE WHEN issue IS NULL THEN [{', '.join(f"{{'field': '{f}', 'value': CASE WHEN {'true' if f not in ('title', 'caption', 'rights') else f'n_{f} > 0 OR'} {'AND' if f not in ('title', 'caption', 'rights') else ''} {f} IS NOT NULL THEN {_VALUES_SQL.get(f, f)} END}}" for f in FIELDS)}] ELSE [{{'field': NULL, 'value': NULL}}] END) AS x FROM ({READ_SQL}))
WHERE issue IS NOT NULL OR x.value IS NOT NULL"""


def read(image_tags: DataFrame) -> DataFrame:
    """One row a photo and source: a column a field, and the issue for which the source is refused."""
    rows, exif = sources(image_tags), F.col("source") == "exif"
    text = lambda name: F.col(name)
    said, blank = lambda name: F.col(name) != "", F.lit("")
    d, zone, fraction = text("date_taken"), text("zone"), text("fraction")
    day, rest = F.translate(F.substring(d, 1, 10), ":", "-"), F.substring(d, 12, 1 << 20)
    mark = F.when(F.substring(d, 11, 1) == " ", "T").otherwise(F.substring(d, 11, 1))
    dated = F.when(d == "", "").when(exif, F.concat(day, F.lit("T"), rest, F.coalesce(F.concat(F.lit("."), fraction), blank), F.coalesce(zone, blank))).otherwise(F.concat(day, mark, rest))
    rows = rows.withColumn("dated", dated)
    issue = F.coalesce(
        F.when(F.col("conflict"), F.when(exif, "ambiguous_embedded_exif").otherwise("ambiguous_embedded_xmp")), V.coordinate_issue("latitude", 90, "NS", exif), V.coordinate_issue("longitude", 180, "EW", exif),
        F.when(said("altitude") & (~F.col("altitude").rlike(r"^[0-9]+(\.[0-9]+)?(/[0-9]+)?\z") | F.col("altitude").rlike(r"/0+\z")), "invalid_gps_altitude"), F.when(~F.col("altitude_ref").isin("", "0", "1"), "invalid_gps_altitude_ref"),
        F.when(exif & d.isNull() & (fraction.isNotNull() | zone.isNotNull()), "date_components_without_date"), F.when(exif & said("date_taken") & ~d.rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), "invalid_date_taken"),
        F.when(exif & said("date_taken") & ~fraction.rlike(r"^[0-9]+\z"), "invalid_date_fraction"), F.when(exif & said("date_taken") & ~zone.rlike(r"^[+-][0-9]{2}:[0-9]{2}\z"), "invalid_date_offset"),
        F.when(said("dated") & ~V.recorded_date(F.col("dated")), "invalid_date_taken"), F.when(said("orientation") & ~F.col("orientation").rlike(r"^\+?0*[1-8]\z"), "invalid_orientation"), F.when(said("rating") & V.rating(F.col("rating")).isNull(), "invalid_rating"),
    )
    values = {
        "date_taken": F.when(F.col("dated").endswith("Z"), F.concat(F.rtrim("dated", F.lit("Z")), F.lit("+00:00"))).otherwise(F.col("dated")), "orientation": F.expr("right(orientation, 1)"), "rating": F.when(F.col("rating") == "", "").otherwise(V.rating(F.col("rating"))),
        "keywords": F.when(exif, F.translate("keywords", ";", "|")).otherwise(F.col("keywords")), "latitude": F.when(F.col("latitude") == "", "").otherwise(V.degrees_minutes("latitude", "NS", exif)), "longitude": F.when(F.col("longitude") == "", "").otherwise(V.degrees_minutes("longitude", "EW", exif)),
        **{p: F.when(F.col(f"n_{p}") > 0, F.col(f"local_{p}")).otherwise(F.col(p)) for p in ("title", "caption", "rights")},
    }
    return rows.select("photo_id", "source", issue.alias("issue"), *[values.get(f, F.col(f)).alias(f) for f in FIELDS])


@query("interpreted_fields", EXIF_FIELDS_SQL)
def interpreted_fields(image_tags: DataFrame) -> DataFrame:
    """Tags as fields of their sources, in one form for comparison: offsets written out, ratings, orientations and coordinates checked.

    A refused source gives one row, its issue.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))
    rows = read(image_tags).select("photo_id", "source", "issue", F.explode(F.when(F.col("issue").isNull(), fields).otherwise(nothing)).alias("x"))
    return rows.select("photo_id", "source", "x.field", "x.value", "issue").filter("issue is not null or value is not null")


COMPOSED_SQL = f"SELECT photo_id, issue, CASE WHEN issue IS NULL THEN {_VALUES_SQL['date_taken']} END AS date_taken FROM ({READ_SQL}) WHERE source = 'exif'"


@query("exif_composed", COMPOSED_SQL)
def exif_composed(image_tags: DataFrame) -> DataFrame:
    """The date of a picture from its day, time, fraction and offset; parts that don't fit are an issue, never dropped."""
    return read(image_tags).filter("source = 'exif'").select("photo_id", "issue", F.when(F.col("issue").isNull(), F.col("date_taken")).alias("date_taken"))


@query("ratings", f"SELECT photo_id, source, rating AS said, CASE WHEN NOT (NOT regexp_full_match(rating, '-0*1(\\.0*)?|[+-]?0*\\.?0*|\\+?0*[0-4]?\\.[0-9]+|\\+?0*[0-5](\\.0*)?') OR rating IN ('', '+', '-', '.', '+.', '-.') OR rating LIKE '%.') THEN {_RATED_SQL} END AS rating FROM ({WIDE_SQL}) WHERE rating IS NOT NULL")
def ratings(image_tags: DataFrame) -> DataFrame:
    """Ratings without superfluous zeros; null for what is no plain number, or neither -1 nor from 0 to 5."""
    return sources(image_tags).filter("rating is not null").select("photo_id", "source", F.col("rating").alias("said"), V.rating(F.col("rating")).alias("rating"))


GPS_SQL = f"""
SELECT photo_id, source, axis, issue, CASE WHEN issue IS NULL THEN text END AS text FROM (
  SELECT photo_id, source, 'latitude' AS axis, {_gps_sql('latitude', 90, 'NS')} AS issue, CASE WHEN {_gps_sql('latitude', 90, 'NS')} IS NULL THEN {_minutes_sql('latitude', 'NS')} END AS text FROM ({WIDE_SQL}) WHERE latitude IS NOT NULL OR latitude_ref IS NOT NULL
  UNION ALL SELECT photo_id, source, 'longitude', {_gps_sql('longitude', 180, 'EW')}, CASE WHEN {_gps_sql('longitude', 180, 'EW')} IS NULL THEN {_minutes_sql('longitude', 'EW')} END FROM ({WIDE_SQL}) WHERE longitude IS NOT NULL OR longitude_ref IS NOT NULL)"""


@query("gps_minutes", GPS_SQL)
def gps_minutes(image_tags: DataFrame) -> DataFrame:
    """Coordinates as degrees and exact decimal minutes, or why they are refused; EXIF's are unsigned with a hemisphere apart."""
    rows, exif = sources(image_tags), F.col("source") == "exif"
    one = lambda axis, most, ends: F.struct(F.lit(axis).alias("axis"), V.coordinate_issue(axis, most, ends, exif).alias("issue"), V.degrees_minutes(axis, ends, exif).alias("text"), F.coalesce(axis, f"{axis}_ref").isNotNull().alias("there"))
    rows = rows.select("photo_id", "source", F.explode(F.array(one("latitude", 90, "NS"), one("longitude", 180, "EW"))).alias("x")).select("photo_id", "source", "x.*").filter("there")
    return rows.select("photo_id", "source", "axis", "issue", F.when(F.col("issue").isNull(), F.col("text")).alias("text"))


@query("keyword_lists", "SELECT photo_id, k AS place, string_split(value, ';')[k] AS keyword FROM (SELECT photo_id, value, unnest(range(1, len(string_split(value, ';')) + 1)) AS k FROM image_tags WHERE tag = 'IFD0:XPKeywords')")
def keyword_lists(image_tags: DataFrame) -> DataFrame:
    """Keywords set apart by semicolons, in order, white space kept."""
    rows = image_tags.filter("tag = 'IFD0:XPKeywords'").select("photo_id", F.posexplode(F.split("value", ";")).alias("k", "keyword"))
    return rows.select("photo_id", (F.col("k") + 1).cast("bigint").alias("place"), "keyword")


@query("localized_titles", """
SELECT photo_id, count(*) AS languages, max(CASE WHEN lang = 'x-default' THEN value END) AS plain, string_agg(lang || '=' || value, ',' ORDER BY lang) AS titles FROM (
  SELECT photo_id, CASE WHEN tag = 'XMP-dc:Title' THEN 'x-default' ELSE substr(tag, 14) END AS lang, value FROM image_tags WHERE tag = 'XMP-dc:Title' OR tag LIKE 'XMP-dc:Title-%') GROUP BY photo_id""")
def localized_titles(image_tags: DataFrame) -> DataFrame:
    """A text by language; one without a language is the default's. A photo has few."""
    rows = image_tags.filter((F.col("tag") == "XMP-dc:Title") | F.col("tag").startswith("XMP-dc:Title-"))
    lang = F.when(F.col("tag") == "XMP-dc:Title", "x-default").otherwise(F.substring("tag", 14, 100))
    per = rows.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct(lang.alias("lang"), "value"))).alias("t"))
    plain = F.element_at(F.filter("t", lambda x: x["lang"] == "x-default"), 1)["value"]
    return per.select("photo_id", F.size("t").cast("bigint").alias("languages"), plain.alias("plain"), F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["lang"], x["value"])), ",").alias("titles"))


REPORT_SQL = f"""
SELECT photo_id, CASE WHEN count(issue) > 0 THEN 'needs_attention' ELSE 'captured' END AS state, count(issue) AS issues, coalesce(string_agg(DISTINCT source || ':' || issue, ',' ORDER BY source || ':' || issue), '') AS codes, count(DISTINCT source) AS sources FROM ({EXIF_FIELDS_SQL}) GROUP BY photo_id"""


@query("capture_report", REPORT_SQL)
def capture_report(image_tags: DataFrame) -> DataFrame:
    """A capture's report of each photo: whether it needs attention, and each issue by source and code."""
    code = F.when(F.col("issue").isNotNull(), F.concat_ws(":", "source", "issue"))
    per = interpreted_fields(image_tags).groupBy("photo_id").agg(F.count("issue").alias("issues"), F.array_join(F.sort_array(F.collect_set(code)), ",").alias("codes"), F.countDistinct("source").alias("sources"))
    return per.withColumn("state", F.when(F.col("issues") > 0, "needs_attention").otherwise("captured"))


@query("issue_groups", f"SELECT source, issue AS code, count(*) AS n, count(DISTINCT photo_id) AS photos, min(photo_id) AS first FROM ({EXIF_FIELDS_SQL}) WHERE issue IS NOT NULL GROUP BY 1, 2")
def issue_groups(image_tags: DataFrame) -> DataFrame:
    """What the issues are, by source and code."""
    rows = interpreted_fields(image_tags).filter("issue is not null")
    return rows.groupBy("source", F.col("issue").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("photo_id").alias("photos"), F.min("photo_id").alias("first"))


RESOLVED_SQL = f"""
SELECT f.photo_id, f.field, arg_min(f.value, CASE f.source WHEN 'embedded_xmp' THEN 0 ELSE 1 END) AS value, arg_min(f.source, CASE f.source WHEN 'embedded_xmp' THEN 0 ELSE 1 END) AS source FROM ({EXIF_FIELDS_SQL}) f WHERE f.value IS NOT NULL GROUP BY 1, 2"""


@query("resolved_fields", RESOLVED_SQL)
def resolved_fields(image_tags: DataFrame, order: tuple = ("embedded_xmp", "exif")) -> DataFrame:
    """Each field from the first source that says it, with that source."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    rows = interpreted_fields(image_tags).filter(F.col("value").isNotNull() & (rank > 0))
    best = rows.groupBy("photo_id", "field").agg(F.min_by(F.struct("value", "source"), rank).alias("x"))
    return best.select("photo_id", "field", "x.value", "x.source")


@query("resolved_exif_only", f"SELECT photo_id, field, value, source FROM ({EXIF_FIELDS_SQL}) WHERE value IS NOT NULL AND source = 'exif'")
def resolved_exif_only(image_tags: DataFrame) -> DataFrame:
    """The same with the camera's own tags as the primary source: nothing falls back to another."""
    return resolved_fields(image_tags, ("exif",))


@query("capture_date_policy", f"""
SELECT p.id, coalesce(c.date_taken, strftime(f.first_seen, '%Y-%m-%dT%H:%M:%S')) AS date_taken, CASE WHEN c.date_taken IS NOT NULL THEN 'exif' WHEN f.first_seen IS NOT NULL THEN 'file_mtime' END AS date_source
FROM photos p LEFT JOIN (SELECT photo_id, date_taken FROM ({COMPOSED_SQL})) c ON c.photo_id = p.id LEFT JOIN (SELECT photo_id, min(created_at) AS first_seen FROM review_events GROUP BY 1) f ON f.photo_id = p.id""")
def capture_date_policy(photos: DataFrame, image_tags: DataFrame, review_events: DataFrame) -> DataFrame:
    """The camera's own date or, where it has none that fits, when the file was first seen; and which of the two it is."""
    seen = review_events.groupBy(F.col("photo_id").alias("id")).agg(F.date_format(F.min("created_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("seen"))
    own = exif_composed(image_tags).select(F.col("photo_id").alias("id"), F.col("date_taken").alias("own"))
    rows = photos.select("id").join(own, "id", "left").join(seen, "id", "left")
    return rows.select("id", F.coalesce("own", "seen").alias("date_taken"), F.when(F.col("own").isNotNull(), "exif").when(F.col("seen").isNotNull(), "file_mtime").alias("date_source"))


@query("version_fields_diff", f"""
SELECT coalesce(a.photo_id, b.photo_id) AS photo_id, coalesce(a.field, b.field) AS field, a.value AS exif, b.value AS xmp FROM (SELECT * FROM ({EXIF_FIELDS_SQL}) WHERE source = 'exif' AND value IS NOT NULL) a
FULL JOIN (SELECT * FROM ({EXIF_FIELDS_SQL}) WHERE source = 'embedded_xmp' AND value IS NOT NULL) b ON a.photo_id = b.photo_id AND a.field = b.field WHERE a.value IS DISTINCT FROM b.value""")
def version_fields_diff(image_tags: DataFrame) -> DataFrame:
    """What a switch of the primary source would change: fields that the two sources say differently, or only one says."""
    said = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    per = interpreted_fields(image_tags).groupBy("photo_id", "field").agg(said("exif").alias("exif"), said("embedded_xmp").alias("xmp"))
    return per.filter(~F.col("exif").eqNullSafe(F.col("xmp")))


@query("reapply_history", """
SELECT coalesce(h.photo_id, t.photo_id) AS photo_id, coalesce(h.field, t.field) AS field, CASE WHEN h.field IS NULL THEN 'remove' WHEN t.field IS NULL THEN 'add' ELSE 'set' END AS step, h.value
FROM (SELECT photo_id, field, arg_min(value, id) AS value FROM tags GROUP BY 1, 2 HAVING arg_min(value, id) <> '') h FULL JOIN (SELECT photo_id, field, arg_max(value, id) AS value FROM tags GROUP BY 1, 2 HAVING arg_max(value, id) <> '') t ON h.photo_id = t.photo_id AND h.field = t.field WHERE h.value IS DISTINCT FROM t.value""")
def reapply_history(tags: DataFrame) -> DataFrame:
    """The steps from a photo's present fields back to its first ones: what to set, to add and to remove."""
    per = tags.groupBy("photo_id", "field").agg(F.min_by("value", "id").alias("then"), F.max_by("value", "id").alias("now"))
    then, now = F.nullif("then", F.lit("")), F.nullif("now", F.lit(""))
    rows = per.select("photo_id", "field", then.alias("value"), now.alias("now")).filter(~F.col("value").eqNullSafe(F.col("now")))
    step = F.when(F.col("value").isNull(), "remove").when(F.col("now").isNull(), "add").otherwise("set")
    return rows.select("photo_id", "field", step.alias("step"), "value")


@query("incoming_versions", """
SELECT i.photo_id, i.field, i.value, CASE WHEN i.value = n.value THEN 'preserve' ELSE 'confirmation_required' END AS rule FROM (SELECT DISTINCT photo_id, field, value FROM tags WHERE source = 'click') i JOIN (SELECT photo_id, field, arg_max(value, id) AS value FROM tags WHERE source <> 'click' GROUP BY 1, 2) n
ON n.photo_id = i.photo_id AND n.field = i.field WHERE NOT EXISTS (SELECT 1 FROM tags k WHERE k.source = 'view' AND k.photo_id = i.photo_id AND k.field = i.field AND k.value = i.value)""")
def incoming_versions(tags: DataFrame) -> DataFrame:
    """Incoming values that no known version holds, and whether they agree with the present one or ask for a decision."""
    known = tags.filter("source = 'view'").select("photo_id", "field", "value")
    novel = tags.filter("source = 'click'").select("photo_id", "field", "value").distinct().join(known, ["photo_id", "field", "value"], "left_anti")
    now = tags.filter("source <> 'click'").groupBy("photo_id", "field").agg(F.max_by("value", "id").alias("now"))
    return novel.join(now, ["photo_id", "field"]).select("photo_id", "field", "value", F.when(F.col("value") == F.col("now"), "preserve").otherwise("confirmation_required").alias("rule"))


@query("choice_tokens", """
SELECT photo_id, sha256(photo_id || '|' || string_agg(field || '=' || value, ',' ORDER BY field)) AS token, count(*) AS fields FROM (SELECT photo_id, field, arg_max(value, id) AS value FROM tags GROUP BY 1, 2) GROUP BY photo_id""")
def choice_tokens(tags: DataFrame) -> DataFrame:
    """A token bound to the version of a photo's fields that a choice was offered for. A photo has few fields."""
    last = tags.groupBy("photo_id", "field").agg(F.max_by("value", "id").alias("value"))
    per = last.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("m"))
    line = F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["field"], x["value"])), ",")
    return per.select("photo_id", F.sha2(F.concat_ws("|", F.col("photo_id").cast("string"), line), 256).alias("token"), F.size("m").cast("bigint").alias("fields"))


@query("metadata_sources", f"""
SELECT photo_id, source, count(*) AS fields, count(issue) AS issues FROM ({EXIF_FIELDS_SQL}) GROUP BY 1, 2 UNION ALL SELECT photo_id, 'capture:' || arg_max(state, id), count(*), count(*) FILTER (WHERE state = 'needs_attention') FROM captures GROUP BY photo_id""")
def metadata_sources(image_tags: DataFrame, captures: DataFrame) -> DataFrame:
    """Everything that says something of a photo: its sources with their fields, and its captures with their latest state."""
    sources = interpreted_fields(image_tags).groupBy("photo_id", "source").agg(F.count(F.lit(1)).alias("fields"), F.count("issue").alias("issues"))
    seen = captures.groupBy("photo_id").agg(F.max_by("state", "id").alias("s"), F.count(F.lit(1)).alias("fields"), F.count_if(F.col("state") == "needs_attention").alias("issues"))
    return sources.union(seen.select("photo_id", F.concat(F.lit("capture:"), "s"), "fields", "issues"))


@query("import_plan", f"""
SELECT r.photo_id, CASE WHEN r.state = 'needs_attention' THEN 'hold' WHEN x.photo_id IS NOT NULL THEN 'embedded_xmp' WHEN r.sources > 0 THEN 'exif' ELSE 'none' END AS primary_source FROM ({REPORT_SQL}) r LEFT JOIN (SELECT DISTINCT photo_id FROM ({EXIF_FIELDS_SQL}) WHERE source = 'embedded_xmp' AND value IS NOT NULL) x ON x.photo_id = r.photo_id""")
def import_plan(image_tags: DataFrame) -> DataFrame:
    """Which source an import takes as the primary one; a photo whose report needs attention is held."""
    xmp = interpreted_fields(image_tags).filter("source = 'embedded_xmp' and value is not null").select("photo_id", F.lit(True).alias("xmp")).distinct()
    rows = capture_report(image_tags).join(xmp, "photo_id", "left")
    plan = F.when(F.col("state") == "needs_attention", "hold").when(F.col("xmp"), "embedded_xmp").when(F.col("sources") > 0, "exif").otherwise("none")
    return rows.select("photo_id", plan.alias("primary_source"))
