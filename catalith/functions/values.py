"""Column expressions over typed metadata values and what is shown of them, with queries that show them on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..registry import query


def rating(text: Column) -> Column:
    """-1 or 0 to 5 without superfluous zeros, by the digits themselves; null for anything else, such as 4e0 or a blank beside."""
    sign, whole = F.regexp_extract(text, "^([+-]?)", 1), F.ltrim(F.regexp_extract(text, "^[+-]?([0-9]*)", 1), F.lit("0"))
    part = F.rtrim(F.regexp_extract(text, r"\.([0-9]+)$", 1), F.lit("0"))
    number = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    allowed = F.when(sign == "-", number.isin("0", "1")).otherwise(F.length(whole).isin(0, 1) & ((whole < "5") | ((whole == "5") & (part == ""))))
    plain = text.rlike(r"^[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)\z")
    return F.when(plain & allowed, F.concat(F.when((sign == "-") & (number != "0"), "-").otherwise(""), number))


def recorded_date(text: Column) -> Column:
    """Whether a text is a date to the year, month, day, minute or second, with or without a zone, that the calendar and clock have."""
    clock = r"^[0-9]{4}(-(0[1-9]|1[0-2])(-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?)?)?\z"
    return text.rlike(clock) & ((F.length(text) < 10) | F.substring(text, 1, 10).try_cast("date").isNotNull())


#: Digits of a fraction that stay exact when it is multiplied by 60.
MOST_DIGITS = 36


def coordinate_issue(axis: str, most: int, ends: str, exif: Column) -> Column:
    """Why a coordinate in decimal degrees is refused; EXIF has the hemisphere apart and no sign."""
    value, ref = F.col(axis), F.col(f"{axis}_ref")
    degrees = F.regexp_extract(value, "^[+-]?([0-9]+)", 1).try_cast("decimal(38,0)")
    beyond = degrees.isNull() | (degrees > most) | ((degrees == most) & value.rlike(r"\.[0-9]*[1-9]")) | (F.length(F.regexp_extract(value, r"\.([0-9]+)$", 1)) > MOST_DIGITS)
    wrong = (
        F.when(exif & ref.isNull(), "gps_coordinate_without_reference").when(~value.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z"), f"invalid_gps_{axis}").when(exif & ~ref.isin(*ends), "invalid_gps_reference")
        .when(exif & value.startswith("-") & value.rlike("[1-9]"), "negative_exif_coordinate").when(beyond, f"invalid_gps_{axis}")
    )
    return F.when(value != "", wrong).when(exif & ref.isNotNull(), "gps_reference_without_coordinate")


def degrees_minutes(axis: str, ends: str, exif: Column) -> Column:
    """Decimal degrees as degrees and decimal minutes with as many places, computed on the digits."""
    value = F.col(axis)
    digits = F.regexp_extract(value, r"\.([0-9]+)$", 1)
    scaled = (digits.try_cast("decimal(36,0)") * F.lit(60)).cast("decimal(38,0)").cast("string")
    padded = F.when(F.length(scaled) > F.length(digits), scaled).otherwise(F.concat(F.repeat(F.lit("0"), F.length(digits) + 1 - F.length(scaled)), scaled))
    places = F.length(digits)
    minutes = F.when(digits == "", "0").otherwise(F.concat(F.substring(padded, F.lit(1), F.length(padded) - places), F.lit("."), F.substring(padded, F.length(padded) - places + 1, places)))
    end = F.when(exif, F.col(f"{axis}_ref")).when(value.startswith("-"), ends[1]).otherwise(ends[0])
    return F.concat(F.regexp_extract(value, "^[+-]?([0-9]+)", 1).try_cast("decimal(38,0)").cast("string"), F.lit(","), minutes, end)


def shown_path(path: Column, library: str, rejects: str) -> Column:
    """A path relative to the library, Rejects/... for one in the rejects, else as it is."""
    inside = lambda root: F.substring(path, len(root) + 2, 1 << 20)
    return F.when(path.startswith(library + "/"), inside(library)).when(path.startswith(rejects + "/"), F.concat(F.lit("Rejects/"), inside(rejects))).otherwise(path)


def mirrored(path: Column, library: str, rejects: str) -> Column:
    """Where a library file lies in the rejects, and the reverse; null for any other path."""
    inside = lambda root: F.substring(path, len(root) + 1, 1 << 20)
    return F.when(path.startswith(library + "/"), F.concat(F.lit(rejects), inside(library))).when(path.startswith(rejects + "/"), F.concat(F.lit(library), inside(rejects)))


def folder_day(folder: Column) -> Column:
    """The day that a folder yyyy/mm/dd names; null where it names none of the calendar."""
    return F.when(folder.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.translate(folder, "/", "-").try_cast("date"))


def turned(first: Column, then: Column) -> Column:
    """The orientation (1 to 8) of a picture that is turned once more by 0 to 3 quarters (1, 6, 3 or 8). A mirrored one stays mirrored."""
    every = schema.QUARTERS | schema.MIRRORED
    quarters = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    back = lambda kind: F.element_at(F.array(*[F.lit(o) for o in kind]), ((quarters[first] + quarters[then]) % 4 + 1).cast("int"))
    return F.when(first.isin(*schema.MIRRORED), back(schema.MIRRORED)).otherwise(back(schema.QUARTERS))


def bytes_shown(size: Column) -> Column:
    """A size in units of 1000, to one place below ten."""
    units = F.array(*map(F.lit, ("B", "kB", "MB", "GB", "TB", "PB")))
    step = F.when(size < 1000, 0).otherwise(F.least(F.floor(F.log10(size.cast("double") + 0.5) / 3), F.lit(5)).cast("int"))
    scaled = size / F.pow(F.lit(1000.0), step)
    number = F.when((step == 0) | (scaled >= 10), F.floor(scaled).cast("string")).otherwise((F.floor(scaled * 10) / 10).cast("decimal(10,1)").cast("string"))
    return F.concat_ws(" ", number, F.element_at(units, step.cast("int") + 1))


def duration_shown(seconds: Column) -> Column:
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    hours = F.floor(seconds / 3600).cast("string")
    return F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), part(F.pmod(seconds / 60, F.lit(60))), part(F.pmod(seconds, F.lit(60))))


@query("shown_paths", """
SELECT id, CASE WHEN p LIKE '/dst/library/%' THEN substr(p, 14) WHEN p LIKE '/dst/rejects/%' THEN 'Rejects/' || substr(p, 14) ELSE p END AS shown, CASE WHEN p LIKE '/dst/library/%' THEN '/dst/rejects/' || substr(p, 14) WHEN p LIKE '/dst/rejects/%' THEN '/dst/library/' || substr(p, 14) END AS mirror
FROM (SELECT id, coalesce(dest_path, source_path) AS p FROM photos)""")
def shown_paths(photos: DataFrame, library: str = "/dst/library", rejects: str = "/dst/rejects") -> DataFrame:
    p = F.coalesce("dest_path", "source_path")
    return photos.select("id", shown_path(p, library, rejects).alias("shown"), mirrored(p, library, rejects).alias("mirror"))


@query("folder_days", r"""
SELECT id, day_folder AS folder, CAST(CASE WHEN regexp_full_match(day_folder, '\d{4}/\d{2}/\d{2}') THEN TRY_CAST(replace(day_folder, '/', '-') AS DATE) END AS VARCHAR) AS day FROM asked""")
def folder_days(asked: DataFrame) -> DataFrame:
    """The day that a folder names, if it names one of the calendar."""
    return asked.select("id", F.col("day_folder").alias("folder"), folder_day(F.col("day_folder")).cast("string").alias("day"))


@query("turned_twice", """
, circle(o, mirrored, q) AS (VALUES (1, 0, 0), (6, 0, 1), (3, 0, 2), (8, 0, 3), (2, 1, 0), (7, 1, 1), (4, 1, 2), (5, 1, 3))
SELECT t.content_id, t.first, t.then_turned, c.o AS both FROM turns t JOIN circle a ON a.o = t.first JOIN circle b ON b.o = t.then_turned JOIN circle c ON c.mirrored = a.mirrored AND c.q = (a.q + b.q) % 4""")
def turned_twice(turns: DataFrame) -> DataFrame:
    """The orientation of each picture, mirrored or not, once it was turned by more quarters."""
    return turns.select("content_id", "first", "then_turned", turned(F.col("first"), F.col("then_turned")).alias("both"))


@query("shown_sizes", """
SELECT id, s AS size, CASE WHEN u = 0 OR s / power(1000.0, u) >= 10 THEN CAST(CAST(floor(s / power(1000.0, u)) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(s / power(1000.0, u) * 10) / 10 AS DECIMAL(10, 1)) AS VARCHAR) END || ' ' || ['B', 'kB', 'MB', 'GB', 'TB', 'PB'][u + 1] AS shown
FROM (SELECT id, size AS s, CASE WHEN size < 1000 THEN 0 WHEN size < 1000000 THEN 1 WHEN size < 1000000000 THEN 2 WHEN size < 1000000000000 THEN 3 ELSE 4 END AS u FROM asked)""")
def shown_sizes(asked: DataFrame) -> DataFrame:
    return asked.select("id", "size", bytes_shown(F.col("size")).alias("shown"))


@query("shown_durations", """
SELECT id, CASE WHEN seconds < 36000 THEN '0' ELSE '' END || (seconds // 3600) || ':' || lpad(CAST(seconds // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') AS shown FROM asked""")
def shown_durations(asked: DataFrame) -> DataFrame:
    """Hours, minutes and seconds; hours have two digits at least."""
    return asked.select("id", duration_shown(F.col("seconds")).alias("shown"))


@query("instant_gaps", "SELECT id, photo_id, CAST(date_diff('microsecond', lag(created_at) OVER w, created_at) AS DOUBLE) / 1000000 AS seconds FROM review_events WINDOW w AS (PARTITION BY photo_id ORDER BY created_at, id)")
def instant_gaps(review_events: DataFrame) -> DataFrame:
    """Seconds since a photo's event before."""
    from pyspark.sql import Window

    before = F.lag("created_at").over(Window.partitionBy("photo_id").orderBy("created_at", "id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return review_events.select("id", "photo_id", ((micros(F.col("created_at")) - micros(before)).cast("double") / 1_000_000).alias("seconds"))


@query("json_rows", """
SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) t, LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)""")
def json_rows(events: DataFrame) -> DataFrame:
    """The members of an object as rows."""
    return events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("json_kinds", """
SELECT event_id, CASE WHEN json_valid(text) AND NOT regexp_matches(regexp_replace(text, '"([^"\\\\]|\\\\.)*"', '""', 'g'), 'NaN|Infinity') THEN lower(json_type(text)) END AS kind FROM payloads""")
def json_kinds(payloads: DataFrame) -> DataFrame:
    """What kind of value a text holds as JSON; null where it is none."""
    bare = F.regexp_replace("text", r'"([^"\\]|\\.)*+"', '""')
    valid, head = F.try_parse_json("text").isNotNull() & ~bare.rlike("NaN|Infinity"), F.substring(F.ltrim("text"), 1, 1)
    kind = F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "varchar").when(head.isin("t", "f"), "boolean").when(head == "n", "null").otherwise("number")
    return payloads.select("event_id", F.when(valid, kind).alias("kind"))


@query("type_names", r"SELECT id, type_name AS type, regexp_full_match(type_name, '[a-z0-9]{1,10}') AS valid, CASE WHEN lower(ltrim(trim(type_name), '.')) IN ('jpg', 'png', 'cr2', 'tif') THEN 'supported' ELSE 'warning' END AS support FROM asked")
def type_names(asked: DataFrame) -> DataFrame:
    """Whether a name may be a file type, and whether the type is read as a picture or only carried along."""
    t = F.col("type_name")
    plain = F.lower(F.ltrim(F.trim(t), F.lit(".")))
    return asked.select("id", t.alias("type"), t.rlike("^[a-z0-9]{1,10}$").alias("valid"), F.when(plain.isin(*schema.RASTER, *schema.RAW), "supported").otherwise("warning").alias("support"))
