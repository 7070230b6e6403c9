"""Column expressions over paths, dates and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def basename(path: Column) -> Column:
    """What follows the last slash; null for a null or empty path."""
    return F.substring_index(F.nullif(path, F.lit("")), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the name's last dot; empty without a dot."""
    name = basename(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).when(name.isNotNull(), F.lit(""))


def stem(path: Column) -> Column:
    """The name without its extension; a leading or trailing dot belongs to the stem."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def under(path: Column, root: str) -> Column:
    """Whether path is root or lies below it: a literal prefix, which reaches the Parquet scan as a range."""
    return (path == F.lit(root)) | path.startswith(root.rstrip("/") + "/")


def normal_folder(folder: Column) -> Column:
    """A relative folder without empty and "." steps; "." alone is kept; null where it is empty, absolute or goes outside.

    Steps "a/.." inside are not folded, so a folder that has them is refused as well.
    """
    steps = F.filter(F.split(folder, "/"), lambda s: (s != "") & (s != "."))
    refused = (folder == "") | folder.startswith("/") | F.array_contains(steps, "..") | (F.size(steps) == 0) | folder.contains("\0")
    return F.when(folder == ".", folder).when(~refused, F.array_join(steps, "/"))


def escape_like(text: str) -> str:
    """A search term as a LIKE pattern that matches it literally."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def current_path(dest: Column, source: Column, status: Column) -> Column:
    return F.when(status.isin(*schema.DELIVERED, *schema.IN_REJECTS), dest).otherwise(source)


def suspicious(date: Column, status: Column, least: int = schema.MIN_YEAR, now: int = schema.NOW_YEAR) -> Column:
    """A dated, not failed photo whose year is before the least or after next year."""
    year = F.expr("try_cast(substring(date_taken, 1, 4) as int)") if date is None else F.substring(date, 1, 4).try_cast("int")
    return F.coalesce(date.rlike("^[0-9]{4}-") & ((year < least) | (year > now + 1)) & (status != "Failed"), F.lit(False))


def undated(date: Column, source: Column, status: Column) -> Column:
    return (status != "Failed") & (date.isNull() | (source == "file_mtime"))


def distance_for(percent: Column) -> Column:
    """The largest distance that a whole percent of similarity permits."""
    return F.floor((F.lit(100) - percent) * F.lit(schema.HASH_BITS) / 100).cast("int")


def match_distance(percent: float) -> int:
    """The same for a percentage that may have a fraction."""
    return math.floor((100 - percent) * schema.HASH_BITS / 100 + 1e-9)


def score(distance: Column) -> Column:
    """Percent of equal bits, to two places, halves to even."""
    return F.bround((F.lit(schema.HASH_BITS) - distance) * 100 / F.lit(schema.HASH_BITS), 2)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet does not take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def filing_folder(date: Column, source: Column) -> Column:
    """Year, month and day of a trusted date; the year alone under Undated for a file time."""
    whole = date.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.when(~F.coalesce(whole, F.lit(False)), F.lit("library/Unsorted")).when(source == "file_mtime", F.concat(F.lit("library/Undated/"), F.substring(date, 1, 4))).otherwise(F.concat_ws("/", F.lit("library"), F.substring(date, 1, 4), F.substring(date, 6, 2), F.substring(date, 9, 2)))


def failure_kind(message: Column) -> Column:
    """The kind of a failure by how its message starts."""
    head = F.lower(F.substring(message, 1, 60))
    return F.when(head.contains("hash"), "hash").when(head.contains("permission"), "permission").when(head.contains("space"), "space").when(head.contains("missing") | head.contains("no such"), "missing").otherwise("other")


def plain_reason(message: Column) -> Column:
    """A failure message without exception name, error number and quoted paths, cut at 120 characters."""
    out = F.regexp_replace(message, r"^[A-Za-z]*(Error|Exception):\s*", "")
    out = F.regexp_replace(out, r"\[Errno \d+\]\s*", "")
    out = F.regexp_replace(out, r":?\s*'[^']*'", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) > 120, F.concat(F.substring(out, 1, 117), F.lit("..."))).otherwise(out)
