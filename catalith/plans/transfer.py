"""Transfer, rename and confirmation plans: relations only, no file is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..functions.numbering import numbered
from ..registry import query

FILED = "CASE WHEN date_taken IS NULL THEN 'library/Unsorted' WHEN date_source = 'file_mtime' THEN 'library/Undated/' || substr(date_taken, 1, 4) ELSE 'library/' || replace(substr(date_taken, 1, 10), '-', '/') END"


@query("transfer_plan", f"SELECT folder, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, min(id) AS first FROM (SELECT id, file_size, {FILED} AS folder FROM photos WHERE status IN ('Pending', 'Copied', 'Rejected_Copied')) GROUP BY folder")
def transfer_plan(photos: DataFrame, mode: str = "MOVE") -> DataFrame:
    """What a move would file where: destination folders with their files and bytes."""
    rows = photos.filter(F.col("status").isin(*schema.ELIGIBLE[mode]))
    return rows.groupBy(X.filing_folder(F.col("date_taken"), F.col("date_source")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.min("id").alias("first"))


@query("transfer_space", "SELECT status, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM photos WHERE status IN ('Pending', 'Copied', 'Rejected_Copied') GROUP BY status")
def transfer_space(photos: DataFrame, mode: str = "MOVE") -> DataFrame:
    return photos.filter(F.col("status").isin(*schema.ELIGIBLE[mode])).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


@query("unplanned", """
SELECT id, CASE WHEN status IN ('Rejected', 'Rejected_Copied', 'Rejected_Emptied') THEN 'stays in rejects' WHEN status = 'Duplicate' AND sha1_hash NOT IN (SELECT sha1_hash FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination', 'Pending')) THEN 'no twin' ELSE 'not eligible' END AS reason
FROM photos WHERE status <> 'Pending' AND NOT (status = 'Duplicate' AND sha1_hash IN (SELECT sha1_hash FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination', 'Pending')))""")
def unplanned(photos: DataFrame) -> DataFrame:
    """Photos that a copy leaves out, and why."""
    twin = photos.filter(F.col("status").isin(*schema.DELIVERED, "Pending")).select("sha1_hash", F.lit(True).alias("twin")).distinct()
    rows = photos.join(twin, "sha1_hash", "left").filter((F.col("status") != "Pending") & ~((F.col("status") == "Duplicate") & F.coalesce("twin", F.lit(False))))
    reason = F.when(F.col("status").startswith("Rejected"), "stays in rejects").when(F.col("status") == "Duplicate", "no twin").otherwise("not eligible")
    return rows.select("id", reason.alias("reason"))


@query("unique_destinations", f"""
SELECT id, folder || '/' || short || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS target FROM (SELECT id, folder, short, row_number() OVER (PARTITION BY folder, short ORDER BY id) AS k FROM (SELECT id, {FILED} AS folder, substr(name, 10, 2) AS short FROM photos WHERE status = 'Pending'))""")
def unique_destinations(photos: DataFrame) -> DataFrame:
    """Targets made unique by a number after the stem, in order of id."""
    rows = photos.filter("status = 'Pending'").select("id", X.filing_folder(F.col("date_taken"), F.col("date_source")).alias("folder"), F.substring("name", 10, 2).alias("short"))
    return numbered(rows, ["folder", "short"]).select("id", F.concat("folder", F.lit("/"), "short", F.when(F.col("k") > 1, F.concat(F.lit("_"), (F.col("k") - 1).cast("string"))).otherwise("")).alias("target"))


RESOLVED_SQL = r"""
, held AS (SELECT folder, stem, ext, n, min(sha1_hash) AS sha1_hash, count(*) FILTER (true) AS files FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*?)(_([1-9][0-9]*))?(\.[^./]*)?$', 1) AS stem, regexp_extract(path, '(\.[^./]*)?$', 1) AS ext,
  coalesce(try_cast(regexp_extract(path, '_([1-9][0-9]*)(\.[^./]*)?$', 1) AS BIGINT), 0) AS n, sha1_hash FROM occupied) GROUP BY 1, 2, 3, 4), chained AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY n) - 1 AS place FROM held),
judged AS (SELECT w.*, (SELECT min(c.n) FROM chained c WHERE c.folder = w.folder AND c.stem = w.stem AND c.ext = w.ext AND c.place = c.n AND c.sha1_hash = w.sha1_hash) AS present FROM wanted w), fresh AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY id) AS k FROM judged WHERE present IS NULL),
numbered AS (SELECT f.*, k - 1 + (SELECT count(*) FROM chained c WHERE c.folder = f.folder AND c.stem = f.stem AND c.ext = f.ext AND c.n - c.place <= f.k - 1) AS n FROM fresh f)
SELECT id, folder || '/' || stem || CASE WHEN n > 0 THEN '_' || n ELSE '' END || ext AS target, already FROM (SELECT id, folder, stem, ext, n, false AS already FROM numbered UNION ALL SELECT id, folder, stem, ext, present, true FROM judged WHERE present IS NOT NULL)"""


@query("resolved_destinations", RESOLVED_SQL)
def resolved_destinations(wanted: DataFrame, occupied: DataFrame) -> DataFrame:
    """Where each photo goes: its name or, where that is taken, the first free one with a number after the original stem.

    A taken name on the way to the first free one that holds the photo's own content is the photo, delivered before.
    Photos that want one name take its free numbers in order of id. Free numbers follow from how many taken ones lie
    below: both are put in one order by the free names before them, so no photo meets all files of its name.
    """
    key, path = ["folder", "stem", "ext"], F.col("path")
    ending = r"(?:_([1-9][0-9]*))?(\.[^./]*)?$"
    held = occupied.select(
        X.folder(path).alias("folder"), F.regexp_extract(path, "([^/]*?)" + ending, 1).alias("stem"), F.regexp_extract(path, r"(\.[^./]*)?$", 1).alias("ext"),
        F.coalesce(F.nullif(F.regexp_extract(path, ending, 1), F.lit("")).try_cast("bigint"), F.lit(0)).alias("n"), "sha1_hash",
    ).groupBy(*key, "n").agg(F.min("sha1_hash").alias("sha1_hash"))
    by_number = Window.partitionBy(*key).orderBy("n")
    held = held.withColumn("place", (F.row_number().over(by_number) - 1).cast("bigint"))
    first = held.filter("place = n").groupBy(*key, "sha1_hash").agg(F.min("n").alias("present"))
    judged = wanted.join(first, [*key, "sha1_hash"], "left")
    fresh = numbered(judged.filter("present is null"), key).select("id", *key, (F.col("k") - 1).alias("at"), F.lit(1).alias("side"))
    taken = held.select(F.lit(None).cast("bigint").alias("id"), *key, (F.col("n") - F.col("place")).alias("at"), F.lit(0).alias("side"))
    upto = Window.partitionBy(*key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = fresh.unionByName(taken).withColumn("below", F.sum(1 - F.col("side")).over(upto)).filter("side = 1").select("id", *key, (F.col("at") + F.col("below")).alias("n"), F.lit(False).alias("already"))
    rows = placed.unionByName(judged.filter("present is not null").select("id", *key, F.col("present").alias("n"), F.lit(True).alias("already")))
    return rows.select("id", F.concat("folder", F.lit("/"), "stem", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), "ext").alias("target"), "already")


#: Ids of one part of a snapshot token.
TOKEN_IDS = 1000


@query("snapshot_token", """
SELECT folder, sha256(string_agg(part || ':' || digest, ',' ORDER BY part)) AS token, CAST(sum(n) AS BIGINT) AS files FROM (
  SELECT camera AS folder, id // 1000 AS part, count(*) AS n, sha256(string_agg(id || ':' || status || ':' || coalesce(sha1_hash, ''), ',' ORDER BY id)) AS digest FROM photos GROUP BY 1, 2) GROUP BY folder""")
def snapshot_token(photos: DataFrame, ids: int = TOKEN_IDS) -> DataFrame:
    """A digest of each folder's rows in order, which a confirmation must still match.

    It is a digest of digests: a part holds the rows of `ids` neighbouring ids at most, and a folder gathers one line a
    part, so that no array grows with a folder's rows by more than a thousandth of them.
    """
    line = F.concat_ws(":", F.col("id").cast("string"), "status", F.coalesce("sha1_hash", F.lit("")))
    digest = lambda rows: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["line"]), ","), 256)
    parts = photos.groupBy(F.col("camera").alias("folder"), F.floor(F.col("id") / ids).alias("part")).agg(digest(F.struct("id", line.alias("line"))).alias("digest"), F.count(F.lit(1)).alias("n"))
    whole = F.struct("part", F.concat_ws(":", F.col("part").cast("string"), "digest").alias("line"))
    return parts.groupBy("folder").agg(digest(whole).alias("token"), F.sum("n").alias("files"))


@query("selection_skips", "SELECT id, CASE WHEN status IN ('Rejected', 'Rejected_Copied') THEN 'already rejected' WHEN status NOT IN ('Completed', 'Copied', 'Found_At_Destination') THEN 'not delivered' WHEN id IN (SELECT photo_id FROM issues WHERE NOT resolved AND category = 'unestablished_outcome') THEN 'open issue' ELSE 'reject' END AS outcome FROM photos")
def selection_skips(photos: DataFrame, issues: DataFrame) -> DataFrame:
    """What a reject of all photos would do with each."""
    open_ids = issues.filter("not resolved and category = 'unestablished_outcome'").select(F.col("photo_id").alias("id"), F.lit(True).alias("open")).distinct()
    s = F.col("status")
    outcome = F.when(s.isin(*schema.IN_REJECTS), "already rejected").when(~s.isin(*schema.DELIVERED), "not delivered").when(F.col("open"), "open issue").otherwise("reject")
    return photos.join(open_ids, "id", "left").select("id", outcome.alias("outcome"))
