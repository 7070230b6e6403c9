"""The gallery's named predicates: views, filters, holds and reasons, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query
from .review import FLAGS_SQL

DELIVERED_SQL = "('Completed', 'Copied', 'Found_At_Destination')"
UNORGANIZED_SQL = "('Pending', 'Processing', 'Failed')"


def view_predicates() -> dict[str, Column]:
    """The views that a status and a date decide. Others join something: similar, review and job."""
    s, d = F.col("status"), F.col("date_taken")
    every = (*schema.DELIVERED, *schema.NOT_ORGANIZED)
    return {
        "all": s.isin(*every), "organized": s.isin(*schema.DELIVERED), "unorganized": s.isin(*schema.NOT_ORGANIZED), "source": s.isin(*schema.STILL_IN_SOURCE),
        "suspicious": s.isin(*every) & X.suspicious(d, s), "rejects": s.isin(*schema.IN_REJECTS) & F.col("in_rejects"), "job": ~s.isin(*schema.COPIES),
    }


def in_rejects(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Adds in_rejects: whether the listing shows the file at its place under the rejects folder."""
    there = observed.filter(X.under(F.col("path"), "/dst/rejects")).select(F.col("path").alias("dest_path"), F.lit(True).alias("there")).distinct()
    return photos.join(there, "dest_path", "left").withColumn("in_rejects", F.coalesce("there", F.lit(False))).drop("there")


@query("view_members", f"""
SELECT v AS view, id FROM (SELECT id, unnest([CASE WHEN status IN {DELIVERED_SQL} OR status IN {UNORGANIZED_SQL} THEN 'all' END, CASE WHEN status IN {DELIVERED_SQL} THEN 'organized' END, CASE WHEN status IN {UNORGANIZED_SQL} THEN 'unorganized' END,
  CASE WHEN status IN ('Pending', 'Processing', 'Failed', 'Copied', 'Rejected_Copied') THEN 'source' END, CASE WHEN (status IN {DELIVERED_SQL} OR status IN ('Pending', 'Processing')) AND (CAST(substr(date_taken, 1, 4) AS INTEGER) < 1800 OR CAST(substr(date_taken, 1, 4) AS INTEGER) > 2027) THEN 'suspicious' END,
  CASE WHEN status IN ('Rejected', 'Rejected_Copied') AND dest_path IN (SELECT path FROM observed) THEN 'rejects' END, CASE WHEN status NOT IN ('Duplicate', 'Removed_Duplicate') THEN 'job' END, CASE WHEN id IN (SELECT a.photo_id FROM available a JOIN available b ON a.photo_id <> b.photo_id AND bit_count(xor(a.h, b.h)) <= 16) THEN 'similar' END, CASE WHEN id IN (SELECT id FROM ({FLAGS_SQL}) WHERE small OR later OR odd_date OR issue) THEN 'review' END]) AS v FROM photos) WHERE v IS NOT NULL""")
def view_members(photos: DataFrame, observed: DataFrame, match_cache: DataFrame, contents: DataFrame, review_events: DataFrame, issues: DataFrame) -> DataFrame:
    """Every photo in every view that holds it: one predicate map, one pass over the photos and what the views join."""
    from .review import review_flags

    similar = match_cache.filter("at_75 > 0").select(F.col("photo_id").alias("id"), F.lit(True).alias("similar"))
    asked = review_flags(photos, contents, review_events, issues).select("id", (F.col("small") | F.col("later") | F.col("odd_date") | F.col("issue")).alias("asked"))
    rows = in_rejects(photos, observed).join(similar, "id", "left").join(asked, "id", "left")
    views = view_predicates() | {"similar": F.col("similar"), "review": F.col("asked")}
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in views.items()]))
    return rows.select(F.explode(names).alias("view"), "id")


@query("filter_top_files", "SELECT id, source_path FROM photos WHERE source_path LIKE '/src/%' AND instr(substr(source_path, 6), '/') = 0 UNION SELECT id, source_path FROM photos WHERE source_path LIKE '/src/src1/en/%'")
def filter_top_files(photos: DataFrame, root: str = "/src", folders: tuple = (".", "src1/en")) -> DataFrame:
    """Files in folders below a root; "." is the files directly in it, which no subfolder holds."""
    base, path, keep = root.rstrip("/") + "/", F.col("source_path"), F.lit(False)
    for one in folders:
        keep = keep | (path.startswith(base) & (F.instr(F.substring(path, len(base) + 1, 1 << 20), "/") == 0) if one == "." else path.startswith(f"{base}{one}/"))
    return photos.filter(keep).select("id", "source_path")


@query("folder_names", r"""
SELECT id, f AS folder, CASE WHEN f = '.' THEN f WHEN f = '' OR f LIKE '/%' OR n = '..' OR n LIKE '../%' OR n IN ('', '.') THEN NULL ELSE n END AS normal FROM (
  SELECT id, folder AS f, CASE WHEN folder LIKE '%/./%' THEN replace(folder, '/./', '/') WHEN folder LIKE '%//%' THEN replace(folder, '//', '/') WHEN folder LIKE '%/' THEN rtrim(folder, '/') ELSE folder END AS n FROM asked)""")
def folder_names(asked: DataFrame) -> DataFrame:
    """A folder as a user names it, cleaned of empty and "." steps; null where it is empty, absolute or outside."""
    return asked.select("id", "folder", X.normal_folder(F.col("folder")).alias("normal"))


@query("other_names", r"""
SELECT p.id FROM (SELECT *, regexp_extract(dest_path, '([^/]*)\.[^./]*$', 1) AS stem FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination')) p
WHERE EXISTS (SELECT 1 FROM photos d WHERE d.sha1_hash = p.sha1_hash AND regexp_extract(d.source_path, '([^/]*)\.[^./]*$', 1) <> p.stem) OR EXISTS (SELECT 1 FROM photos d JOIN log_entries o ON o.photo_id = d.id WHERE d.sha1_hash = p.sha1_hash AND regexp_extract(o.source_path, '([^/]*)\.[^./]*$', 1) <> p.stem)""")
def other_names(photos: DataFrame, log_entries: DataFrame) -> DataFrame:
    """Delivered photos whose content also has, or had at an operation, another name. A content's least and greatest names decide: no pair is made."""
    named = lambda df: df.select("sha1_hash", X.stem(F.col("source_path")).alias("n"))
    then = log_entries.groupBy(F.col("photo_id").alias("id")).agg(F.min_by("source_path", X.stem(F.col("source_path"))).alias("low"), F.max_by("source_path", X.stem(F.col("source_path"))).alias("high"))
    then = then.join(photos.select("id", "sha1_hash"), "id").select("sha1_hash", F.explode(F.array("low", "high")).alias("source_path"))
    names = named(photos).union(named(then)).groupBy("sha1_hash").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    rows = photos.filter(F.col("status").isin(*schema.DELIVERED)).join(names, "sha1_hash")
    own = X.stem(F.col("dest_path"))
    return rows.filter((F.col("least") != own) | (F.col("most") != own)).select("id")


HELD_SQL = "SELECT photo_id FROM captures GROUP BY photo_id HAVING arg_max(state, id) = 'needs_attention'"


@query("source_summary", f"""
SELECT f AS filter, count(*) AS n, min(id) AS first FROM (SELECT p.id, unnest([CASE WHEN status = 'Pending' AND p.id NOT IN ({HELD_SQL}) THEN 'ready' END, CASE WHEN status = 'Pending' THEN 'indexed' END, CASE WHEN sha1_hash IN (SELECT sha1_hash FROM photos WHERE status = 'Duplicate') THEN 'identical' END,
    CASE WHEN status = 'Pending' AND sha1_hash NOT IN (SELECT sha1_hash FROM contents WHERE width > 0 AND height > 0 AND h62 IS NOT NULL) THEN 'unknown_dimensions' END, CASE WHEN status = 'Processing' THEN 'unfinished' END, CASE WHEN status = 'Failed' THEN 'failed' END,
    CASE WHEN status <> 'Failed' AND p.id IN ({HELD_SQL}) THEN 'metadata_held' END]) AS f FROM photos p WHERE status IN {UNORGANIZED_SQL}) WHERE f IS NOT NULL GROUP BY f""")
def source_summary(photos: DataFrame, contents: DataFrame, captures: DataFrame) -> DataFrame:
    """How many photos each of the seven filters of the source summary keeps, and the first of them.

    Here a content's dimensions count as known where its picture could be read, which is where it has a hash.
    """
    copied = photos.filter("status = 'Duplicate' and sha1_hash is not null").select("sha1_hash", F.lit(True).alias("copied")).distinct()
    known = contents.filter("width > 0 and height > 0 and h62 is not null and sha1_hash is not null").select("sha1_hash", F.lit(True).alias("known")).distinct()
    rows = photos.filter(F.col("status").isin(*schema.NOT_ORGANIZED)).join(copied, "sha1_hash", "left").join(known, "sha1_hash", "left").join(metadata_held(captures), "id", "left")
    s, no = F.col("status"), F.lit(False)
    held = F.coalesce("held", no)
    named = {"ready": (s == "Pending") & ~held, "indexed": s == "Pending", "identical": F.coalesce("copied", no), "unknown_dimensions": (s == "Pending") & F.col("known").isNull(), "unfinished": s == "Processing", "failed": s == "Failed", "metadata_held": (s != "Failed") & held}
    each = rows.select("id", F.explode(F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in named.items()]))).alias("filter"))
    return each.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def metadata_held(captures: DataFrame) -> DataFrame:
    """id, held: photos whose latest capture needs attention."""
    last = captures.groupBy(F.col("photo_id").alias("id")).agg(F.max_by("state", "id").alias("state"))
    return last.filter("state = 'needs_attention'").select("id", F.lit(True).alias("held"))


@query("source_hold", f"""
SELECT p.id, p.id IN ({HELD_SQL}) AS metadata_held, coalesce(v.state = 'waiting', false) AS waiting, coalesce(v.state = 'not_kept', false) AS not_kept, p.id IN ({HELD_SQL}) OR coalesce(v.state = 'waiting', false) AS attention, p.id IN ({HELD_SQL}) OR coalesce(v.state IN ('waiting', 'not_kept'), false) AS hold
FROM photos p LEFT JOIN (SELECT photo_id, arg_max(answer, id) AS state FROM version_answers GROUP BY photo_id) v ON v.photo_id = p.id WHERE p.status IN {UNORGANIZED_SQL}""")
def source_hold(photos: DataFrame, captures: DataFrame, version_answers: DataFrame) -> DataFrame:
    """Why a photo in the source is held: its latest capture, or an earlier version that waits or was not kept."""
    last = version_answers.groupBy(F.col("photo_id").alias("id")).agg(F.max_by("answer", "id").alias("state"))
    rows = photos.filter(F.col("status").isin(*schema.NOT_ORGANIZED)).select("id").join(metadata_held(captures), "id", "left").join(last, "id", "left")
    held, state = F.coalesce("held", F.lit(False)), F.coalesce("state", F.lit(""))
    waiting, not_kept = state == "waiting", state == "not_kept"
    return rows.select("id", held.alias("metadata_held"), waiting.alias("waiting"), not_kept.alias("not_kept"), (held | waiting).alias("attention"), (held | waiting | not_kept).alias("hold"))


@query("date_pending", f"""
SELECT id, date_taken FROM photos p WHERE status IN {DELIVERED_SQL} AND (CAST(substr(date_taken, 1, 4) AS INTEGER) < 1800 OR CAST(substr(date_taken, 1, 4) AS INTEGER) > 2027) AND NOT EXISTS (SELECT 1 FROM confirmations c WHERE c.photo_id = p.id AND c.date_taken = p.date_taken)""")
def date_pending(photos: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Delivered photos of a suspicious date that nobody confirmed; a confirmation holds for the date that it saw."""
    rows = photos.filter(F.col("status").isin(*schema.DELIVERED) & X.suspicious(F.col("date_taken"), F.col("status")))
    return rows.join(confirmations.select(F.col("photo_id").alias("id"), "date_taken"), ["id", "date_taken"], "left_anti").select("id", "date_taken")


@query("small_pending", f"""
SELECT p.id FROM photos p JOIN contents c USING (sha1_hash) WHERE p.status IN {DELIVERED_SQL} AND least(c.width, c.height) < 1000 AND p.sha1_hash NOT IN (SELECT q.sha1_hash FROM review_events r JOIN photos q ON q.id = r.photo_id WHERE r.action = 'view')""")
def small_pending(photos: DataFrame, contents: DataFrame, review_events: DataFrame) -> DataFrame:
    """Delivered small photos of whose content no copy was reviewed."""
    seen = review_events.filter("action = 'view'").select(F.col("photo_id").alias("id")).distinct().join(photos.select("id", "sha1_hash"), "id").select("sha1_hash").distinct()
    small = contents.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.least("width", "height") < 1000)).select("sha1_hash")
    return photos.filter(F.col("status").isin(*schema.DELIVERED)).join(small, "sha1_hash", "left_semi").join(seen, "sha1_hash", "left_anti").select("id")


@query("library_pending", """
SELECT p.id, f.kind FROM photos p JOIN findings f ON f.photo_id = p.id AND f.path = p.dest_path AND f.expected_sha1 IS NOT DISTINCT FROM p.sha1_hash WHERE f.run_id = (SELECT max(run_id) FROM findings WHERE completed) AND f.settled_by IS NULL""")
def library_pending(photos: DataFrame, findings: DataFrame) -> DataFrame:
    """Photos that the latest completed check's findings still describe: same path, same content, not settled."""
    last = F.broadcast(findings.filter("completed").agg(F.max("run_id").alias("last")))  # one row
    open_ones = findings.filter("settled_by is null").join(last, F.col("run_id") == F.col("last")).select("photo_id", "path", "expected_sha1", "kind")
    same = (photos["id"] == open_ones["photo_id"]) & (photos["dest_path"] == open_ones["path"]) & photos["sha1_hash"].eqNullSafe(open_ones["expected_sha1"])
    return photos.join(open_ones, same).select("id", "kind")


@query("not_an_image", r"""
SELECT path, CASE WHEN size = 0 THEN 'empty file' WHEN ext IN ('txt', 'html') THEN 'not an image' WHEN ext = '' THEN 'unknown type' END AS refusal FROM (SELECT path, size, regexp_extract(path, '\.([^./]*)$', 1) AS ext FROM observed)""")
def not_an_image(observed: DataFrame) -> DataFrame:
    """Why a file is refused before it is decoded: empty, or of a type that is no image; null where it is not."""
    ext = X.extension(F.col("path"))
    refusal = F.when(F.col("size") == 0, "empty file").when(ext.isin("txt", "html"), "not an image").when(ext == "", "unknown type")
    return observed.select("path", refusal.alias("refusal"))


SHOWN_SQL = "CASE WHEN status = 'Copied' AND note = 'original kept' THEN 'Copied_Only' ELSE status END"


@query("log_status", f"SELECT op, {SHOWN_SQL} AS shown FROM operations")
def log_status(operations: DataFrame) -> DataFrame:
    """The log's statuses; a copy whose original stayed, which its note tells, has one of its own."""
    return operations.select("op", shown_status().alias("shown"))


def shown_status() -> Column:
    return F.when((F.col("status") == "Copied") & F.coalesce(F.col("note") == "original kept", F.lit(False)), "Copied_Only").otherwise(F.col("status"))


def holds(column: str, term: str) -> Column:
    """Whether a text holds a term, whatever its case; wildcards are letters like others, and no text holds nothing."""
    return F.coalesce(F.ilike(column, F.lit(X.escape_like(term)), F.lit("\\")), F.lit(False))


@query("oplog_filtered", f"""
SELECT op, run_id, photo_id, shown FROM (SELECT *, {SHOWN_SQL} AS shown FROM log_entries) WHERE shown IN ('Failed', 'Copied_Only', 'Completed') AND (source_path ILIKE '%13%' OR dest_path ILIKE '%13%' OR message ILIKE '%13%')""")
def oplog_filtered(log_entries: DataFrame, shown: tuple = ("Failed", "Copied_Only", "Completed"), term: str = "13") -> DataFrame:
    """The log by derived status and by one text over the paths of the time and the message; operations without a photo survive."""
    rows = log_entries.withColumn("shown", shown_status()).filter(F.col("shown").isin(*shown))
    return rows.filter(holds("source_path", term) | holds("dest_path", term) | holds("message", term)).select("op", "run_id", "photo_id", "shown")


@query("oplog_edits", """
SELECT op, run_id, photo_id FROM log_entries o WHERE timestamp >= DATE '1995-01-01' AND timestamp < DATE '1998-01-01' AND EXISTS (SELECT 1 FROM operation_events e WHERE e.op = o.op AND e.step = 'metadata_saved' AND e.outcome = 'verified') AND EXISTS (SELECT 1 FROM operation_events i WHERE i.op = o.op AND i.step = 'intent' AND i.kind = 'metadata_edit')""")
def oplog_edits(log_entries: DataFrame, operation_events: DataFrame, since: str = "1995-01-01", until: str = "1998-01-01") -> DataFrame:
    """Metadata edits of a span of time: operations that meant an edit and saved it, verified. Their steps are read once."""
    saved, meant = (F.col("step") == "metadata_saved") & (F.col("outcome") == "verified"), (F.col("step") == "intent") & F.coalesce(F.col("kind") == "metadata_edit", F.lit(False))
    edits = operation_events.groupBy("op").agg(F.bool_or(saved).alias("saved"), F.bool_or(meant).alias("meant")).filter("saved and meant").select("op")
    rows = log_entries.filter((F.col("timestamp") >= F.lit(since).cast("date")) & (F.col("timestamp") < F.lit(until).cast("date")))
    return rows.join(edits, "op", "left_semi").select("op", "run_id", "photo_id")


@query("oplog_of_photo", """
, files(id) AS (SELECT id FROM photos WHERE id = 61 OR sha1_hash = (SELECT sha1_hash FROM photos WHERE id = 61) UNION SELECT x.id FROM files f JOIN (SELECT origin_file_id AS at, file_id AS id FROM origins UNION SELECT a.file_id, b.file_id FROM consolidations a JOIN consolidations b ON a.op = b.op) x ON x.at = f.id)
SELECT op, photo_id FROM operations WHERE photo_id IN (SELECT id FROM files)""")
def oplog_of_photo(operations: DataFrame, photos: DataFrame, origins: DataFrame, consolidations: DataFrame, photo: int = 61) -> DataFrame:
    """What was done to a photo, to its exact copies, to anything made from these, and to what was consolidated with any of them."""
    from .lineage import closure

    own = photos.filter(F.col("id") == photo).select("sha1_hash").distinct()
    start = photos.join(F.broadcast(own), "sha1_hash", "left_semi").select("id").union(photos.filter(F.col("id") == photo).select("id")).distinct()  # one content
    files = closure(origins, start, consolidations)
    return operations.join(files, operations["photo_id"] == files["id"], "left_semi").select("op", "photo_id")


@query("all_ids", f"SELECT id FROM photos WHERE status IN {DELIVERED_SQL} AND name LIKE '%.cr2' AND substr(date_taken, 1, 4) IN ('1997', '2003')")
def all_ids(photos: DataFrame) -> DataFrame:
    """Select all: every id that the filters keep, without a limit."""
    return photos.filter(F.col("status").isin(*schema.DELIVERED) & (X.extension(F.col("source_path")) == "cr2") & F.substring("date_taken", 1, 4).isin("1997", "2003")).select("id")


@query("sort_smallest", "SELECT id, file_size FROM photos ORDER BY file_size ASC NULLS FIRST, id LIMIT 50")
def sort_smallest(photos: DataFrame, n: int = 50) -> DataFrame:
    return photos.select("id", "file_size").orderBy(F.col("file_size").asc_nulls_first(), "id").limit(n)


@query("gallery_page_oldest", f"SELECT id, date_taken FROM photos WHERE status IN {DELIVERED_SQL} ORDER BY date_taken IS NULL, date_taken, id LIMIT 60")
def gallery_page_oldest(photos: DataFrame, size: int = 60) -> DataFrame:
    return photos.filter(F.col("status").isin(*schema.DELIVERED)).select("id", "date_taken").orderBy(F.col("date_taken").isNull(), "date_taken", "id").limit(size)


@query("sort_duplicates", "SELECT id, copies FROM (SELECT id, CASE WHEN sha1_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY sha1_hash) - 1 END AS copies FROM photos) ORDER BY copies DESC, id LIMIT 50")
def sort_duplicates(photos: DataFrame, n: int = 50) -> DataFrame:
    """Photos with the most copies first; contents are counted before the rows meet them."""
    per = photos.filter("sha1_hash is not null").groupBy("sha1_hash").agg((F.count(F.lit(1)) - 1).alias("copies"))
    return photos.join(per, "sha1_hash", "left").select("id", F.coalesce("copies", F.lit(0)).alias("copies")).orderBy(F.desc("copies"), "id").limit(n)


@query("available_contents", f"""
SELECT c.content_id, min(p.id) AS photo_id FROM photos p JOIN contents c USING (sha1_hash) JOIN observed o ON o.path = p.dest_path AND o.sha1_hash = p.sha1_hash WHERE p.status IN {DELIVERED_SQL} GROUP BY c.content_id""")
def available_contents(photos: DataFrame, contents: DataFrame, observed: DataFrame) -> DataFrame:
    """One delivered photo for each content whose file the listing shows at its path with that content."""
    there = observed.select(F.col("path").alias("dest_path"), "sha1_hash").distinct()
    held = photos.filter(F.col("status").isin(*schema.DELIVERED)).join(there, ["dest_path", "sha1_hash"], "left_semi")
    return held.join(contents.select("sha1_hash", "content_id"), "sha1_hash").groupBy("content_id").agg(F.min("id").alias("photo_id"))


@query("thumbnail_of_photo", "SELECT p.id, t.size, t.bytes FROM photos p JOIN contents c USING (sha1_hash) JOIN thumbnails t USING (content_id) WHERE t.present")
def thumbnail_of_photo(photos: DataFrame, contents: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """The cached pictures of each photo's content."""
    held = thumbnails.filter("present").join(contents.select("content_id", "sha1_hash"), "content_id")
    return photos.select("id", "sha1_hash").join(held, "sha1_hash").select("id", "size", "bytes")


@query("thumbnail_cache_totals", "SELECT size, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM thumbnails WHERE present GROUP BY size")
def thumbnail_cache_totals(thumbnails: DataFrame) -> DataFrame:
    return thumbnails.filter("present").groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("unread_count", "SELECT count(*) AS unread, max(id) AS newest FROM runs WHERE status <> 'Running' AND id NOT IN (SELECT id FROM review_events WHERE action = 'view')")
def unread_count(runs: DataFrame, review_events: DataFrame) -> DataFrame:
    return runs.filter("status <> 'Running'").join(review_events.filter("action = 'view'").select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("unread"), F.max("id").alias("newest"))


@query("rejects_reminder", """
SELECT files, bytes, days, files >= 100 OR bytes >= 1000000000 OR days >= 90 AS remind FROM (SELECT count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, CAST(coalesce(date_diff('day', min(l.last), TIMESTAMP '2026-01-01'), 0) AS BIGINT) AS days
  FROM photos p LEFT JOIN (SELECT photo_id, max(created_at) AS last FROM review_events WHERE action = 'error' GROUP BY photo_id) l ON l.photo_id = p.id WHERE p.status IN ('Rejected', 'Rejected_Copied'))""")
def rejects_reminder(photos: DataFrame, review_events: DataFrame, now: str = "2026-01-01", most_files: int = 100, most_bytes: int = 1_000_000_000, most_days: int = 90) -> DataFrame:
    """Whether the rejects ask to be looked at: by their number, their size, or the age of the oldest."""
    last = review_events.filter("action = 'error'").groupBy(F.col("photo_id").alias("id")).agg(F.max("created_at").alias("last"))
    days = F.coalesce(F.datediff(F.lit(now).cast("date"), F.min("last").cast("date")), F.lit(0)).cast("bigint")
    per = photos.filter(F.col("status").isin(*schema.IN_REJECTS)).join(last, "id", "left").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), days.alias("days"))
    return per.withColumn("remind", (F.col("files") >= most_files) | (F.col("bytes") >= most_bytes) | (F.col("days") >= most_days))


@query("hash_texts", r"""
SELECT content_id, phash_state = 'ok' AND regexp_full_match(lower(text), '[0-9a-f]{16}') AS usable FROM hash_records""")
def hash_texts(hash_records: DataFrame) -> DataFrame:
    """Whether a recorded hash is one: sixteen hexadecimal digits of a picture that could be read."""
    return hash_records.select("content_id", ((F.col("phash_state") == "ok") & F.lower("text").rlike("^[0-9a-f]{16}$")).alias("usable"))


@query("discovery_breakdown", r"""
SELECT CASE WHEN ext IN ('jpg', 'png', 'tif', 'cr2') THEN 'photos' WHEN ext IN ('xmp', 'aae') THEN 'sidecars' WHEN ext IN ('mp4', 'mov', 'avi', 'mkv') THEN 'videos' WHEN ext IN ('jpeg', 'nef') THEN 'disabled' ELSE 'other' END AS part, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT regexp_extract(path, '\.([^./]*)$', 1) AS ext, size FROM observed) GROUP BY 1""")
def discovery_breakdown(observed: DataFrame, enabled: tuple = ("jpg", "png", "tif", "cr2")) -> DataFrame:
    """What a walk found, in parts: photos of enabled types, photos of types that are switched off, sidecars, videos, others."""
    ext = X.extension(F.col("path"))
    part = F.when(ext.isin(*enabled), "photos").when(ext.isin("xmp", "aae"), "sidecars").when(ext.isin("mp4", "mov", "avi", "mkv"), "videos").when(ext.isin(*schema.RASTER, *schema.RAW), "disabled").otherwise("other")
    return observed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("selected_ids", "SELECT p.id, p.status FROM photos p WHERE p.id IN (SELECT unnest([3, 5, 8, 13, 21, 34, 55, 89, 144, 100000007]))")
def selected_ids(photos: DataFrame, wanted: tuple = (3, 5, 8, 13, 21, 34, 55, 89, 144, 100_000_007)) -> DataFrame:
    """A list of ids that a caller hands over, as a table (of bounded length, hence broadcast)."""
    ids = photos.sparkSession.createDataFrame([(i,) for i in wanted], "id long")
    return photos.join(F.broadcast(ids), "id", "left_semi").select("id", "status")
