"""What a check's findings mean: where content went, how grave a finding is, labels of clashing names, decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query
from .checks import CHECK_SQL, destination_check

#: Where a file's content may turn up, best first: in the library, in the rejects, in the source.
PLACES_SQL = f"""
SELECT observed AS sha1_hash, path AS found, CASE WHEN path LIKE '/dst/rejects/%' THEN 2 ELSE 1 END AS rank FROM ({CHECK_SQL}) WHERE kind = 'unknown' UNION ALL SELECT sha1_hash, source_path, 3 FROM photos WHERE status IN ('Pending', 'Processing', 'Failed', 'Copied', 'Rejected_Copied')"""
LOCATED_SQL = f"""
SELECT m.id, m.path, m.kind, m.observed, p.rank, p.found FROM (SELECT * FROM ({CHECK_SQL}) WHERE kind IN ('missing', 'changed')) m LEFT JOIN (SELECT sha1_hash, rank, found FROM (SELECT *, row_number() OVER (PARTITION BY sha1_hash ORDER BY rank, found) AS k FROM ({PLACES_SQL})) WHERE k = 1) p ON p.sha1_hash = m.expected"""


def places(photos: DataFrame, rows: DataFrame) -> DataFrame:
    """sha1_hash, rank, found: the best place of each content; of equal ones the first path."""
    unknown = rows.filter("kind = 'unknown'").select(F.col("observed").alias("sha1_hash"), F.when(X.under(F.col("path"), "/dst/rejects"), 2).otherwise(1).alias("rank"), F.col("path").alias("found"))
    source = photos.filter(F.col("status").isin(*schema.STILL_IN_SOURCE)).select("sha1_hash", F.lit(3).alias("rank"), F.col("source_path").alias("found"))
    return unknown.union(source).filter("sha1_hash is not null").groupBy("sha1_hash").agg(F.min(F.struct("rank", "found")).alias("x")).select("sha1_hash", "x.rank", "x.found")


@query("located_findings", f"SELECT id, path, kind, CASE rank WHEN 1 THEN 'library' WHEN 2 THEN 'rejects' WHEN 3 THEN 'source' END AS found_in, found FROM ({LOCATED_SQL})")
def located_findings(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing and changed files with the best place where their content still is."""
    return _located(photos, observed).select("id", "path", "kind", "found_in", "found")


def _located(photos: DataFrame, observed: DataFrame) -> DataFrame:
    rows = destination_check(photos, observed)
    best = places(photos, rows).withColumnRenamed("sha1_hash", "expected")
    where = F.when(F.col("rank") == 1, "library").when(F.col("rank") == 2, "rejects").when(F.col("rank") == 3, "source")
    return rows.filter(F.col("kind").isin("missing", "changed")).join(best, "expected", "left").withColumn("found_in", where)


DESCRIBED_SQL = f"""
SELECT path, finding, CASE finding WHEN 'moved' THEN 'warn' WHEN 'renamed' THEN 'warn' WHEN 'lost' THEN 'bad' WHEN 'missing' THEN 'warn' WHEN 'replaced' THEN CASE WHEN held THEN 'warn' ELSE 'bad' END WHEN 'changed' THEN 'warn' WHEN 'unknown_photo' THEN 'warn' WHEN 'empty' THEN 'warn' ELSE 'quiet' END AS tone FROM (
  SELECT l.path, l.rank IS NOT NULL AS held, CASE WHEN l.kind = 'changed' THEN CASE WHEN bit_count(xor(s.recorded, s.seen)) > 16 THEN 'replaced' ELSE 'changed' END WHEN l.rank = 1 AND regexp_extract(l.found, '^(.*)/[^/]*$', 1) = regexp_extract(l.path, '^(.*)/[^/]*$', 1) THEN 'renamed' WHEN l.rank = 1 THEN 'moved' WHEN l.rank IS NULL THEN 'lost' ELSE 'missing' END AS finding
  FROM ({LOCATED_SQL}) l LEFT JOIN looks s ON s.photo_id = l.id
  UNION ALL SELECT path, true, CASE WHEN size = 0 THEN 'empty' WHEN ext = '' THEN 'unrecognised' WHEN ext NOT IN ('jpg', 'png', 'cr2', 'tif') THEN 'other_type' WHEN observed IN (SELECT sha1_hash FROM photos) THEN 'extra_copy' ELSE 'unknown_photo' END FROM (SELECT *, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM ({CHECK_SQL}) WHERE kind = 'unknown'))"""


@query("described_findings", DESCRIBED_SQL)
def described_findings(photos: DataFrame, observed: DataFrame, looks: DataFrame) -> DataFrame:
    """Each finding by name, with its tone: bad where something is lost, warn where something is to be done, else quiet."""
    known = _located(photos, observed).join(looks.select(F.col("photo_id").alias("id"), "recorded", "seen"), "id", "left")
    other = F.bit_count(F.col("recorded").bitwiseXOR(F.col("seen"))) > max(schema.THRESHOLDS.values())
    same_folder = X.folder(F.col("found")) == X.folder(F.col("path"))
    finding = (
        F.when((F.col("kind") == "changed") & other, "replaced").when(F.col("kind") == "changed", "changed").when((F.col("found_in") == "library") & same_folder, "renamed")
        .when(F.col("found_in") == "library", "moved").when(F.col("found_in").isNull(), "lost").otherwise("missing")
    )
    known = known.select("path", finding.alias("finding"), F.col("found").isNotNull().alias("held"))
    ext = X.extension(F.col("path"))
    held = photos.select(F.col("sha1_hash").alias("observed"), F.lit(True).alias("known")).filter("observed is not null").distinct()
    unknown = destination_check(photos, observed).filter("kind = 'unknown'").join(held, "observed", "left")
    kind = F.when(F.col("size") == 0, "empty").when(ext == "", "unrecognised").when(~ext.isin(*schema.RASTER, *schema.RAW), "other_type").when(F.col("known"), "extra_copy").otherwise("unknown_photo")
    rows = known.union(unknown.select("path", kind.alias("finding"), F.lit(True).alias("held")))
    return rows.select("path", "finding", tone(F.col("finding"), F.col("held")).alias("tone"))


def tone(finding: Column, held: Column) -> Column:
    lost = (finding == "lost") | ((finding == "replaced") & ~held)
    return F.when(lost, "bad").when(finding.isin("moved", "renamed", "missing", "replaced", "changed", "unknown_photo", "empty"), "warn").otherwise("quiet")


@query("findings_by_severity", f"SELECT path, finding, tone FROM ({DESCRIBED_SQL}) ORDER BY CASE tone WHEN 'bad' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, path LIMIT 200")
def findings_by_severity(photos: DataFrame, observed: DataFrame, looks: DataFrame, most: int = 200) -> DataFrame:
    """The head of a report: the gravest findings first, then by path."""
    severity = F.when(F.col("tone") == "bad", 0).when(F.col("tone") == "warn", 1).otherwise(2)
    return described_findings(photos, observed, looks).orderBy(severity, "path").limit(most)


@query("finding_totals", f"SELECT finding, tone, count(*) AS n FROM ({DESCRIBED_SQL}) GROUP BY 1, 2")
def finding_totals(photos: DataFrame, observed: DataFrame, looks: DataFrame) -> DataFrame:
    return described_findings(photos, observed, looks).groupBy("finding", "tone").agg(F.count(F.lit(1)).alias("n"))


@query("look_verdicts", "SELECT photo_id, CAST(bit_count(xor(recorded, seen)) AS INTEGER) AS distance, CASE WHEN bit_count(xor(recorded, seen)) <= 16 THEN 'alike' ELSE 'different' END AS look FROM looks")
def look_verdicts(looks: DataFrame) -> DataFrame:
    """Whether a changed file still looks like the photo that it replaced."""
    d = F.bit_count(F.col("recorded").bitwiseXOR(F.col("seen")))
    return looks.select("photo_id", d.alias("distance"), F.when(d <= max(schema.THRESHOLDS.values()), "alike").otherwise("different").alias("look"))


@query("repair_groups", f"""
SELECT CASE WHEN rank = 1 THEN 'move_back' WHEN rank = 2 THEN 'from_rejects' WHEN rank = 3 THEN 'copy_back' WHEN kind = 'changed' THEN 'keep_new' ELSE 'advice' END AS fix, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files, min(path) AS first FROM ({LOCATED_SQL}) GROUP BY 1, 2""")
def repair_groups(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """What would repair the findings, by kind of repair and folder; a plan, nothing is moved."""
    where = F.col("found_in")
    fix = F.when(where == "library", "move_back").when(where == "rejects", "from_rejects").when(where == "source", "copy_back").when(F.col("kind") == "changed", "keep_new").otherwise("advice")
    return _located(photos, observed).groupBy(fix.alias("fix"), X.folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


@query("clash_folder_labels", r"""
SELECT name, folder, label FROM (SELECT c.name, c.folder, s.label, row_number() OVER (PARTITION BY c.name, c.folder ORDER BY s.depth) AS k FROM clashes c JOIN (
  SELECT name, folder, depth, CASE WHEN depth < parts THEN '…/' || suffix ELSE folder END AS label, count(*) OVER (PARTITION BY name, suffix) AS holders FROM (
    SELECT name, folder, depth, len(string_split(folder, '/')) - 1 AS parts, array_to_string((string_split(folder, '/'))[-depth:], '/') AS suffix FROM (SELECT name, folder, unnest(range(1, len(string_split(folder, '/')))) AS depth FROM clashes))) s
  ON s.name = c.name AND s.folder = c.folder AND s.holders = 1) WHERE k = 1""")
def clash_folder_labels(clashes: DataFrame) -> DataFrame:
    """For names that several contents share, each folder's shortest end that no other folder of the name has.

    A folder sends one row for each of its steps; suffixes are counted map-side.
    """
    parts = F.slice(F.split("folder", "/"), 2, 1 << 20)
    each = clashes.select("name", "folder", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    each = each.withColumn("suffix", F.array_join(F.slice("parts", F.size("parts") - F.col("depth") + 1, F.col("depth")), "/"))
    single = each.groupBy("name", "suffix").agg(F.count(F.lit(1)).alias("holders"), F.min("folder").alias("folder"), F.min("depth").alias("depth"), F.min(F.size("parts")).alias("n")).filter("holders = 1")
    label = F.when(F.col("depth") < F.col("n"), F.concat(F.lit("…/"), "suffix")).otherwise(F.col("folder"))
    return single.groupBy("name", "folder").agg(F.min_by(label, "depth").alias("label"))


@query("folder_chains", """
SELECT c.top AS path, f.folder AS shown, f.photos FROM (SELECT folder, count(*) AS photos FROM (SELECT unnest(['/src', '/src/' || camera, '/src/' || camera || '/' || lens, '/src/' || camera || '/' || lens || '/only']) AS folder FROM photos) GROUP BY 1) f JOIN (SELECT '/src/' || camera || '/' || lens AS top, '/src/' || camera || '/' || lens || '/only' AS last FROM photos GROUP BY 1, 2) c ON c.last = f.folder
UNION ALL SELECT folder, folder, count(*) FROM (SELECT unnest(['/src', '/src/' || camera]) AS folder FROM photos) GROUP BY 1 HAVING folder = '/src' OR folder IN (SELECT '/src/' || camera FROM photos GROUP BY camera HAVING count(DISTINCT lens) > 1)
UNION ALL SELECT '/src/' || camera, '/src/' || camera || '/' || min(lens) || '/only', count(*) FROM photos GROUP BY camera HAVING count(DISTINCT lens) = 1""")
def folder_chains(photos: DataFrame) -> DataFrame:
    """The folder tree with chains drawn together: a folder that holds one folder and no file of its own is that folder.

    Here every file lies one folder deeper than in the catalog, so that there are chains. A chain is as long as a path.
    """
    folder = F.concat(X.folder(F.col("source_path")), F.lit("/only"))
    parts = F.split(folder, "/")
    rows = photos.select(parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.size(parts))).alias("k"))
    rows = rows.select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("folder"), (F.col("k") == F.size("parts")).alias("own"))
    nodes = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("photos"), F.count_if("own").alias("own")).withColumn("parent", X.folder(F.col("folder")))
    single = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.max("folder").alias("child"))
    chained = nodes.join(single.withColumnRenamed("parent", "folder"), "folder", "left").withColumn("joined", (F.col("own") == 0) & (F.col("children") == 1) & (F.col("parent") != ""))
    heads = chained.join(chained.select(F.col("folder").alias("parent"), F.col("joined").alias("under_chain")), "parent", "left").filter(~F.coalesce("under_chain", F.lit(False)))
    # a chain ends in the shallowest folder at or below its head that is not joined to its child
    ends = chained.filter(~F.coalesce("joined", F.lit(False))).select(F.col("folder").alias("shown"), F.col("photos").alias("n"))
    steps = F.split("shown", "/")
    above = ends.select("shown", "n", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("folder"))
    found = heads.select("folder", "photos").join(above, "folder").filter("n = photos")
    return found.groupBy(F.col("folder").alias("path"), "photos").agg(F.min_by("shown", F.length("shown")).alias("shown")).select("path", "shown", "photos")


@query("outside_count", "SELECT count(*) AS outside FROM photos WHERE status <> 'Failed' AND NOT source_path LIKE '/src/src1/%'")
def outside_count(photos: DataFrame, root: str = "/src/src1") -> DataFrame:
    """Photos that lie outside the folder that the tree shows."""
    return photos.filter((F.col("status") != "Failed") & ~X.under(F.col("source_path"), root)).agg(F.count(F.lit(1)).alias("outside"))


@query("unchanged_sources", """
SELECT c.path, CASE WHEN p.path IS NOT NULL AND p.size = c.size AND abs(p.mtime - c.mtime) < 0.000001 THEN 'unchanged' ELSE 'to_scan' END AS verdict FROM candidates c LEFT JOIN (SELECT * FROM recorded WHERE status IN ('Pending', 'Copied', 'Duplicate', 'Rejected_Copied')) p ON p.path = c.path""")
def unchanged_sources(candidates: DataFrame, recorded: DataFrame, force: bool = False) -> DataFrame:
    """Which files of a walk need not be read: size and time as recorded, in a row that is settled and still has its source."""
    settled = recorded.filter(F.col("status").isin(*schema.SETTLED)).select("path", F.col("size").alias("known_size"), F.col("mtime").alias("known_mtime"))
    same = F.lit(not force) & (F.col("known_size") == F.col("size")) & (F.abs(F.col("known_mtime") - F.col("mtime")) < 1e-6)
    return candidates.join(settled, "path", "left").select("path", F.when(same, "unchanged").otherwise("to_scan").alias("verdict"))


@query("relocation_outcomes", """
SELECT op, CASE WHEN source_state = 'unreadable' OR dest_state = 'unreadable' THEN 'open' WHEN dest_state = 'match' AND source_state = 'absent' THEN 'moved' WHEN source_state IN ('match', 'present') AND dest_state = 'absent' THEN 'not_moved' WHEN dest_state = 'match' AND source_state = 'match' AND run_id % 2 = 0 THEN 'moved' ELSE 'open' END AS outcome FROM ends""")
def relocation_outcomes(ends: DataFrame) -> DataFrame:
    """What became of an interrupted rename, by what lies under the old and the new name.

    Only one name holds the file, or both are the same file (here of every second run): settled; all else stays open.
    """
    old, new, same_file = F.col("source_state"), F.col("dest_state"), F.col("run_id") % 2 == 0
    unreadable = (old == "unreadable") | (new == "unreadable")
    moved = (new == "match") & ((old == "absent") | ((old == "match") & same_file))
    outcome = F.when(unreadable, "open").when(moved, "moved").when(old.isin("match", "present") & (new == "absent"), "not_moved").otherwise("open")
    return ends.select("op", outcome.alias("outcome"))


@query("emptied_rejects", """
SELECT id, CASE WHEN status = 'Rejected' THEN 'Rejected_Emptied' ELSE status END AS new_status FROM photos WHERE status IN ('Rejected', 'Rejected_Copied') AND dest_path NOT IN (SELECT path FROM observed) AND id NOT IN (SELECT photo_id FROM issues WHERE category = 'unestablished_outcome' AND NOT resolved)
  AND id NOT IN (SELECT photo_id FROM review_events GROUP BY photo_id HAVING arg_max(action, id) = 'error')""")
def emptied_rejects(photos: DataFrame, observed: DataFrame, issues: DataFrame, review_events: DataFrame) -> DataFrame:
    """Rejected photos whose file is gone: not those of an open issue, nor those whose last event recorded it already."""
    gone = photos.filter(F.col("status").isin(*schema.IN_REJECTS)).join(observed.select(F.col("path").alias("dest_path")), "dest_path", "left_anti")
    unsure = issues.filter("category = 'unestablished_outcome' and not resolved").select(F.col("photo_id").alias("id"))
    noticed = review_events.groupBy(F.col("photo_id").alias("id")).agg(F.max_by("action", "id").alias("last")).filter("last = 'error'").select("id")
    rows = gone.join(unsure, "id", "left_anti").join(noticed, "id", "left_anti")
    return rows.select("id", F.when(F.col("status") == "Rejected", "Rejected_Emptied").otherwise(F.col("status")).alias("new_status"))


@query("thumbnail_rebuild", """
SELECT t.content_id, t.size, CASE WHEN t.present THEN CASE WHEN t.size = 320 THEN 'already' WHEN a.content_id IS NOT NULL THEN 'made' ELSE 'kept' END WHEN a.content_id IS NOT NULL THEN 'made' ELSE 'failed' END AS outcome, a.copy
FROM thumbnails t LEFT JOIN (SELECT c.content_id, arg_min(coalesce(p.dest_path, p.source_path), (CASE WHEN p.status IN ('Completed', 'Copied', 'Found_At_Destination') THEN 0 ELSE 1 END) * 1000000000 + p.id) AS copy FROM photos p JOIN contents c USING (sha1_hash) WHERE p.status IN ('Completed', 'Copied', 'Found_At_Destination', 'Pending') GROUP BY c.content_id) a ON a.content_id = t.content_id""")
def thumbnail_rebuild(photos: DataFrame, contents: DataFrame, thumbnails: DataFrame, replace: tuple = (1280,)) -> DataFrame:
    """What a rebuild would do with each cached picture, and from which copy: a delivered one before one in the source."""
    delivered = F.col("status").isin(*schema.DELIVERED)
    usable = photos.filter(delivered | (F.col("status") == "Pending")).join(contents.select("sha1_hash", "content_id"), "sha1_hash")
    best = usable.groupBy("content_id").agg(F.min_by(F.coalesce("dest_path", "source_path"), F.struct((~delivered).alias("late"), "id")).alias("copy"))
    has, there = F.col("copy").isNotNull(), F.col("present")
    outcome = F.when(there & ~F.col("size").isin(*replace), "already").when(has, "made").when(there, "kept").otherwise("failed")
    return thumbnails.join(best, "content_id", "left").select("content_id", "size", outcome.alias("outcome"), "copy")


@query("edit_twins", """
SELECT id, twin, CASE WHEN twin_status IN ('Rejected', 'Rejected_Copied') THEN 'in rejects' WHEN twin IN (SELECT photo_id FROM issues WHERE category = 'unestablished_outcome' AND NOT resolved) THEN 'file issue' ELSE 'ready' END AS rule FROM (
  SELECT p.id, q.id AS twin, q.status AS twin_status, row_number() OVER (PARTITION BY p.id ORDER BY CASE WHEN q.status LIKE 'Rejected%' THEN 1 ELSE 0 END, q.id) AS k FROM photos p JOIN photos q ON q.sha1_hash = p.sha1_hash AND q.id <> p.id AND q.status IN ('Completed', 'Copied', 'Found_At_Destination', 'Rejected', 'Rejected_Copied') WHERE p.status = 'Copied') WHERE k = 1""")
def edit_twins(photos: DataFrame, issues: DataFrame) -> DataFrame:
    """The photo that an edit would become equal to: in the library before the rejects, then the least id; and what forbids it.

    A content's two best rows are enough to find the best other one, so no pair of copies is made.
    """
    held = photos.filter(F.col("status").isin(*schema.DELIVERED, *schema.IN_REJECTS) & F.col("sha1_hash").isNotNull())
    key = F.struct(F.when(F.col("status").isin(*schema.IN_REJECTS), 1).otherwise(0).alias("late"), F.col("id").alias("twin"), F.col("status").alias("twin_status"))
    first = held.groupBy("sha1_hash").agg(F.min(key).alias("a"))
    second = held.join(first, "sha1_hash").filter(F.col("id") != F.col("a.twin")).groupBy("sha1_hash").agg(F.min(key).alias("b"))
    rows = photos.filter("status = 'Copied'").join(first, "sha1_hash").join(second, "sha1_hash", "left")
    twin = F.when(F.col("a.twin") != F.col("id"), F.col("a")).otherwise(F.col("b"))
    rows = rows.select("id", twin.alias("t")).filter("t is not null").select("id", "t.twin", "t.twin_status")
    unsure = issues.filter("category = 'unestablished_outcome' and not resolved").select(F.col("photo_id").alias("twin"), F.lit(True).alias("unsure")).distinct()
    rule = F.when(F.col("twin_status").isin(*schema.IN_REJECTS), "in rejects").when(F.col("unsure"), "file issue").otherwise("ready")
    return rows.join(unsure, "twin", "left").select("id", "twin", rule.alias("rule"))


@query("safety_questions", """
SELECT r.id, max(CASE WHEN o.message LIKE 'OSError%' THEN 'source_empty' END) AS source_question, max(CASE WHEN o.message LIKE 'PermissionError%' THEN 'network_destination' END) AS network_question FROM (SELECT max(id) AS id FROM runs WHERE status <> 'Running') r LEFT JOIN operations o ON o.run_id = r.id AND o.status = 'Failed' GROUP BY r.id""")
def safety_questions(runs: DataFrame, operations: DataFrame) -> DataFrame:
    """What the newest settled run's refusals ask the user; older runs ask nothing any more."""
    last = F.broadcast(runs.filter("status <> 'Running'").agg(F.max("id").alias("id")))  # one row
    rows = last.join(operations.filter("status = 'Failed'").select(F.col("run_id").alias("id"), "message"), "id", "left")
    asks = lambda head, question: F.max(F.when(F.col("message").startswith(head), question))
    return rows.groupBy("id").agg(asks("OSError", "source_empty").alias("source_question"), asks("PermissionError", "network_destination").alias("network_question"))


@query("plan_page", """
SELECT folder, id, k FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY id) AS k, dense_rank() OVER (ORDER BY folder) AS g FROM (SELECT id, CASE WHEN date_taken IS NULL THEN 'library/Unsorted' WHEN date_source = 'file_mtime' THEN 'library/Undated/' || substr(date_taken, 1, 4) ELSE 'library/' || replace(substr(date_taken, 1, 10), '-', '/') END AS folder FROM photos WHERE status = 'Pending')) WHERE k <= 50 AND g BETWEEN 51 AND 100""")
def plan_page(photos: DataFrame, page: int = 2, size: int = 50) -> DataFrame:
    """A page of a plan: the second fifty destination folders with the first fifty files of each."""
    from pyspark.sql import Window

    rows = photos.filter("status = 'Pending'").select("id", X.filing_folder(F.col("date_taken"), F.col("date_source")).alias("folder"))
    some = F.broadcast(rows.select("folder").distinct().orderBy("folder").offset((page - 1) * size).limit(size))  # one page of folders
    order = Window.partitionBy("folder").orderBy("id")
    return rows.join(some, "folder").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size).select("folder", "id", "k")


@query("findings_export", f"SELECT CASE WHEN regexp_matches(path, '^[=+@-]') THEN '''' || path ELSE path END AS path, finding, tone FROM ({DESCRIBED_SQL})")
def findings_export(photos: DataFrame, observed: DataFrame, looks: DataFrame) -> DataFrame:
    """A report's rows as they are exported; sources.files.export writes them."""
    return described_findings(photos, observed, looks).withColumn("path", X.csv_safe(F.col("path")))
