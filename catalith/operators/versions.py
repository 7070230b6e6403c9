"""Versions and decisions: earlier versions of pictures, retained metadata, choices and the receipts that used them, scans and moved folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as X
from ..registry import query
from .capture import EXIF_FIELDS_SQL, interpreted_fields

CURRENT = ("Completed", "Copied", "Found_At_Destination")

LINKS_SQL = f"""
SELECT p.id AS photo_id, p.sha1_hash, arg_max(c.photo_id, c.change_id) AS version_of, max(c.change_id) AS change_id FROM photos p JOIN changes c ON c.before_sha1 = p.sha1_hash AND c.photo_id <> p.id JOIN photos o ON o.id = c.photo_id AND o.sha1_hash <> p.sha1_hash
WHERE p.sha1_hash NOT IN (SELECT sha1_hash FROM photos WHERE status IN {CURRENT}) GROUP BY p.id, p.sha1_hash"""


@query("version_links", f"SELECT photo_id, version_of, change_id FROM ({LINKS_SQL})")
def version_links(photos: DataFrame, changes: DataFrame) -> DataFrame:
    """Photos whose content is what another photo's was before a change, with the newest such change; contents that are still in use are none."""
    return _links(photos, changes).select("photo_id", "version_of", "change_id")


def _links(photos: DataFrame, changes: DataFrame) -> DataFrame:
    now = photos.select(F.col("id").alias("version_of"), F.col("sha1_hash").alias("present"))
    edges = changes.select(F.col("photo_id").alias("version_of"), "change_id", F.col("before_sha1").alias("sha1_hash")).join(now, "version_of").filter("present <> sha1_hash")
    in_use = photos.filter(F.col("status").isin(*CURRENT)).select("sha1_hash")
    # of a content's changes only the two newest of different photos can win, so copies of a content never meet all changes
    newest = edges.groupBy("sha1_hash", "version_of").agg(F.max("change_id").alias("change_id")).withColumn("k", F.row_number().over(Window.partitionBy("sha1_hash").orderBy(F.desc("change_id")))).filter("k <= 2")
    rows = photos.select(F.col("id").alias("photo_id"), "sha1_hash").join(in_use, "sha1_hash", "left_anti").join(newest, "sha1_hash").filter("version_of <> photo_id")
    return rows.groupBy("photo_id", "sha1_hash").agg(F.max(F.struct("change_id", "version_of")).alias("x")).select("photo_id", "sha1_hash", "x.version_of", "x.change_id")


@query("version_badges", f"""
WITH_LINKS SELECT coalesce(l.photo_id, e.version_of) AS photo_id, l.version_of, l.state, coalesce(e.earlier_versions, 0) AS earlier_versions, coalesce(e.waiting, 0) AS waiting FROM stated l
FULL JOIN (SELECT version_of, count(DISTINCT sha1_hash) AS earlier_versions, count(DISTINCT CASE WHEN state = 'waiting' THEN sha1_hash END) AS waiting FROM stated GROUP BY version_of) e ON e.version_of = l.photo_id""".replace(
    "WITH_LINKS", f", stated AS (SELECT k.*, coalesce(a.answer, 'waiting') AS state FROM ({LINKS_SQL}) k LEFT JOIN (SELECT photo_id, arg_max(answer, id) AS answer FROM version_answers GROUP BY 1) a ON a.photo_id = k.photo_id)"))
def version_badges(photos: DataFrame, changes: DataFrame, version_answers: DataFrame) -> DataFrame:
    """Badges in both directions: what a photo is an earlier version of and how that was answered, and how many it has itself."""
    answers = version_answers.groupBy("photo_id").agg(F.max_by("answer", "id").alias("answer"))
    stated = _links(photos, changes).join(answers, "photo_id", "left").withColumn("state", F.coalesce("answer", F.lit("waiting")))
    own = stated.groupBy(F.col("version_of").alias("photo_id")).agg(F.countDistinct("sha1_hash").alias("earlier_versions"), F.countDistinct(F.when(F.col("state") == "waiting", F.col("sha1_hash"))).alias("waiting"))
    out = stated.select("photo_id", "version_of", "state").join(own, "photo_id", "full")
    return out.select("photo_id", "version_of", "state", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("earlier_versions", "waiting")])


# Retained metadata versions.

BEFORE_SQL = f"SELECT photo_id, field, arg_min(value, CASE source WHEN 'embedded_xmp' THEN 0 ELSE 1 END) AS value, arg_min(source, CASE source WHEN 'embedded_xmp' THEN 0 ELSE 1 END) AS source FROM ({EXIF_FIELDS_SQL}) WHERE value IS NOT NULL GROUP BY 1, 2"
ACTIVATION_SQL = f"""
SELECT r.photo_id, r.version, v.field, b.value AS before, v.value AS after, b.source AS previous_source FROM retained r JOIN (SELECT photo_id - 1 AS photo_id, field, value FROM ({EXIF_FIELDS_SQL}) WHERE source = 'embedded_xmp' AND value IS NOT NULL) v ON v.photo_id = r.photo_id
LEFT JOIN ({BEFORE_SQL}) b ON b.photo_id = r.photo_id AND b.field = v.field WHERE r.state = 'valid' AND r.linked AND b.value IS DISTINCT FROM v.value"""


@query("activation_changes", ACTIVATION_SQL)
def activation_changes(retained: DataFrame, image_tags: DataFrame) -> DataFrame:
    """What the activation of a retained version as the primary source would change, field by field, with the source that said it before.

    The version comes before the embedded sources, so a field that it doesn't name stays. Refused ones change nothing.
    """
    fields = interpreted_fields(image_tags).filter("value is not null")
    held = fields.filter("source = 'embedded_xmp'").select((F.col("photo_id") - 1).alias("photo_id"), "field", F.col("value").alias("after"))
    order = F.when(F.col("source") == "embedded_xmp", 0).otherwise(1)
    before = fields.groupBy("photo_id", "field").agg(F.min_by(F.struct("value", "source"), order).alias("b")).select("photo_id", "field", F.col("b.value").alias("before"), F.col("b.source").alias("previous_source"))
    rows = retained.filter("state = 'valid' and linked").select("photo_id", "version").join(held, "photo_id").join(before, ["photo_id", "field"], "left")
    return rows.filter(~F.col("before").eqNullSafe(F.col("after"))).select("photo_id", "version", "field", "before", "after", "previous_source")


@query("activation_plan", f"""
SELECT r.photo_id, r.version, CASE WHEN NOT r.linked THEN 'no_confirmed_association' WHEN r.state <> 'valid' THEN 'unreadable' WHEN c.n IS NULL THEN 'unchanged' ELSE 'activate' END AS verdict, coalesce(c.n, 0) AS changes, c.folder
FROM retained r LEFT JOIN (SELECT photo_id, count(*) AS n, max(CASE WHEN field = 'date_taken' THEN CASE WHEN length(after) >= 10 THEN replace(left(after, 10), '-', '/') ELSE 'Undated' END END) AS folder FROM ({ACTIVATION_SQL}) GROUP BY 1) c ON c.photo_id = r.photo_id""")
def activation_plan(retained: DataFrame, image_tags: DataFrame) -> DataFrame:
    """Whether each retained version may become primary, how many fields that changes, and where a new date would file the photo."""
    filed = F.when(F.length("after") >= 10, F.translate(F.substring("after", 1, 10), "-", "/")).otherwise("Undated")
    per = activation_changes(retained, image_tags).groupBy("photo_id").agg(F.count(F.lit(1)).alias("changes"), F.max(F.when(F.col("field") == "date_taken", filed)).alias("folder"))
    rows = retained.join(per, "photo_id", "left")
    verdict = F.when(~F.col("linked"), "no_confirmed_association").when(F.col("state") != "valid", "unreadable").when(F.col("changes").isNull(), "unchanged").otherwise("activate")
    return rows.select("photo_id", "version", verdict.alias("verdict"), F.coalesce("changes", F.lit(0)).alias("changes"), "folder")


# Choices and receipts.

USES_SQL = """
SELECT d.decision_id, r.event_id FROM receipts r JOIN decisions d ON d.photo_id = r.photo_id AND d.kind = 'primary' AND d.decision_id = r.primary_revision
UNION SELECT d.decision_id, r.event_id FROM (SELECT r.*, coalesce(r.association_revision, (SELECT max(a.decision_id) FROM decisions a WHERE a.kind = 'association' AND a.photo_id = r.photo_id AND a.decision_id <= r.highwater)) AS revision FROM receipts r) r
JOIN decisions d ON d.photo_id = r.photo_id AND d.kind = 'association' AND d.decision_id = r.revision AND list_sort(d.owners) = list_sort(r.owners)"""


@query("decision_uses", f"SELECT d.decision_id, d.kind, count(u.event_id) AS uses, min(u.event_id) AS first_use FROM decisions d LEFT JOIN ({USES_SQL}) u USING (decision_id) GROUP BY 1, 2")
def decision_uses(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """How often each saved choice was applied, and first by which receipt; choices that none used have 0."""
    used = matched_receipts(decisions, receipts).groupBy("decision_id").agg(F.count(F.lit(1)).alias("uses"), F.min("event_id").alias("first_use"))
    return decisions.select("decision_id", "kind").join(used, "decision_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def matched_receipts(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """decision_id, event_id: the choice of a kind that each receipt used.

    A primary choice is named by its number. An association is named too, or is the last one up to the receipt's
    high-water mark (found in one sorted pass over both), and its owners are the receipt's as sets.
    """
    owners = lambda c: F.sort_array(F.array_distinct(c))
    d = decisions.select("photo_id", "kind", "decision_id", owners("owners").alias("owners"))
    primary = receipts.select("photo_id", "event_id", F.col("primary_revision").alias("decision_id")).join(d.filter("kind = 'primary'").select("photo_id", "decision_id"), ["photo_id", "decision_id"]).select("decision_id", "event_id")
    links = d.filter("kind = 'association'").select("photo_id", "decision_id", "owners")
    marks = links.select("photo_id", F.col("decision_id").alias("at"), F.lit(0).alias("side"), "decision_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("named"), F.lit(None).cast("array<string>").alias("seen"))
    asked = receipts.select("photo_id", F.col("highwater").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("decision_id"), "event_id", F.col("association_revision").alias("named"), owners("owners").alias("seen"))
    upto = Window.partitionBy("photo_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("last", F.last("decision_id", ignorenulls=True).over(upto)).filter("side = 1")
    found = found.select("photo_id", "event_id", F.coalesce("named", "last").alias("decision_id"), "seen").join(links, ["photo_id", "decision_id"]).filter("seen = owners")
    return primary.union(found.select("decision_id", "event_id"))


@query("applied_choices", f"SELECT r.event_id, count(u.decision_id) AS used FROM receipts r JOIN ({USES_SQL}) u USING (event_id) GROUP BY 1")
def applied_choices(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts that used a saved choice, and how many; the others are no part of the history."""
    return matched_receipts(decisions, receipts).groupBy("event_id").agg(F.count(F.lit(1)).alias("used"))


# Scans and folders.


@query("scan_coverage", r"""
, folders AS (SELECT DISTINCT regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS folder FROM photos), complete AS (SELECT root, max(run_id) AS run_id, arg_max(scanned_at, run_id) AS scanned_at FROM scans WHERE status = 'Completed' AND NOT targeted AND every_type AND NOT issues GROUP BY root)
SELECT f.folder, c.root, c.run_id, c.scanned_at, coalesce((SELECT count(*) FROM scans s WHERE s.root = c.root AND s.run_id > c.run_id AND NOT s.targeted AND s.issues), 0) AS issues_since FROM folders f
LEFT JOIN (SELECT f.folder, arg_max(c, length(c.root)) AS c FROM folders f JOIN complete c ON f.folder = c.root OR starts_with(f.folder, c.root || '/') GROUP BY f.folder) x ON x.folder = f.folder LEFT JOIN complete c ON c.root = x.c.root""")
def scan_coverage(photos: DataFrame, scans: DataFrame) -> DataFrame:
    """The scan that covers each source folder: the last complete one of the nearest root above it that has one.

    A scan covers if it was of no selection, completed, met no failure of its own and read every type. Roots are counted
    first; a folder meets only the roots among its ancestors.
    """
    full = (F.col("status") == "Completed") & ~F.col("targeted") & F.col("every_type") & ~F.col("issues")
    complete = scans.filter(full).groupBy("root").agg(F.max_by(F.struct("run_id", "scanned_at"), "run_id").alias("x")).select("root", "x.*")
    later = scans.filter("not targeted and issues").select("root", F.col("run_id").alias("id")).join(complete.select("root", "run_id"), "root").filter("id > run_id").groupBy("root").agg(F.count(F.lit(1)).alias("issues_since"))
    complete = complete.join(later, "root", "left")
    folders = photos.select(X.folder(F.col("source_path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    best = folders.select("folder", F.explode(above).alias("root")).join(complete, "root").groupBy("folder").agg(F.max_by(F.struct("root", "run_id", "scanned_at", "issues_since"), F.length("root")).alias("x"))
    return folders.join(best, "folder", "left").select("folder", "x.root", "x.run_id", "x.scanned_at", F.coalesce("x.issues_since", F.lit(0)).alias("issues_since"))


@query("moved_folders", """
SELECT folder, count(*) AS photos, count(*) FILTER (WHERE found_path IS NULL) AS lost, CASE WHEN count(DISTINCT target) = 1 AND count(target) = count(*) THEN min(target) END AS moved_to FROM (
  SELECT *, CASE WHEN found_in = 'library' AND ends_with(found_path, substr(path, length(folder) + 1)) THEN left(found_path, length(found_path) - length(path) + length(folder)) END AS target FROM gone_files) GROUP BY folder""")
def moved_folders(gone_files: DataFrame) -> DataFrame:
    """Folders that are gone, and where each moved to: the one folder under which every member was found in the same layout.

    One member that is lost, or lies elsewhere or under another name, and the folder has not moved. Members are reduced
    map-side to their number and the least and greatest target, so a folder may hold any share of the files.
    """
    inner = F.substring("path", F.length("folder") + 1, F.length("path"))
    target = F.when((F.col("found_in") == "library") & F.col("found_path").endswith(inner), F.substring("found_path", F.lit(1), F.length("found_path") - F.length(inner)))
    per = gone_files.withColumn("target", target).groupBy("folder").agg(F.count(F.lit(1)).alias("photos"), F.count_if(F.col("found_path").isNull()).alias("lost"), F.count("target").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"))
    return per.select("folder", "photos", "lost", F.when((F.col("n") == F.col("photos")) & (F.col("low") == F.col("high")), F.col("low")).alias("moved_to"))
