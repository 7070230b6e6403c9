"""Choices and receipts: candidates of a sidecar, current sidecars, cleanup, backups, comparisons that are still to be made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..functions.similarity import hashes
from ..registry import query
from .metadata import sidecar_owners


@query("import_choices", r"""
SELECT s.id, f.name AS candidate, count(*) OVER (PARTITION BY s.id) AS candidates, f.name LIKE '%.cr2' AS raw FROM sidecars s JOIN inventory f ON f.folder = s.folder AND regexp_extract(f.name, '^(.+)\.[^.]+$', 1) = s.base
WHERE s.state = 'valid' AND NOT EXISTS (SELECT 1 FROM inventory g WHERE g.folder = s.folder AND g.name = s.base) AND s.owner_name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM inventory o WHERE o.folder = s.folder AND o.name = s.owner_name AND regexp_extract(o.name, '^(.+)\.[^.]+$', 1) = s.base)""")
def import_choices(sidecars: DataFrame, inventory: DataFrame) -> DataFrame:
    """The photos that a sidecar may belong to where its owner has to be chosen. A stem has few photos."""
    asked = sidecar_owners(sidecars, inventory).filter("verdict = 'needs_choice'").select("id").join(sidecars.filter("owner_name is not null"), "id")
    stems = inventory.select("folder", X.stem(F.col("name")).alias("base"), F.col("name").alias("candidate"))
    rows = asked.join(stems, ["folder", "base"])
    per = rows.groupBy("id").agg(F.count(F.lit(1)).alias("candidates"))
    return rows.join(per, "id").select("id", "candidate", "candidates", (X.extension(F.col("candidate")).isin(*schema.RAW)).alias("raw"))


@query("current_sidecars", """
SELECT p.id, r.receipt, r.k AS version FROM photos p JOIN (SELECT photo_id, max(id) AS receipt, arg_max(k, id) AS k FROM review_events WHERE action = 'purchase' AND k % 3 <> 0 GROUP BY photo_id) r ON r.photo_id = p.id WHERE p.status IN ('Completed', 'Copied', 'Found_At_Destination')""")
def current_sidecars(photos: DataFrame, review_events: DataFrame) -> DataFrame:
    """The sidecar that lies beside a delivered photo: its latest pair receipt that is no bridge of a consolidation (every third)."""
    last = review_events.filter("action = 'purchase' and k % 3 <> 0").groupBy(F.col("photo_id").alias("id")).agg(F.max("id").alias("receipt"), F.max_by("k", F.col("id")).alias("version"))
    return photos.filter(F.col("status").isin(*schema.DELIVERED)).select("id").join(last, "id")


@query("source_cleanup", """
SELECT p.id, CASE WHEN p.status NOT IN ('Completed', 'Copied', 'Found_At_Destination') THEN 'not delivered' WHEN r.photo_id IS NULL THEN 'no receipt' WHEN p.id IN (SELECT photo_id FROM issues WHERE category = 'unestablished_outcome' AND NOT resolved) THEN 'open issue' WHEN o.path IS NULL THEN 'file missing' WHEN o.sha1_hash <> p.sha1_hash THEN 'file changed' ELSE 'eligible' END AS verdict
FROM photos p LEFT JOIN (SELECT DISTINCT photo_id FROM review_events WHERE action = 'purchase') r ON r.photo_id = p.id LEFT JOIN observed o ON o.path = p.dest_path""")
def source_cleanup(photos: DataFrame, review_events: DataFrame, issues: DataFrame, observed: DataFrame) -> DataFrame:
    """Whether the source of an edited photo may go: delivered, with a receipt, without an open issue, and its file as recorded."""
    receipt = review_events.filter("action = 'purchase'").select(F.col("photo_id").alias("id"), F.lit(True).alias("receipt")).distinct()
    unsure = issues.filter("category = 'unestablished_outcome' and not resolved").select(F.col("photo_id").alias("id"), F.lit(True).alias("unsure")).distinct()
    there = observed.select(F.col("path").alias("dest_path"), F.col("sha1_hash").alias("seen"))
    rows = photos.join(receipt, "id", "left").join(unsure, "id", "left").join(there, "dest_path", "left")
    verdict = (
        F.when(~F.col("status").isin(*schema.DELIVERED), "not delivered").when(F.col("receipt").isNull(), "no receipt").when(F.col("unsure"), "open issue")
        .when(F.col("seen").isNull(), "file missing").when(F.col("seen") != F.col("sha1_hash"), "file changed").otherwise("eligible")
    )
    return rows.select("id", verdict.alias("verdict"))


BACKUPS_SQL = "SELECT id AS attempt, status, CASE WHEN status = 'Completed' THEN 'b-' || id || '.zst' END AS file, id % 4 = 0 AS pruned, id % 5 <> 0 AS listed, started_at FROM runs WHERE mode = 'COPY'"


@query("backup_list", f"""
SELECT attempt, file, CASE WHEN file IS NULL THEN NULL WHEN pruned THEN 'pruned' WHEN listed THEN 'present' ELSE 'missing' END AS availability FROM ({BACKUPS_SQL})""")
def backup_list(runs: DataFrame, reachable: bool = True) -> DataFrame:
    """Recorded backups with what their folder shows now; where it can't be reached nothing is called missing.

    Here completed copy runs stand for backups; every fourth was pruned, and every fifth file is not in the listing.
    """
    file = F.when(F.col("status") == "Completed", F.concat(F.lit("b-"), F.col("id").cast("string"), F.lit(".zst")))
    rows = runs.filter("mode = 'COPY'").select(F.col("id").alias("attempt"), file.alias("file"), (F.col("id") % 4 == 0).alias("pruned"), (F.col("id") % 5 != 0).alias("listed"))
    now = F.when(F.col("file").isNull(), None).when(F.col("pruned"), "pruned").when(F.lit(not reachable), "unknown").when(F.col("listed"), "present").otherwise("missing")
    return rows.select("attempt", "file", now.alias("availability"))


@query("backup_totals", f"SELECT count(*) FILTER (WHERE NOT pruned AND listed AND file IS NOT NULL) AS present, max(CASE WHEN file IS NOT NULL THEN attempt END) AS last_success, count(*) AS attempts FROM ({BACKUPS_SQL})")
def backup_totals(runs: DataFrame) -> DataFrame:
    return backup_list(runs).agg(F.count_if(F.col("availability") == "present").alias("present"), F.max(F.when(F.col("file").isNotNull(), F.col("attempt"))).alias("last_success"), F.count(F.lit(1)).alias("attempts"))


@query("comparison_pending", """
, early AS (SELECT DISTINCT h62 AS h FROM contents WHERE h62 IS NOT NULL AND 4 * content_id < 3 * (SELECT max(content_id) FROM contents))
SELECT v.batch, (SELECT count(*) FROM hashes) AS hashes, (SELECT count(*) FROM hashes) - CASE WHEN v.batch = 0 THEN (SELECT count(*) FROM early) ELSE (SELECT count(*) FROM hashes) END AS pending, (SELECT count(*) FROM contents WHERE h62 IS NULL) AS unavailable FROM (VALUES (0), (1)) v(batch)""")
def comparison_pending(contents: DataFrame, markers: DataFrame) -> DataFrame:
    """After each batch of the index: hashes that no comparison has finished with, by the markers that it left, and contents without a hash."""
    done = hashes(contents).join(markers, "h", "left").agg(F.count(F.lit(1)).alias("hashes"), *[F.count_if(F.coalesce(F.col("batch") > k, F.lit(True))).alias(f"p{k}") for k in (0, 1)])
    none = contents.agg(F.count_if(F.col("h62").isNull()).alias("unavailable"))
    per = done.select("hashes", F.explode(F.array(*[F.struct(F.lit(k).alias("batch"), F.col(f"p{k}").alias("pending")) for k in (0, 1)])).alias("x"))
    return per.crossJoin(F.broadcast(none)).select("x.batch", "hashes", "x.pending", "unavailable")  # two rows and one


@query("json_fidelity", r"""
SELECT event_id, text, coalesce(json_valid(text) AND NOT regexp_matches(regexp_replace(text, '"([^"\\]|\\.)*"', '""', 'g'), 'NaN|Infinity') AND regexp_matches(text, '^\s*\{'), false) AS faithful FROM payloads""")
def json_fidelity(payloads: DataFrame) -> DataFrame:
    """Whether a text is a JSON object that every reader gives back alike: no numbers beyond JSON's own. Words inside strings are only words."""
    bare = F.regexp_replace("text", r'"([^"\\]|\\.)*+"', '""')
    faithful = F.try_parse_json("text").isNotNull() & ~bare.rlike("NaN|Infinity") & F.col("text").rlike(r"^\s*\{")
    return payloads.select("event_id", "text", F.coalesce(faithful, F.lit(False)).alias("faithful"))


@query("facet_sizes", """
SELECT count(*) FILTER (WHERE p.id IN (SELECT photo_id FROM available WHERE h IN (SELECT low FROM edges UNION SELECT high FROM edges))) AS near, count(*) FILTER (WHERE p.file_size >= 2000) AS large, count(*) FILTER (WHERE p.status <> 'Failed' AND least(c.width, c.height) < 1000) AS small FROM photos p LEFT JOIN contents c USING (sha1_hash)""")
def facet_sizes(photos: DataFrame, contents: DataFrame, available: DataFrame, met_hashes: DataFrame) -> DataFrame:
    """The chips of look-alikes and of sizes, over one base."""
    near = available.join(met_hashes, "h", "left_semi").select(F.col("photo_id").alias("id"), F.lit(True).alias("is_near"))
    rows = photos.join(contents.select("sha1_hash", "width", "height"), "sha1_hash", "left").join(near, "id", "left")
    return rows.agg(F.count("is_near").alias("near"), F.count_if(F.col("file_size") >= 2000).alias("large"), F.count_if((F.col("status") != "Failed") & (F.least("width", "height") < 1000)).alias("small"))
