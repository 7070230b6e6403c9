"""Metadata: tags, priorities, captures, differences, sidecars, earlier versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query

#: The sources of a field, first choice first.
PRIORITY = ("purchase", "signup", "click", "view", "error")


@query("tag_conflicts", "SELECT photo_id, field, count(DISTINCT value) AS \"values\", string_agg(DISTINCT value, '|' ORDER BY value) AS seen FROM tags GROUP BY photo_id, field HAVING count(DISTINCT value) > 1")
def tag_conflicts(tags: DataFrame) -> DataFrame:
    """Fields for which a photo's sources say different things."""
    per = tags.groupBy("photo_id", "field").agg(F.sort_array(F.collect_set("value")).alias("v"))
    return per.filter(F.size("v") > 1).select("photo_id", "field", F.size("v").cast("bigint").alias("values"), F.array_join("v", "|").alias("seen"))


@query("resolve_priority", """
SELECT photo_id, field, value, source FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, field ORDER BY list_position(['purchase', 'signup', 'click', 'view', 'error'], source), id DESC) AS k FROM tags) WHERE k = 1""")
def resolve_priority(tags: DataFrame) -> DataFrame:
    """Each field's value from its first source in order; an empty value counts as said, an absent one falls through."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source"))
    best = tags.groupBy("photo_id", "field").agg(F.min_by(F.struct("value", "source"), F.struct(rank.alias("rank"), (-F.col("id")).alias("newest"))).alias("x"))
    return best.select("photo_id", "field", "x.value", "x.source")


@query("capture_dedupe", "SELECT id FROM (SELECT id, value, lag(value) OVER (PARTITION BY photo_id, source, field ORDER BY id) AS before FROM tags) WHERE before IS NULL OR value <> before")
def capture_dedupe(tags: DataFrame) -> DataFrame:
    """Captures that say something new: the first of a field, and each that differs from the one before."""
    order = Window.partitionBy("photo_id", "source", "field").orderBy("id")
    rows = tags.withColumn("before", F.lag("value").over(order))
    return rows.filter(F.col("before").isNull() | (F.col("value") != F.col("before"))).select("id")


@query("field_diff", """
SELECT coalesce(a.photo_id, b.photo_id) AS photo_id, coalesce(a.field, b.field) AS field, a.value AS before, b.value AS after FROM (SELECT photo_id, field, arg_max(value, id) AS value FROM tags WHERE source = 'view' GROUP BY ALL) a
FULL JOIN (SELECT photo_id, field, arg_max(value, id) AS value FROM tags WHERE source = 'click' GROUP BY ALL) b ON a.photo_id = b.photo_id AND a.field = b.field WHERE a.value IS DISTINCT FROM b.value""")
def field_diff(tags: DataFrame, before: str = "view", after: str = "click") -> DataFrame:
    """Fields that differ between two versions of a photo's metadata; absent is not empty."""
    one = lambda s, n: tags.filter(F.col("source") == s).groupBy("photo_id", "field").agg(F.max_by("value", "id").alias(n))
    return one(before, "before").join(one(after, "after"), ["photo_id", "field"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))


@query("field_values", "SELECT field, source, count(DISTINCT photo_id) AS photos, count(*) FILTER (WHERE value = '') AS empty FROM tags GROUP BY 1, 2")
def field_values(tags: DataFrame) -> DataFrame:
    return tags.groupBy("field", "source").agg(F.countDistinct("photo_id").alias("photos"), F.count_if(F.col("value") == "").alias("empty"))


def associated(photos: DataFrame, sidecars: DataFrame) -> DataFrame:
    stem = F.floor(F.col("id") / 4)
    owners = photos.filter("status <> 'Failed'").groupBy("camera", "lens", stem.alias("stem")).agg(F.count(F.lit(1)).alias("owners"), F.count_if(X.extension(F.col("name")).isin(*schema.RAW)).alias("raws"))
    cars = sidecars.withColumn("stem", stem).join(owners, ["camera", "lens", "stem"], "left").fillna(0, ["owners", "raws"])
    basis = F.when(F.col("owners") == 0, "orphan").when(F.col("id") % 7 == 0, "full_name").when(F.col("owners") == 1, "single").when(F.col("raws") == 1, "policy").otherwise("needs_choice")
    return cars.select(F.col("id").alias("sidecar"), basis.alias("basis"), "owners")


ASSOCIATION_SQL = r"""
SELECT s.id AS sidecar, CASE WHEN n.owners = 0 THEN 'orphan' WHEN s.id % 7 = 0 THEN 'full_name' WHEN n.owners = 1 THEN 'single' WHEN n.raws = 1 THEN 'policy' ELSE 'needs_choice' END AS basis, n.owners
FROM photos s JOIN (SELECT s.id, count(p.id) AS owners, count(*) FILTER (WHERE p.name LIKE '%.cr2') AS raws FROM photos s LEFT JOIN photos p ON p.camera = s.camera AND p.lens = s.lens AND p.id // 4 = s.id // 4 AND p.status <> 'Failed' GROUP BY s.id) n ON n.id = s.id"""


@query("sidecar_association", ASSOCIATION_SQL)
def sidecar_association(photos: DataFrame) -> DataFrame:
    """Which photo a sidecar belongs to: by full name, by being the only one of its stem, or by the raw-first rule.

    Here a stem is a folder and a run of four ids, and each photo stands for a sidecar.
    """
    return associated(photos, photos)


@query("sidecar_owners", r"""
SELECT id, CASE WHEN state = 'not_xmp' THEN 'ignored' WHEN NOT is_full AND n = 0 THEN 'orphan' WHEN state <> 'valid' THEN 'needs_attention' WHEN owner_name IS NOT NULL THEN CASE WHEN owned THEN 'associated' ELSE 'needs_choice' END WHEN is_full OR n = 1 OR raws = 1 THEN 'associated' ELSE 'needs_choice' END AS verdict,
  CASE WHEN state <> 'valid' OR (NOT is_full AND n = 0) OR (owner_name IS NOT NULL AND NOT owned) THEN NULL WHEN is_full THEN 'full_name' WHEN owner_name IS NOT NULL THEN 'declared_owner' WHEN n = 1 THEN 'single' WHEN raws = 1 THEN 'policy' END AS basis FROM (
  SELECT s.*, EXISTS (SELECT 1 FROM inventory f WHERE f.folder = s.folder AND f.name = s.base) AS is_full, (SELECT count(*) FROM inventory f WHERE f.folder = s.folder AND regexp_extract(f.name, '^(.+)\.[^.]+$', 1) = s.base) AS n, (SELECT count(*) FROM inventory f WHERE f.folder = s.folder AND regexp_extract(f.name, '^(.+)\.[^.]+$', 1) = s.base AND f.name LIKE '%.cr2') AS raws,
    EXISTS (SELECT 1 FROM inventory f WHERE f.folder = s.folder AND f.name = s.owner_name AND (f.name = s.base OR (regexp_extract(f.name, '^(.+)\.[^.]+$', 1) = s.base AND NOT EXISTS (SELECT 1 FROM inventory g WHERE g.folder = s.folder AND g.name = s.base)))) AS owned FROM sidecars s)""")
def sidecar_owners(sidecars: DataFrame, inventory: DataFrame, policy: str = "raw_only") -> DataFrame:
    """Which photo a sidecar belongs to: by full name, by the owner that it names, as the only one of its stem, or by policy.

    Equi-joins by folder and name and by folder and stem; stems are counted before they are joined.
    """
    names = inventory.distinct()
    full = names.select("folder", F.col("name").alias("base"), F.lit(True).alias("is_full"))
    stem, raw = X.stem(F.col("name")), X.extension(F.col("name")).isin(*schema.RAW)
    stems = inventory.groupBy("folder", stem.alias("base")).agg(F.count(F.lit(1)).alias("n"), F.count_if(raw).alias("raws"))
    owners = names.select("folder", F.col("name").alias("owner_name"), stem.alias("owner_stem"))
    rows = sidecars.join(full, ["folder", "base"], "left").join(stems, ["folder", "base"], "left").join(owners, ["folder", "owner_name"], "left").fillna(0, ["n", "raws"])
    is_full, named, valid = F.coalesce("is_full", F.lit(False)), F.col("owner_name").isNotNull(), F.col("state") == "valid"
    owned = F.coalesce(F.col("owner_stem").isNotNull() & F.when(is_full, F.col("owner_name") == F.col("base")).otherwise(F.col("owner_stem") == F.col("base")), F.lit(False))
    chosen = {"raw_only": F.col("raws") == 1, "non_raw_only": F.col("n") - F.col("raws") == 1, "all": F.lit(True)}.get(policy, F.lit(False))
    orphan = ~is_full & (F.col("n") == 0)
    settled = F.when(named, owned).otherwise(is_full | (F.col("n") == 1) | chosen)
    verdict = F.when(F.col("state") == "not_xmp", "ignored").when(orphan, "orphan").when(~valid, "needs_attention").when(settled, "associated").otherwise("needs_choice")
    basis = F.when(~valid | orphan | (named & ~owned), None).when(is_full, "full_name").when(named, "declared_owner").when(F.col("n") == 1, "single").when(chosen, "policy")
    return rows.select("id", verdict.alias("verdict"), basis.alias("basis"))


@query("earlier_versions", """
SELECT p.id, max(o.file_id) AS later, count(*) AS links FROM photos p JOIN origins o ON o.origin_file_id = p.id JOIN photos q ON q.id = o.file_id
WHERE q.sha1_hash <> p.sha1_hash AND p.sha1_hash NOT IN (SELECT sha1_hash FROM photos WHERE status IN ('Completed', 'Copied', 'Found_At_Destination', 'Rejected', 'Rejected_Copied')) GROUP BY p.id""")
def earlier_versions(photos: DataFrame, origins: DataFrame) -> DataFrame:
    """Photos that an edit superseded and whose content is held nowhere now, with their newest later version."""
    held = photos.filter(F.col("status").isin(*schema.DELIVERED, *schema.IN_REJECTS)).select("sha1_hash").distinct()
    old = photos.join(held, "sha1_hash", "left_anti").select(F.col("id").alias("origin_file_id"), F.col("sha1_hash").alias("old"))
    rows = origins.join(old, "origin_file_id").join(photos.select(F.col("id").alias("file_id"), "sha1_hash"), "file_id").filter("sha1_hash <> old")
    return rows.groupBy(F.col("origin_file_id").alias("id")).agg(F.max("file_id").alias("later"), F.count(F.lit(1)).alias("links"))


@query("map_equality", """
SELECT a.photo_id AS a, b.photo_id AS b FROM (SELECT photo_id, string_agg(field || '=' || value, ',' ORDER BY field) AS m FROM (SELECT photo_id, field, arg_max(value, id) AS value FROM tags GROUP BY ALL) GROUP BY photo_id) a
JOIN (SELECT photo_id, string_agg(field || '=' || value, ',' ORDER BY field) AS m FROM (SELECT photo_id, field, arg_max(value, id) AS value FROM tags GROUP BY ALL) GROUP BY photo_id) b ON a.m = b.m AND a.photo_id = b.photo_id - 1""")
def map_equality(tags: DataFrame) -> DataFrame:
    """Neighbouring photos whose whole field maps are equal, whatever the order of entries."""
    last = tags.groupBy("photo_id", "field").agg(F.max_by("value", "id").alias("value"))
    maps = last.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("m"))
    a, b = maps.select(F.col("photo_id").alias("a"), "m"), maps.select(F.col("photo_id").alias("b"), F.col("m").alias("n"))
    return a.join(b, (F.col("a") == F.col("b") - 1) & (F.col("m") == F.col("n"))).select("a", "b")


@query("attention_explained", "SELECT category, resolved, count(*) AS n, count(DISTINCT p.status) AS statuses, min(p.id) AS first FROM issues i JOIN photos p ON p.id = i.photo_id GROUP BY 1, 2")
def attention_explained(issues: DataFrame, photos: DataFrame) -> DataFrame:
    rows = issues.join(photos.select(F.col("id").alias("photo_id"), "status"), "photo_id")
    return rows.groupBy("category", "resolved").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("status").alias("statuses"), F.min("photo_id").alias("first"))


@query("transfer_hold", """
SELECT p.id, CASE WHEN e.k IS NULL THEN NULL WHEN e.k < 30 THEN 'choice' WHEN e.action = 'error' THEN 'decision' ELSE NULL END AS hold FROM photos p LEFT JOIN (SELECT photo_id, arg_max(k, id) AS k, arg_max(action, id) AS action FROM review_events GROUP BY photo_id) e ON e.photo_id = p.id WHERE p.status = 'Pending'""")
def transfer_hold(photos: DataFrame, review_events: DataFrame) -> DataFrame:
    """Why a pending photo may not move yet, by its latest capture."""
    last = review_events.groupBy(F.col("photo_id").alias("id")).agg(F.max_by(F.struct("k", "action"), "id").alias("x")).select("id", "x.*")
    hold = F.when(F.col("k") < 30, "choice").when(F.col("action") == "error", "decision")
    return photos.filter("status = 'Pending'").join(last, "id", "left").select("id", hold.alias("hold"))
