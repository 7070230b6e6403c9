"""Smaller relations: attention, thumbnails, decisions, settings, notifications, recovery, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..functions.numbering import numbered
from ..registry import query
from ..plans.similarity_index import label_pairs, within


@query("attention_newest", """
SELECT photo_id, id, own FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY id DESC) AS k FROM (
  SELECT i.photo_id, r.id, true AS own FROM issues i JOIN review_events r ON r.photo_id = i.photo_id UNION SELECT i.photo_id, r.id, false FROM issues i JOIN origins o ON o.file_id = i.photo_id JOIN review_events r ON r.photo_id = o.origin_file_id)) WHERE k <= 20""")
def attention_newest(issues: DataFrame, review_events: DataFrame, origins: DataFrame, most: int = 20) -> DataFrame:
    """Each issue's newest evidence: its own events and those of the file it came from."""
    e = review_events.select(F.col("photo_id").alias("at"), "id")
    own = issues.select("photo_id").join(e, F.col("photo_id") == F.col("at")).select("photo_id", "id", F.lit(True).alias("own"))
    linked = issues.select("photo_id").join(origins, F.col("photo_id") == F.col("file_id")).join(e, F.col("origin_file_id") == F.col("at")).select("photo_id", "id", F.lit(False).alias("own"))
    order = Window.partitionBy("photo_id").orderBy(F.desc("id"))
    return own.union(linked).distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


@query("thumbnail_totals", "SELECT width AS size, count(*) AS n, CAST(sum(width * height) AS BIGINT) AS pixels FROM contents WHERE phash_state = 'ok' GROUP BY width")
def thumbnail_totals(contents: DataFrame) -> DataFrame:
    return contents.filter("phash_state = 'ok'").groupBy(F.col("width").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("width").cast("bigint") * F.col("height")).alias("pixels"))


@query("thumbnail_orphans", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT content_id FROM contents)")
def thumbnail_orphans(embeddings: DataFrame, contents: DataFrame) -> DataFrame:
    """Cached pictures whose content the catalog no longer has."""
    return embeddings.select("vec_id").join(contents, F.col("vec_id") == F.col("content_id"), "left_anti")


@query("hash_validity", "SELECT phash_state, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(lpad(to_hex(h62), 16, '0')), '^[0-9a-f]{16}$')) AS valid FROM contents GROUP BY phash_state")
def hash_validity(contents: DataFrame) -> DataFrame:
    written = F.lower(F.lpad(F.hex("h62"), 16, "0"))
    return contents.groupBy("phash_state").agg(F.count(F.lit(1)).alias("n"), F.count_if(written.rlike("^[0-9a-f]{16}$")).alias("valid"))


VALIDATION_SQL = """
SELECT t AS threshold, count(*) FILTER (WHERE d <= m) AS found, count(*) FILTER (WHERE d <= m AND same) AS right_ones, count(*) FILTER (WHERE same) AS truth FROM (VALUES (75, 16), (80, 12), (85, 9), (90, 6), (95, 3), (100, 0)) v(t, m) LEFT JOIN (
  SELECT CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS d, a.label = b.label AS same FROM (SELECT c.h62 AS h, e.label FROM contents c JOIN embeddings e ON e.vec_id = c.content_id) a JOIN (SELECT c.h62 AS h, e.label FROM contents c JOIN embeddings e ON e.vec_id = c.content_id) b ON a.h < b.h) p ON true GROUP BY t"""


@query("validation_by_threshold", VALIDATION_SQL)
def validation_by_threshold(contents: DataFrame, embeddings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """How many of the near pairs share a label, at each of the six thresholds, the counts behind precision and recall; truth is every pair of unequal hashes that shares a label.

    Only pairs at most 16 bits apart are counted, without edges where tiles meet; the truth follows from the sizes of labels and buckets.
    """
    count = F.count(F.lit(1))
    sizes = contents.filter("h62 is not null").join(embeddings.select(F.col("vec_id").alias("content_id"), "label"), "content_id").groupBy(F.col("h62").alias("h"), "label").agg(count.alias("n"))
    if edges is None:
        parts = label_pairs(sizes, list(schema.THRESHOLDS.values())).groupBy(F.col("level").alias("m")).agg(F.sum("found").alias("found"), F.sum("same").alias("right_ones"))
        near = parts.select("m", F.expr("found div 2").alias("found"), F.expr("right_ones div 2").alias("right_ones"))
    else:
        low, high = (sizes.select(F.col("h").alias(side), F.col("label").alias(f"{side}_label"), F.col("n").alias(f"{side}_n")) for side in ("low", "high"))
        made = edges.select("low", "high", "distance").join(low, "low").join(high, "high")
        n, same = F.col("low_n") * F.col("high_n"), F.coalesce(F.col("low_label") == F.col("high_label"), F.lit(False))
        upto = F.explode(F.filter(F.array(*map(F.lit, schema.THRESHOLDS.values())), lambda m: m >= F.col("distance"))).alias("m")
        near = made.groupBy("distance").agg(F.sum(n).alias("found"), F.sum(F.when(same, n)).alias("right_ones")).select(upto, "found", "right_ones").groupBy("m").agg(F.sum("found").alias("found"), F.sum("right_ones").alias("right_ones"))
    labels = sizes.filter("label is not null").groupBy("label").agg(F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("truth"))
    levels = labels.select("truth", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(d).alias("m")) for t, d in schema.THRESHOLDS.items()])).alias("x")).select("truth", "x.*")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return levels.join(F.broadcast(near), "m", "left").select("threshold", none("found"), none("right_ones"), "truth")  # a row for each threshold


@query("incremental_pairs", """
, early AS (SELECT DISTINCT h62 AS h FROM contents WHERE h62 IS NOT NULL AND 4 * content_id < 3 * (SELECT max(content_id) FROM contents))
SELECT a.h AS known, b.h AS new, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM early a JOIN (SELECT h FROM hashes WHERE h NOT IN (SELECT h FROM early)) b ON bit_count(xor(a.h, b.h)) <= 3""")
def incremental_pairs(edges: DataFrame, markers: DataFrame, most: int = 3) -> DataFrame:
    """What the index's last step found between the hashes that it was given and those known before, by their markers."""
    last = markers.filter("batch = 1").select("h", F.lit(True).alias("late"))
    found = within(edges, most).join(last.select(F.col("h").alias("low"), F.col("late").alias("low_new")), "low", "left").join(last.select(F.col("h").alias("high"), F.col("late").alias("high_new")), "high", "left")
    new, known = (F.when(F.col("low_new"), F.col(a)).otherwise(F.col(b)) for a, b in (("low", "high"), ("high", "low")))
    return found.filter("(low_new is null) <> (high_new is null)").select(known.alias("known"), new.alias("new"), "distance")


@query("recovery_totals", "SELECT phash_state, count(*) AS n, count(*) FILTER (WHERE s.held) AS retryable FROM contents c LEFT JOIN (SELECT sha1_hash, bool_or(dest_path IS NOT NULL) AS held FROM photos GROUP BY 1) s USING (sha1_hash) GROUP BY 1")
def recovery_totals(contents: DataFrame, photos: DataFrame) -> DataFrame:
    held = photos.groupBy("sha1_hash").agg(F.bool_or(F.col("dest_path").isNotNull()).alias("held"))
    return contents.join(held, "sha1_hash", "left").groupBy("phash_state").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("retryable"))


@query("decision_history", """
SELECT photo_id, id, 'saved' AS origin FROM review_events WHERE action IN ('click', 'view') UNION ALL SELECT photo_id, max(id), 'applied' FROM review_events WHERE action = 'purchase' GROUP BY photo_id, k""")
def decision_history(review_events: DataFrame) -> DataFrame:
    """Saved choices, and receipts of applied ones, once for each choice that they used."""
    saved = review_events.filter(F.col("action").isin("click", "view")).select("photo_id", "id", F.lit("saved").alias("origin"))
    applied = review_events.filter("action = 'purchase'").groupBy("photo_id", "k").agg(F.max("id").alias("id")).select("photo_id", "id", F.lit("applied").alias("origin"))
    return saved.union(applied)


@query("edit_kinds", "SELECT field, count(DISTINCT photo_id) AS photos, count(DISTINCT value) FILTER (WHERE value <> '') AS \"values\" FROM tags WHERE source = 'purchase' GROUP BY field")
def edit_kinds(tags: DataFrame) -> DataFrame:
    return tags.filter("source = 'purchase'").groupBy("field").agg(F.countDistinct("photo_id").alias("photos"), F.countDistinct(F.when(F.col("value") != "", F.col("value"))).alias("values"))


@query("operation_actions", """
SELECT op, o.status, d.amount AS earlier, CASE WHEN d.amount IS NULL THEN 'first' WHEN d.amount < o.amount THEN 'more' ELSE 'less' END AS change FROM operations o LEFT JOIN (SELECT run_id, photo_id, min(amount) AS amount FROM operations WHERE status = 'Completed' GROUP BY 1, 2) d ON d.run_id = o.run_id AND d.photo_id = o.photo_id WHERE o.status = 'Copied'""")
def operation_actions(operations: DataFrame) -> DataFrame:
    """What an operation did against what the same run did to the photo before."""
    done = operations.filter("status = 'Completed'").groupBy("run_id", "photo_id").agg(F.min("amount").alias("earlier"))
    rows = operations.filter("status = 'Copied'").join(done, ["run_id", "photo_id"], "left")
    return rows.select("op", "status", "earlier", F.when(F.col("earlier").isNull(), "first").when(F.col("earlier") < F.col("amount"), "more").otherwise("less").alias("change"))


@query("pair_retry", "SELECT photo_id, op FROM (SELECT photo_id, arg_max(op, op) AS op, arg_max(status, op) AS status FROM operations GROUP BY photo_id) WHERE status = 'Failed' AND photo_id IN (SELECT photo_id FROM issues WHERE NOT resolved)")
def pair_retry(operations: DataFrame, issues: DataFrame) -> DataFrame:
    """Photos whose last operation failed and whose issue is open."""
    last = operations.groupBy("photo_id").agg(F.max_by(F.struct("op", "status"), "op").alias("x")).select("photo_id", "x.*").filter("status = 'Failed'")
    return last.join(issues.filter("not resolved"), "photo_id", "left_semi").select("photo_id", "op")


@query("shared_sidecar_cleanup", "SELECT camera AS sidecar, bool_and(status IN ('Completed', 'Copied', 'Found_At_Destination')) AS removable, count(*) FILTER (WHERE status NOT IN ('Completed', 'Copied', 'Found_At_Destination')) AS owners_left FROM photos GROUP BY camera")
def shared_sidecar_cleanup(photos: DataFrame) -> DataFrame:
    """A shared sidecar may go once every owner was delivered."""
    done = F.col("status").isin(*schema.DELIVERED)
    return photos.groupBy(F.col("camera").alias("sidecar")).agg(F.bool_and(done).alias("removable"), F.count_if(~done).alias("owners_left"))


@query("composition_preview", """
SELECT photo_id, field, coalesce(t, d, b) AS value, CASE WHEN t IS NOT NULL THEN 'typed' WHEN d IS NOT NULL THEN 'donor' WHEN b IS NOT NULL THEN 'base' ELSE 'unchanged' END AS origin FROM (
  SELECT photo_id, field, arg_max(value, id) FILTER (WHERE source = 'purchase') AS t, arg_max(value, id) FILTER (WHERE source = 'signup') AS d, arg_max(value, id) FILTER (WHERE source = 'view') AS b FROM tags GROUP BY 1, 2)""")
def composition_preview(tags: DataFrame) -> DataFrame:
    """Typed values over a donor's over the base's, with where each came from."""
    newest = lambda s, n: F.max_by(F.when(F.col("source") == s, F.col("value")), F.when(F.col("source") == s, F.col("id"))).alias(n)
    per = tags.groupBy("photo_id", "field").agg(newest("purchase", "t"), newest("signup", "d"), newest("view", "b"))
    origin = F.when(F.col("t").isNotNull(), "typed").when(F.col("d").isNotNull(), "donor").when(F.col("b").isNotNull(), "base").otherwise("unchanged")
    return per.select("photo_id", "field", F.coalesce("t", "d", "b").alias("value"), origin.alias("origin"))


@query("settings_read", "SELECT r.target, coalesce(s.k, 1800) AS value, s.k IS NOT NULL AS saved, coalesce(s.revision, 0) AS revision FROM (SELECT DISTINCT target FROM runs) r LEFT JOIN (SELECT photo_id, arg_max(k, id) AS k, count(*) AS revision FROM review_events WHERE action = 'click' GROUP BY 1) s ON s.photo_id = r.target")
def settings_read(runs: DataFrame, review_events: DataFrame) -> DataFrame:
    """A setting's saved value or its default, with its revision."""
    saved = review_events.filter("action = 'click'").groupBy(F.col("photo_id").alias("target")).agg(F.max_by("k", "id").alias("k"), F.count(F.lit(1)).alias("revision"))
    rows = runs.select("target").distinct().join(saved, "target", "left")
    return rows.select("target", F.coalesce("k", F.lit(schema.MIN_YEAR)).alias("value"), F.col("k").isNotNull().alias("saved"), F.coalesce("revision", F.lit(0)).alias("revision"))


@query("notifications_page", "SELECT id, status, id IN (SELECT id FROM review_events WHERE action = 'view') AS read FROM runs WHERE id < 1000 AND status <> 'Running' ORDER BY id DESC LIMIT 41")
def notifications_page(runs: DataFrame, review_events: DataFrame, before: int = 1000, size: int = 40) -> DataFrame:
    seen = review_events.filter("action = 'view'").select("id", F.lit(True).alias("read"))
    rows = runs.filter((F.col("id") < before) & (F.col("status") != "Running")).join(seen, "id", "left")
    return rows.select("id", "status", F.coalesce("read", F.lit(False)).alias("read")).orderBy(F.desc("id")).limit(size + 1)


@query("active_jobs", "SELECT target, CASE WHEN arg_max(status, id) = 'Running' THEN 'running' WHEN arg_max(status, id) = 'Cancelled' THEN 'awaiting reconciliation' ELSE 'idle' END AS state, max(id) AS run FROM runs GROUP BY target")
def active_jobs(runs: DataFrame) -> DataFrame:
    per = runs.groupBy("target").agg(F.max_by("status", "id").alias("s"), F.max("id").alias("run"))
    return per.select("target", F.when(F.col("s") == "Running", "running").when(F.col("s") == "Cancelled", "awaiting reconciliation").otherwise("idle").alias("state"), "run")


@query("status_before_reject", "SELECT p.id, coalesce(r.action, 'Copied') AS before FROM photos p LEFT JOIN (SELECT photo_id, arg_max(action, id) AS action FROM review_events WHERE action <> 'error' GROUP BY 1) r ON r.photo_id = p.id WHERE p.status IN ('Rejected', 'Rejected_Copied')")
def status_before_reject(photos: DataFrame, review_events: DataFrame) -> DataFrame:
    last = review_events.filter("action <> 'error'").groupBy(F.col("photo_id").alias("id")).agg(F.max_by("action", "id").alias("action"))
    return photos.filter(F.col("status").isin(*schema.IN_REJECTS)).join(last, "id", "left").select("id", F.coalesce("action", F.lit("Copied")).alias("before"))


@query("issue_verdicts", """
SELECT op, CASE WHEN source_state = 'match' AND dest_state = 'match' THEN 'both' WHEN dest_state = 'match' THEN 'delivered' WHEN source_state = 'match' THEN 'kept' WHEN source_state = 'absent' AND dest_state = 'absent' THEN 'lost' ELSE 'unclear' END AS verdict FROM ends WHERE status = 'Failed'""")
def issue_verdicts(ends: DataFrame) -> DataFrame:
    """A check's verdict from what lies at both ends."""
    s, d = F.col("source_state"), F.col("dest_state")
    verdict = F.when((s == "match") & (d == "match"), "both").when(d == "match", "delivered").when(s == "match", "kept").when((s == "absent") & (d == "absent"), "lost").otherwise("unclear")
    return ends.filter("status = 'Failed'").select("op", verdict.alias("verdict"))


@query("first_seen", "SELECT p.id, min(r.created_at) AS first_seen, count(r.id) AS sightings FROM photos p LEFT JOIN review_events r ON r.photo_id = p.id GROUP BY p.id")
def first_seen(photos: DataFrame, review_events: DataFrame) -> DataFrame:
    per = review_events.groupBy(F.col("photo_id").alias("id")).agg(F.min("created_at").alias("first_seen"), F.count(F.lit(1)).alias("sightings"))
    return photos.select("id").join(per, "id", "left").select("id", "first_seen", F.coalesce("sightings", F.lit(0)).alias("sightings"))


@query("rename_plan", r"""
SELECT id, new_stem, CASE WHEN k > 1 THEN new_stem || '_' || (k - 1) ELSE new_stem END AS target FROM (SELECT *, row_number() OVER (PARTITION BY new_stem ORDER BY id) AS k FROM (SELECT id, regexp_replace('trip ' || (id % 50) || '.jpg', '\.(jpg|png|cr2|tif)$', '') AS new_stem FROM photos WHERE status IN ('Completed', 'Copied')))""")
def rename_plan(photos: DataFrame) -> DataFrame:
    """New names without a known extension; a clash is numbered in order of id."""
    asked = F.concat(F.lit("trip "), (F.col("id") % 50).cast("string"), F.lit(".jpg"))
    rows = photos.filter(F.col("status").isin("Completed", "Copied")).select("id", F.regexp_replace(asked, r"\.(jpg|png|cr2|tif)$", "").alias("new_stem"))
    return numbered(rows, ["new_stem"]).select("id", "new_stem", F.when(F.col("k") > 1, F.concat("new_stem", F.lit("_"), (F.col("k") - 1).cast("string"))).otherwise(F.col("new_stem")).alias("target"))


@query("relocate_candidates", r"SELECT DISTINCT p.sha1_hash, regexp_extract(q.name, '^(.+)\.[^.]+$', 1) AS candidate FROM photos p JOIN photos q USING (sha1_hash) WHERE p.status = 'Completed' AND q.id <> p.id")
def relocate_candidates(photos: DataFrame) -> DataFrame:
    """Names that other rows of a delivered content offer for it.

    Rows are counted by content and name before contents meet: a name counts unless the only row that has it is the
    only delivered one.
    """
    done = F.col("status") == "Completed"
    names = photos.filter("sha1_hash is not null").groupBy("sha1_hash", X.stem(F.col("source_path")).alias("candidate")).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("own"))
    per = names.groupBy("sha1_hash").agg(F.sum("own").alias("delivered")).filter("delivered > 0")
    return names.join(per, "sha1_hash").filter(~((F.col("n") == 1) & (F.col("own") == 1) & (F.col("delivered") == 1))).select("sha1_hash", "candidate")
