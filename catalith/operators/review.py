"""Review events: latest per key, flags, decisions, as-of reads, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X
from ..registry import query


def latest(events: DataFrame, key: str, *columns: str) -> DataFrame:
    """The newest row a key by id, combined map-side."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), "id").alias("x")).select(key, "x.*")


@query("latest_review_action", "SELECT photo_id, max(id) AS id, arg_max(action, id) AS action, arg_max(created_at, id) AS created_at FROM review_events GROUP BY photo_id")
def latest_review_action(review_events: DataFrame) -> DataFrame:
    return latest(review_events, "photo_id", "id", "action", "created_at")


@query("rejected_at", "SELECT photo_id, max(created_at) AS rejected_at FROM review_events WHERE action = 'error' GROUP BY photo_id")
def rejected_at(review_events: DataFrame) -> DataFrame:
    return review_events.filter("action = 'error'").groupBy("photo_id").agg(F.max("created_at").alias("rejected_at"))


FLAGS_SQL = """
SELECT p.id, p.status IN ('Completed', 'Copied', 'Found_At_Destination') AND coalesce(least(c.width, c.height) < 1000, false) AND NOT EXISTS (SELECT 1 FROM review_events r WHERE r.photo_id = p.id AND r.action = 'view') AS small,
  coalesce(l.action = 'click', false) AS later, p.status IN ('Completed', 'Copied', 'Found_At_Destination') AND coalesce(CAST(substr(p.date_taken, 1, 4) AS INTEGER) < 1800, false) AS odd_date, EXISTS (SELECT 1 FROM issues i WHERE i.photo_id = p.id AND i.category = 'unestablished_outcome' AND NOT i.resolved) AS issue
FROM photos p LEFT JOIN contents c USING (sha1_hash) LEFT JOIN (SELECT photo_id, arg_max(action, id) AS action FROM review_events GROUP BY photo_id) l ON l.photo_id = p.id"""


@query("review_flags", FLAGS_SQL)
def review_flags(photos: DataFrame, contents: DataFrame, review_events: DataFrame, issues: DataFrame) -> DataFrame:
    """Why each photo asks for review: small, put off, odd date, open issue."""
    seen = review_events.groupBy(F.col("photo_id").alias("id")).agg(F.max_by("action", "id").alias("action"), F.bool_or(F.col("action") == "view").alias("viewed"))
    open_ids = issues.filter("category = 'unestablished_outcome' and not resolved").select(F.col("photo_id").alias("id"), F.lit(True).alias("open")).distinct()
    rows = photos.join(contents.select("sha1_hash", "width", "height"), "sha1_hash", "left").join(seen, "id", "left").join(open_ids, "id", "left")
    delivered, no = F.col("status").isin(*schema.DELIVERED), F.lit(False)
    return rows.select(
        "id", (delivered & F.coalesce(F.least("width", "height") < 1000, no) & ~F.coalesce("viewed", no)).alias("small"), F.coalesce(F.col("action") == "click", no).alias("later"),
        (delivered & X.suspicious(F.col("date_taken"), F.col("status"))).alias("odd_date"), F.coalesce("open", no).alias("issue"),
    )


@query("review_reason_counts", f"SELECT count(*) FILTER (WHERE small) AS small, count(*) FILTER (WHERE later) AS later, count(*) FILTER (WHERE odd_date) AS odd_date, count(*) FILTER (WHERE issue) AS issue, count(*) FILTER (WHERE small OR later OR odd_date OR issue) AS every FROM ({FLAGS_SQL})")
def review_reason_counts(photos: DataFrame, contents: DataFrame, review_events: DataFrame, issues: DataFrame) -> DataFrame:
    flags = review_flags(photos, contents, review_events, issues)
    names = ("small", "later", "odd_date", "issue")
    either = F.lit(False)
    for n in names:
        either = either | F.col(n)
    return flags.agg(*[F.count_if(n).alias(n) for n in names], F.count_if(either).alias("every"))


@query("bookmark_order", """
SELECT p.id, CASE l.action WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 7 END AS rank FROM photos p LEFT JOIN (SELECT photo_id, arg_max(action, id) AS action FROM review_events GROUP BY photo_id) l ON l.photo_id = p.id ORDER BY rank, p.id LIMIT 100""")
def bookmark_order(photos: DataFrame, review_events: DataFrame, n: int = 100) -> DataFrame:
    a = F.col("action")
    rank = F.when(a == "error", 0).when(a == "purchase", 1).when(a == "signup", 2).when(a == "click", 3).when(a == "view", 4).otherwise(7)
    rows = photos.select("id").join(latest(review_events, "photo_id", "action").withColumnRenamed("photo_id", "id"), "id", "left")
    return rows.select("id", rank.alias("rank")).orderBy("rank", "id").limit(n)


# What may be decided for each reason, and the length of a note.
ACTIONS = {"small": ("reviewed",), "later": ("later", "done", "keep"), "date": ("correct",)}
NOTE = 60

_ALLOWED_SQL = " OR ".join(f"(reason = '{r}' AND action IN ({', '.join(repr(a) for a in acts)}))" for r, acts in ACTIONS.items())


@query("review_decide", f"""
, history AS (SELECT * FROM review_events WHERE id % 10 <> 0), flags AS ({FLAGS_SQL.replace('review_events', 'history')}), present AS (
  SELECT p.id AS photo_id, p.sha1_hash, p.status, p.date_taken AS date_now, coalesce(h.n, 0) AS now_revision, h.preset, f.small, f.later, f.odd_date FROM photos p JOIN flags f ON f.id = p.id
  LEFT JOIN (SELECT photo_id, count(*) AS n, arg_max(CASE WHEN k % 2 = 0 THEN 'keep' ELSE 'date' END, id) FILTER (action = 'click') AS preset FROM history GROUP BY 1) h ON h.photo_id = p.id
), judged AS (
  SELECT q.*, CASE WHEN NOT ({_ALLOWED_SQL}) OR length(note) > {NOTE} OR (reason <> 'later' AND note <> '') OR (reason <> 'later' AND bookmark IS NOT NULL) OR (reason = 'date') <> (coalesce(date_taken, '') <> '') THEN 'invalid'
    WHEN id <> first_id THEN CASE WHEN payload = first_payload THEN 'replayed' ELSE 'request_conflict' END WHEN sha1 IS DISTINCT FROM sha1_hash OR revision <> now_revision THEN 'changed' WHEN reason = 'date' AND date_taken IS DISTINCT FROM date_now THEN 'date_changed'
    WHEN status NOT IN ('Completed', 'Copied', 'Found_At_Destination') THEN 'not_in_library' WHEN action <> 'later' AND NOT CASE reason WHEN 'small' THEN small WHEN 'later' THEN later ELSE odd_date END THEN 'not_current' WHEN action = 'keep' AND preset IS DISTINCT FROM 'keep' THEN 'not_a_keep' END AS refusal FROM (
    SELECT q.*, p.* EXCLUDE (photo_id), min(q.id) OVER (PARTITION BY request_id) AS first_id, concat_ws('|', q.photo_id, sha1, revision, reason, action, note, bookmark, date_taken) AS payload, arg_min(concat_ws('|', q.photo_id, sha1, revision, reason, action, note, bookmark, date_taken), q.id) OVER (PARTITION BY request_id) AS first_payload
    FROM requests q JOIN present p ON p.photo_id = q.photo_id) q
)
SELECT id AS request, photo_id, coalesce(refusal, CASE WHEN row_number() OVER (PARTITION BY photo_id, refusal IS NULL ORDER BY id) = 1 THEN 'saved' ELSE 'changed' END) AS outcome FROM judged""")
def review_decide(requests: DataFrame, photos: DataFrame, contents: DataFrame, review_events: DataFrame, issues: DataFrame) -> DataFrame:
    """What becomes of each request of a batch, by the state before it: saved, replayed, or why it is refused.

    Malformed requests come first; a request id that was used before is a replay if nothing else differs; then content,
    revision and date must be the present ones, the photo in the library, and the reminder current. A saved decision raises
    the photo's revision, so of a photo's requests one is saved and the others find it changed.
    """
    history = review_events.filter("id % 10 <> 0")  # what was recorded before the batch
    flags = review_flags(photos, contents, history, issues)
    preset = F.when(F.col("k") % 2 == 0, "keep").otherwise("date")
    click = F.when(F.col("action") == "click", F.col("id"))
    before = history.groupBy(F.col("photo_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max_by(preset, click).alias("preset"))
    present = photos.select("id", "sha1_hash", "status", F.col("date_taken").alias("date_now")).join(flags, "id").join(before, "id", "left").withColumnRenamed("id", "photo_id").withColumn("now_revision", F.coalesce("n", F.lit(0)))
    payload = F.concat_ws("|", *[F.col(c).cast("string") for c in ("photo_id", "sha1", "revision", "reason", "action", "note", "bookmark", "date_taken")])
    rows = requests.withColumn("payload", payload)
    first = rows.groupBy("request_id").agg(F.min(F.struct("id", "payload")).alias("first"))
    rows = rows.join(first, "request_id").join(present, "photo_id")
    reason, action = F.col("reason"), F.col("action")
    allowed = F.lit(False)
    for r, acts in ACTIONS.items():
        allowed = allowed | ((reason == r) & action.isin(*acts))
    dated = F.coalesce(F.col("date_taken") != "", F.lit(False))
    invalid = ~allowed | (F.length("note") > NOTE) | ((reason != "later") & (F.col("note") != "")) | ((reason != "later") & F.col("bookmark").isNotNull()) | ((reason == "date") != dated)
    current = F.when(reason == "small", F.col("small")).when(reason == "later", F.col("later")).otherwise(F.col("odd_date"))
    refusal = (
        F.when(invalid, "invalid").when(F.col("id") != F.col("first.id"), F.when(F.col("payload") == F.col("first.payload"), "replayed").otherwise("request_conflict"))
        .when(~F.col("sha1").eqNullSafe(F.col("sha1_hash")) | (F.col("revision") != F.col("now_revision")), "changed").when((reason == "date") & ~F.col("date_taken").eqNullSafe(F.col("date_now")), "date_changed")
        .when(~F.col("status").isin(*schema.DELIVERED), "not_in_library").when((action != "later") & ~current, "not_current").when((action == "keep") & ~F.col("preset").eqNullSafe(F.lit("keep")), "not_a_keep")
    )
    rows = rows.select(F.col("id").alias("request"), "photo_id", refusal.alias("refusal"))
    winner = rows.filter("refusal is null").groupBy("photo_id").agg(F.min("request").alias("winner"))
    outcome = F.coalesce("refusal", F.when(F.col("request") == F.col("winner"), "saved").otherwise("changed"))
    return rows.join(winner, "photo_id", "left").select("request", "photo_id", outcome.alias("outcome"))


@query("cleared_diff", """
SELECT id, 'date' AS cleared FROM photos WHERE status <> 'Failed' AND CAST(substr(date_taken, 1, 4) AS INTEGER) < 2000 AND NOT CAST(substr(date_taken, 1, 4) AS INTEGER) < 1800""")
def cleared_diff(photos: DataFrame, before: int = 2000, after: int = 1800) -> DataFrame:
    """Reviews that a changed setting clears: suspicious under the old least year, not under the new one."""
    d, s = F.col("date_taken"), F.col("status")
    return photos.filter(X.suspicious(d, s, least=before) & ~X.suspicious(d, s, least=after)).select("id", F.lit("date").alias("cleared"))


def _odd_sql(date: str, least: int = 1800, now: int = 2026) -> str:
    return f"(coalesce(CAST(substr({date}, 1, 4) AS INTEGER) < {least} OR CAST(substr({date}, 1, 4) AS INTEGER) > {now + 1}, false) AND {date} IS DISTINCT FROM confirmed)"


@query("cleared_reviews", f"""
SELECT id, unnest(list_filter([CASE WHEN both_in AND {_odd_sql('old_date')} AND NOT {_odd_sql('new_date')} AND NOT coalesce(new_date = confirmed, false) THEN 'date:date_changed' END, CASE WHEN both_in AND NOT seen AND coalesce(old_side < 1000, false) AND coalesce(new_side >= 1000, false) THEN 'small:dimensions_changed' END,
  CASE WHEN now_in AND {_odd_sql('new_date', 2000)} AND NOT {_odd_sql('new_date')} THEN 'date:date_rule_changed' END, CASE WHEN now_in AND NOT seen AND coalesce(new_side < 2000, false) AND NOT coalesce(new_side < 1000, false) THEN 'small:size_rule_changed' END,
  CASE WHEN now_in AND {_odd_sql('new_date', now=2024)} AND NOT {_odd_sql('new_date')} THEN 'date:calendar_year_changed' END], lambda x: x IS NOT NULL)) AS cleared FROM (
  SELECT u.*, c.date_taken AS confirmed, u.id IN (SELECT photo_id FROM review_events WHERE action = 'view') AS seen, new_status IN ('Completed', 'Copied', 'Found_At_Destination') AS now_in, old_status IN ('Completed', 'Copied', 'Found_At_Destination') AND new_status IN ('Completed', 'Copied', 'Found_At_Destination') AS both_in FROM updates u LEFT JOIN confirmations c ON c.photo_id = u.id)""")
def cleared_reviews(updates: DataFrame, confirmations: DataFrame, review_events: DataFrame, least: tuple = (2000, schema.MIN_YEAR), side: tuple = (2000, 1000), year: tuple = (2024, schema.NOW_YEAR)) -> DataFrame:
    """Reviews that clear themselves: a date or size that changed, a least year or size that was lowered, a year that has begun.

    Each is pending by what was true before and not by what is now; what was confirmed or looked at is not pending.
    least, side, year: the settings and the calendar before and now. One pass judges all causes.
    """
    seen = review_events.filter("action = 'view'").select(F.col("photo_id").alias("id"), F.lit(True).alias("seen")).distinct()
    rows = updates.join(confirmations.select(F.col("photo_id").alias("id"), F.col("date_taken").alias("confirmed")), "id", "left").join(seen, "id", "left")
    no, delivered = F.lit(False), lambda c: F.col(c).isin(*schema.DELIVERED)
    odd = lambda c, low=least[1], now=year[1]: F.coalesce(X.suspicious(F.col(c), F.lit("Copied"), least=low, now=now), no) & ~F.col(c).eqNullSafe(F.col("confirmed"))
    small = lambda c, most=side[1]: F.col("seen").isNull() & F.coalesce(F.col(c) < most, no)
    both, now_in = delivered("old_status") & delivered("new_status"), delivered("new_status")
    causes = {
        "date:date_changed": both & odd("old_date") & ~odd("new_date") & ~F.coalesce(F.col("new_date") == F.col("confirmed"), no), "small:dimensions_changed": both & small("old_side") & F.coalesce(F.col("new_side") >= side[1], no),
        "date:date_rule_changed": now_in & odd("new_date", low=least[0]) & ~odd("new_date"), "small:size_rule_changed": now_in & small("new_side", side[0]) & ~small("new_side"), "date:calendar_year_changed": now_in & odd("new_date", now=year[0]) & ~odd("new_date"),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in causes.items()]))).alias("cleared"))


@query("asof_decision", """
SELECT r.id AS run_id, max(e.id) AS decision, arg_max(e.action, e.id) AS action FROM runs r LEFT JOIN review_events e ON e.photo_id = r.target AND e.id <= r.id GROUP BY r.id""")
def asof_decision(runs: DataFrame, review_events: DataFrame) -> DataFrame:
    """For each run the newest decision on its target that its mark still covers.

    Both sides are put in one order per target and the last decision is carried forward: no pair of run and event is made.
    """
    e = review_events.select(F.col("photo_id").alias("target"), F.col("id").alias("mark"), F.lit(0).alias("side"), F.struct("id", "action").alias("d"))
    r = runs.select("target", F.col("id").alias("mark"), F.lit(1).alias("side"), F.lit(None).cast("struct<id:bigint,action:string>").alias("d"))
    order = Window.partitionBy("target").orderBy("mark", "side").rowsBetween(Window.unboundedPreceding, 0)
    return e.union(r).withColumn("d", F.last("d", ignorenulls=True).over(order)).filter("side = 1").select(F.col("mark").alias("run_id"), F.col("d.id").alias("decision"), F.col("d.action").alias("action"))


@query("retention", "SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY id DESC) > 3 AS prune FROM runs WHERE status = 'Completed'")
def retention(runs: DataFrame, keep: int = 3) -> DataFrame:
    """Of each target's completed runs the newest stay."""
    order = Window.partitionBy("target").orderBy(F.desc("id"))
    return runs.filter("status = 'Completed'").select("id", "target", (F.row_number().over(order) > keep).alias("prune"))


@query("event_islands", """
SELECT photo_id, action, min(id) AS first, max(id) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN action = before THEN 0 ELSE 1 END) OVER (PARTITION BY photo_id ORDER BY created_at, id) AS g FROM (SELECT *, lag(action) OVER (PARTITION BY photo_id ORDER BY created_at, id) AS before FROM review_events)) GROUP BY photo_id, action, g HAVING count(*) >= 3""")
def event_islands(review_events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of three or more events of one kind."""
    order = Window.partitionBy("photo_id").orderBy("created_at", "id")
    rows = review_events.withColumn("new", F.when(F.col("action") == F.lag("action").over(order), 0).otherwise(1))
    rows = rows.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("photo_id", "action", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("g")


@query("batch_review_counts", "SELECT action, count(DISTINCT photo_id) AS photos, count(*) AS events FROM review_events GROUP BY action")
def batch_review_counts(review_events: DataFrame) -> DataFrame:
    return review_events.groupBy("action").agg(F.countDistinct("photo_id").alias("photos"), F.count(F.lit(1)).alias("events"))
