"""The catalog's tables, derived from the tables of a directory.

Each view is a DataFrame here and a common table expression in SQL (see oracle_views): the two are the same relation.
The views over whole texts and vectors are written once a session, as an index is, so that a query reads a narrow table
and not the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..plans.similarity_index import SimilarityIndex, all_pairs, band, neighbour_sums
from .stored import delete_at_end, shared_dir, stamped, stored

_indexes: dict[tuple, SimilarityIndex] = {}

#: Bits of a locality hash: what fits a long beside a sign and what every engine can shift.
BITS = 62

#: Bits between the hashes whose pairs the index keeps, 95 %.
CLOSE = 3

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def similarity_hashes(texts: DataFrame) -> DataFrame:
    """texts: content_id, text. content_id, h62: bit i is set where most words' hashes have it, so like texts have near hashes.

    It stands for the perceptual hash of a picture, which is an input. Words are summed where they are read.
    """
    word = F.md5(F.col("word"))
    half = lambda at: F.conv(F.substring(word, at, 8), 16, 10).cast("bigint")
    rows = texts.select("content_id", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).select("content_id", half(1).alias("high"), half(9).alias("low"))
    bits = [F.expr(f"sum(shiftright({'low' if i < BITS // 2 else 'high'}, {i % (BITS // 2)}) & 1L) as b{i}") for i in range(BITS)]
    sums = rows.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"), *bits)
    return sums.selectExpr("content_id", " + ".join(f"if(2 * b{i} > n, {1 << i}L, 0L)" for i in range(BITS)) + " as h62")


def earlier(contents: DataFrame) -> DataFrame:
    """The contents of the lower three quarters of the ids: those that an earlier run knew."""
    last = F.broadcast(contents.agg(F.max("content_id").alias("last_id")))  # one row
    return contents.crossJoin(last).filter("4 * content_id < 3 * last_id").drop("last_id")


class Catalog:
    """Lazy views over the Parquet tables in sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def photos(self) -> DataFrame:
        return self._stored(lambda: self._photos, "photos")

    @cached_property
    def contents(self) -> DataFrame:
        return self._stored(lambda: self._contents, "contents")

    def _stored(self, build: Callable[[], DataFrame], name: str) -> DataFrame:
        return stored(self.spark, build, ["documents", "embeddings"], self.sf_dir, name)

    @cached_property
    def _index(self) -> SimilarityIndex | None:
        """The kept index of look-alikes, after two steps: the contents of the earlier ids, then the others.

        The second step compares only what the first has not. Its pairs are those that the last step is asked for, up to CLOSE
        bits apart: wider ones grow too fast to be stored. None where the session names no shared folder.
        """
        base = shared_dir(self.spark)
        if base is None or getattr(self.spark, "_jvm", None) is None:
            return None
        key = stamped(self.spark, ["documents"], self.sf_dir, "index")
        if key not in _indexes:
            index = SimilarityIndex(self.spark, f"{base}/catalith-views/index-{uuid.uuid4().hex}", CLOSE)
            delete_at_end(self.spark, index.path)
            index.step(similarity.hashes(earlier(self.contents)))
            index.step(self.hashes)
            _indexes[key] = index
        return _indexes[key]

    @cached_property
    def hashes(self) -> DataFrame:
        """h: the distinct hashes."""
        return similarity.hashes(self.contents)

    @cached_property
    def met_hashes(self) -> DataFrame:
        """h, n: the hashes with others up to 6 bits away, and how many these are."""
        sums = lambda: neighbour_sums(self.hashes.withColumn("n", F.lit(1)), [6])
        return self._stored(lambda: sums().withColumnRenamed("s0", "n"), "met-hashes")

    @cached_property
    def edges(self) -> DataFrame:
        """low, high, distance, band: the hashes up to 3 bits apart, as the index keeps them."""
        if self._index is None:
            return all_pairs(self.hashes, CLOSE).withColumn("band", band(F.col("distance")))
        return self._index.edges()

    @cached_property
    def markers(self) -> DataFrame:
        """h, batch: the hashes that the index has finished with."""
        if self._index is None:
            early = similarity.hashes(earlier(self.contents)).withColumn("early", F.lit(True))
            return self.hashes.join(early, "h", "left").select("h", F.when(F.col("early"), 0).otherwise(1).alias("batch"))
        return self._index.markers()

    @cached_property
    def available(self) -> DataFrame:
        return self._stored(lambda: similarity.available(self.photos, self.contents), "available")

    @cached_property
    def buckets(self) -> DataFrame:
        return self._stored(lambda: similarity.buckets(self.available), "buckets")

    @cached_property
    def match_cache(self) -> DataFrame:
        """photo_id, at_75 to at_100: the cached counts of look-alikes, remade when the table changes."""
        return self._stored(lambda: similarity.count_matches(self.available, self.buckets), "match-counts")

    @cached_property
    def pictures(self) -> DataFrame:
        """content_id, orientation, pixels: grey values of 32 x 32 points, made of the vectors; every 23rd picture is dark."""
        e, i = F.col("embedding"), F.col("vec_id")
        point = lambda k: F.floor(F.lit(128.5) + 1500 * F.element_at(e, F.floor(k / 32).cast("int") % F.size(e) + 1).cast("double") * F.element_at(e, (k % 32 + 32) % F.size(e) + 1).cast("double"))
        bounded = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), point(k))).cast("int")
        pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.floor(bounded(k) / F.when(i % 23 == 0, 16).otherwise(1)).cast("int"))
        return self.table("embeddings").select(i.alias("content_id"), (i % 10).cast("int").alias("orientation"), pixels.alias("pixels"))

    @cached_property
    def jpegs(self) -> DataFrame:
        """file_id, data: an encoded file for each document, its scan made of the text, its comment of language and source; some damaged."""
        i, said = F.col("doc_id"), F.hex(F.concat_ws("/", "lang", "source"))
        jfif, tables = F.lit("FFE000104A46494600010100000100010000"), F.lit("FFDB000401AAFFC0000B080030004001011100FFC4000502AABB")
        comment = F.concat(F.lit("FFFE"), F.lpad(F.hex((F.length(said) / 2 + 2).cast("long")), 4, "0"), said)
        scan = F.concat(F.lit("FFDA0008010100003F00"), F.hex(F.sha2("text", 256)), F.lit("FF00FFD0"), F.hex(F.md5("text")))
        kind = F.when(i % 13 == 5, 1).when(i % 17 == 5, 2).when(i % 19 == 5, 3).when(i % 23 == 5, 4).otherwise(0)
        start, more, end = F.when(kind == 1, "FFD9").otherwise("FFD8"), F.when(kind == 4, "FFC10002").otherwise(""), F.when(kind == 2, "").when(kind == 3, "FFD900").otherwise("FFD9")
        return self.table("documents").select(i.alias("file_id"), F.unhex(F.concat(start, jfif, tables, more, comment, scan, end)).alias("data"))

    @cached_property
    def measures(self) -> DataFrame:
        from ..operators.pictures import measured

        return stored(self.spark, lambda: measured(self.pictures), ["embeddings"], self.sf_dir, "measures")

    @cached_property
    def _photos(self) -> DataFrame:
        i = F.col("doc_id")
        name = F.concat(F.lit("doc-"), F.lpad(i.cast("string"), 7, "0"), F.lit("."), F.element_at(F.array(*map(F.lit, ("jpg", "png", "cr2", "tif"))), (i % 4 + 1).cast("int")))
        status = F.element_at(F.array(*map(F.lit, ("Failed", "Pending", "Duplicate", "Removed_Duplicate", "Rejected", "Rejected_Copied", "Completed", "Found_At_Destination", "Processing", "Copied", "Copied", "Copied"))), (i % 12 + 1).cast("int"))
        dest = F.when((i % 12).isin(6, 7, 9, 10, 11), F.concat(F.lit("/dst/library/"), name)).when((i % 12).isin(4, 5), F.concat(F.lit("/dst/rejects/"), name))
        day = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), ((i * 37) % 12000).cast("int")), "yyyy-MM-dd")
        taken = F.when(i % 13 == 0, F.lit(None)).when(i % 97 == 0, F.lit("1799-12-31T00:00:00")).otherwise(F.concat(day, F.lit("T12:00:00")))
        return self.table("documents").select(
            i.alias("id"), F.sha1("text").alias("sha1_hash"), F.col("n_chars").alias("file_size"), status.alias("status"), F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("source_path"),
            dest.alias("dest_path"), taken.alias("date_taken"), F.when(i % 9 == 0, "file_mtime").otherwise("exif").alias("date_source"), name.alias("name"), F.col("source").alias("camera"), F.col("lang").alias("lens"),
        )

    @cached_property
    def _contents(self) -> DataFrame:
        first = self.photos.groupBy("sha1_hash").agg(F.min("id").alias("content_id"))
        texts = self.table("documents").filter("substring(sha1(text), 1, 1) <> '5'").select(F.col("doc_id").alias("content_id"), "text")  # the other pictures can't be read
        vectors = similarity_hashes(texts)
        i = F.col("content_id")
        return first.join(vectors, "content_id", "left").join(self.measures, "content_id", "left").select(
            i, "sha1_hash", "h62", F.when(F.col("h62").isNull(), "error").otherwise("ok").alias("phash_state"), (640 * (1 + i % 8)).cast("int").alias("width"), (480 * (1 + i % 8)).cast("int").alias("height"),
            "mean_brightness", "mean_gradient",
        )

    @cached_property
    def runs(self) -> DataFrame:
        p = F.substring("o_orderpriority", 1, 1)
        mode = F.when(p == "1", "MOVE").when(p == "2", "COPY").when(p == "3", "CHECK").otherwise("INDEX")
        status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Running").otherwise("Cancelled")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), mode.alias("mode"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_custkey").alias("target"))

    @cached_property
    def operations(self) -> DataFrame:
        key = F.concat("l_returnflag", "l_linestatus")
        status = F.when(key == "AF", "Copied").when(key == "AO", "Completed").when(key == "NF", "Failed").when(key == "NO", "Skipped").when(key == "RF", "Duplicate").otherwise("Pending")
        # the six columns identify a line; the id is a function of them, so that no global sort is needed
        op = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("bigint"))
        message = F.when(key == "NF", F.element_at(F.array(*map(F.lit, ("OSError: [Errno 28] No space left: '/dst/a'", "PermissionError: [Errno 13] Permission denied: '/src/b'", "Hash mismatch after copy", "FileNotFoundError: [Errno 2] No such file: '/src/c'", "unexpected end"))), (F.col("l_partkey") % 5 + 1).cast("int")))
        return self.table("lineitem").select(op.alias("op"), F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("photo_id"), status.alias("status"), message.alias("message"), F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").cast("bigint").alias("amount"), F.when((key == "AF") & (F.col("l_quantity") > 25), "original kept").alias("note"))

    @cached_property
    def log_entries(self) -> DataFrame:
        """The log with the paths that each row was about at the time: some files were named otherwise then."""
        known = self.photos.select(F.col("id").alias("photo_id"), F.col("source_path").alias("present"), "dest_path")
        then = F.when(F.col("amount") % 5 == 0, F.regexp_replace("present", "doc-", "orig-")).otherwise(F.col("present"))
        return self.operations.join(known, "photo_id", "left").select("op", "run_id", "photo_id", "status", "note", "message", "timestamp", then.alias("source_path"), F.when(F.col("status").isin("Copied", "Completed"), F.col("dest_path")).alias("dest_path"))

    @cached_property
    def operation_events(self) -> DataFrame:
        """op, step, outcome, kind: steps of the operations that saved metadata; not each was an edit, not each was verified."""
        a = F.col("amount")
        intent = F.struct(F.lit("intent").alias("step"), F.lit("recorded").alias("outcome"), F.when(a % 2 == 0, "metadata_edit").otherwise("keep_new_version").alias("kind"))
        saved = F.struct(F.lit("metadata_saved").alias("step"), F.when(a % 9 == 0, "failed").otherwise("verified").alias("outcome"), F.lit(None).cast("string").alias("kind"))
        return self.operations.filter("status = 'Completed' and amount % 3 = 0").select("op", F.explode(F.array(intent, saved)).alias("x")).select("op", "x.*")

    @cached_property
    def consolidations(self) -> DataFrame:
        """op, file_id: files that a verified consolidation made one."""
        return self.table("documents").filter("doc_id % 50 in (11, 36)").select(F.floor(F.col("doc_id") / 50).cast("bigint").alias("op"), F.col("doc_id").alias("file_id"))

    @cached_property
    def wanted(self) -> DataFrame:
        """id, folder, stem, ext, sha1_hash: the names that waiting photos want; a name is wanted by several."""
        i = F.col("id")
        return self.photos.filter("status in ('Pending', 'Duplicate', 'Copied') and sha1_hash is not null").select(i, F.concat(F.lit("/dst/library/"), "lens").alias("folder"), F.concat(F.lit("IMG_"), F.substring("name", 10, 1)).alias("stem"), F.lit(".jpg").alias("ext"), "sha1_hash")

    @cached_property
    def occupied(self) -> DataFrame:
        """path, sha1_hash: names that are taken; some are numbered with gaps, some hold the content that a photo would bring."""
        rows = self.wanted.filter("id % 4 in (1, 3)")
        number = F.floor(F.col("id") / 60) % 7
        return rows.groupBy(F.concat("folder", F.lit("/"), "stem", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), "ext").alias("path")).agg(F.min("sha1_hash").alias("sha1_hash")).filter("substring(sha1_hash, 2, 1) <> '7'")

    @cached_property
    def asked(self) -> DataFrame:
        """id, folder, day_folder, type_name, size, seconds: what users and files name, some of it wrong."""
        i, c, d = F.col("id"), F.col("camera"), F.col("date_taken")
        k, text = i % 8, lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        folder = F.when(k == 0, ".").when(k == 1, text(c, "//", F.col("lens"))).when(k == 2, text("/", c)).when(k == 3, text("../", c)).when(k == 4, text(c, "/./", F.col("lens"))).when(k == 5, text(c, "/")).when(k == 6, "").otherwise(c)
        day = F.when(i % 5 == 0, text("Undated/", F.substring(d, 1, 4))).when(i % 5 == 1, "2001/02/30").when(i % 5 == 2, F.substring(d, 1, 4)).otherwise(F.translate(F.substring(d, 1, 10), "-", "/"))
        kind = F.when(i % 4 == 0, ".JPG").when(i % 4 == 1, "txt").when(i % 4 == 2, " cr2").otherwise(F.regexp_extract("name", r"\.([^.]*)$", 1))
        size = F.col("file_size") * F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (1, 97, 10_007, 1_000_003, 100_000_007)]), (i % 5 + 1).cast("int"))
        return self.photos.select(i, folder.alias("folder"), day.alias("day_folder"), kind.alias("type_name"), size.alias("size"), (i * 37 * (1 + i % 3 * 100)).alias("seconds"))

    @cached_property
    def hash_records(self) -> DataFrame:
        """content_id, phash_state, text: hashes as texts, some cut off, in capitals or none at all."""
        plain, k = F.lower(F.lpad(F.hex("h62"), 16, "0")), F.col("content_id") % 5
        text = F.when(k == 0, F.substring(plain, 1, 15)).when(k == 1, F.upper(plain)).when(k == 2, "unreadable-hash!").otherwise(plain)
        return self.contents.select("content_id", "phash_state", text.alias("text")).filter("text is not null")

    @cached_property
    def turns(self) -> DataFrame:
        """content_id, first, then_turned: the orientation of a picture, and quarters by which it is turned once more."""
        i = F.col("content_id")
        return self.contents.select(i, (i % 8 + 1).cast("int").alias("first"), F.element_at(F.array(*map(F.lit, (1, 6, 3, 8))), (F.floor(i / 8) % 4 + 1).cast("int")).alias("then_turned"))

    @cached_property
    def updates(self) -> DataFrame:
        """id, old_status, new_status, old_date, new_date, old_side, new_side: photos before and after a rescan."""
        i, d = F.col("id"), F.col("date_taken")
        year = lambda text: F.concat(F.lit(text), F.substring(d, 5, 100))
        sides = self.contents.select("sha1_hash", F.least("width", "height").alias("side"))
        rows = self.photos.join(sides, "sha1_hash", "left")
        old = F.when(i % 9 == 1, year("1700")).when(i % 9 == 2, year("2090")).otherwise(d)
        new = F.when(i % 27 == 10, year("1650")).when(i % 9 == 4, year("2026")).when(i % 9 == 5, year("1950")).otherwise(d)
        return rows.select(i, F.when(i % 15 == 0, "Pending").otherwise(F.col("status")).alias("old_status"), F.col("status").alias("new_status"), old.alias("old_date"), new.alias("new_date"), F.when(i % 4 == 1, F.lit(480)).otherwise(F.col("side")).alias("old_side"), F.col("side").alias("new_side"))

    @cached_property
    def requests(self) -> DataFrame:
        """id, request_id, photo_id, sha1, revision, reason, action, note, bookmark, date_taken: decisions as browsers send them, some twice, some out of date."""
        i, k = F.col("id"), F.col("k")
        own = self.photos.select(F.col("id").alias("photo_id"), "sha1_hash", F.col("date_taken").alias("date_now"))
        before = self.review_events.filter("id % 10 <> 0").groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"))
        rows = self.review_events.filter("id % 10 = 0").join(own, "photo_id").join(before, "photo_id", "left")
        reason = F.element_at(F.array(*map(F.lit, ("small", "later", "date", "later", "other"))), (k % 5 + 1).cast("int"))
        action = F.when(k % 11 == 1, "correct").when(reason == "small", "reviewed").when(reason == "date", "correct").otherwise(F.element_at(F.array(*map(F.lit, ("later", "done", "keep"))), (k % 3 + 1).cast("int")))
        return rows.select(
            i, F.concat(F.lit("r"), F.when(i % 40 == 10, i - 10).otherwise(i).cast("string")).alias("request_id"), "photo_id", F.when(k % 13 == 2, F.sha1("sha1_hash")).otherwise(F.col("sha1_hash")).alias("sha1"), (F.coalesce("n", F.lit(0)) + F.when(k % 7 == 3, 1).otherwise(0)).alias("revision"),
            reason.alias("reason"), action.alias("action"), F.when(k % 17 == 4, F.repeat(F.lit("x"), 61)).when(reason == "later", "a note").otherwise("").alias("note"), F.when(reason == "later", F.when(k % 2 == 0, "keep").otherwise("date")).alias("bookmark"),
            F.when(reason == "date", F.when(k % 19 == 2, "1799").otherwise(F.col("date_now"))).alias("date_taken"),
        )

    @cached_property
    def review_events(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("photo_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("int").alias("k"))

    @cached_property
    def issues(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("photo_id"), F.when(F.col("toxic") == 1, "unestablished_outcome").otherwise("note").alias("category"), (F.col("quality") == 0).alias("resolved"))

    @cached_property
    def origins(self) -> DataFrame:
        return self.table("documents").filter("doc_id > 0").select(F.col("doc_id").alias("file_id"), F.floor(F.col("doc_id") / 2).cast("bigint").alias("origin_file_id"))

    @cached_property
    def observed(self) -> DataFrame:
        """What a walk of the destination found: most delivered files, some changed, moved or renamed, and strangers."""
        p = self.photos.filter("dest_path is not null")
        path = F.when(F.col("id") % 23 == 0, F.regexp_replace("dest_path", "/dst/", "/dst/moved/")).when(F.col("id") % 29 == 0, F.regexp_replace("dest_path", "doc-", "renamed-")).otherwise(F.col("dest_path"))
        seen = p.filter(F.col("id") % 19 != 0).select(path.alias("path"), F.when(F.col("id") % 31 == 0, F.sha1("sha1_hash")).otherwise(F.col("sha1_hash")).alias("sha1_hash"), F.col("file_size").alias("size"))
        pages = self.table("pages").select(F.concat(F.lit("/dst/library/page-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".jpg").when(F.col("page_id") % 3 == 1, ".txt").otherwise("")).alias("path"), F.sha1("html").alias("sha1_hash"), F.when(F.col("page_id") % 11 == 0, F.lit(0).cast("bigint")).otherwise(F.length("html").cast("bigint")).alias("size"))
        return seen.unionByName(pages)

    @cached_property
    def tags(self) -> DataFrame:
        """Metadata values as (photo, source, field, value) with the sources' reading order."""
        return self.table("events").select(F.col("event_id").alias("id"), (F.col("user_id")).alias("photo_id"), F.col("event_type").alias("source"), F.concat(F.lit("field"), (F.col("event_id") % 8).cast("string")).alias("field"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise((F.col("event_id") % 7).cast("string")).alias("value"))

    @cached_property
    def captures(self) -> DataFrame:
        """Metadata captures: the state that each left, in order of id."""
        return self.review_events.select("id", "photo_id", F.when(F.col("k") < 30, "needs_attention").otherwise("captured").alias("state"), F.col("action").alias("source"))

    @cached_property
    def version_answers(self) -> DataFrame:
        answer = F.when(F.col("k") < 34, "waiting").when(F.col("k") < 67, "not_kept").otherwise("kept")
        return self.review_events.filter("action = 'click'").select("id", "photo_id", answer.alias("answer"))

    @cached_property
    def confirmations(self) -> DataFrame:
        """Dates that somebody confirmed; of some photos the date has changed since."""
        return self.photos.filter("id % 97 = 0").select(F.col("id").alias("photo_id"), F.when(F.col("id") % 194 == 0, F.col("date_taken")).otherwise("1798").alias("date_taken"))

    @cached_property
    def thumbnails(self) -> DataFrame:
        i = F.col("vec_id")
        return self.table("embeddings").select(i.alias("content_id"), F.explode(F.array(F.lit(320), F.lit(1280))).alias("size"), (i % 11 != 0).alias("present")).withColumn("bytes", F.col("size") * (F.col("content_id") % 50 + 1))

    @cached_property
    def findings(self) -> DataFrame:
        """What two checks found: one that was completed and one that was not."""
        from ..operators.checks import destination_check

        rows = destination_check(self.photos, self.observed).filter("kind <> 'ok'")
        runs = F.explode(F.array(F.struct(F.lit(9).alias("run_id"), F.lit(True).alias("completed")), F.struct(F.lit(11).alias("run_id"), F.lit(False).alias("completed")))).alias("r")
        rows = rows.select(runs, F.col("id").alias("photo_id"), "path", "kind", F.col("expected").alias("expected_sha1"), F.col("observed").alias("observed_sha1"), "size")
        return rows.select("r.run_id", "r.completed", "photo_id", "path", "kind", "expected_sha1", "observed_sha1", "size", F.when((F.col("photo_id") % 5 == 0) & (F.col("r.run_id") == 9), F.col("photo_id")).alias("settled_by"))

    @cached_property
    def image_tags(self) -> DataFrame:
        """photo_id, tag, value: qualified metadata tags as a reader gives them, some of them wrong."""
        i, day, text = F.col("id"), F.substring("date_taken", 1, 10), lambda c: c.cast("string")
        exif = F.concat(F.translate(day, "-", ":"), F.lit(" "), F.substring("date_taken", 12, 8))
        degrees = lambda most: F.concat(text(i % most), F.lit("."), F.lpad(text(i * 7 % 1000), 3, "0"))
        tags = {
            "ExifIFD:DateTimeOriginal": F.when(i % 11 == 0, None).when(i % 17 == 0, "unknown").when(i % 29 == 3, "2020:01:02 99:99:99").when(i % 29 == 4, "").otherwise(exif), "ExifIFD:SubSecTimeOriginal": F.when(i % 3 == 0, text(i % 100)).when(i % 31 == 0, "x"),
            "ExifIFD:OffsetTimeOriginal": F.when(i % 2 == 0, "+02:00").when(i % 37 == 0, "2h"), "IFD0:Orientation": F.when(i % 5 != 0, text(i % 10)), "IFD0:Make": F.col("camera"),
            "IFD0:Copy1:Make": F.when(i % 7 == 0, F.col("lens")).when(i % 2 == 0, F.col("camera")), "IFD0:XPKeywords": F.concat("lens", F.lit("; "), "camera", F.lit(";x")),
            "XMP-xmp:Rating": F.element_at(F.array(*map(F.lit, ("4.50", "-1", "05.0", "7", "0.00", None, "4e0", " 3 ", "+2", "5.0000000000000000001", ".5", "-1.0", "-2", ""))), (i % 14 + 1).cast("int")), "XMP-dc:Title": F.col("camera"), "XMP-dc:Title-de": F.when(i % 4 == 0, F.col("lens")),
            "XMP-exif:DateTimeOriginal": F.when(i % 3 == 1, F.concat(F.translate(day, "-", ":"), F.when(i % 59 == 1, " 08:00:61").when(i % 59 == 4, "").otherwise(" 08:00:00Z"))), "GPS:GPSLatitude": F.when(i % 31 == 1, "12 deg").when(i % 31 == 2, "-1.5").when(i % 31 == 5, "12.3456789012345678901234567").when(i % 31 == 6, "090.000").when(i % 4 < 3, degrees(95)), "GPS:GPSLatitudeRef": F.when(i % 37 == 2, "X").when(i % 8 < 6, F.lit("N")).when(i % 8 == 7, "S"),
            "IFD0:Foo:Make": F.when(i % 53 == 7, F.lit("other")), "IFD0:Model": F.when(i % 2 == 1, F.concat("camera", F.lit(" II"))), "IFD0:Artist": F.when(i % 3 == 0, F.col("lens")), "IFD0:Rating": F.when(i % 9 == 2, "3.0").when(i % 9 == 4, "6"), "IFD0:Copyright": F.when(i % 7 == 3, F.lit("")), "XMP-dc:Subject": F.when(i % 6 == 1, F.lit("a;b")),
            "XMP-tiff:Orientation": F.when(i % 6 == 2, "+08").when(i % 41 == 3, "9"), "XMP-exif:GPSLatitude": F.when(i % 13 == 2, "-12.250").when(i % 13 == 3, "+7"), "XMP-exif:GPSAltitude": F.when(i % 13 == 4, "100/2").when(i % 47 == 5, "1/0"), "GPS:GPSAltitudeRef": F.when(i % 43 == 4, "2").when(i % 5 == 1, "0"), "XMP-dc:Rights-fr": F.when(i % 10 == 3, F.lit("tous")),
            "GPS:GPSLongitude": F.when(i % 4 < 3, degrees(185)), "GPS:GPSLongitudeRef": F.when(i % 4 < 3, F.lit("E")),
        }
        rows = self.photos.select(i.alias("photo_id"), F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in tags.items()])).alias("x"))
        return rows.select("photo_id", "x.tag", "x.value").filter("value is not null")

    @cached_property
    def ends(self) -> DataFrame:
        """op, kind, source_state, dest_state: what a check met at both ends of each operation that needs one."""
        pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
        rows = self.operations.filter(F.col("status").isin("Failed", "Pending"))
        source = F.when(F.col("status") == "Failed", pick(("match", "mismatch", "absent", "unreadable"), F.col("photo_id"))).otherwise(pick(("absent", "present", "present", "unreadable"), F.col("photo_id")))
        dest = F.when(F.col("status") == "Failed", pick(("match", "absent", "mismatch"), F.col("run_id"))).otherwise(pick(("match", "absent", "mismatch", "match", "absent"), F.col("run_id")))
        return rows.select("op", "status", "run_id", "photo_id", source.alias("source_state"), dest.alias("dest_state"))

    @cached_property
    def looks(self) -> DataFrame:
        """Recorded and seen hashes of delivered pictures: what was seen differs in as many bits as the id says."""
        other = F.expr("shiftleft(1L, cast(photo_id % 40 as int)) - 1L")
        rows = self.photos.filter(F.col("dest_path").isNotNull()).join(self.contents.filter("h62 is not null").select("sha1_hash", "h62"), "sha1_hash")
        return rows.select(F.col("id").alias("photo_id"), F.col("h62").alias("recorded")).withColumn("seen", F.col("recorded").bitwiseXOR(other))

    @cached_property
    def clashes(self) -> DataFrame:
        """name, folder: folders of names that several contents share; here a name is its last digits and type."""
        rows = self.photos.select(F.expr("right(name, 6)").alias("name"), F.regexp_extract("source_path", "^(.*)/[^/]*$", 1).alias("folder"), "sha1_hash")
        shared = rows.groupBy("name").agg(F.min("sha1_hash").alias("a"), F.max("sha1_hash").alias("b")).filter("a <> b").select("name")
        return rows.join(shared, "name", "left_semi").select("name", "folder").distinct()

    @cached_property
    def payloads(self) -> DataFrame:
        """event_id, text: payloads of events, some of them no JSON, or JSON that not every reader takes."""
        odd = ('{"a": NaN}', '{"a": [1, {"b": null}]}', "[1]", '{"a": ', '{"a": "Infinity"}', '{"NaN": "-Infinity \\" NaN"}', '{"a": -Infinity}', "", " {}")
        k = F.col("event_id") % 12
        return self.table("events").select("event_id", F.when(k < len(odd), F.element_at(F.array(*map(F.lit, odd)), (F.least(k, F.lit(len(odd) - 1)) + 1).cast("int"))).otherwise(F.col("props")).alias("text"))

    @cached_property
    def changes(self) -> DataFrame:
        """change_id, photo_id, before_sha1: contents that photos had before a change: those of photos one or two further, as chains and branches."""
        i = F.col("id")
        before = self.photos.select((i - 1).alias("photo_id"), F.col("sha1_hash").alias("before_sha1")).filter("photo_id % 7 in (0, 1, 4)").unionByName(self.photos.select((i - 2).alias("photo_id"), F.col("sha1_hash").alias("before_sha1")).filter("photo_id % 7 = 3"))
        return before.filter("photo_id >= 0").select((F.col("photo_id") * 10 + F.col("photo_id") % 7).alias("change_id"), "photo_id", "before_sha1")

    @cached_property
    def retained(self) -> DataFrame:
        """photo_id, version, state, linked: a retained sidecar of each photo; its fields are what the next photo's XMP says."""
        i = F.col("id")
        return self.photos.select(i.alias("photo_id"), F.sha2(F.concat("sha1_hash", F.lit("#xmp")), 256).alias("version"), F.when(i % 9 == 0, "needs_attention").otherwise("valid").alias("state"), (i % 5 != 0).alias("linked"))

    @cached_property
    def decisions(self) -> DataFrame:
        """decision_id, photo_id, kind, owners: saved choices."""
        kind = F.when(F.col("action") == "click", "association").otherwise("primary")
        return self.review_events.filter("action in ('click', 'view')").select(F.col("id").alias("decision_id"), "photo_id", kind.alias("kind"), self._owners(F.col("k") % 4).alias("owners"))

    @staticmethod
    def _owners(kind: Column) -> Column:
        return F.when(kind == 0, F.array(F.lit("a=1"), F.lit("b=2"))).when(kind == 1, F.array(F.lit("b=2"), F.lit("a=1"))).when(kind == 2, F.array(F.lit("a=1"))).otherwise(F.array(F.lit("a=2"), F.lit("b=1")))

    @cached_property
    def receipts(self) -> DataFrame:
        """event_id, photo_id, primary_revision, association_revision, highwater, owners: applied choices; older ones don't name their association."""
        before = Window.partitionBy("photo_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        last = lambda action: F.last(F.when(F.col("action") == action, F.col("id")), ignorenulls=True).over(before)
        rows = self.review_events.withColumn("view", last("view")).withColumn("click", last("click")).filter("action = 'purchase'")
        return rows.select(F.col("id").alias("event_id"), "photo_id", F.when(F.col("k") % 3 != 0, F.col("view")).alias("primary_revision"), F.when(F.col("k") % 5 == 0, F.col("click")).alias("association_revision"), F.when(F.col("k") % 7 == 0, F.col("click") - 1).otherwise(F.col("id")).alias("highwater"), self._owners(F.col("k") % 3).alias("owners"))

    @cached_property
    def scans(self) -> DataFrame:
        """run_id, root, scanned_at, status, targeted, every_type, issues: index runs, each of the source or of a folder below it."""
        i = F.col("id")
        of = self.photos.select(i.alias("target"), F.col("source_path"))
        depth = (F.col("run_id") % 3 + 2).cast("int")
        rows = self.runs.filter("mode = 'INDEX'").select(i.alias("run_id"), "status", F.col("started_at").alias("scanned_at"), "target").join(of, "target")
        return rows.select("run_id", F.array_join(F.slice(F.split("source_path", "/"), F.lit(1), depth), "/").alias("root"), "scanned_at", "status", (F.col("run_id") % 5 == 0).alias("targeted"), (F.col("run_id") % 7 != 0).alias("every_type"), (F.col("run_id") % 4 == 0).alias("issues"))

    @cached_property
    def gone_files(self) -> DataFrame:
        """path, folder, found_path, found_in: members of folders that are gone, some of which lie elsewhere now."""
        i = F.col("id")
        shelf = F.concat(F.lit("/dst/library/"), "camera", F.lit("/"), (F.floor(i / 40) % 9).cast("string"))
        inner = F.concat(F.when(i % 3 == 0, "sub/").otherwise(""), "name")
        lost = (F.floor(i / 40) % 4 == 1) & (i % 40 == 7)
        other = (F.floor(i / 40) % 4 == 2) & (i % 40 == 9)
        found = F.when(lost, None).when(other, F.concat(F.lit("/dst/library/else/"), "name")).otherwise(F.concat(F.lit("/dst/library/new/"), "camera", F.lit("-"), (F.floor(i / 40) % 9).cast("string"), F.lit("/"), inner))
        return self.photos.select(F.concat(shelf, F.lit("/"), inner).alias("path"), shelf.alias("folder"), found.alias("found_path"), F.when(found.isNotNull(), F.when(i % 101 == 100, "rejects").otherwise("library")).alias("found_in"))

    @cached_property
    def arrivals(self) -> DataFrame:
        """Rows as a scan hands them to the writer: some without content or path, with a control character, or empty."""
        i = F.col("id")
        path = F.when(i % 41 == 0, None).when(i % 43 == 0, F.lit("")).when(i % 47 == 0, F.concat("source_path", F.lit("\n"))).otherwise(F.col("source_path"))
        return self.photos.select(i, F.when(i % 37 != 0, F.col("sha1_hash")).alias("sha1_hash"), path.alias("source_path"), F.when(i % 53 == 0, 0).otherwise(F.col("file_size")).cast("bigint").alias("file_size"))

    @cached_property
    def recorded(self) -> DataFrame:
        return self.photos.select(F.col("source_path").alias("path"), F.col("file_size").alias("size"), (F.col("id") * 1.5).alias("mtime"), "status")

    @cached_property
    def candidates(self) -> DataFrame:
        """What a walk of the source finds: some files newer, some of another size, some times off by a rounding."""
        i = F.col("id")
        moved = F.when(i % 7 == 0, F.lit(1.0)).when(i % 3 == 0, F.lit(0.0000004)).otherwise(F.lit(0.0))
        return self.photos.select(F.col("source_path").alias("path"), (F.col("file_size") + F.when(i % 11 == 0, 1).otherwise(0)).alias("size"), (i * 1.5 + moved).alias("mtime"))

    @cached_property
    def inventory(self) -> DataFrame:
        """folder, name of every photo in the source; some have a raw twin of the same stem."""
        rows = self.photos.select("id", F.regexp_extract("source_path", "^(.*)/[^/]*$", 1).alias("folder"), "name")
        twins = rows.filter("id % 3 = 0 and not name like '%.cr2'").select("id", "folder", F.regexp_replace("name", r"\.[^.]*$", ".cr2").alias("name"))
        return rows.union(twins).drop("id")

    @cached_property
    def sidecars(self) -> DataFrame:
        """id, folder, base (the sidecar's name without .xmp), owner_name, state of one sidecar a photo."""
        i, stem = F.col("id"), F.regexp_extract("name", r"^(.+)\.[^.]+$", 1)
        base = F.when(i % 11 == 0, F.concat(F.lit("none-"), i.cast("string"))).when(i % 5 == 0, F.col("name")).otherwise(stem)
        owner = F.when(i % 14 == 7, F.lit("other.jpg")).when(i % 7 == 0, F.col("name"))
        state = F.when(i % 17 == 0, "not_xmp").when(i % 13 == 0, "needs_attention").otherwise("valid")
        return self.photos.select(i, F.regexp_extract("source_path", "^(.*)/[^/]*$", 1).alias("folder"), base.alias("base"), owner.alias("owner_name"), state.alias("state"))
