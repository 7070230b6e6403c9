"""Review decisions, cleared reviews, the log's search and closures against hand-known answers."""

from __future__ import annotations

import pytest

from catalith.operators import lineage, predicates, review

REQUEST = "id long, request_id string, photo_id long, sha1 string, revision long, reason string, action string, note string, bookmark string, date_taken string"
PHOTO = "id long, sha1_hash string, status string, date_taken string"


def state(spark):
    photos = spark.createDataFrame([(1, "a", "Copied", "0001-01-01"), (2, "b", "Completed", "2020-01-01"), (3, "c", "Pending", "0001-01-01")], PHOTO)
    contents = spark.createDataFrame([("a", 640, 480), ("b", 2400, 1600), ("c", 10, 10)], "sha1_hash string, width int, height int")
    events = spark.createDataFrame([(1, 2, "click", 4), (3, 2, "click", 3)], "id long, photo_id long, action string, k int")
    issues = spark.createDataFrame([], "photo_id long, category string, resolved boolean")
    return photos, contents, events, issues


DECISIONS = [
    ((10, "r1", 1, "a", 0, "small", "reviewed", "", None, None), "saved"), ((20, "r1", 1, "a", 0, "small", "reviewed", "", None, None), "replayed"), ((30, "r1", 1, "a", 0, "date", "correct", "", None, "0001-01-01"), "request_conflict"),
    ((40, "r2", 1, "a", 0, "date", "correct", "", None, "0001-01-01"), "changed"),  # the first decision raised the revision
    ((50, "r3", 1, "x", 0, "small", "reviewed", "", None, None), "changed"), ((60, "r4", 1, "a", 5, "small", "reviewed", "", None, None), "changed"), ((70, "r5", 1, "a", 0, "small", "later", "", None, None), "invalid"), ((80, "r6", 1, "a", 0, "later", "later", "n" * 61, "date", None), "invalid"),
    ((90, "r7", 1, "a", 0, "small", "reviewed", "a note", None, None), "invalid"), ((100, "r8", 1, "a", 0, "date", "correct", "", None, None), "invalid"), ((110, "r9", 1, "a", 0, "small", "reviewed", "", "keep", None), "invalid"), ((120, "r10", 1, "a", 0, "date", "correct", "", None, "0002"), "date_changed"),
    ((130, "r11", 3, "c", 0, "small", "reviewed", "", None, None), "not_in_library"), ((140, "r12", 2, "b", 2, "small", "reviewed", "", None, None), "not_current"), ((150, "r13", 2, "b", 2, "later", "keep", "", "date", None), "not_a_keep"), ((160, "r14", 2, "b", 2, "later", "done", "", "date", None), "saved"),
]


def test_decisions_by_the_state_before_them(spark):
    requests = spark.createDataFrame([r for r, _ in DECISIONS], REQUEST)
    got = {r["request"]: r["outcome"] for r in review.review_decide(requests, *state(spark)).collect()}
    assert got == {r[0]: outcome for r, outcome in DECISIONS}


def test_what_clears_a_review(spark):
    c, p = "Copied", "Pending"
    updates = [
        (1, c, c, "1700-01-01", "2000-01-01", 2500, 2500), (2, c, c, "1700-01-01", "1650-01-01", 2500, 2500), (3, p, c, "1700-01-01", "2000-01-01", 2500, 2500), (4, c, c, "2010-01-01", "2010-01-01", 480, 2500), (5, c, c, "2010-01-01", "2010-01-01", 480, 600),
        (6, c, c, "2010-01-01", "1950-01-01", 2500, 2500), (7, c, c, "2010-01-01", "2026-01-01", 2500, 2500), (8, c, c, "2010-01-01", "2010-01-01", 2500, 1500), (9, c, p, "1700-01-01", "1950-01-01", 480, 1500), (10, c, c, "1700-01-01", "2000-01-01", 480, 2500),
    ]
    rows = spark.createDataFrame(updates, "id long, old_status string, new_status string, old_date string, new_date string, old_side int, new_side int")
    confirmed = spark.createDataFrame([(10, "1700-01-01"), (6, "1950-01-01")], "photo_id long, date_taken string")
    seen = spark.createDataFrame([(10, "view"), (1, "click")], "photo_id long, action string")
    got = sorted((r["id"], r["cleared"]) for r in review.cleared_reviews(rows, confirmed, seen).collect())
    assert got == [(1, "date:date_changed"), (4, "small:dimensions_changed"), (7, "date:calendar_year_changed"), (8, "small:size_rule_changed")]


def test_one_text_over_paths_and_message(spark):
    log = [
        (1, "Copied", "original kept", None, "/src/a%b", None), (2, "Copied", None, "no A%B here", "/x", None), (3, "Failed", None, None, "/x", "/dst/a%B"), (4, "Failed", None, "aXb", "/x", None), (5, "Skipped", None, "a%b", "/x", None), (6, "Failed", None, "a%b", None, None),
    ]
    rows = spark.createDataFrame([(str(i), i, i, *r) for i, *r in log], "op string, run_id long, photo_id long, status string, note string, message string, source_path string, dest_path string")
    got = {(r["op"], r["shown"]) for r in predicates.oplog_filtered(rows, ("Failed", "Copied", "Copied_Only"), "a%b").collect()}
    assert got == {("1", "Copied_Only"), ("2", "Copied"), ("3", "Failed"), ("6", "Failed")}


def test_closure_follows_consolidations_both_ways(spark):
    origins = spark.createDataFrame([(2, 1), (3, 2), (11, 10), (12, 11), (21, 20)], "file_id long, origin_file_id long")
    joined = spark.createDataFrame([(100, 3), (100, 11), (101, 50), (101, 51)], "op long, file_id long")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(lineage.closure(origins, 1, joined)) == [1, 2, 3, 11, 12]
    assert ids(lineage.closure(origins, 11, joined)) == [3, 11, 12]
    assert ids(lineage.closure(origins, spark.createDataFrame([(20,), (50,)], "id long"), joined)) == [20, 21, 50, 51]


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="its own origin"):
        lineage.roots(spark.createDataFrame([(1, 2), (2, 1)], "file_id long, origin_file_id long"), rounds=4)


def test_destinations_skip_taken_names_and_find_themselves(spark):
    from catalith.plans import transfer

    wanted = spark.createDataFrame([(1, "new1"), (2, "a"), (3, "c"), (4, "new2"), (5, "new3"), (6, "e")], "id long, sha1_hash string").selectExpr("id", "'/d' as folder", "'x_y' as stem", "'.jpg' as ext", "sha1_hash")
    taken = [("/d/x_y.jpg", "a"), ("/d/x_y_1.jpg", "b"), ("/d/x_y_2.jpg", "c"), ("/d/x_y_4.jpg", "d"), ("/d/x_y_5.jpg", "e"), ("/d/x_y.png", "z"), ("/other/x_y_3.jpg", "z"), ("/d/x_y_03.jpg", "q")]
    got = {r["id"]: (r["target"], r["already"]) for r in transfer.resolved_destinations(wanted, spark.createDataFrame(taken, "path string, sha1_hash string")).collect()}
    # e lies beyond the first free name, 3, so it is not met
    assert got == {1: ("/d/x_y_3.jpg", False), 2: ("/d/x_y.jpg", True), 3: ("/d/x_y_2.jpg", True), 4: ("/d/x_y_6.jpg", False), 5: ("/d/x_y_7.jpg", False), 6: ("/d/x_y_8.jpg", False)}
