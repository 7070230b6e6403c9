"""Version graph, decision history, coverage and moved folders against hand-known answers."""

from __future__ import annotations

from catalith.operators import versions


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def graph(spark, photos, changes, answers=()):
    return (
        spark.createDataFrame(photos, "id long, sha1_hash string, status string"), spark.createDataFrame(changes, "change_id long, photo_id long, before_sha1 string"), spark.createDataFrame(list(answers), "id long, photo_id long, answer string")
    )


def test_chain_of_three_and_branches(spark):
    """a became b became c; x and y both were s before; z is still in use, so it is no earlier version."""
    photos = [(1, "a", "Pending"), (2, "b", "Pending"), (3, "c", "Copied"), (4, "s", "Pending"), (5, "x", "Copied"), (6, "y", "Copied"), (7, "z", "Pending"), (8, "z", "Copied"), (9, "s", "Duplicate")]
    changes = [(10, 2, "a"), (11, 3, "b"), (12, 5, "s"), (13, 6, "s"), (14, 3, "z"), (15, 3, "a"), (16, 3, "c")]
    p, c, a = graph(spark, photos, changes, [(1, 1, "kept"), (2, 1, "not_kept")])
    assert rows(versions.version_links(p, c), "photo_id", "version_of", "change_id") == [(1, 3, 15), (2, 3, 11), (4, 6, 13), (9, 6, 13)]
    got = rows(versions.version_badges(p, c, a), "photo_id", "version_of", "state", "earlier_versions", "waiting")
    assert got == sorted([(1, 3, "not_kept", 0, 0), (2, 3, "waiting", 0, 0), (3, None, None, 2, 1), (4, 6, "waiting", 0, 0), (6, None, None, 1, 1), (9, 6, "waiting", 0, 0)], key=str)


def test_the_newest_change_of_the_photo_itself_does_not_hide_another(spark):
    p, c, _ = graph(spark, [(1, "a", "Pending"), (2, "b", "Pending")], [(10, 2, "a"), (11, 1, "a")])
    assert rows(versions.version_links(p, c), "photo_id", "version_of") == [(1, 2)]


def test_a_choice_used_twice_and_one_never_used(spark):
    d = spark.createDataFrame([(1, 7, "association", ["a=1", "b=2"]), (2, 7, "primary", ["a=1"]), (3, 7, "association", ["a=2"]), (4, 8, "primary", [])], "decision_id long, photo_id long, kind string, owners array<string>")
    receipts = [
        (10, 7, 2, None, 2, ["b=2", "a=1"]),  # its association is the last up to 2: choice 1, owners equal as sets
        (11, 7, 2, 1, 99, ["a=1", "b=2", "a=1"]),  # names choice 1
        (12, 7, None, None, 99, ["a=1"]),  # the last is choice 3, of other owners
        (13, 7, 4, None, 0, ["a=1"]),  # names a choice of another photo; nothing up to 0
    ]
    r = spark.createDataFrame(receipts, "event_id long, photo_id long, primary_revision long, association_revision long, highwater long, owners array<string>")
    assert rows(versions.decision_uses(d, r), "decision_id", "uses", "first_use") == sorted([(1, 2, 10), (2, 2, 10), (3, 0, None), (4, 0, None)], key=str)
    assert rows(versions.applied_choices(d, r), "event_id", "used") == [(10, 2), (11, 2)]


def test_folders_inherit_from_the_nearest_root(spark):
    photos = spark.createDataFrame([("/src/a/b/1",), ("/src/a/b/c/2",), ("/src/ab/3",), ("/other/4",)], "source_path string")
    scans = [
        (1, "/src", "t1", "Completed", False, True, False), (2, "/src/a", "t2", "Completed", False, True, False), (3, "/src/a/b", "t3", "Completed", False, True, True), (4, "/src/a", "t4", "Running", False, True, False),
        (5, "/src/a", "t5", "Completed", True, True, False), (6, "/src/a", "t6", "Completed", False, False, True), (7, "/src/a", "t7", "Cancelled", False, True, True),
    ]
    s = spark.createDataFrame(scans, "run_id long, root string, scanned_at string, status string, targeted boolean, every_type boolean, issues boolean")
    got = rows(versions.scan_coverage(photos, s), "folder", "root", "run_id", "issues_since")
    assert got == sorted([("/src/a/b", "/src/a", 2, 2), ("/src/a/b/c", "/src/a", 2, 2), ("/src/ab", "/src", 1, 0), ("/other", None, None, 0)], key=str)


def test_one_member_elsewhere_and_the_folder_has_not_moved(spark):
    found = {
        "whole": [("1", "/n/whole/1", "library"), ("s/2", "/n/whole/s/2", "library")], "lost": [("1", "/n/l/1", "library"), ("2", None, None)], "flat": [("1", "/n/f/1", "library"), ("s/2", "/n/f/2", "library")],
        "split": [("1", "/n/x/1", "library"), ("2", "/n/y/2", "library")], "rejects": [("1", "/r/1", "library"), ("2", "/r/2", "rejects")], "renamed": [("1", "/n/q/one", "library")],
    }
    files = spark.createDataFrame([(f"/lib/{f}/{inner}", f"/lib/{f}", path, where) for f, members in found.items() for inner, path, where in members], "path string, folder string, found_path string, found_in string")
    got = {r["folder"]: (r["photos"], r["lost"], r["moved_to"]) for r in versions.moved_folders(files).collect()}
    assert got == {"/lib/whole": (2, 0, "/n/whole"), "/lib/lost": (2, 1, None), "/lib/flat": (2, 0, None), "/lib/split": (2, 0, None), "/lib/rejects": (2, 0, None), "/lib/renamed": (1, 0, None)}


def test_activation_of_a_retained_version(spark):
    tags = spark.createDataFrame([(1, "IFD0:Make", "a"), (1, "XMP-xmp:Rating", "3"), (2, "XMP-tiff:Make", "b"), (2, "XMP-xmp:Rating", "3"), (2, "XMP-exif:DateTimeOriginal", "2020:01:02"), (4, "XMP-xmp:Rating", "1"), (6, "XMP-xmp:Rating", "1")], "photo_id long, tag string, value string")
    held = spark.createDataFrame([(1, "v1", "valid", True), (3, "v3", "needs_attention", True), (5, "v5", "valid", False), (9, "v9", "valid", True)], "photo_id long, version string, state string, linked boolean")
    assert rows(versions.activation_changes(held, tags), "photo_id", "field", "before", "after", "previous_source") == sorted([(1, "camera_make", "a", "b", "exif"), (1, "date_taken", None, "2020-01-02", None)], key=str)
    got = rows(versions.activation_plan(held, tags), "photo_id", "verdict", "changes", "folder")
    assert got == sorted([(1, "activate", 2, "2020/01/02"), (3, "unreadable", 0, None), (5, "no_confirmed_association", 0, None), (9, "unchanged", 0, None)], key=str)
