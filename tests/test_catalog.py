"""Hand-known answers for the catalog operators."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith import schema
from catalith.functions import numbering
from catalith.functions import paths as X
from catalith.functions import similarity as shared
from catalith.operators import checks, duplicates, gallery, lineage, metadata, oplog, predicates, records, similarity
from catalith.plans import similarity_index
from catalith.streaming import incremental


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.JPG",), ("/a/.hidden",), ("/a/x.tar.gz",), ("/a/trail.",), ("plain",), ("",), (None,)], "p string")
    got = [tuple(r) for r in rows.select(X.basename(F.col("p")).alias("b"), X.extension(F.col("p")).alias("e"), X.stem(F.col("p")).alias("s")).collect()]
    assert got == [("b.JPG", "jpg", "b"), (".hidden", "hidden", ".hidden"), ("x.tar.gz", "gz", "x.tar"), ("trail.", "", "trail."), ("plain", "", "plain"), (None, None, None), (None, None, None)]


def test_suspicious_boundaries(spark):
    dates = ["0001-01-01", "2218-01-01", "1799-12-31", "1800-01-01", "2027-12-31", "2028-01-01", None, "1900-01-01"]
    rows = spark.createDataFrame([(i, d, "Copied") for i, d in enumerate(dates)], "id int, d string, s string")
    got = [r[0] for r in rows.orderBy("id").select(X.suspicious(F.col("d"), F.col("s"))).collect()]
    assert got == [True, True, True, False, False, True, False, False]


def test_threshold_distances_and_score(spark):
    got = [r[0] for r in spark.createDataFrame([(75,), (80,), (85,), (90,), (95,), (100,)], "t int").select(X.distance_for(F.col("t"))).collect()]
    assert got == [16, 12, 9, 6, 3, 0]
    assert spark.createDataFrame([(2,), (6,)], "d int").select(X.score(F.col("d"))).collect() == [(96.88,), (90.62,)]


def test_search_treats_wildcards_literally(spark):
    photos = spark.createDataFrame([(1, "trip_%", "a"), (2, "trip_XX", "b"), (3, "TRIP_%1", "c"), (4, "other", "a")], "id long, name string, sha1_hash string")
    assert ids(gallery.search_name(photos, term="trip_%")) == [1, 3, 4]


def brute(hashes, most):
    return sorted((int(a), int(b), bin(int(a) ^ int(b)).count("1")) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if bin(int(a) ^ int(b)).count("1") <= most)


def frame(spark, hashes):
    return spark.createDataFrame([(h,) for h in hashes], "h long")


def mutated(rng, n, most):
    """Random hashes, and of each one another a few bits away."""
    base = rng.integers(0, 1 << 62, n)
    return sorted({*map(int, base), *(int(b) ^ sum(1 << int(k) for k in rng.choice(62, m, replace=False)) for b, m in zip(base, rng.integers(1, most, n), strict=True))})


@pytest.mark.parametrize("most", [3, 6])
def test_near_pairs_equal_brute_force(spark, most):
    hashes = mutated(np.random.default_rng(73), 60, 9)
    got = similarity.near_pairs(frame(spark, hashes).withColumnRenamed("h", "a"), frame(spark, hashes).withColumnRenamed("h", "b"), 62, most).filter("a < b")
    assert sorted(map(tuple, got.collect())) == brute(hashes, most)


@pytest.mark.parametrize("tile", [7, 40, 4096])
def test_tiled_pairs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity_index, "TILE", tile)
    rng = np.random.default_rng(5)
    hashes = sorted({*mutated(rng, 40, 22), *(int(x) for x in rng.integers(0, 1 << 30, 40)), 0, (1 << 62) - 1})
    assert sorted(map(tuple, similarity_index.all_pairs(frame(spark, hashes), 16).collect())) == brute(hashes, 16)
    assert similarity_index.all_pairs(frame(spark, []), 16).count() == 0


def test_tiles_of_far_apart_bit_counts_never_meet(spark):
    """A third each of few, middling and many set bits: two thirds of the pairs are not compared."""
    rng = random.Random(3)
    hashes = [sum(1 << k for k in rng.sample(range(62), n)) for n in (4, 31, 58) for _ in range(300)]
    tiles = similarity_index.Tiles(frame(spark, sorted(set(hashes))))
    assert similarity_index.planned(tiles, None, 16) < 0.4 * len(hashes) ** 2 / 2
    assert sorted(map(tuple, similarity_index.pairs_of(tiles, None, 16).collect())) == brute(sorted(set(hashes)), 16)


def test_index_compares_only_what_is_new_and_appends_once(spark, tmp_path):
    hashes = mutated(np.random.default_rng(9), 200, 18)
    index, new = similarity_index.SimilarityIndex(spark, f"{tmp_path}/index"), hashes[::100]
    old = [h for h in hashes if h not in new]
    assert index.batches() == [] and index.edges().count() == 0 and index.pending(frame(spark, hashes)).count() == len(hashes)
    assert index.step(frame(spark, old))[0] == len(old)
    assert sorted(tuple(r)[:3] for r in index.edges().collect()) == brute(old, 16)

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # dies after its edges, before its markers
        index.step(frame(spark, hashes), before_markers=die)
    assert index.pending(frame(spark, hashes)).count() == len(new) and sorted(tuple(r)[:3] for r in index.edges().collect()) == brute(old, 16)
    again = similarity_index.SimilarityIndex(spark, f"{tmp_path}/index")
    n, compared = again.step(frame(spark, hashes))
    assert n == len(new) and compared <= len(new) * (len(old) + len(new))
    assert sorted(tuple(r)[:3] for r in again.edges().collect()) == brute(hashes, 16)
    assert again.step(frame(spark, hashes)) == (0, 0) and again.batches() == [0, 1]
    assert sorted(r["h"] for r in again.markers().collect()) == hashes and {r["h"] for r in again.markers().filter("batch = 1").collect()} == set(new)


@pytest.mark.parametrize("most", [0, 3, 6, 9, 12, 16])
def test_edges_within_read_their_bands_only(spark, tmp_path, most):
    index = similarity_index.SimilarityIndex(spark, f"{tmp_path}/index")
    hashes = mutated(np.random.default_rng(4), 100, 18)
    index.step(frame(spark, hashes))
    near = similarity_index.within(index.edges(), most)
    assert sorted(tuple(r)[:3] for r in near.collect()) == brute(hashes, most)
    assert "PartitionFilters: [isnotnull(band" in near._jdf.queryExecution().toString()


def library(spark, hashes):
    photos = spark.createDataFrame([(i, f"s{i}", "Copied") for i in range(len(hashes))], "id long, sha1_hash string, status string")
    contents = spark.createDataFrame([(i, f"s{i}", h, 100.0, 20.0) for i, h in enumerate(hashes)], "content_id long, sha1_hash string, h62 long, mean_brightness double, mean_gradient double")
    return photos, contents


def looks(spark, hashes):
    """available, buckets, edges and cached counts of a library."""
    photos, contents = library(spark, hashes)
    avail = shared.available(photos, contents).cache()
    sizes = shared.buckets(avail)
    edges = similarity_index.all_pairs(shared.hashes(contents), 16).withColumn("band", similarity_index.band(F.col("distance"))).cache()
    return avail, sizes, edges, shared.count_matches(avail, sizes, edges)


def test_equal_hashes_are_counted_not_joined(spark):
    avail, sizes, edges, counts = looks(spark, [7] * 200)
    assert {r["matches"] for r in similarity.match_counts(counts).collect()} == {199}
    assert similarity.neighbourhood_sets(avail, sizes, edges).collect()[0][0:2] == (0, 200)
    assert edges.count() == 0


def test_all_six_thresholds_are_counted(spark):
    values = [0, 0, 0x7, 0x3F, 0x1FF, 0xFFF, 0xFFFF, 0x1FFFF]
    _, contents = library(spark, values)
    _, _, edges, counts = looks(spark, values)
    got = {r["photo_id"]: tuple(r)[1:] for r in similarity.threshold_counts(counts).collect()}
    assert got[0] == (6, 5, 4, 3, 2, 1)  # at 75, 80, 85, 90, 95, 100; the last is 17 bits away
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "vec_id long, label int")
    rows = {r["threshold"]: (r["found"], r["truth"]) for r in records.validation_by_threshold(contents, labels, edges).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(range(8), 2) if values[a] != values[b]]
    truth = sum((a - b) % 2 == 0 for a, b in pairs)
    assert rows == {t: (sum((values[a] ^ values[b]).bit_count() <= d for a, b in pairs), truth) for t, d in schema.THRESHOLDS.items()}


def test_no_id_is_left_out(spark):
    log = spark.createDataFrame([(1, "Failed"), (1000, "Failed"), (5000, "Copied")], "run_id long, status string")
    assert {tuple(r) for r in oplog.oplog_status_facets(log).collect()} == {("Failed", 2), ("Copied", 1)}
    rows = [(1, "Copied", "/dst/1", "s1", "/src/a/x/1"), (2, "Copied", "/dst/2", "s2", "/src/a/y/2"), (3, "Copied", "/dst/3", "s3", "/src/b/x/3"), (4, "Pending", None, "s4", "/src/a/y/4")]
    photos = spark.createDataFrame(rows, "id long, status string, dest_path string, sha1_hash string, source_path string")
    observed = spark.createDataFrame([("/dst/2", "s2"), ("/dst/moved/1", "s1")], "path string, sha1_hash string")
    assert {tuple(r) for r in checks.vanished(photos, observed).collect()} == {(1, "Found_At_Destination"), (3, "Failed")}
    assert {tuple(r) for r in checks.gone_folder(photos, observed).collect()} == {(1, "/src/a/x"), (3, "/src/b")}
    cars = spark.createDataFrame([(i, "Copied", "n.cr2" if i == 5 else "n.jpg", "c", "l") for i in (4, 5, 10)], "id long, status string, name string, camera string, lens string")
    assert {tuple(r) for r in metadata.sidecar_association(cars).collect()} == {(4, "policy", 2), (5, "policy", 2), (10, "single", 1)}


def test_sets_are_relative_to_their_reference(spark):
    avail, _, _, counts = looks(spark, [0, 0x3F, 0xFFF, 0x3FFFF])
    assert ids(similarity.reference_set(avail), "member") == [0, 1]
    assert sorted(r["matches"] for r in similarity.match_counts(counts).collect()) == [1, 1, 2, 2]


def test_normalize_duplicates(spark):
    rows = [(1, "a", "Pending"), (2, "a", "Duplicate"), (3, "b", "Duplicate"), (4, "b", "Duplicate"), (5, "c", "Completed"), (6, "c", "Pending"), (7, "d", "Failed"), (8, "a", "Pending")]
    got = {r["id"]: r["new_status"] for r in duplicates.normalize_duplicates(spark.createDataFrame(rows, "id long, sha1_hash string, status string")).collect()}
    assert got == {1: "Pending", 2: "Duplicate", 3: "Pending", 4: "Duplicate", 5: "Completed", 6: "Duplicate", 8: "Duplicate"}


def test_rows_without_content_are_kept(spark):
    """A null hash is a content that is not known: rows that carry it are listed, and are no copies of each other by search."""
    photos = spark.createDataFrame([(1, "trip.jpg", None, "Pending"), (2, "other.jpg", None, "Pending"), (3, "trip.png", "a", "Copied"), (4, "x.png", "a", "Duplicate")], "id long, name string, sha1_hash string, status string")
    assert ids(gallery.search_name(photos, term="trip")) == [1, 3, 4]
    assert ids(duplicates.normalize_duplicates(photos)) == [1, 2, 3, 4]
    assert ids(duplicates.insert_time_duplicates(photos)) == [1, 2, 3, 4]
    contents = spark.createDataFrame([(3, "a", 7, 100, 100)], "content_id long, sha1_hash string, h62 long, width int, height int")
    operations = spark.createDataFrame([(1, "Copied")], "photo_id long, status string")
    got = {r["id"]: (r["width"], r["copies"], r["operations"]) for r in gallery.inspect_photo(photos, contents, operations).collect()}
    assert got == {1: (None, 0, 1), 2: (None, 0, 0), 3: (100, 1, 0), 4: (100, 1, 0)}
    assert ids(gallery.size_below(photos, contents)) == [3, 4]
    assert sorted(tuple(r) for r in predicates.sort_duplicates(photos).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_numbers_in_groups_do_not_depend_on_ranges(spark):
    rows = spark.createDataFrame([(i * 3 % 101, "ab"[i % 3 == 0]) for i in range(100)], "id long, g string")
    got = {(r["g"], r["id"]): r["k"] for r in numbering.numbered(rows, ["g"], width=7).collect()}
    for g in "ab":
        assert [got[g, i] for i in sorted(i for h, i in got if h == g)] == list(range(1, sum(h == g for h, _ in got) + 1))


def test_closure_of_a_deep_forest(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MOST_LEVELS", 3)
    origins = spark.createDataFrame([(i, i - 1) for i in range(1, 12)] + [(50, 3), (60, 50), (99, 98)], "file_id long, origin_file_id long")
    assert ids(lineage.closure(origins, 2)) == [*range(2, 12), 50, 60]


def test_names_offered_by_other_rows(spark):
    rows = [(1, "a", "/s/one.jpg", "Completed"), (2, "a", "/s/two.jpg", "Duplicate"), (3, "b", "/s/only.jpg", "Completed"), (4, "c", "/s/x.jpg", "Completed"), (5, "c", "/t/x.png", "Duplicate"), (6, "d", "/s/y.jpg", "Completed"), (7, "d", "/s/z.jpg", "Completed")]
    photos = spark.createDataFrame(rows, "id long, sha1_hash string, source_path string, status string")
    assert {tuple(r) for r in records.relocate_candidates(photos).collect()} == {("a", "two"), ("c", "x"), ("d", "y"), ("d", "z")}


def test_roots_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 70)] + [(201, 200)], "file_id long, origin_file_id long")
    got = {r["file_id"]: (r["root"], r["depth"]) for r in lineage.roots(chain).collect()}
    assert got == {**{i: (0, i) for i in range(1, 70)}, 201: (200, 1)}


def test_empty_value_suppresses_fallback(spark):
    tags = spark.createDataFrame([(1, 9, "purchase", "title", ""), (2, 9, "click", "title", "x"), (3, 9, "click", "place", "y")], "id long, photo_id long, source string, field string, value string")
    got = {r["field"]: (r["value"], r["source"]) for r in metadata.resolve_priority(tags).collect()}
    assert got == {"title": ("", "purchase"), "place": ("y", "click")}


def test_incremental_index_reads_each_file_once(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.parquet(source)
    incremental.index_available(spark, source, schema, target, check)
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    incremental.index_available(spark, source, schema, target, check)
    incremental.index_available(spark, source, schema, target, check)
    assert sorted(r["first_id"] for r in spark.read.parquet(target).collect()) == [1, 2, 5]
