"""Look-alikes without stored pairs: what is folded where tiles meet, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from catalith import registry, schema
from catalith.functions import similarity as shared
from catalith.operators import records, similarity
from catalith.plans import similarity_index
from catalith.sources import catalog, stored

SF_DIR = "/root/testdata/sf0.001"
#: Queries that must not make the index, whose stored pairs grew with the square of the table.
WITHOUT_INDEX = [
    "similar_gallery_ranked", "comparison_state", "facet_sizes", "pair_compare", "validation_by_threshold", "count_cache", "hamming_pairs_le6", "largest_match",
    "match_counts", "match_queue_largest", "match_queue_name", "match_queue_newest", "match_queue_oldest", "match_queue_similar", "matched_photo_ids", "neighbourhood_sets",
    "similarity_diagnostics", "six_threshold_counts", "view_members", "hamming_pairs_le16",
]


@pytest.mark.parametrize("name", WITHOUT_INDEX)
def test_query_stores_no_pairs(spark, monkeypatch, name):
    def step(self, *rows):
        raise AssertionError("the index was made")

    monkeypatch.setattr(stored, "_written", {})
    monkeypatch.setattr(catalog, "_indexes", {})
    monkeypatch.setattr(similarity_index.SimilarityIndex, "step", step)
    registry.queries()[name](spark, SF_DIR).collect()


def crowd(n=90):
    """Hashes around a few centres, some of them equal, and the ends of the range."""
    rng = np.random.default_rng(11)
    centres = [int(x) for x in rng.integers(0, 1 << 62, 4)]
    moved = [centres[k % 4] ^ sum(1 << int(b) for b in rng.choice(62, k % 10, replace=False)) for k in range(n)]
    return [*moved, *moved[:9], *moved[:5], moved[0], 0, (1 << 62) - 1]


def library(spark, values):
    photos = spark.createDataFrame([(i + 1000, f"s{i}", "Copied") for i in range(len(values))], "id long, sha1_hash string, status string")
    contents = spark.createDataFrame([(i, f"s{i}", h, 10 + i * 7 % 5, 3, 100.0, 20.0) for i, h in enumerate(values)], "content_id long, sha1_hash string, h62 long, width int, height int, mean_brightness double, mean_gradient double")
    avail = shared.available(photos, contents).cache()
    return avail, contents, shared.buckets(avail)


def apart(a, b):
    return (a ^ b).bit_count()


@pytest.mark.parametrize("tile", [5, 40, 16384])
def test_matches_are_counted_where_tiles_meet(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity_index, "SIDE", tile)
    monkeypatch.setattr(similarity_index, "TASK", 900)
    values = crowd()
    avail, _, sizes = library(spark, values)
    got = {r["photo_id"] - 1000: tuple(r)[1:] for r in shared.count_matches(avail, sizes).collect()}
    assert got == {i: tuple(sum(apart(a, b) <= d for b in values) - 1 for d in schema.THRESHOLDS.values()) for i, a in enumerate(values)}
    assert shared.count_matches(avail.limit(0), sizes.limit(0)).count() == 0


def test_sums_of_many_near_hashes_are_exact():
    """More hashes than a byte counts, and sizes of many bits."""
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 11, n)) for n in (700, 1500))
    n = rng.integers(1, 1 << 40, len(b))
    want = [[sum(int(w) for y, w in zip(b, n, strict=True) if 0 < apart(int(x), int(y)) <= most) for x in a[:40]] for most in (16, 4)]
    assert similarity_index.near_sums(a, b, n, [16, 4])[:, :40].tolist() == want


def test_pairs_leave_a_task_in_small_batches():
    """A crowd of near hashes is not made one batch: what is held at once doesn't grow with its pairs."""
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 9000))
    sizes = [len(i) for i, _, _ in similarity_index.near(h, h, 16)]
    assert sum(sizes) == len(h) ** 2 and max(sizes) <= similarity_index.AT_ONCE


@pytest.fixture(params=[5, 40, 16384])
def tiled(request, monkeypatch):
    monkeypatch.setattr(similarity_index, "SIDE", request.param)
    monkeypatch.setattr(similarity_index, "TASK", 900)


def test_labels_of_near_pairs(spark, tiled):
    values = crowd()
    _, contents, _ = library(spark, values)
    label = lambda i: None if i % 11 == 4 else i * i % 3
    labels = spark.createDataFrame([(i, label(i)) for i in range(len(values))], "vec_id long, label int")
    pairs = [(apart(a, b), label(i) is not None and label(i) == label(j)) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and a != b]
    got = {r["threshold"]: tuple(r)[1:] for r in records.validation_by_threshold(contents, labels).select("threshold", "found", "right_ones", "truth").collect()}
    assert got == {t: (sum(d <= m for d, _ in pairs), sum(s for d, s in pairs if d <= m), sum(s for _, s in pairs)) for t, m in schema.THRESHOLDS.items()}


def test_largest_of_the_neighbours(spark, tiled):
    values = crowd()
    avail, contents, _ = library(spark, values)
    pixels = [(10 + i * 7 % 5) * 3 for i in range(len(values))]
    want = {}
    for i, a in enumerate(values):
        near = [(pixels[j], -j) for j, b in enumerate(values) if j != i and apart(a, b) <= 6]
        if near:
            want[i + 1000] = (-max(near)[1], max(near)[0])
    assert {r["id"]: (r["content_id"], r["pixels"]) for r in similarity.largest_match(avail, contents).collect()} == want
    none = contents.selectExpr("content_id", "sha1_hash", "h62", "0 as width", "height")
    assert similarity.largest_match(avail, none).count() == 0


def test_sets_of_equal_neighbours(spark, tiled):
    values = crowd()
    avail, _, sizes = library(spark, values)
    sets = {}
    for i, a in enumerate(values):
        sets.setdefault(frozenset(b for b in values if apart(a, b) <= 6), []).append(i + 1000)
    want = {(min(ids), len(ids)) for ids in sets.values() if len(ids) > 1}
    assert want and {tuple(r) for r in similarity.neighbourhood_sets(avail, sizes).collect()} == want


def test_met_hashes_and_their_pairs(spark, tiled):
    values = sorted(set(crowd()))
    rows = spark.createDataFrame([(h, 1) for h in values], "h long, n long")
    met = similarity_index.neighbour_sums(rows, [6]).withColumnRenamed("s0", "n")
    want = {a: sum(0 < apart(a, b) <= 6 for b in values) for a in values}
    assert {tuple(r) for r in met.collect()} == {(a, n) for a, n in want.items() if n}
    assert tuple(similarity.similarity_diagnostics(rows.select("h"), met).collect()[0]) == (len(values), sum(want.values()) // 2, sum(not n for n in want.values()))


@pytest.mark.parametrize("name", ["comparison_pending", "incremental_pairs"])
def test_index_keeps_close_pairs_only(spark, monkeypatch, name):
    monkeypatch.setattr(stored, "_written", {})
    monkeypatch.setattr(catalog, "_indexes", {})
    registry.queries()[name](spark, SF_DIR).collect()
    (index,) = catalog._indexes.values()
    assert index.edges().agg({"distance": "max"}).collect()[0][0] <= 3 and index.batches() == [0, 1]
