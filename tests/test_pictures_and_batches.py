"""Picture hashes, JPEG fingerprints and the batched writer against hand-known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from catalith.operators import jpegs, pictures
from catalith.streaming.batches import CATALOG_RULES, BatchedWriter

ROW = "id long, sha1_hash string, source_path string, file_size long"


def plain_hash(p):
    """The 64 bits by the cosine sums as they are written in books."""
    low = [sum(2 * p[y][x] * 2 * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low)
    return [c > (middle[31] + middle[32]) / 2 for c in low]


def test_hash_and_measures_by_loops():
    rng = np.random.default_rng(3)
    for _ in range(3):
        p = rng.integers(0, 256, (32, 32)).astype(float)
        assert pictures.perceptual_hashes(p[None])[0].tolist() == plain_hash(p.tolist())
        bright, steep = (v[0] for v in pictures.measures(p[None]))
        step = lambda line, k: line[1] - line[0] if k == 0 else line[31] - line[30] if k == 31 else (line[k + 1] - line[k - 1]) / 2
        want = sum(math.hypot(step(p[y], x), step(p[:, x], y)) for y in range(32) for x in range(32)) / 1024
        assert abs(bright - p.sum() / 1024) < 1e-9 and abs(steep - want) < 1e-9


def test_stored_turned_and_tagged_upright_agree():
    """A picture that is stored as each orientation says shows, and so hashes, as the upright one."""
    p = np.random.default_rng(5).integers(0, 256, (32, 32)).astype(float)
    stored = {1: p, 2: np.fliplr(p), 3: np.rot90(p, 2), 4: np.flipud(p), 5: p.T, 6: np.rot90(p, 1), 7: np.rot90(p, 2).T, 8: np.rot90(p, -1), 9: p}
    for kind, a in stored.items():
        assert (pictures.upright(a[None], np.array([kind]))[0] == p).all(), kind


def test_pictures_of_other_sizes_have_no_hash(spark):
    rows = [(1, 1, [7] * 1024), (2, None, [1, 2]), (3, 2, None), (4, 1, [None] * 1024), (5, None, list(range(1024)))]
    got = {r["content_id"]: r["phash"] for r in pictures.measured(spark.createDataFrame(rows, "content_id long, orientation int, pixels array<int>")).collect()}
    assert [got[k] is None for k in (1, 2, 3, 4, 5)] == [False, True, True, True, False] and len(got[5]) == 16
    assert pictures.measured(spark.createDataFrame([], "content_id long, orientation int, pixels array<int>")).count() == 0


def segment(code, body):
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


JFIF = segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
TABLES = segment(0xDB, b"\x01") + segment(0xC0, b"\x08\0\x10\0\x20\x01\x01\x11\0") + segment(0xC4, b"\x02")
SCAN = segment(0xDA, b"\x01\x01\0\0\x3f\0") + b"abc\xff\0def\xff\xd0ghi"
END = b"\xff\xd9"


def whole(*more, scan=SCAN):
    return b"\xff\xd8" + JFIF + b"".join(more) + TABLES + scan + END


def test_files_that_differ_in_metadata_share_the_picture():
    base = jpegs.fingerprint(whole())
    said = jpegs.fingerprint(whole(segment(0xFE, b"a comment"), segment(0xE1, jpegs.EXIF + b"x")))
    assert base[0] == said[0] == "ok" and base[1] == said[1] and base[2] != said[2] and base[3:5] == (32, 16) and (base[6], said[6]) == (1, 3)
    assert jpegs.fingerprint(whole(scan=SCAN + b"z"))[1] != base[1] and jpegs.fingerprint(whole(scan=SCAN.replace(b"\xff\xd0", b"\xff\xff\xff\xd0")))[1] == base[1]
    icc = [segment(0xE2, jpegs.ICC + bytes((k, 2)) + b"p") for k in (1, 2)]
    assert jpegs.fingerprint(whole(*icc))[:2] == base[:2]


REFUSED = {
    "not_jpeg": b"GIF89a", "truncated_segment": b"\xff\xd8\xff", "expected_marker": b"\xff\xd8ab", "stuffed_byte_outside_scan": b"\xff\xd8\xff\0", "trailing_data_or_additional_image": whole() + b"x", "missing_end_of_image": whole()[:-2], "missing_frame_or_scan": b"\xff\xd8" + END,
    "incomplete_icc_profile": whole(segment(0xE2, jpegs.ICC + b"\x01\x02p")), "invalid_icc_sequence": whole(*[segment(0xE2, jpegs.ICC + b"\x01\x02p")] * 2), "unsupported_app1": whole(segment(0xE1, b"other")), "unsupported_app_5": whole(segment(0xE5, b"")), "unsupported_app0": whole(JFIF),
    "unsupported_marker_c1": whole(segment(0xC1, b"")), "scan_without_required_headers": b"\xff\xd8" + SCAN + END, "invalid_segment_length": b"\xff\xd8\xff\xdb\0\x01", "unsupported_frame": whole(TABLES), "invalid_scan_components": whole(scan=segment(0xDA, b"\x01\x05\0\0\x3f\0")), "invalid_restart_interval": whole(segment(0xDD, b"\0")),
    "invalid_entropy_padding": whole(scan=SCAN + b"\xff\xff\0"),
}


@pytest.mark.parametrize("state", REFUSED)
def test_what_is_unusual_gives_a_state(state):
    assert jpegs.fingerprint(REFUSED[state]) == (state, *[None] * 6)


def test_no_input_crashes():
    rng, good = random.Random(7), whole(segment(0xFE, b"a"))
    for _ in range(3000):
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.choice([0, 0xFF, 0xD8, 0xDA, rng.randrange(256)])
        assert isinstance(jpegs.fingerprint(bytes(data[: rng.randint(0, len(data))]))[0], str)
    assert jpegs.fingerprint(None)[0] == "truncated_segment" and jpegs.fingerprint(b"\xff" * 200_000)[0] == "not_jpeg"


def arrivals(n, at=0):
    good = "a" * 40
    return [(i, good if i % 5 else None, f"/p/{i}" if i % 7 else "", 1 if i % 11 else 0) for i in range(at, at + n)]


@pytest.mark.parametrize("step", ["rows", "quarantine", "ledger"])
def test_a_batch_that_dies_is_written_once(spark, tmp_path, step):
    """Two files arrive; the writer dies at a step of the first batch, is started anew, and a third file arrives later."""
    source, died = tmp_path / "in", []
    put = lambda rows: spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(source))
    put(arrivals(40))
    put(arrivals(40, 40))
    writer = BatchedWriter(spark, f"{tmp_path}/out", CATALOG_RULES)
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(source))

    def die(at):
        if at == step and not died:
            died.append(at)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        writer.run(stream(), f"{tmp_path}/checkpoint", die)
    assert writer.rows(ROW).count() == (0 if step != "ledger" else 40 - sum(not (i % 5 and i % 7 and i % 11) for i in range(40)))
    BatchedWriter(spark, f"{tmp_path}/out", CATALOG_RULES).run(stream(), f"{tmp_path}/checkpoint")
    put(arrivals(20, 80))
    writer.run(stream(), f"{tmp_path}/checkpoint")
    bad = {i: "no_content" if not i % 5 else "no_path" if not i % 7 else "empty_file" for i in range(100) if not (i % 5 and i % 7 and i % 11)}
    assert sorted(r["id"] for r in writer.rows(ROW).collect()) == [i for i in range(100) if i not in bad]
    assert sorted((r["id"], r["broken"]) for r in writer.quarantine(ROW).collect()) == sorted(bad.items())
    ledger = spark.read.parquet(f"{tmp_path}/out/ledger").collect()
    assert sum(r["rows"] for r in ledger) == 100 - len(bad) and sum(r["quarantine"] for r in ledger) == len(bad)


def test_turning_once_more_keeps_the_mirror(spark):
    """A picture of any orientation that is turned by quarters shows as its upright form, turned."""
    from catalith.functions import values

    p = np.random.default_rng(8).integers(0, 256, (32, 32)).astype(float)
    quarters = {1: 0, 6: 1, 3: 2, 8: 3}
    rows = spark.createDataFrame([(o, t) for o in range(1, 9) for t in quarters], "a int, b int")
    for r in rows.select("a", "b", values.turned(rows["a"], rows["b"]).alias("c")).collect():
        shown = lambda o: pictures.upright(p[None], np.array([o]))[0]
        assert (shown(r["c"]) == np.rot90(shown(r["a"]), -quarters[r["b"]])).all(), tuple(r)
