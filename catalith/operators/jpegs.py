"""Fingerprints of encoded JPEG files: what makes the picture, and what is said about it, hashed apart.

A file's markers are walked once. Comments, EXIF, XMP and ICC segments count as metadata; tables, frame, scans and restart
markers, the presence of JFIF and Adobe's colour segment count as the picture. Files that differ in metadata only share the
picture's digest. Whatever is unusual, cut off or malformed gives a state instead of digests; a fingerprint finds
candidates and proves nothing about a file's pixels.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The name of the fingerprint, heads of segments, markers, and bounds.
PROFILE = b"jpeg-encoded-v1-experiment"
EXIF, XMP, XMP_MORE, ICC = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0", b"ICC_PROFILE\0"
START, END, SCAN, FRAMES, HUFFMAN, QUANTISATION, RESTART, COMMENT = 0xD8, 0xD9, 0xDA, (0xC0, 0xC2), 0xC4, 0xDB, 0xDD, 0xFE
MOST_MARKERS, MOST_SCANS, MOST_PADDING = 100_000, 4096, 65_536

#: Entropy-coded data: anything but a marker; stuffed and restart markers belong to it.
_ENTROPY = re.compile(rb"(?:[^\xff]++|\xff\x00|\xff++[\xd0-\xd7])*+")
_PADDED = re.compile(rb"\xff++")

SCHEMA = "file_id long, state string, image_sha256 string, metadata_sha256 string, width int, height int, scans int, metadata_segments int"


class Refused(Exception):
    """The state of a file without a fingerprint."""


def _need(fine: bool, state: str) -> None:
    if not fine:
        raise Refused(state)


def _marker(data: bytes, at: int) -> tuple[int, int]:
    """The marker at a place, fill bytes before it skipped, and the place after it."""
    _need(at < len(data), "truncated_segment")
    m = _PADDED.match(data, at)
    _need(m is not None, "expected_marker")
    _need(m.end() - at <= MOST_PADDING, "excessive_marker_padding")
    _need(m.end() < len(data), "truncated_segment")
    _need(data[m.end()] != 0, "stuffed_byte_outside_scan")
    return data[m.end()], m.end() + 1


def _application(code: int, body: bytes, seen: dict) -> bool:
    """Whether an application segment is metadata; those that nothing is known about are refused."""
    if code == 0xE0:
        fine = "jfif" not in seen and body.startswith(b"JFIF\0") and len(body) >= 14 and body[5] == 1 and body[6] <= 2 and len(body) == 14 + 3 * body[12] * body[13]
        _need(fine, "unsupported_app0")
        seen["jfif"] = True
        return True
    if code == 0xE1:
        _need(body.startswith((EXIF, XMP, XMP_MORE)), "unsupported_app1")
        return True
    if code == 0xE2:
        _need(body.startswith(ICC) and len(body) >= 14, "unsupported_app2")
        part, total = body[12], body[13]
        _need(1 <= part <= total and part not in seen["icc"] and seen.get("icc_total", total) == total, "invalid_icc_sequence")
        seen["icc_total"] = total
        seen["icc"].add(part)
        return True
    _need(code == 0xEE, f"unsupported_app_{code - 0xE0}")
    _need("adobe" not in seen and len(body) == 12 and body.startswith(b"Adobe"), "unsupported_adobe_segment")
    seen["adobe"] = True
    return False


def _frame(code: int, body: bytes, seen: dict) -> None:
    _need("frame" not in seen and len(body) >= 6 and body[0] == 8, "unsupported_frame")
    height, width, count = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
    _need(width > 0 and height > 0 and count in (1, 3) and len(body) == 6 + 3 * count, "unsupported_frame")
    _need(len(set(body[6::3])) == count, "duplicate_components")
    seen["frame"] = width, height, frozenset(body[6::3])


def _scan(body: bytes, seen: dict) -> None:
    _need("frame" in seen and QUANTISATION in seen and HUFFMAN in seen and bool(body), "scan_without_required_headers")
    count = body[0]
    _need(count > 0 and len(body) == 4 + 2 * count, "invalid_scan_header")
    parts = body[1 : 1 + 2 * count : 2]
    _need(len(set(parts)) == count and set(parts) <= seen["frame"][2], "invalid_scan_components")
    seen["scans"] += 1
    _need(seen["scans"] <= MOST_SCANS, "scan_limit")


def fingerprint(data: bytes | None) -> tuple:
    """state, image_sha256, metadata_sha256, width, height, scans, metadata_segments. Never raises."""
    try:
        return "ok", *_walk(data or b"")
    except Refused as refused:
        return str(refused), None, None, None, None, None, None


def _walk(data: bytes) -> tuple:
    _need(len(data) >= 2, "truncated_segment")
    _need(data[:2] == b"\xff\xd8", "not_jpeg")
    image, metadata = hashlib.sha256(PROFILE + b"\0\xff\xd8"), hashlib.sha256(PROFILE + b"\0metadata\0")
    seen: dict = {"icc": set(), "scans": 0, "segments": 0}
    at = 2
    for _ in range(MOST_MARKERS):
        code, at = _marker(data, at)
        if code == END:
            _need("frame" in seen and seen["scans"] > 0, "missing_frame_or_scan")
            _need("icc_total" not in seen or seen["icc"] == set(range(1, seen["icc_total"] + 1)), "incomplete_icc_profile")
            _need(at == len(data), "trailing_data_or_additional_image")
            image.update(b"\xff\xd9")
            return image.hexdigest(), metadata.hexdigest(), *seen["frame"][:2], seen["scans"], seen["segments"]
        _need(code in (*FRAMES, HUFFMAN, QUANTISATION, RESTART, SCAN, COMMENT) or 0xE0 <= code <= 0xEF, f"unsupported_marker_{code:02x}")
        _need(at + 2 <= len(data), "truncated_segment")
        length = int.from_bytes(data[at : at + 2], "big")
        _need(length >= 2, "invalid_segment_length")
        _need(at + length <= len(data), "truncated_segment")
        body, segment = data[at + 2 : at + length], bytes((0xFF, code)) + data[at : at + length]
        at += length
        ancillary = code == COMMENT
        if 0xE0 <= code <= 0xEF:
            ancillary = _application(code, body, seen)
        elif code in FRAMES:
            _frame(code, body, seen)
        elif code in (QUANTISATION, HUFFMAN):
            _need(bool(body), "empty_quantization_table" if code == QUANTISATION else "empty_huffman_table")
            seen[code] = True
        elif code == RESTART:
            _need(len(body) == 2, "invalid_restart_interval")
        elif code == SCAN:
            _scan(body, seen)
        if code == 0xE0:
            image.update(b"\xff\xe0JFIF\0")
        (metadata if ancillary else image).update(segment)
        seen["segments"] += ancillary
        if code == SCAN:
            end = _ENTROPY.match(data, at).end()
            image.update(re.sub(rb"\xff++(?=[\xd0-\xd7])", b"\xff", data[at:end]))  # fill bytes before a restart are no part of it
            at = end
            _need(at < len(data), "missing_end_of_image")
            fill = _PADDED.match(data, at)
            _need(fill.end() >= len(data) or data[fill.end()] != 0, "invalid_entropy_padding")
    raise Refused("marker_limit")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 3 + [pa.int32()] * 4
    for batch in batches:
        found = list(zip(*(fingerprint(d) for d in batch.column("data").to_pylist()), strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), *(pa.array(list(c), k) for c, k in zip(found, kinds, strict=True))], names=["file_id", "state", "image_sha256", "metadata_sha256", "width", "height", "scans", "metadata_segments"])


FINGERPRINT_SQL = """
SELECT file_id, CASE damage WHEN 1 THEN 'not_jpeg' WHEN 2 THEN 'missing_end_of_image' WHEN 3 THEN 'trailing_data_or_additional_image' WHEN 4 THEN 'unsupported_marker_c1' ELSE 'ok' END AS state,
  CASE WHEN damage = 0 THEN sha256(unhex('6A7065672D656E636F6465642D76312D6578706572696D656E7400FFD8' || 'FFE04A46494600' || tables || scan || 'FFD9')) END AS image_sha256, CASE WHEN damage = 0 THEN sha256(unhex('6A7065672D656E636F6465642D76312D6578706572696D656E74006D6574616461746100' || jfif || said)) END AS metadata_sha256,
  CASE WHEN damage = 0 THEN CAST(64 AS INTEGER) END AS width, CASE WHEN damage = 0 THEN CAST(48 AS INTEGER) END AS height, CASE WHEN damage = 0 THEN CAST(1 AS INTEGER) END AS scans, CASE WHEN damage = 0 THEN CAST(2 AS INTEGER) END AS metadata_segments FROM jpeg_parts"""


@query("jpeg_fingerprints", FINGERPRINT_SQL)
def jpeg_fingerprints(jpegs: DataFrame) -> DataFrame:
    """State and digests of every file."""
    return jpegs.select("file_id", "data").mapInArrow(_each, SCHEMA)


@query("jpeg_twins", f"""
SELECT image_sha256, count(*) AS files, count(DISTINCT metadata_sha256) AS metadata_kinds, min(file_id) AS first FROM ({FINGERPRINT_SQL}) WHERE state = 'ok' GROUP BY image_sha256 HAVING count(*) > 1""")
def jpeg_twins(jpegs: DataFrame) -> DataFrame:
    """Pictures that several files hold, and in how many kinds of metadata."""
    from pyspark.sql import functions as F

    rows = jpeg_fingerprints(jpegs).filter("state = 'ok'").groupBy("image_sha256")
    return rows.agg(F.count("*").alias("files"), F.countDistinct("metadata_sha256").alias("metadata_kinds"), F.min("file_id").alias("first")).filter("files > 1")
