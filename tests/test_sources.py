"""Files, sidecars and selections."""

from __future__ import annotations

import hashlib

import pytest

from catalith.sources import files, selection, sidecars


def test_scan_and_describe(spark, tmp_path):
    for name, data in {"a/x.jpg": b"\xff\xd8\xff\xe0rest", "a/y.png": b"\xff\xd8\xffjpeg inside", "b/z.txt": b"words", "b/none": b"words", "b/thumbs.db": b"x", ".hidden/q.jpg": b"q", "a/.dot.jpg": b"q", "a/x.xmp": b"<x/>", "c/x.xmp": b"<x/>", "w.webp": b"RIFF1234WEBPmore", "h.heic": b"\0\0\0\x18ftypheic"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = files.scan(spark, str(tmp_path))
    got = {r["path"][len(str(tmp_path)) + 1 :]: r for r in files.described(found).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {
        "a/x.jpg": "photo", "a/y.png": "wrong_extension", "b/z.txt": "other_type", "b/none": "unrecognised", "b/thumbs.db": "housekeeping", "a/x.xmp": "other_type", "c/x.xmp": "other_type", "w.webp": "photo", "h.heic": "photo",
    }
    assert got["a/x.jpg"]["sha1"] == hashlib.sha1(b"\xff\xd8\xff\xe0rest").hexdigest()
    assert [r["path"][len(str(tmp_path)) :] for r in files.beside_photos(found).collect()] == ["/a/x.xmp"]
    counts = {r["ext"]: (r["found"], r["eligible"]) for r in files.discovered(found, files.normalize_extensions(" .JPG, png,jpg,")).collect()}
    assert counts["jpg"] == (1, 1) and counts["txt"] == (1, 0)


def test_selection_round_trip_and_seal(spark, tmp_path):
    path = str(tmp_path / "s")
    selection.write(spark.range(5, 50, 3), path)
    assert sorted(r["id"] for r in selection.read(spark, path).collect()) == list(range(5, 50, 3))
    spark.range(1).write.mode("append").parquet(f"{path}/ids")
    with pytest.raises(ValueError):
        selection.read(spark, path).count()
    with pytest.raises(ValueError):
        selection.write(spark.range(2).union(spark.range(1)), str(tmp_path / "t"))


XMP = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="3">
<dc:subject><rdf:Bag><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Bag></dc:subject><dc:title><rdf:Alt><rdf:li xml:lang="x-default">T</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>"""


@pytest.mark.parametrize(
    ("data", "state", "code"),
    [(XMP, "valid", None), (b"<a/>", "not_xmp", None), (b"plain", "not_xmp", None), (XMP[:-20], "needs_attention", "malformed"), (b"<!DOCTYPE a>" + XMP, "needs_attention", "unsafe_xml"), ("<?xml version='1.0' encoding='utf-16'?><!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>".encode("utf-16"), "needs_attention", "unsafe_xml"), (b"<a>" * 70 + b"</a>" * 70, "needs_attention", "xml_limit"), (b"<a>" + b"<b/>" * 20_001 + b"</a>", "needs_attention", "xml_limit"), (XMP.replace(b"<rdf:Bag>", b"<rdf:Odd>").replace(b"</rdf:Bag>", b"</rdf:Odd>"), "needs_attention", "unsupported_property")],
)
def test_sidecar_states(data, state, code):
    assert sidecars.parse(data)[:2] == (state, code)


def test_sidecar_properties(spark):
    row = sidecars.read_sidecars(spark.createDataFrame([("p", XMP)], "path string, content binary")).collect()[0]
    assert row["properties"] == {"{http://ns.adobe.com/xap/1.0/}Rating": "3", "{http://purl.org/dc/elements/1.1/}subject": "a\nb", "{http://purl.org/dc/elements/1.1/}title": "x-default=T"}


def test_export_quotes_formulas(spark, tmp_path):
    files.export(spark.createDataFrame([(2, "=1+1"), (1, "ok")], "id long, cell string").coalesce(1), str(tmp_path / "out"), "csv")
    rows = spark.read.option("header", "true").csv(str(tmp_path / "out")).collect()
    assert sorted(r["cell"] for r in rows) == ["'=1+1", "ok"]
