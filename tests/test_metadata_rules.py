"""Rules of metadata values against hand-known answers, apart from any SQL."""

from __future__ import annotations

from decimal import Decimal, localcontext

import pytest

from catalith.operators import capture, choices


def fields(spark, tags):
    """{source: fields or issue} of one photo with these tags."""
    rows = spark.createDataFrame([(1, t, v) for t, v in tags], "photo_id long, tag string, value string")
    out = {}
    for r in capture.interpreted_fields(rows).collect():
        if r["issue"]:
            out[r["source"]] = r["issue"]
        else:
            out.setdefault(r["source"], {})[r["field"]] = r["value"]
    return out


RATINGS = {"4.50": "4.5", "-1": "-1", "05.0": "5", "7": None, "0.00": "0", "4e0": None, " 3 ": None, "+2": "2", "5.0000000000000000001": None, ".5": "0.5", "-1.0": "-1", "-2": None, "-0": "0", "5.": None, ".": None, "+": None, "0005.000": "5", "4.9999999999999999999999999999999999999999": "4.9999999999999999999999999999999999999999", "-0.5": None, "3\n": None}


def test_ratings(spark):
    rows = spark.createDataFrame([(i, "XMP-xmp:Rating", v) for i, v in enumerate(RATINGS)], "photo_id long, tag string, value string")
    assert {r["said"]: r["rating"] for r in capture.ratings(rows).collect()} == RATINGS


GPS = {
    ("12.5", "N"): "12,30.0N", ("12", "S"): "12,0S", ("012.2500", "N"): "12,15.0000N", ("12 deg", "N"): "invalid_gps_latitude", ("-1.5", "N"): "negative_exif_coordinate", ("1.5", "X"): "invalid_gps_reference", ("1.5", "E"): "invalid_gps_reference", ("1.5", None): "gps_coordinate_without_reference",
    (None, "N"): "gps_reference_without_coordinate", ("90.0", "N"): "90,0.0N", ("90.01", "N"): "invalid_gps_latitude", ("91", "N"): "invalid_gps_latitude", ("1e1", "N"): "invalid_gps_latitude", ("0.1234567890123456789012345", "N"): None, ("-0.0", "N"): "0,0.0N", ("1.", "N"): "invalid_gps_latitude",
}


def test_coordinates_are_exact(spark):
    rows = [(i, t, v) for i, (value, ref) in enumerate(GPS) for t, v in (("GPS:GPSLatitude", value), ("GPS:GPSLatitudeRef", ref)) if v is not None]
    got = {r["photo_id"]: r["issue"] or r["text"] for r in capture.gps_minutes(spark.createDataFrame(rows, "photo_id long, tag string, value string")).collect()}
    for i, ((value, _), want) in enumerate(GPS.items()):
        if want is None:
            with localcontext() as exact:
                exact.prec = 60
                want = f"0,{Decimal(value) * 60:f}N"
        assert got[i] == want, value
    xmp = {"-12.250": "12,15.000S", "+7": "7,0N", "-0.5": "0,30.0S"}
    rows = spark.createDataFrame([(i, "XMP-exif:GPSLatitude", v) for i, v in enumerate(xmp)], "photo_id long, tag string, value string")
    assert {r["photo_id"]: r["text"] for r in capture.gps_minutes(rows).collect()} == dict(enumerate(xmp.values()))


DATES = {
    ("2020:01:02 03:04:05", None, None): "2020-01-02T03:04:05", ("2020:01:02 03:04:05", "07", "+02:00"): "2020-01-02T03:04:05.07+02:00", ("2020:01:02 99:99:99", None, None): "invalid_date_taken", ("2020:02:30 00:00:00", None, None): "invalid_date_taken", ("2020:01:02", None, None): "invalid_date_taken",
    (None, "07", None): "date_components_without_date", ("2020:01:02 03:04:05", "x", None): "invalid_date_fraction", ("2020:01:02 03:04:05", None, "2h"): "invalid_date_offset", ("2020:01:02 03:04:05", None, "+24:00"): "invalid_date_taken", ("", None, None): "", ("2020:01:02 23:59:60", None, None): "invalid_date_taken",
}


@pytest.mark.parametrize("parts", DATES)
def test_exif_dates(spark, parts):
    tags = [(t, v) for t, v in zip((capture.DATE, capture.FRACTION, capture.OFFSET), parts, strict=True) if v is not None]
    got = fields(spark, tags)["exif"]
    assert (got if isinstance(got, str) else got["date_taken"]) == DATES[parts]


XMP_DATES = {"2020": "2020", "2020:05": "2020-05", "2020:13": "invalid_date_taken", "2020:01:02 03:04Z": "2020-01-02T03:04+00:00", "2020:01:02 03:04:05-00:00": "2020-01-02T03:04:05-00:00", "2020:01:02 25:04": "invalid_date_taken", "2020:01:02 03": "invalid_date_taken", "20": "invalid_date_taken"}


@pytest.mark.parametrize("said", XMP_DATES)
def test_xmp_dates(spark, said):
    got = fields(spark, [("XMP-exif:DateTimeOriginal", said)])["embedded_xmp"]
    assert (got if isinstance(got, str) else got["date_taken"]) == XMP_DATES[said]


def test_copies_collapse_and_other_parts_conflict(spark):
    assert fields(spark, [("IFD0:Make", "a"), ("IFD0:Copy12:Make", "a"), ("IFD0:Model", "m")]) == {"exif": {"camera_make": "a", "camera_model": "m"}}
    assert fields(spark, [("IFD0:Make", "a"), ("IFD0:Copy1:Make", "b")]) == {"exif": "ambiguous_embedded_exif"}
    assert fields(spark, [("IFD0:Make", "a"), ("IFD0:Foo:Make", "a")]) == {"exif": "ambiguous_embedded_exif"}
    assert fields(spark, [("IFD0:Make", "a"), ("Other:Foo:Make", "a"), ("NoFamily", "x")]) == {"exif": {"camera_make": "a"}}


def test_a_wrong_value_refuses_its_source_only(spark):
    tags = [("IFD0:Make", "a"), ("IFD0:Orientation", "9"), ("IFD0:Rating", "9"), ("XMP-tiff:Make", "b"), ("XMP-dc:Title", "t"), ("XMP-dc:Title-de", "T"), ("XMP-dc:Subject", "x;y")]
    assert fields(spark, tags) == {"exif": "invalid_orientation", "embedded_xmp": {"camera_make": "b", "title": "de=T,x-default=t", "keywords": "x;y"}}
    assert fields(spark, [("IFD0:XPKeywords", "x; y"), ("IFD0:Orientation", "+006"), ("GPS:GPSAltitude", "1/0")]) == {"exif": "invalid_gps_altitude"}
    assert fields(spark, [("IFD0:XPKeywords", "x; y"), ("IFD0:Orientation", "+006"), ("GPS:GPSAltitude", "3/2")]) == {"exif": {"keywords": "x| y", "orientation": "6", "altitude": "3/2"}}


def test_one_scan_interprets_all_tags(spark, tmp_path):
    spark.createDataFrame([(1, "IFD0:Make", "a")], "photo_id long, tag string, value string").write.parquet(f"{tmp_path}/tags")
    plan = capture.interpreted_fields(spark.read.parquet(f"{tmp_path}/tags"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_words_inside_strings_are_faithful(spark):
    texts = {'{"a": NaN}': False, '{"a": "NaN"}': True, '{"a": "Infinity"}': True, '{"a": -Infinity}': False, "[1]": False, '{"a": ': False, '{"a\\"": 1}': True, "": False, " {}": True}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, text string")
    assert {r["text"]: r["faithful"] for r in choices.json_fidelity(rows).collect()} == texts
