"""Files as a table: a recursive scan, formats by leading bytes, digests, exports.

The scan reads the binaryFile source; while no column made from the content is asked for, Spark reads only names,
sizes and times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths as X

# Leading bytes of image formats, in hexadecimal; brands of ISO media files at offset 4.
PREFIXES = {"ffd8ff": "jpeg", "89504e470d0a1a0a": "png", "47494638": "gif", "424d": "bmp", "4d4d002a": "tiff", "49492a00": "tiff"}
BRANDS = {"mif1": "heif", "msf1": "heif", "heic": "heif", "heix": "heif", "hevc": "heif", "avif": "avif", "avis": "avif"}
EXPECTED = {"jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "jfif": "jpeg", "png": "png", "gif": "gif", "bmp": "bmp", "webp": "webp", "tif": "tiff", "tiff": "tiff", "heic": "heif", "heif": "heif", "avif": "avif"}
# Names that other programs leave behind.
HOUSEKEEPING = (".ds_store", "thumbs.db", "desktop.ini", ".picasa.ini")


def normalize_extensions(raw: str) -> list[str]:
    """A comma list of extensions: trimmed, lower-case, without dots, each once, in order."""
    return list(dict.fromkeys(x.strip().lower().lstrip(".") for x in raw.split(",") if x.strip().lstrip(".")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, content of every file below root that is neither hidden nor oddly named.

    Spark's file sources leave out files without any byte; rows of size 0 come from other listings only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    hidden = X.basename(F.col("path")).startswith(".") | F.substring("path", len(root) + 1, 10_000).contains("/.")
    return rows.filter(~hidden & ~F.col("path").rlike(r"[\x00-\x1f\x7f]"))


def discovered(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files by extension: how many, how many eligible, bytes."""
    ext = X.extension(F.col("path"))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("found"), F.count_if(ext.isin(*extensions)).alias("eligible"), F.sum("size").alias("bytes"))


def file_format(content: Column) -> Column:
    """The format that a file's first bytes show; null if none is known."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = F.when(F.lit(False), F.lit(None))
    for prefix, name in PREFIXES.items():
        out = out.when(head.startswith(prefix), name)
    text = F.decode(F.unhex(F.substring(head, 9, 16)), "ISO-8859-1")
    out = out.when(head.startswith(b"RIFF".hex()) & (F.substring(head, 17, 8) == b"WEBP".hex()), "webp")
    for brand, name in BRANDS.items():
        out = out.when(text == "ftyp" + brand, name)
    return out


def described(files: DataFrame) -> DataFrame:
    """path, ext, format, sha1, kind: photo, wrong_extension, empty, housekeeping, other_type or unrecognised."""
    ext, fmt = X.extension(F.col("path")), file_format(F.col("content"))
    wanted = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])
    rows = files.select("path", "size", ext.alias("ext"), fmt.alias("format"), F.sha1("content").alias("sha1"))
    photo = F.col("ext").isin(*schema.RASTER, *schema.RAW, *EXPECTED)
    kind = (
        F.when(F.lower(X.basename(F.col("path"))).isin(*HOUSEKEEPING), "housekeeping").when(F.col("size") == 0, "empty")
        .when(~photo & F.col("format").isNull(), F.when(F.col("ext") == "", "unrecognised").otherwise("other_type"))
        .when(~photo | (F.col("format") != F.element_at(wanted, F.col("ext"))), "wrong_extension").otherwise("photo")
    )
    return rows.withColumn("kind", kind)


def beside_photos(files: DataFrame) -> DataFrame:
    """Sidecars whose folder holds a photo of the same name or stem."""
    named = files.select("path", X.folder(F.col("path")).alias("dir"), X.stem(F.col("path")).alias("stem"), X.extension(F.col("path")).alias("ext"))
    cars = named.filter(F.col("ext").isin("xmp", "aae"))
    photos = named.filter(F.col("ext").isin(*schema.RASTER, *schema.RAW))
    keys = photos.select("dir", "stem").union(photos.select("dir", X.basename(F.col("path")))).distinct()
    return cars.join(keys, ["dir", "stem"], "left_semi").select("path")


def export(rows: DataFrame, path: str, form: str, order: str = "id") -> None:
    """Rows as CSV, with cells that a spreadsheet would run quoted, or as JSON; in order."""
    out = rows.orderBy(order)
    if form == "csv":
        out = out.select(*[X.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])
        out.write.option("header", "true").csv(path)
    else:
        out.write.json(path)
