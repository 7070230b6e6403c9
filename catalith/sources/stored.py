"""Tables that are derived once a session and read by many queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: dict[tuple, tuple[str, StructType]] = {}
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str | None:
    """The folder named by spark.checkpoint.dir; one of our own where that is unset and the session is local; else none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-catalith-views-"))
    return _own_dir[0]


def written(df: DataFrame, base: str, name: str) -> DataFrame:
    """Writes df as Parquet under base and reads it back; the folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{base}/catalith-views/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends, if it is there by now."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder; where the session names none, a checkpoint of Spark's own needs it as well."""
    base = shared_dir(df.sparkSession)
    if base is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return written(df, base, name)


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Of a file or folder its size and time of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(where).getLength(), files.getFileStatus(where).getModificationTime()


def stored(spark: SparkSession, build: Callable[[], DataFrame], tables: list[str], sf_dir: str, name: str) -> DataFrame:
    """What build gives, derived from these tables of sf_dir: written at its first use in a session, and again if one changes.

    Later uses read it by path and schema and build nothing. Where the session names no shared folder it is derived each time.
    """
    base = shared_dir(spark)
    if base is None or getattr(spark, "_jvm", None) is None:
        return build()
    key = stamped(spark, tables, sf_dir, name)
    if key not in _written:
        out = written(build(), base, name)
        files = out.inputFiles()
        if not files:
            return out
        _written[key] = files[0].rsplit("/", 1)[0], out.schema
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def stamped(spark: SparkSession, tables: list[str], sf_dir: str, name: str) -> tuple:
    """A key that changes with the session and with any of the tables."""
    return (spark.sparkContext.applicationId, sf_dir, name, *(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables))
