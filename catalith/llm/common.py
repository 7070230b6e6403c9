"""Helpers that every operator of this package shares."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (fixed by the query contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch; long texts make large rows, so both are bounded.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20

#: Keys that lookup() broadcasts at most, and the rows that such a key holds at least.
HOT_KEYS, LEAST_HOT = 10_000, 64

_own_dir: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that a Python worker holds a few tens of MB of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-catalith-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage in a place that every executor sees, so a lost executor costs a re-read, not a rerun.
    The folder goes by discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/catalith-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    path, spark = _paths.pop(df, None), df.sparkSession
    jvm = getattr(spark, "_jvm", None)
    if path and jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """Inner join of rows with table, which has one row a key, where a key may hold any share of the rows.

    times: the column of table that counts a key's rows (or more); total: the sum of these counts. A key that holds a
    HOT_KEYS-th of the rows or more is joined by a broadcast, which has HOT_KEYS rows at most; the others by a shuffle.
    The driver learns the hashes of the hot keys only. table is read twice or more, so it should be a written one.
    """
    mark = F.xxhash64(*on)  # keys of one hash are on the same side, so equal hashes do no harm
    hot = [r[0] for r in table.filter(F.col(times) >= max(LEAST_HOT, -(-total // HOT_KEYS))).select(mark).distinct().collect()]
    if not hot:
        return rows.join(table, on)
    often = rows.filter(mark.isin(hot)).join(F.broadcast(table.filter(mark.isin(hot))), on)
    return often.unionByName(rows.filter(~mark.isin(hot)).join(table.filter(~mark.isin(hot)), on))


def row_key(doc_id: Column, mark: Column) -> Column:
    """A string, never null, of an id and a mark of its text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), mark.cast("string"))


def rows_of(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """The rows of docs whose key is in keys (one column, key), one a key, with all their columns.

    Of rows that share a key the one stays whose columns, as strings, hash least: rows that differ in more than the key
    are told apart the same way on every run. They are reduced map-side before the one shuffle of the texts, so no key
    gathers in a task. The columns travel in a struct: their names can't clash.
    """
    mark = F.xxhash64(*[F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("\0")) for c in docs.columns])
    held = docs.select(key.alias("key"), mark.alias("mark"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    one = held.groupBy("key").agg(F.min_by("row", "mark").alias("row"))
    return one.join(keys, "key", "left_semi").select("row.*")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies. Each executor has the package, so the path holds there as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_cache(key: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task; it must bound its own size."""
    kept = sys.modules.setdefault("_catalith_worker", types.ModuleType("_catalith_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
