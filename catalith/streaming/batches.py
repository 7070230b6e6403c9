"""A batched writer of catalog rows: every good row once, every bad row once in quarantine, whenever a batch dies.

Each micro-batch is judged row by row with column expressions: a row that fails a rule goes to the quarantine with the
rule's name, the others to the table. Both are written under the batch's id, replacing what an earlier try left, and
the ledger's entry comes last. Readers see the batches that the ledger holds and no others. The stream's checkpoint gives a
batch that died the same rows and the same id again, so a replay replaces instead of adding; a batch whose entry is
complete is left alone, as the ledger may be further than the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query

#: Conditions by name; one that comes out null is broken.
Rules = dict[str, str]

#: What a catalog row must fulfil.
CATALOG_RULES: Rules = {"no_content": "sha1_hash rlike '^[0-9a-f]{40}$'", "no_path": "length(source_path) > 0", "control_character": r"not source_path rlike '[\\x00-\\x1F\\x7F]'", "empty_file": "file_size > 0"}


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds broken: the first rule that a row breaks, null for a good row."""
    return rows.withColumn("broken", F.coalesce(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in rules.items()]))


class BatchedWriter:
    """A table, its quarantine and its ledger in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: Rules) -> None:
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def write(self, batch: DataFrame, batch_id: int, between: Callable[[str], None] = lambda step: None) -> None:
        """One micro-batch; `between` is told of each step, for tests."""
        entry = f"{self.path}/ledger/batch={batch_id}"
        if self._exists(f"{entry}/_SUCCESS"):
            return
        rows = judged(batch, self.rules)
        rows.filter("broken is null").drop("broken").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        between("rows")
        rows.filter("broken is not null").write.mode("overwrite").parquet(f"{self.path}/quarantine/batch={batch_id}")
        between("quarantine")
        written = [self.spark.read.schema(batch.schema).parquet(f"{self.path}/{kind}/batch={batch_id}").agg(F.count(F.lit(1)).alias(kind)) for kind in ("rows", "quarantine")]
        written[0].crossJoin(written[1]).write.mode("overwrite").parquet(entry)  # one row each
        between("ledger")

    def run(self, stream: DataFrame, checkpoint: str, between: Callable[[str], None] = lambda step: None) -> None:
        """Writes what has arrived since the last run, a micro-batch at a time."""
        writer = stream.writeStream.foreachBatch(lambda batch, n: self.write(batch, n, between)).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = self.spark.read.parquet(f"{self.path}/ledger").select("batch").distinct() if self._exists(f"{self.path}/ledger") else None
        if done is None:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        rows = self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        return rows.join(F.broadcast(done), "batch", "left_semi")  # one row a batch

    def rows(self, schema: str) -> DataFrame:
        return self._read("rows", schema)

    def quarantine(self, schema: str) -> DataFrame:
        return self._read("quarantine", f"{schema}, broken string")


@query("quarantined_rows", r"""
SELECT id, CASE WHEN sha1_hash IS NULL THEN 'no_content' WHEN source_path IS NULL OR source_path = '' THEN 'no_path' WHEN regexp_matches(source_path, '[\x00-\x1F\x7F]') THEN 'control_character' WHEN file_size IS NULL OR file_size <= 0 THEN 'empty_file' END AS broken FROM arrivals
WHERE sha1_hash IS NULL OR source_path IS NULL OR source_path = '' OR regexp_matches(source_path, '[\x00-\x1F\x7F]') OR file_size IS NULL OR file_size <= 0""")
def quarantined_rows(arrivals: DataFrame) -> DataFrame:
    """The rows that a batch sets aside, with the first rule that each breaks."""
    return judged(arrivals, CATALOG_RULES).filter("broken is not null").select("id", "broken")


@query("accepted_rows", r"""
SELECT id, sha1_hash, file_size FROM arrivals WHERE sha1_hash IS NOT NULL AND source_path <> '' AND NOT regexp_matches(source_path, '[\x00-\x1F\x7F]') AND file_size > 0""")
def accepted_rows(arrivals: DataFrame) -> DataFrame:
    """The rows that a batch adds to the table."""
    return judged(arrivals, CATALOG_RULES).filter("broken is null").select("id", "sha1_hash", "file_size")
