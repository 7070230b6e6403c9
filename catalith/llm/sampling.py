"""Bounded samples of labelled rows for fitting, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values that may be thinned before they are ranked (a row of the driver's for each).
FREQUENT = 1000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, *, folds: int, not_fold: int, most: int) -> DataFrame:
    """doc_id, label: at most `most` labelled ids outside the held-out fold, the first by a hash of the id.

    The bound makes the result fit to be broadcast.
    """
    rows = labels.filter(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != not_fold))
    one = rows.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def per_value_ids(docs: DataFrame, value: str, *, folds: int, not_fold: int, most: int, most_rows: int) -> DataFrame:
    """doc_id, label: for each value at most `most` ids outside the held-out fold, the first by a hash of the id.

    All values together get most_rows at most, so that the sample is fit to be broadcast: where there are very many
    values each gets fewer, and of more values than most_rows only the commonest, of equal ones the first, are sampled.
    Of the FREQUENT commonest values only ids of a low enough hash (about four times as many as are wanted) are ranked,
    so that a value that holds most rows sends few to the task that ranks it.
    """
    rows = docs.filter(F.col(value).isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != not_fold)).select("doc_id", F.col(value).alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    values = counts.count()
    if values > most_rows:
        counts = counts.orderBy(F.desc("n"), "label").limit(most_rows)
        rows = rows.join(F.broadcast(counts.select("label")), "label", "left_semi")  # most_rows at most
    most = min(most, most_rows // max(1, min(values, most_rows)))
    common = counts.filter(F.col("n") > 8 * most).orderBy(F.desc("n"), "label").limit(FREQUENT).collect()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    order = Window.partitionBy("label").orderBy("draw", "doc_id")
    few = rows.withColumn("draw", draw)
    if common:
        upto = F.create_map(*[F.lit(x) for r in common for x in (r["label"], 4 * most / r["n"])])
        few = few.filter(F.col("draw") <= F.coalesce(F.try_element_at(upto, F.col("label")), F.lit(1.0)))
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("doc_id", "label")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled ids (bounded by the sample, hence broadcast).

    Of rows that share an id one text is taken, so that the result is as bounded as the ids.
    """
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
