"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a word target. A document is first given the whole copies that its source's target makes
certain; what is left of the target, the wanted words, is filled by a Pareto order sample: documents are ranked by

    random odds / inclusion odds = (u / (1 - u)) / (p / (1 - p))

where p is a document's inclusion probability. Inside a source it rises with the document's length: it is in proportion
to a measure, the root of the size rounded down to a power of two (size 1 to 3: 1, 4 to 15: 2, 16 to 63: 4, ...), so that
longer documents, which hold more context, come more often than fragments. The probabilities are scaled so that times
sizes they add up to the wanted words; where that would bring some to 1 or more, these documents get one more whole
copy and the rest is scaled anew, until none is left (levels of the measure are few, so this is a prefix of them). The
ranking is cut where the words taken come nearest to what is wanted: a sample of fixed size, the size being
counted in words.

The cut is found without sorting a source: ranks fall into bins, bins are summed map-side first, and only the rows
of the one bin in which a source's cut lies are ordered. A source that holds a third of all rows is therefore
never gathered in one task.

Defined cases: null text counts 0 words; the null source is a source of its own, last in order; an empty table
gives an empty result; rows of equal doc_id and equal size share one rank and are taken or left together; other
columns of the input are never read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

BINS = 4096


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def level(size: Column) -> Column:
    """The measure's exponent: half the binary digits before a size's last."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def source_targets(sizes_: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """sizes_: src, level, size. One row a source: src, source_size, target, certain, wanted (words beyond the certain copies).

    Filling to a common level: sources in order of cap / weight; level k leaves the first k at their caps and
    shares the rest by weight; the true level is the largest of these.
    """
    sources = sizes_.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    total = F.sum("source_size").over(everywhere) * F.lit(share)
    common = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)
    out = ranked.withColumn("common", common).withColumn("common", F.max("common").over(everywhere))
    out = out.withColumn("target", F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")))
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("certain", F.floor(share_of).cast("long"))
    out = out.withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
    return out.select("src", "source_size", "target", "certain", "wanted")


def inclusions(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """levels: src, level, size. Adds to each source and level: whole (copies of each document), inclusion (of one more).

    wanted becomes what is left of the source's wanted words after the whole copies. A source has few levels.
    """
    rows = levels.join(targets, levels["src"].eqNullSafe(targets["src"])).drop(levels["src"]).withColumn("measure", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")))
    down = Window.partitionBy("src").orderBy(F.desc("level"))
    above = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("measure") * F.col("size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("left", F.col("wanted") - above).withColumn("rest", rest)
    rows = rows.withColumn("full", (F.col("rest") > 0) & (F.col("left") * F.col("measure") >= F.col("rest")))  # if all levels above are
    scale = F.when(~F.col("full") & (F.col("rest") > 0), F.col("left") / F.col("rest"))
    whole = Window.partitionBy("src")
    first = F.max(F.when(~F.col("full"), F.struct("level", scale.alias("scale"), "left"))).over(whole)  # the highest that is not
    rows = rows.withColumn("first", first)
    inclusion = F.when(~F.col("full") & (F.col("first.scale") > 0), F.col("first.scale") * F.col("measure"))
    out = rows.withColumn("inclusion", inclusion).withColumn("whole", F.col("certain") + F.col("full").cast("long")).withColumn("wanted", F.coalesce("first.left", F.lit(0.0)))
    return out.select("src", "level", "source_size", "target", "whole", "wanted", "inclusion")


def _rank(planned: DataFrame, seed: str) -> DataFrame:
    """Adds q, the Pareto rank; null where nothing is left to sample."""
    u = _uniform(F.col("id"), seed)
    return planned.withColumn("q", (u / (1 - u)) / (F.col("inclusion") / (1 - F.col("inclusion"))))


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's columns beside each row of its source and level."""
    plan = plan.withColumnRenamed("src", "plan_src").withColumnRenamed("level", "plan_level")
    return rows.join(plan, F.col("src").eqNullSafe(F.col("plan_src")) & (F.col("level") == F.col("plan_level"))).drop("plan_src", "plan_level")


def plan_mix(sized: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix", bins: int = BINS) -> DataFrame:
    """sized: id, src, size, level. One row a source and level: its target, whole copies, inclusion, and the last rank that is sampled."""
    levels = materialize(sized.groupBy("src", "level").agg(F.sum("size").alias("size")), "mix-levels")
    plan = materialize(inclusions(levels, source_targets(levels, weights, share, cap)), "mix-inclusions")
    ranked = _rank(_planned(sized, plan), seed).filter("q is not null")
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int"))
    per_bin = ranked.groupBy("src", "bin", "wanted").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = per_bin.withColumn("upto", F.sum("n").over(upto)).filter("upto >= wanted").groupBy("src").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    cut = cut.select(F.col("src").alias("cut_src"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
    inside = ranked.join(cut, F.col("src").eqNullSafe(F.col("cut_src")) & (F.col("bin") == F.col("cut_bin")))
    seen = Window.partitionBy("src").orderBy("q", F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("ahead", F.col("before") + F.sum("size").over(seen) - F.col("size"))
    last = inside.filter(2 * F.col("ahead") + F.col("size") <= 2 * F.col("wanted")).groupBy("src").agg(F.max(F.struct("q", F.coalesce("id", F.lit(9223372036854775807)).alias("id"))).alias("last"))
    last = last.select(F.col("src").alias("last_src"), "last")
    out = plan.join(cut, F.col("src").eqNullSafe(F.col("cut_src")), "left").join(last, F.col("src").eqNullSafe(F.col("last_src")), "left")
    return materialize(out.select("src", "level", "source_size", "target", "whole", "wanted", "inclusion", "cut_bin", "last"), "mix-plan")


def apply_mix(rows: DataFrame, plan: DataFrame, *, seed: str = "mix", bins: int = BINS) -> DataFrame:
    """rows: id, src, level and any others. Adds the plan's columns, and copies, the times that a row is taken."""
    out = _rank(_planned(rows, plan), seed)
    place = F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int")
    inside = F.struct(F.col("q"), F.coalesce("id", F.lit(9223372036854775807)).alias("id")) <= F.col("last")
    more = F.when(F.col("q").isNull(), 0).when(F.col("cut_bin").isNull() | (place < F.col("cut_bin")), 1).when(place > F.col("cut_bin"), 0).otherwise(F.when(inside, 1).otherwise(0))
    return out.withColumn("copies", F.col("whole") + more.cast("long"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("src"), words(F.col(text_col)).alias("size")).withColumn("level", level(F.col("size")))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies, whole, inclusion: one row a document.

    whole: the copies that are certain; inclusion: the probability of one more.
    """
    sized = materialize(sizes(docs), "mix-sizes")
    plan = plan_mix(sized, weights=weights, share=share, cap=cap, seed=seed)
    out = apply_mix(sized, plan, seed=seed)
    return out.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "whole", F.coalesce("inclusion", F.lit(0.0)).alias("inclusion"))


def repeat_rows(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it."""
    plan = plan_mix(materialize(sizes(docs), "mix-sizes"), weights=weights, share=share, cap=cap, seed=seed)
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("src"), level(words(F.col("text"))).alias("level"))
    taken = apply_mix(held, plan, seed=seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id AS id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src
), ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY src ASC NULLS LAST) - 1) % 3) + 1] AS w, source_size * 2 AS cap FROM sources
), commons AS (
  SELECT *, (CAST((sum(source_size) OVER ()) AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, src ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, src ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM ranked
), targets AS (
  SELECT src, source_size, least(CAST(cap AS DOUBLE), max(lv) OVER () * w) AS target FROM commons
), planned AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS certain FROM targets
), wants AS (
  SELECT *, target - certain * source_size AS wanted FROM planned
), levels AS (
  SELECT src, (length(bin(size)) - 1) // 2 AS level, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY 1, 2
), scaled AS (
  SELECT w.*, l.level, l.s, CAST(1 AS BIGINT) << l.level AS measure, wanted - coalesce(CAST(sum(l.s) OVER (PARTITION BY w.src ORDER BY l.level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rem,
    CAST(sum(l.s * (CAST(1 AS BIGINT) << l.level)) OVER (PARTITION BY w.src ORDER BY l.level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM wants w JOIN levels l ON l.src IS NOT DISTINCT FROM w.src
), filled AS (
  SELECT *, rest > 0 AND rem * measure >= rest AS is_full FROM scaled
), highest AS (
  SELECT *, max({'level': level, 'scale': CASE WHEN rest > 0 THEN rem / rest END, 'rem': rem}) FILTER (NOT is_full) OVER (PARTITION BY src) AS top FROM filled
), chances AS (
  SELECT src, level, source_size, target, certain + CASE WHEN is_full THEN 1 ELSE 0 END AS whole, coalesce(top.rem, 0) AS wanted, CASE WHEN NOT is_full AND top.scale > 0 THEN top.scale * measure END AS inclusion FROM highest
), r AS (
  SELECT *, (u / (1 - u)) / (inclusion / (1 - inclusion)) AS rk FROM (
    SELECT s.id, s.size, c.*, (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(s.id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
    FROM sized s JOIN chances c ON s.src IS NOT DISTINCT FROM c.src AND (length(bin(s.size)) - 1) // 2 = c.level)
), c AS (
  SELECT *, CAST(sum(CASE WHEN rk IS NULL THEN 0 ELSE size END) OVER (PARTITION BY src ORDER BY rk NULLS LAST, id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS ahead FROM r
), d AS (
  SELECT *, whole + CASE WHEN rk IS NOT NULL AND 2 * ahead + size <= 2 * wanted THEN 1 ELSE 0 END AS copies FROM c
)
SELECT id AS doc_id, src AS source, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, CAST(whole AS BIGINT) AS whole, coalesce(inclusion, 0) AS inclusion FROM d
"""
