"""Document fingerprints of closed syncmers, with DataFrame functions only.

A text's words (in scripts without spaces, its characters) are hashed. A k-mer is k words in a row; its inner
substrings are the s-mers of s words. A k-mer is an anchor if its least s-mer is its first or its last: a rule that
looks at nothing outside the k-mer, so an edit changes only the anchors that it touches, and every k - s k-mers in a
row hold an anchor. A fingerprint is the sequence of a text's anchors, each with its position.

Two fingerprints are matched by position: of the anchors that both hold, at their first places, those are in line that
stand at the same position in both or are shifted by as many words as another one. Likeness is the share of the anchors
in line among all distinct anchors of the two. Words put in or taken out shift what follows as a whole and cost only
the anchors around them; anchors that two texts share by chance, each shifted by its own distance, count for nothing.

The next document of each is found without a global sort. Ids fall into cells of equal width; cells that hold more
than a block's rows are cut again, by id, then by the text's hash, so neither far-off nor repeated ids gather in one;
runs of cells make blocks of about BLOCK_ROWS rows. The texts are shuffled once, by block, and the first document of a
block is sent to the block before as well.

Defined cases: null text is empty text; a text without words has an empty fingerprint, and two of these are alike
(1.0); a text too short for an anchor has one anchor, of all its words; rows of equal doc_id follow in the order of
their text's hash; null ids come first; a single document follows itself; an empty table gives an empty result;
other columns of the input are never read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 6, 2
#: Rows of a block of neighbouring ids; blocks at most (what is broadcast is a row a block or a cell); tasks at most.
BLOCK_ROWS, BLOCKS, CELLS_PER_BLOCK, BLOCKS_PER_TASK, TASKS = 250, 100_000, 4, 4, 20_000
#: Times that cells are cut again: each cut makes a heavy cell's range at least four times smaller.
CUTS = 100

#: Scripts that are written without spaces between words, as ranges of code points.
_NO_SPACES = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{323AF}"
_WHITE = "\t\n\x0b\x0c\r "


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; each character of a script without spaces is one."""
    apart = F.regexp_replace(text, f"([{_NO_SPACES}])", " $1 ")
    trimmed = F.btrim(apart, F.lit(_WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_anchors(df: DataFrame, text: str, out: str, *, k: int = K, s: int = S) -> DataFrame:
    """Adds out: array of longs, a text's anchors in order: the hash's 32 bits above the position's."""
    w, m, at = f"_{out}_words", f"_{out}_inner", f"_{out}_at"
    span = k - s + 1  # s-mers of a k-mer
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
    inner = F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(s)]))
    df = df.withColumn(m, F.when(F.size(w) >= k, inner))
    smer = lambda i, j: F.get(F.col(m), i + j)
    edge = lambda i: F.least(smer(i, 0), smer(i, span - 1)) <= F.least(*[smer(i, j) for j in range(1, span - 1)])
    df = df.withColumn(at, F.when(F.size(w) >= k, F.filter(F.sequence(F.lit(0), F.size(w) - k), edge)))
    packed = lambda position, h: F.shiftleft(h, 32).bitwiseOR(position.cast("long"))
    found = F.transform(F.col(at), lambda i: packed(i, F.xxhash64(F.slice(F.col(w), i + 1, F.lit(k)))))
    whole = F.array(packed(F.lit(0), F.xxhash64(F.col(w))))
    none = F.array().cast("array<long>")
    return df.withColumn(out, F.when(F.size(w) == 0, none).when(F.coalesce(F.size(at), F.lit(0)) > 0, found).otherwise(whole)).drop(w, m, at)


def written(anchors: Column) -> Column:
    """A fingerprint as a string: position:hash of each anchor, in order."""
    one = lambda x: F.concat(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0")))
    return F.array_join(F.transform(anchors, one), " ")


def with_firsts(df: DataFrame, anchors: str, out: str) -> DataFrame:
    """Adds out: each distinct anchor at its first position, in order of hash."""
    by = f"_{out}_sorted"
    df = df.withColumn(by, F.sort_array(anchors))
    new = lambda x, i: (i == 0) | (F.shiftrightunsigned(F.get(F.col(by), i - 1), 32) != F.shiftrightunsigned(x, 32))
    return df.withColumn(out, F.filter(F.col(by), new)).drop(by)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds out: the likeness of the fingerprints whose firsts are a and b; 1.0 for two empty ones."""
    both, shifts = f"_{out}_both", f"_{out}_shifts"
    # positions stay below 2^30, so a side fits beside them: hash, position, side
    sided = lambda column, side: F.transform(column, lambda x: F.shiftleft(F.shiftrightunsigned(x, 32), 32).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), 1)).bitwiseOR(F.lit(side)))
    df = df.withColumn(both, F.sort_array(F.concat(sided(F.col(a), 0), sided(F.col(b), 1))))
    here, after = lambda i: F.get(F.col(both), i), lambda i: F.get(F.col(both), i + 1)
    same = lambda i: F.shiftrightunsigned(here(i), 32) == F.shiftrightunsigned(after(i), 32)
    place = lambda x: F.shiftrightunsigned(x.bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    shift = lambda i: F.when(here(i).bitwiseAND(F.lit(1)) == 0, place(after(i)) - place(here(i))).otherwise(place(here(i)) - place(after(i)))
    pairs = F.when(F.size(both) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(both) - 2))
    df = df.withColumn(shifts, F.sort_array(F.transform(F.filter(pairs, same), shift)))
    agreed = lambda x, i: (x == 0) | F.coalesce(F.get(F.col(shifts), i - 1) == x, F.lit(False)) | F.coalesce(F.get(F.col(shifts), i + 1) == x, F.lit(False))
    in_line, either = F.size(F.filter(F.col(shifts), agreed)), F.size(both) - F.size(shifts)
    return df.withColumn(out, F.when(either == 0, F.lit(1.0)).otherwise(in_line / either)).drop(both, shifts)


def _stats(keys: DataFrame, columns: list[str]) -> dict[int, tuple]:
    """Of each cell the number of rows, and the range of each key column."""
    ranges = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]
    return {r["cell"]: (r["n"], [(r[f"low_{c}"], r[f"high_{c}"]) for c in columns]) for r in keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ranges).collect()}


def _refined(rows: DataFrame, cuts: DataFrame, columns: list[str]) -> DataFrame:
    """rows: cell and the key columns. Moves the rows of the cut cells to the cells that these were cut into."""
    value = F.coalesce(*[F.when(F.col("cut_by") == i, F.col(c)) for i, c in enumerate(columns)])
    far = F.floor((value.cast("double") - F.col("cut_low").cast("double")) / F.col("cut_width").cast("double")).cast("long")
    part = F.when(F.col("cut_far"), far).otherwise(F.floor((value - F.col("cut_low")) / F.col("cut_width")).cast("long"))
    moved = rows.join(F.broadcast(cuts), F.col("cell") == F.col("cut_cell"), "left")
    part = F.when(F.col("cut_cell").isNotNull(), F.col("cut_base") + F.least(part, F.col("cut_parts") - 1))
    return moved.withColumn("cell", F.coalesce(part, F.col("cell"))).drop("cut_cell", "cut_by", "cut_low", "cut_width", "cut_far", "cut_base", "cut_parts")


def _cut(keys: DataFrame, columns: list[str], rows: int) -> tuple[list[DataFrame], list[tuple[int, int, int]], bool]:
    """The cuts one after another; (cell, rows, least first key) of each cell that is left, in order; whether all are small.

    The driver holds a few numbers for each cell, CELLS_PER_BLOCK cells or so for each block.
    """
    spark, cuts, inside, used = keys.sparkSession, [], {}, 1
    keys = keys.withColumn("cell", F.lit(0).cast("long"))
    found = known = _stats(keys, columns)
    for _ in range(CUTS):
        made = []
        for cell, (n, ranges) in known.items():
            by = next((i for i, (low, high) in enumerate(ranges) if low != high), None)
            if n > rows and by is not None:
                low, high = ranges[by]
                parts = min(CELLS_PER_BLOCK * -(-n // rows), high - low + 1)
                width = -(-(high - low + 1) // parts)
                far = width * parts >= 1 << 52  # beyond what a double holds exactly
                made.append((cell, by, low, float(width), far, used, parts))
                inside[cell] = range(used, used + parts)
                used += parts
        if not made:
            break
        cuts.append(spark.createDataFrame(made, "cut_cell long, cut_by int, cut_low long, cut_width double, cut_far boolean, cut_base long, cut_parts long").coalesce(1))
        keys = _refined(keys, cuts[-1], columns)
        known = _stats(keys.filter(F.col("cell") >= made[0][5]), columns)
        found = found | known
    order, todo = [], [0] if 0 in found else []
    while todo:
        cell = todo.pop()
        if cell in inside:
            todo += [c for c in reversed(inside[cell]) if c in found]
        else:
            n, ranges = found[cell]
            order.append((cell, n, ranges[0][0]))
    return cuts, order, all(n <= rows for _, n, _ in order)


def with_blocks(docs: DataFrame, *, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """docs: doc_id, text. key, order, tie, row, text, block, first, before; and the number of blocks.

    order, tie and row give the order of the documents; first is the least order of the block, before the block before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("order"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    most = max(block_rows, -(-rows.count() // BLOCKS))
    columns = ["order"]
    cuts, cells, small = _cut(rows.select(*columns), columns, most)
    if not small:  # ids that very many rows share
        columns = ["order", "tie", "row"]
        cuts, cells, _ = _cut(rows.select(*columns), columns, most)
    blocks, firsts, ahead = [], [], most
    for cell, n, first in cells:
        if ahead + n > most:
            firsts.append(first)
            ahead = 0
        ahead += n
        blocks.append((cell, len(firsts) - 1))
    table = [(cell, block, firsts[block], (block - 1) % len(firsts)) for cell, block in blocks]
    spark = docs.sparkSession
    table = spark.createDataFrame(table, "cell long, block long, first long, before long").coalesce(1)
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    for cut in cuts:
        rows = _refined(rows, cut, columns)
    return rows.join(F.broadcast(table), "cell").drop("cell"), len(firsts)


def with_next(docs: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text, anchors, firsts, next_text, next_firsts: the text (empty for null) and what follows in order of doc_id."""
    rows, blocks = with_blocks(docs, block_rows=block_rows)
    own = F.struct(F.col("block").alias("to"), F.lit(False).alias("lent"))
    to = F.when(F.col("order") == F.col("first"), F.array(own, F.struct(F.col("before").alias("to"), F.lit(True).alias("lent")))).otherwise(F.array(own))
    sent = rows.select("key", "order", "tie", "row", "text", F.explode(to).alias("t")).select("key", "order", "tie", "row", "text", "t.to", "t.lent")
    sent = sent.repartition(max(1, min(TASKS, blocks // BLOCKS_PER_TASK)), "to")
    sent = with_firsts(with_anchors(sent, "text", "anchors"), "anchors", "firsts")
    follow = Window.partitionBy("to").orderBy("lent", "order", "tie", "row")
    out = sent.withColumn("next_text", F.lead("text").over(follow)).withColumn("next_firsts", F.lead("firsts").over(follow)).filter(~F.col("lent"))
    return out.select(F.col("key").alias("doc_id"), "text", "anchors", "firsts", "next_text", "next_firsts")


def fingerprint_edits(docs: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors: one row a row of docs."""
    rows = with_next(docs, block_rows=block_rows).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_firsts(with_anchors(rows.withColumn("edited", edited), "edited", "edited_anchors"), "edited_anchors", "edited_firsts")
    rows = with_likeness(with_likeness(rows, "firsts", "edited_firsts", "near_edited"), "firsts", "next_firsts", "near_next")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("anchors")).alias("fingerprint"), written(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("anchors").cast("long").alias("n_anchors"),
    )
