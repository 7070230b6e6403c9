"""N-gram Jaccard join by T-occurrence search (DivideSkip), distributed over blocks.

1. Each whole text becomes the set of its distinct k-word shingles, hashed to 64 bits. Documents of equal sets form a
   class; only one of each goes on.
2. Two linked sets of sizes a and b share at least T = ceil(similar * (a + b) / (1 + similar)) shingles, hence at
   least one among the first n - ceil(similar * n) + 1 of each in any common order (the prefix). The order here puts
   rare shingles first: of a fixed share of the hash space (SHARE) the document frequency is counted, and shingles
   that only one class holds fall out at once; the rest of the space follows by hash, and shingles found to be very
   frequent in a sample of documents come last. What the sample misses costs time, never a link.
3. Classes that share a prefix shingle fall into candidate components. These are cut into bands of size and chunks
   of CHUNK classes; a block is a pair of chunks that may hold links. A component of more than PAIRED chunks in a band
   is cut by prefix shingle instead: the holders of each shingle make blocks, and a pair counts where its least common
   prefix shingle is. A block is searched on its own: its shingles' inverted lists are built, and for each class
   DivideSkip heap-merges the short lists, jumping over classes that cannot occur often enough, probes the long ones by
   binary search, and keeps every class that occurs at least T times. Occurrences are exact, so no link is missed and
   none is false.
4. A block returns a spanning forest of its links and each class's number of links; connected components of the
   forests give the documents' components.

Nothing is capped: a long list or a large component makes more blocks, not dropped pairs. Shingles, components and
classes that hold many rows are joined by a bounded broadcast (common.lookup).

Defined cases: null text and text without words have no shingle, link with nothing and are their own component; texts
of fewer than k words have one shingle, the whole sequence; a null doc_id takes part but never names a component
unless it has none but nulls; repeated rows are copies of one class; an empty table gives an empty result; other
columns of the input are never read, whatever they are called.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, row_key, rows_of
from .components import components

#: Classes of a chunk, and rows that a task holds at once.
CHUNK = 512
TASK_ROWS = 1500
#: One of so many documents is looked at for very frequent shingles; of these at most so many are noted.
SAMPLED_ONE_IN, FREQUENT = 64, 20_000
#: Chunks of one band up to which a component's blocks are pairs of chunks.
PAIRED = 48
#: Bits of the filter that keeps documents out of the last shuffle.
FILTER_BITS = 1 << 25
#: DivideSkip's weight of a probe against a merge step.
PROBE = 0.0085
#: Long lists that are probed before sets that cannot get there any more are left out.
PROBED = 16
SLICE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _shingled(texts: list[bytes], k: int) -> list[np.ndarray]:
    """bytes.lower() and bytes.split() change and split at exactly the characters of the contract: A-Z and ASCII white space."""
    split = [t.lower().split() for t in texts]
    edges = np.cumsum([0, *map(len, split)])
    flat = np.empty(edges[-1], object)
    flat[:] = [w for words in split for w in words]
    words = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        windows = max(0, len(words) - k + 1)
        grams = np.zeros(windows, np.uint64)
        for j in range(k if windows else 0):
            grams += _mix(words[j : j + windows] + np.uint64(j + 1) * _BASE)
        grams = _mix(grams)
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            n = int(b - a)
            if n >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif n:
                out.append(_mix(_mix(words[a:b] + np.arange(101, 101 + n, dtype=np.uint64) * _BASE).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, out, first = [(t or "").encode() for t in texts], [], 0
    while first < len(raw):
        last, size = first, 0
        while last < len(raw) and (last == first or size + len(raw[last]) < SLICE):
            size += len(raw[last])
            last += 1
        out += _shingled(raw[first:last], k)
        first = last
    return out


class Threshold:
    """similar = num / den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def needed(self, a, b):
        """Shingles that linked sets of sizes a and b share at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1

    def share(self) -> float:
        """Of the hash space, so that most sets' prefixes lie within it."""
        return min(1.0, 2 * (1 - self.num / self.den))


def _sets(k: int, limit: Threshold, frequent: np.ndarray):
    """For each document its set's size and checksums, and the shingles that may open its prefix."""
    bound = np.uint64(min(limit.share() * 2.0**64, 2.0**64 - 2048))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, counted, further = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    high.append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    low.append(int(_mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))
                rare = s
                if len(frequent) and len(s):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    is_frequent = frequent[at] == s
                    rare = s[~is_frequent]
                here = rare[rare < bound]
                missing = int(limit.prefix(len(s))) - len(here) if len(s) else 0
                more = here[:0]
                if missing > 0:
                    more = np.concatenate([rare[len(here) : len(here) + missing], s[is_frequent] if len(rare) < len(s) else rare[:0]])[:missing]
                counted.append(here.astype(np.int64))
                further.append(more.astype(np.int64))
            lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in c])].astype(np.int32), pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())) for c in (counted, further)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), *lists], names=["row", "doc_id", "text_hash", "n", "high", "low", "counted", "further"])

    return run


SET_SCHEMA = "row long, doc_id long, text_hash long, n long, high long, low long, counted array<long>, further array<long>"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _frequent(docs: DataFrame, k: int, limit: Threshold) -> np.ndarray:
    """Shingles that stand in very many documents of a sample: a hint for the order, of bounded size."""
    some = _rows(docs).filter(F.pmod("text_hash", F.lit(SAMPLED_ONE_IN)) == 0).dropDuplicates(["text_hash"])
    sets = materialize(some.mapInArrow(_sets(k, limit, np.zeros(0, np.uint64)), SET_SCHEMA), "jaccard-sample")
    least = max(8, sets.count() // 500)
    found = sets.select(F.explode("counted").alias("s")).groupBy("s").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(FREQUENT)
    return np.sort(np.array([r["s"] for r in found.select("s").collect()], np.int64).astype(np.uint64))


def merge_skip(flat: list[int], spans: list[tuple[int, int]], least: int) -> tuple[list[int], list[int]]:
    """Numbers that stand in at least `least` of the sorted lists flat[a:b], and in how many.

    A heap holds the head of each list. A head that too few lists share is left behind together with the next ones, as
    many as make least - 1 lists in all; these lists jump, by binary search, to the head that is then on top.
    """
    w = len(spans)
    at, end = [a for a, _ in spans], [b for _, b in spans]
    heap = [flat[a] * w + i for i, (a, b) in enumerate(spans) if a < b]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    found, counts = [], []
    while len(heap) >= least:
        top = heap[0] // w
        above, popped = (top + 1) * w, []
        while heap and heap[0] < above:
            popped.append(pop(heap) % w)
        if len(popped) >= least:
            found.append(top)
            counts.append(len(popped))
            for i in popped:
                at[i] = a = at[i] + 1
                if a < end[i]:
                    push(heap, flat[a] * w + i)
            continue
        while heap and len(popped) < least - 1:
            popped.append(pop(heap) % w)
        if not heap:
            break
        top = heap[0] // w
        for i in popped:
            at[i] = a = bisect_left(flat, top, at[i], end[i])
            if a < end[i]:
                push(heap, flat[a] * w + i)
    return found, counts


class Index:
    """The inverted lists of some sets, which are numbered in order of size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        tokens, of = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.size)
        by = np.argsort(tokens, kind="stable")
        tokens = tokens[by]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        self.tokens, self.starts = tokens[first], np.r_[first, len(tokens)]
        self.postings = of[by].tolist()
        self.keys = np.repeat(np.arange(len(first)), np.diff(self.starts)) * len(sets) + of[by]  # list and number in one

    def search(self, query: np.ndarray, low: int, high: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """DivideSkip: the sets from low up to high that share at least needed[set] tokens with query, and how many."""
        none = np.zeros(0, np.int64)
        if low >= high or not len(self.tokens):
            return none, none
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        lists = at[self.tokens[at] == query]
        least = int(needed[low:high].min())
        if len(lists) < least:
            return none, none
        lists = lists[np.argsort(self.starts[lists + 1] - self.starts[lists], kind="stable")]
        longest = int(self.starts[lists[-1] + 1] - self.starts[lists[-1]])
        n_long = max(0, min(int(least / (PROBE * math.log2(max(2, longest)) + 1)), least - 1))
        n_short = len(lists) - n_long
        short = lists[:n_short]
        spans = [(bisect_left(self.postings, low, a, b), bisect_left(self.postings, high, a, b)) for a, b in zip(self.starts[short].tolist(), self.starts[short + 1].tolist(), strict=True)]
        found, counts = (np.array(x, np.int64) for x in merge_skip(self.postings, spans, least - n_long))
        for i in range(n_short, len(lists), PROBED):  # probes, while a set may still get there
            alive = counts + (len(lists) - i) >= needed[found]
            found, counts = found[alive], counts[alive]
            if not len(found):
                return none, none
            wanted = (lists[i : i + PROBED, None] * len(self.size) + found).ravel()
            hit = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
            counts = counts + hit.reshape(-1, len(found)).sum(axis=0)
        keep = counts >= needed[found]
        return found[keep], counts[keep]


def search_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, limit: Threshold) -> list[tuple[int, int]]:
    """Linked pairs (i, j), i in left and j in right. Either all sets are on both sides, each pair then once, or none is."""
    order = np.flatnonzero(left)
    order = order[np.argsort([len(sets[i]) for i in order], kind="stable")]
    index = Index([sets[i] for i in order])
    place = np.full(len(sets), len(order))
    place[order] = np.arange(len(order))
    out = []
    for q in np.flatnonzero(right).tolist():
        n = len(sets[q])
        low = int(np.searchsorted(index.size * limit.den, limit.num * n))
        high = min(int(np.searchsorted(index.size * limit.num, limit.den * n, side="right")), int(place[q]))
        found, _ = index.search(sets[q], low, high, limit.needed(index.size, n))
        out += [(x, q) for x in order[found].tolist()]
    return out


LINK_SCHEMA = "u long, v long, links long"


def _searcher(k: int, limit: Threshold):
    """Searches the blocks of one task's group: rows block, side (0 left, 1 right, 2 both), shingle, row, weight, prefix, text.

    Where a block is a shingle's, prefix holds a row's prefix shingles, and a pair counts only at its least common one.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("row", "ascending")])
        block, side, row, weight = (table.column(c).to_numpy() for c in ("block", "side", "row", "weight"))
        text, shingle, prefix = table.column("text"), table.column("shingle"), table.column("prefix")
        u, v, n = [], [], []
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() + [len(block)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            at = np.arange(a, b)
            at = at[np.r_[True, row[at][1:] != row[at][:-1]]]  # a repeated document comes once
            sets = shingle_sets(text.take(pa.array(at)).to_pylist(), k)
            pairs = search_block(sets, side[at] != 1, side[at] != 0, limit)
            here = shingle[a].as_py()
            if here is not None:
                held = [frozenset(x) for x in prefix.take(pa.array(at)).to_pylist()]
                pairs = [(i, j) for i, j in pairs if min(held[i] & held[j]) == here]
            root = list(range(len(at)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = np.zeros(len(at), np.int64)
            for i, j in pairs:
                links[i] += weight[at[j]]
                links[j] += weight[at[i]]
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    u.append(int(row[at[max(i, j)]]))
                    v.append(int(row[at[min(i, j)]]))
                    n.append(0)
            for i in np.flatnonzero(links).tolist():
                u.append(int(row[at[i]]))
                v.append(int(row[at[i]]))
                n.append(int(links[i]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(n, pa.int64())})

    return run


def _bit(doc_id: str, text_hash: str):
    return 1 + F.pmod(F.xxhash64(doc_id, text_hash), F.lit(FILTER_BITS))  # bit maps count from 1


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs that may be among wanted (doc_id, text_hash), by a bit map of bounded size."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in wanted.select(_bit("doc_id", "text_hash").alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * len(part)
        bits[at : at + len(part)] = part[: max(0, len(bits) - at)]
    packed = bits.tobytes()

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy()
        at = b - 1
        mask = np.frombuffer(packed, np.uint8)
        return pd.Series((mask[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1)

    return docs.filter(maybe(_bit("doc_id", "text_hash")))


def _prefixes(sets: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
    """row, s: prefix shingles that other classes hold too, or may hold."""
    total = sets.agg(F.sum(F.size("counted"))).first()[0] or 0
    each = classes.select("row", F.explode("counted").alias("s"))
    shared_by = materialize(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "jaccard-shared")
    some = lookup(each, shared_by, ["s"], "df", total).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    sizes = sets.select(F.col("row").alias("of"), (F.col("n") - F.ceil(F.col("n") * limit.num / limit.den) + 1).alias("p"), F.size("counted").alias("held"))
    left = (F.col("p") - (F.col("held") - F.size("shared"))).cast("int")  # places of the prefix that lone shingles don't fill
    counted = some.join(sizes, F.col("row") == F.col("of")).filter(left > 0).select("row", F.explode(F.slice("shared", F.lit(1), left)).alias("x")).select("row", F.col("x.s").alias("s"))
    further = classes.filter(F.size("further") > 0).select("row", F.explode("further").alias("s"))
    return counted.union(further)


def _pairs(chunks: Column, chunk: Column, name) -> Column:
    """For each unordered pair of a chunk with a chunk of the same kind: block, and side (2 for the chunk with itself)."""
    every = F.sequence(F.lit(0), chunks - 1)
    return F.transform(every, lambda c: F.struct(name(F.least(chunk, c), F.greatest(chunk, c)).alias("block"), F.when(c == chunk, 2).when(c > chunk, 0).otherwise(1).alias("side")))


def _plan(active: DataFrame, limit: Threshold) -> tuple[DataFrame, Column]:
    """One row a component and band: its classes, its chunks and its neighbours'; and the band of a class."""
    # bands of size: linked sets lie in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(limit.den / limit.num) * 1.0000001)).cast("int")
    whole, by_band = Window.partitionBy("root"), Window.partitionBy("root").orderBy("band")
    plan = active.groupBy("root", band.alias("band")).agg(F.count(F.lit(1)).alias("times")).withColumn("all", F.sum("times").over(whole))
    plan = plan.withColumn("chunks", F.when(F.col("all") <= CHUNK, 1).otherwise(F.ceil(F.col("times") / F.lit(CHUNK))).cast("int"))
    beside = lambda by, at: F.when((F.col("all") > CHUNK) & (at("band") == F.col("band") + by), at("chunks")).otherwise(0)
    plan = plan.withColumn("below", F.coalesce(beside(-1, lambda c: F.lag(c).over(by_band)), F.lit(0))).withColumn("above", F.coalesce(beside(1, lambda c: F.lead(c).over(by_band)), F.lit(0)))
    plan = plan.withColumn("listed", F.max("chunks").over(whole) > PAIRED).withColumn("one", F.col("all") <= CHUNK)
    return materialize(plan.drop("all"), "jaccard-plan"), band


def _blocks(active: DataFrame, prefixes: DataFrame, leaders: DataFrame, limit: Threshold) -> DataFrame:
    """row, doc_id, text_hash, weight, shingle, prefix, block, side: each class in each block that it takes part in."""
    plan, band = _plan(active, limit)
    placed = lookup(active.withColumn("band", band), plan, ["root", "band"], "times", active.count())
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn("band", F.when(F.col("one"), 0).otherwise(F.col("band")))
    kept = ["row", "doc_id", "text_hash", "weight"]
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda b1, c1, b2, c2: F.xxhash64("root", b1, c1, b2, c2)
    own = _pairs(F.col("chunks"), F.col("chunk"), lambda a, b: name("band", a, "band", b))
    lower = F.transform(upto("below"), lambda c: F.struct(name(F.col("band") - 1, c, "band", "chunk").alias("block"), F.lit(1).alias("side")))
    upper = F.transform(upto("above"), lambda c: F.struct(name("band", "chunk", F.col("band") + 1, c).alias("block"), F.lit(0).alias("side")))
    none = [F.lit(None).cast("long").alias("shingle"), F.lit(None).cast("array<long>").alias("prefix")]
    out = placed.filter("not listed").select(*kept, *none, F.explode(F.concat(own, lower, upper)).alias("x")).select(*kept, "shingle", "prefix", "x.*")
    if plan.filter("listed").limit(1).count():
        large = placed.filter("listed").select(*kept)
        held = prefixes.join(large.select("row"), "row", "left_semi")
        whole = held.groupBy("row").agg(F.collect_set("s").alias("prefix"))
        each = lookup(held, leaders, ["s"], "c", prefixes.count()).withColumn("chunks", F.ceil(F.col("c") / F.lit(CHUNK)).cast("int"))
        chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")).cast("int")
        each = each.select("row", F.col("s").alias("shingle"), F.explode(_pairs(F.col("chunks"), chunk, lambda a, b: F.xxhash64("s", a, b))).alias("x"))
        out = out.unionByName(large.join(whole, "row").join(each, "row").select(*kept, "shingle", "prefix", "x.*"))
    return materialize(out, "jaccard-blocks")


def link_classes(docs: DataFrame, k: int, limit: Threshold) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id, text_hash, n, high, low; links: u, v, links as of the blocks' search)."""
    frequent = _frequent(docs, k, limit)
    sets = materialize(_rows(docs).mapInArrow(_sets(k, limit, frequent), SET_SCHEMA), "jaccard-sets")
    first = F.min_by(F.struct("row", "counted", "further"), "row").alias("x")
    classes = sets.filter("n > 0").groupBy("high", "low", "n").agg(first).select("x.*")
    prefixes = materialize(_prefixes(sets, classes, limit), "jaccard-prefixes")
    leaders = materialize(prefixes.groupBy("s").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "jaccard-leaders")
    near = lookup(prefixes, leaders, ["s"], "c", prefixes.count()).filter("row <> leader").select(F.col("row").alias("u"), F.col("leader").alias("v")).distinct()
    found = components(near)
    small = sets.filter("n > 0").groupBy("high", "low", "n").agg(F.min_by(F.struct("row", "doc_id", "text_hash"), "row").alias("x"), F.count(F.lit(1)).alias("weight")).select("n", "weight", "x.*")
    active = materialize(small.join(found, small["row"] == found["node"]).select("row", "doc_id", "text_hash", "n", "weight", "root"), "jaccard-active")
    placed = _blocks(active, prefixes, leaders, limit)
    groups = max(1, -(-placed.count() // TASK_ROWS))
    key = [F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_hash")]
    texts = _among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), active)
    texts = texts.select(*key, "text").groupBy("key_id", "no_id", "text_hash").agg(F.min("text").alias("text"))  # a repeated row sends one text a map task
    shipped = placed.select(*key, F.pmod("block", F.lit(groups)).alias("group"), "block", "side", "shingle", "row", "weight", "prefix").join(texts, ["key_id", "no_id", "text_hash"])
    shipped = shipped.select("group", "block", "side", "shingle", "row", "weight", "prefix", "text")
    links = materialize(shipped.groupBy("group").applyInArrow(_searcher(k, limit), LINK_SCHEMA), "jaccard-links")
    for table in (prefixes, leaders, active, placed):
        discard(table)
    return sets.select("row", "doc_id", "text_hash", "n", "high", "low"), links


def _joined(docs: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """doc_id, text_hash, n, component_id, stays, class_size, n_links: one row a row of docs."""
    rows, links = link_classes(docs, k, limit)
    roots = components(links.filter("links = 0").select("u", "v"))
    degree = links.filter("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    # of a component the least doc_id stays, null ids last, of equal ids the least text hash
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    classes = rows.filter("n > 0").groupBy("high", "low", "n").agg(F.min("row").alias("first"), best, F.count(F.lit(1)).alias("class_size"))
    known = classes.join(roots, classes["first"] == roots["node"], "left").join(degree, F.col("first") == degree["u"], "left")
    known = materialize(known.select("high", "low", "n", "best", "class_size", F.coalesce("root", "first").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-classes")
    named = materialize(known.groupBy("root").agg(F.min("best").alias("least"), F.count(F.lit(1)).alias("classes")), "jaccard-named")
    known = lookup(known.drop("best"), named, ["root"], "classes", known.count()).select("high", "low", "n", "class_size", "links", "least")
    known = materialize(known, "jaccard-known")
    out = lookup(rows.filter("n > 0"), known, ["high", "low", "n"], "class_size", rows.count())
    out = out.select(
        "doc_id", "text_hash", "n", F.col("least.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("stays"),
        "class_size", (F.col("links") + F.col("class_size") - 1).cast("long").alias("n_links"),
    )
    alone = rows.filter("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def jaccard_join(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size, n_links: one row a row of docs.

    n_links counts the other documents that a document is linked with, copies included.
    """
    out = _joined(docs, k, Threshold(num, den)).withColumnRenamed("n", "n_shingles")
    return out.select("doc_id", "n_shingles", "component_id", "class_size", "n_links")


def keep_one(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called: of each component one.

    It is the row of the least doc_id; null ids come last; of equal ids that of the least text hash. Rows without any
    shingle stay. A row whose id and text are repeated comes once, with the other columns of the one whose columns hash least.
    """
    found = _joined(docs, k, Threshold(num, den)).filter("stays").select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key")).distinct()
    return rows_of(docs, found, row_key(docs["doc_id"].cast("long"), F.xxhash64(docs["text"])))
