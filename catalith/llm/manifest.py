"""Merkle manifest of a dataset: bitmap-rank indexing places the leaves, keyed slot arrays reduce them.

1. A row's leaf is the hash of its columns. Each task gathers its doc_ids, group by group (here: lang), into compressed
   bitmaps of 2^CHUNK_BITS ids; the bitmaps of one chunk are merged into one container, a bitmap with a directory of
   popcounts, or a sorted array where few ids are set. The chunks' counts are summed up a directory of four levels with
   2^LEVEL_BITS entries each, so that nothing is ordered in one task, however ids are spread.
2. A leaf's place is a rank query: what its chunk's directory entries say lies before the chunk, and the bits set
   before its own in the container. No rows are sorted.
3. Places are cut into blocks of 2^BLOCK_BITS. A block's leaves are written to the slots of an array and reduced to one
   node; the blocks' nodes are leaves of the next round, until one a group is left. The groups' roots, by name, are
   reduced likewise. On the way back each block adds its own siblings to the proof of its root.

Ids that several rows share are ranked once more among themselves, by the leaf's first eight bytes, with the same bitmaps:
the null id, or one id, may hold any share of the rows. Equal rows are counted before they are shuffled.

Defined cases: a null column counts as `-`; the null lang is the first group, the null doc_id the first of its group;
rows of one id are ordered by their leaf, equal rows take consecutive places; a single leaf is its group's root, a
single group's root is the root, a proof without siblings is the hash of nothing; an empty table gives an empty result;
other columns are never read, whatever they are called. A null doc_id or n_chars is not tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, LEAST_HOT, materialize

CHUNK_BITS, LEVEL_BITS, BLOCK_BITS = 12, 13, 10
#: Containers of at most so many ids are arrays; a bitmap has a count for each so many bits.
SPARSE, COUNT_BITS = 1 << (CHUNK_BITS - 4), 512
#: Ids that a task gathers before it hands its bitmaps on.
GATHERED = 1 << 20

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PART_SCHEMA = "grp string, chunk long, bits binary, extra binary"
CONTAINER_SCHEMA = "grp string, chunk long, n long, bits binary, counts binary, extra binary"
PLACE_SCHEMA = "grp string, pos long, total long, id long, node binary, other binary"
BLOCK_SCHEMA = "grp string, block long, total long, ids array<long>, nodes array<binary>, others array<binary>, root binary"
PATH_SCHEMA = "grp string, pos long, path binary, subroot binary, root binary"
PROOF_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# Leaves.


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """grp, id, node (the leaf), other (the leaf after tampering; null where it is the same)."""

    def digest(n_chars: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[_part(n_chars if c == "n_chars" else docs[c]) for c in COLUMNS]).cast("binary"), 256))

    tampered = F.coalesce((F.crc32(docs["doc_id"].cast("string")) % 7 == 0) & docs["n_chars"].isNotNull(), F.lit(False))
    grp = F.when(docs["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs["lang"].cast("string")))  # keeps the order, nulls first
    return docs.select(grp.alias("grp"), docs["doc_id"].cast("long").alias("id"), digest(docs["n_chars"]).alias("node"), F.when(tampered, digest(docs["n_chars"] + 1)).alias("other"))


# Bitmaps.


def encode(low: np.ndarray) -> bytes:
    """Distinct ascending places of a chunk: an array of them, or a bitmap, whichever a container of this size is."""
    if len(low) <= SPARSE:
        return b"a" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, bool)
    bits[low] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def directory(data: bytes) -> np.ndarray:
    """For a bitmap, how many bits are set before each run of COUNT_BITS."""
    if data[:1] == b"a":
        return np.zeros(0, np.int64)
    per = np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).reshape(-1, COUNT_BITS).sum(axis=1, dtype=np.int64)
    return np.cumsum(per) - per


def rank(data: bytes, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many of the container's places lie below each of these."""
    if data[:1] == b"a":
        return np.searchsorted(np.frombuffer(data, "<u2", offset=1), low).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little").reshape(-1, COUNT_BITS)
    before = np.cumsum(bits, axis=1, dtype=np.int64) - bits
    return counts[low // COUNT_BITS] + before[low // COUNT_BITS, low % COUNT_BITS]


def _extra(low: np.ndarray, n: np.ndarray) -> bytes:
    """The places that hold more than one row, with their further rows."""
    many = n > 1
    return np.stack([low[many], n[many] - 1], axis=1).astype("<i8").tobytes()


def _extras(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, 2)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, chunk, low, n -> one container for each chunk among the ids gathered."""

    def containers(held: pa.Table) -> pa.RecordBatch:
        one = held.group_by(["grp", "chunk", "low"]).aggregate([("n", "sum")]).sort_by([("grp", "ascending"), ("chunk", "ascending"), ("low", "ascending")])
        grp, chunk = one.column("grp").to_pylist(), one.column("chunk").to_numpy()
        low, n = one.column("low").to_numpy(), one.column("n_sum").to_numpy()
        starts = [i for i in range(len(grp)) if i == 0 or chunk[i] != chunk[i - 1] or grp[i] != grp[i - 1]]
        ends = [*starts[1:], len(grp)]
        return pa.RecordBatch.from_arrays(
            [pa.array([grp[i] for i in starts], pa.string()), pa.array(chunk[starts], pa.int64()), pa.array([encode(low[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([_extra(low[a:b], n[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())],
            names=["grp", "chunk", "bits", "extra"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield containers(pa.Table.from_batches(held))
            held = []
    if sum(b.num_rows for b in held):
        yield containers(pa.Table.from_batches(held))


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The containers of one chunk, merged bit by bit; rows beyond a bit's first are counted."""
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    grp = chunk = None
    for part in parts:
        for row in part.to_pylist():
            grp, chunk = row["grp"], row["chunk"]
            total[decode(row["bits"])] += 1
            more = _extras(row["extra"])
            total[more[:, 0]] += more[:, 1]
    low = np.flatnonzero(total)
    bits = encode(low)
    yield pa.RecordBatch.from_arrays(
        [pa.array([grp], pa.string()), pa.array([chunk], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([bits], pa.binary()), pa.array([directory(bits).astype("<i8").tobytes()], pa.binary()), pa.array([_extra(low, total[low])], pa.binary())],
        names=["grp", "chunk", "n", "bits", "counts", "extra"],
    )


def _ranks(low: np.ndarray, box: dict) -> np.ndarray:
    """The rows of the group before each of these places of a chunk, whose container is given."""
    out = box["ahead"] + rank(box["bits"], np.frombuffer(box["counts"], "<i8"), low)
    more = _extras(box["extra"])
    if len(more):
        upto = np.r_[0, np.cumsum(more[:, 1])]
        out = out + upto[np.searchsorted(more[:, 0], low)]
    return out


def index(rows: DataFrame, label: str) -> DataFrame:
    """rows: grp, chunk, low, n. grp, chunk, n, bits, counts, extra, ahead (rows of the group before it), total (of the group).

    The index can be kept, and merged with a later one: bitmaps of one chunk merge in any order.
    """
    parts = rows.select("grp", "chunk", "low", "n").mapInArrow(_gather, PART_SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_merge(iter(table.to_batches()))))

    boxes = materialize(parts.groupBy("grp", "chunk").applyInArrow(merge, CONTAINER_SCHEMA), f"{label}-bitmaps")
    up = [F.shiftright("chunk", LEVEL_BITS * k).alias(f"c{k}") for k in (1, 2, 3)]
    level = boxes.select("grp", F.col("chunk").alias("c0"), *up, "n")
    ahead = lambda by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found, keys = None, ["grp", "c3", "c2", "c1", "c0"]
    for depth in (4, 3, 2, 1):  # from chunks to the group: counts before each entry among those of one parent
        by, at = keys[:depth], keys[depth]
        own = level.groupBy(*by, at).agg(F.sum("n").alias("n")).select(*by, at, ahead(by, at).alias(f"ahead{depth}"))
        found = own if found is None else found.join(own, [*by, at])
    total = level.groupBy("grp").agg(F.sum("n").alias("total"))
    found = found.join(total, "grp").select("grp", F.col("c0").alias("chunk"), (F.col("ahead1") + F.col("ahead2") + F.col("ahead3") + F.col("ahead4")).alias("ahead"), "total")
    return materialize(boxes.join(found, ["grp", "chunk"]), f"{label}-index")


def place(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """rows: grp, chunk, low, id, node, other, no two of one (grp, chunk, low). Their places: the rank queries."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in PLACES})
        box = right.to_pylist()[0]
        pos = _ranks(left.column("low").to_numpy().astype(np.int64), box)
        total = np.full(len(pos), box["total"], np.int64)
        return pa.table([left.column("grp"), pa.array(pos), pa.array(total), left.column("id"), left.column("node"), left.column("other")], schema=PLACES)

    return rows.groupBy("grp", "chunk").cogroup(boxes.groupBy("grp", "chunk")).applyInArrow(ask, PLACE_SCHEMA)


PLACES = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("id", pa.int64()), ("node", pa.binary()), ("other", pa.binary())])


def _chunked(rows: DataFrame, value: str) -> DataFrame:
    """Adds chunk and low of a value; null values have a chunk of their own below all others."""
    lowest = -(1 << (63 - CHUNK_BITS)) - 1
    chunk = F.coalesce(F.shiftright(value, CHUNK_BITS), F.lit(lowest))
    return rows.withColumn("chunk", chunk).withColumn("low", F.coalesce(F.col(value).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)), F.lit(0)))


def _repeated(boxes: DataFrame) -> DataFrame:
    """grp, chunk, low, times, start, total of the ids that several rows share."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b["grp"], b["chunk"], int(low), int(n) + 1, int(at), b["total"]) for b in batch.to_pylist() for (low, n), at in zip(_extras(b["extra"]), _ranks(_extras(b["extra"])[:, 0], b), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["grp", "chunk", "low", "times", "start", "total"])

    return boxes.filter(F.length("extra") > 0).mapInArrow(spread, "grp string, chunk long, low long, times long, start long, total long")


ID = ["grp", "chunk", "low"]


def positions(rows: DataFrame) -> DataFrame:
    """rows: grp, id, node, other. grp, pos, total, id, node, other: each row's place in its group by id, then node."""
    rows = _chunked(rows, "id")
    boxes = index(rows.withColumn("n", F.lit(1).cast("long")), "manifest")
    repeated = materialize(_repeated(boxes), "manifest-repeated")
    times, most = repeated.agg(F.sum("times"), F.max("times")).first()
    if not times:
        return place(rows, boxes)
    mark = F.xxhash64(*ID)
    hot = [r[0] for r in repeated.filter(F.col("times") >= max(LEAST_HOT, -(-times // HOT_KEYS))).select(mark).distinct().collect()]
    often, seldom = repeated.filter(mark.isin(hot)), repeated.filter(~mark.isin(hot))  # HOT_KEYS ids at most are often
    alone = rows.filter(mark.isin(hot)).join(F.broadcast(often.select(*ID)), ID, "left_anti").unionByName(rows.filter(~mark.isin(hot)).join(seldom.select(*ID), ID, "left_anti"))
    shared = rows.filter(mark.isin(hot)).join(F.broadcast(often), ID).unionByName(rows.filter(~mark.isin(hot)).join(seldom, ID))
    return place(alone, boxes).unionByName(_ties(shared))


def _ties(shared: DataFrame) -> DataFrame:
    """Rows of repeated ids. Equal rows are one with a count; an id's leaves are ranked by their first eight bytes."""
    kinds = shared.groupBy("grp", "id", "chunk", "low", "start", "total", "node", "other").agg(F.count(F.lit(1)).alias("n"))
    # unsigned order of the first eight bytes as the order of a long
    prefix = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    name = F.concat_ws("|", F.col("chunk").cast("string"), F.col("low").cast("string"), "grp")
    kinds = _chunked(kinds.select(name.alias("inner"), F.col("grp").alias("outer"), "id", "start", F.col("total").alias("outer_total"), "node", "other", "n", prefix.alias("prefix")), "prefix").withColumnRenamed("inner", "grp")
    kinds = materialize(kinds, "manifest-ties")
    boxes = index(kinds, "manifest-ties")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("low", "ascending"), ("node", "ascending")])  # leaves of one prefix, in practice one
        low, n = left.column("low").to_numpy().astype(np.int64), left.column("n").to_numpy().astype(np.int64)
        before = np.cumsum(n) - n
        first = np.searchsorted(low, low)
        at = _ranks(low, right.to_pylist()[0]) + before - before[first] + left.column("start").to_numpy()
        return pa.table([left.column("outer"), pa.array(at), left.column("outer_total"), left.column("id"), left.column("node"), left.column("other"), pa.array(n)], names=["grp", "at", "total", "id", "node", "other", "n"])

    placed = kinds.groupBy("grp", "chunk").cogroup(boxes.groupBy("grp", "chunk")).applyInArrow(ask, "grp string, at long, total long, id long, node binary, other binary, n long")
    piece = 1 << BLOCK_BITS  # copies are dealt out in pieces, so no task makes all of one row's
    pieces = placed.withColumn("at_piece", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1, F.lit(piece)))).withColumn("upto", F.least(F.col("at") + F.col("n"), F.col("at_piece") + piece) - 1)
    out = pieces.repartition("grp", "at_piece").withColumn("pos", F.explode(F.sequence("at_piece", "upto")))
    return out.select("grp", "pos", "total", "id", "node", "other")


# Reduction.


def _h(*digests: bytes) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def depth(total: int) -> int:
    """The levels that a block of a group of so many nodes reduces."""
    return min(BLOCK_BITS, (total - 1).bit_length())


def fold_levels(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a block, from its nodes to its root."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([_h(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def _slots(table: pa.Table) -> pa.Table:
    """One block: its nodes in their slots, and its root."""
    at = table.column("pos").to_numpy() & ((1 << BLOCK_BITS) - 1)
    n = len(at)
    ids, nodes, others = ([None] * n for _ in range(3))
    for i, d, node, other in zip(at.tolist(), table.column("id").to_pylist(), table.column("node").to_pylist(), table.column("other").to_pylist(), strict=True):
        ids[i], nodes[i], others[i] = d, node, other
    total = table.column("total")[0].as_py()
    root = fold_levels(nodes, depth(total))[-1][0]
    block = table.column("pos")[0].as_py() >> BLOCK_BITS
    return pa.table({
        "grp": table.column("grp").slice(0, 1), "block": pa.array([block], pa.int64()), "total": pa.array([total], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
        "nodes": pa.array([nodes], pa.list_(pa.binary())), "others": pa.array([others], pa.list_(pa.binary())), "root": pa.array([root], pa.binary()),
    })


def reduce_groups(nodes: DataFrame, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The blocks of each round, and for each round the groups that it brought to one node: grp, node."""

    def slots(table: pa.Table) -> pa.Table:
        return _slots(table)

    rounds, done = [], []
    while True:
        keyed = nodes.withColumn("block", F.shiftright("pos", BLOCK_BITS))
        blocks = materialize(keyed.groupBy("grp", "block").applyInArrow(slots, BLOCK_SCHEMA), f"{label}-blocks")
        rounds.append(blocks)
        after = F.when(F.col("total") <= 1 << BLOCK_BITS, F.lit(1).cast("long")).otherwise(F.ceil(F.col("total") / (1 << BLOCK_BITS)).cast("long"))
        up = blocks.select("grp", F.col("block").alias("pos"), after.alias("total"), F.lit(None).cast("long").alias("id"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("other"))
        done.append(up.filter("total = 1").select("grp", "node"))
        nodes = up.filter("total > 1")
        if not nodes.head(1):
            return rounds, done


LONE, RIGHT, LEFT = 0, 1, 2  # at a level of a path: no sibling, the sibling follows, the sibling precedes


def own_path(levels: list[list[bytes]], i: int) -> bytes:
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append(bytes([LONE]) if j >= len(nodes) else bytes([RIGHT if j > i else LEFT]) + nodes[j])
        i >>= 1
    return b"".join(out)


def steps(path: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(path):
        size = 33 if path[at] else 1
        out.append((path[at], path[at + 1 : at + size]))
        at += size
    return out


def climb(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    for side, sibling in path:
        node = _h(node) if side == LONE else _h(node, sibling) if side == RIGHT else _h(sibling, node)
    return node


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path of their root -> the path of each node."""
    for batch in batches:
        for b in batch.to_pylist():
            levels, n = fold_levels(b["nodes"], depth(b["total"])), len(b["nodes"])
            first = b["block"] << BLOCK_BITS
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["grp"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array([own_path(levels, i) + b["path"] for i in range(n)], pa.binary()), pa.array([b["subroot"]] * n, pa.binary()), pa.array([b["top"]] * n, pa.binary())],
                names=["grp", "pos", "path", "subroot", "root"],
            )


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of leaves with the path of their root -> one row a leaf."""
    for batch in batches:
        for b in batch.to_pylist():
            levels, n, above = fold_levels(b["nodes"], depth(b["total"])), len(b["nodes"]), steps(b["path"])
            hex_above = "".join(s.hex() for _, s in above)
            subroot, root = b["subroot"].hex(), b["top"].hex()
            proofs, folded = [], []
            for i, (node, other) in enumerate(zip(b["nodes"], b["others"], strict=True)):
                own = steps(own_path(levels, i))
                proofs.append(hashlib.sha256(("".join([s.hex() for _, s in own]) + hex_above).encode()).hexdigest())
                folded.append(climb(climb(node if other is None else other, own), above).hex())
            yield pa.RecordBatch.from_arrays(
                [pa.array(b["ids"], pa.int64()), pa.array([x.hex() for x in b["nodes"]]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def _with_path(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    above = paths.select("grp", F.col("pos").alias("block"), "path", "subroot", F.col("root").alias("top"))
    return blocks.join(above, ["grp", "block"])


def _down(rounds: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """The paths of the roots of the first round's blocks. tops: for each round, those of the groups that it finished."""
    paths = tops[-1]
    for blocks, top in zip(reversed(rounds[1:]), reversed(tops[:-1]), strict=True):
        paths = _with_path(blocks, paths).mapInArrow(_descend, PATH_SCHEMA).unionByName(top)
    return paths


def _by_name(subroots: DataFrame) -> DataFrame:
    """Adds pos and total: a group's place by name, in ranges of names, so that no task orders all."""
    ranged = materialize(subroots.repartitionByRange("grp").withColumn("part", F.spark_partition_id()), "manifest-names")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(every).alias("total"))
    numbered = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1)
    return materialize(numbered.join(F.broadcast(parts), "part").select("grp", "node", (F.col("k") + F.col("ahead")).alias("pos"), "total"), "manifest-roots")  # parts: one row a shuffle partition


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a row of docs."""
    placed = positions(materialize(leaves(docs), "manifest-leaves"))
    rounds, done = reduce_groups(placed, "manifest")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    named = _by_name(every)
    top_nodes = named.select(F.lit("").alias("grp"), "pos", "total", F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("binary").alias("other"))
    top_rounds, top_done = reduce_groups(top_nodes, "manifest-top")
    empty = F.lit("").cast("binary")
    tops = [d.select("grp", F.lit(0).cast("long").alias("pos"), empty.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root")) for d in top_done]
    # the top's blocks all the way down: one path a group
    paths = _with_path(top_rounds[0], _down(top_rounds, tops)).mapInArrow(_descend, PATH_SCHEMA).select("pos", "path", "root")
    group_paths = materialize(named.join(paths, "pos").select("grp", "path", F.col("node").alias("subroot"), "root"), "manifest-group-paths")
    own = [d.select("grp").join(group_paths, "grp").select("grp", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root") for d in done]
    return _with_path(rounds[0], _down(rounds, own)).mapInArrow(_prove, PROOF_SCHEMA)


#: crc32 is spelled out bit by bit; the tree and the proofs are recursive.
ORACLE_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, row_number() OVER () AS rid, doc_id IS NOT NULL AND n_chars IS NOT NULL
      AND xor(list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda crc, b:
        list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295), 4294967295) % 7 = 0 AS bad,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, n_chars
  FROM documents
), leaf AS (
  SELECT *, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS h,
    CASE WHEN bad THEN sha256(head || octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1) || tail) END AS other
  FROM rows_
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM leaf
), node AS (
  SELECT 0 AS level, lang, pos, h, total FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (total + 1) // 2 FROM node WHERE total > 1 GROUP BY level, lang, pos // 2, total
), subroot AS (
  SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM node WHERE total = 1
), high AS (
  SELECT 0 AS level, pos, h, total FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (total + 1) // 2 FROM high WHERE total > 1 GROUP BY level, pos // 2, total
), climb AS (
  SELECT rid, 0 AS level, lang, pos, '' AS proof, coalesce(other, h) AS fold FROM placed
  UNION ALL
  SELECT c.rid, c.level + 1, c.lang, c.pos // 2, c.proof || coalesce(s.h, ''), sha256(CASE WHEN s.h IS NULL THEN c.fold WHEN s.pos > c.pos THEN c.fold || s.h ELSE s.h || c.fold END)
  FROM climb c JOIN node o ON o.level = c.level AND o.pos = c.pos AND o.lang IS NOT DISTINCT FROM c.lang AND o.total > 1
  LEFT JOIN node s ON s.level = c.level AND s.pos = xor(c.pos, 1) AND s.lang IS NOT DISTINCT FROM c.lang
), climbed AS (
  SELECT c.rid, s.pos, c.proof, c.fold FROM climb c JOIN node o ON o.level = c.level AND o.pos = c.pos AND o.lang IS NOT DISTINCT FROM c.lang AND o.total = 1 JOIN subroot s ON s.lang IS NOT DISTINCT FROM c.lang
), climb_high AS (
  SELECT rid, 0 AS level, pos, proof, fold FROM climbed
  UNION ALL
  SELECT c.rid, c.level + 1, c.pos // 2, c.proof || coalesce(s.h, ''), sha256(CASE WHEN s.h IS NULL THEN c.fold WHEN s.pos > c.pos THEN c.fold || s.h ELSE s.h || c.fold END)
  FROM climb_high c JOIN high o ON o.level = c.level AND o.pos = c.pos AND o.total > 1 LEFT JOIN high s ON s.level = c.level AND s.pos = xor(c.pos, 1)
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = r.h AS verified
FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h, level FROM high WHERE total = 1) r JOIN climb_high c ON c.rid = p.rid AND c.level = r.level
"""
