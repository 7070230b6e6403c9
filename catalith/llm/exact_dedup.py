"""Exact deduplication against a history of digests held in minimal perfect hashes.

The history's distinct SHA-256 digests are cut into shards by their first bytes. Each shard gets a minimal perfect
hash of cascaded bit levels: at every level the keys left over are hashed into twice as many places, keys alone in
their place settle there, the others go to the next level; a key's slot is the rank of its bit. A slot holds the
full 32-byte digest and the locator of the winning row. A lookup hashes the digest to its slot and compares all 32
bytes, so a digest outside the history is never mistaken for a member.

New rows are first reduced to distinct digests (partial aggregation runs before the shuffle, so thousands of
copies send one row a task), then looked up shard by shard. Members are repeats of the history and update its
winner; non-members are grouped among themselves. A shard holds about SHARD_KEYS keys whatever the corpus size. The
decision goes back to the rows by digest; digests that very many rows hold are sent by a bounded broadcast.

Defined cases: null text counts as empty text; among equal texts the row of the largest doc_id stays (null ids are
smallest; of several rows with that id exactly one stays); an empty history or batch is allowed; other columns of
the input are never read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, row_key, rows_of

SHARD_KEYS = 50_000
SPACE = 2.0
MAX_LEVELS = 64

INDEX_SCHEMA = "shard int, n_keys long, level_sizes array<long>, bits binary, slots binary, win_id binary, win_null binary, win_row binary, n_rows binary"
GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, in_history boolean"


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each 32-byte digest (rows of four words), another for each level."""
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        for k in range(1, 4):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[:, k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_levels(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels, and all levels' bits one after another. The keys must be distinct."""
    left, sizes, bits = np.arange(len(words)), [], []
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = max(64, int(SPACE * len(left)))
        place = (_mix(words[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each key's slot, or -1. A key outside the set may get any slot: compare the bytes there."""
    out, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    rank = np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        if not len(left):
            break
        place = start + (_mix(words[left], level) % np.uint64(size)).astype(np.int64)
        here = bits[place]
        out[left[here]] = rank[place[here]]
        left, start = left[~here], start + size
    return out


def _words(column: pa.Array) -> np.ndarray:
    """32-byte digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _build(table: pa.Table) -> pa.Table:
    """One shard of the history: digest, doc_id, row, n."""
    keys = _words(table.column("digest").combine_chunks())
    sizes, bits = build_levels(keys)
    slot = find_slots(keys, sizes, bits)
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    ids = table.column("doc_id")
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n_keys": pa.array([len(keys)], pa.int64()), "level_sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [np.packbits(bits).tobytes()], "slots": [keys[order].tobytes()],
        "win_id": [_column(table.set_column(table.column_names.index("doc_id"), "doc_id", ids.fill_null(0)), "doc_id")[order].astype(np.int64).tobytes()], "win_null": [np.packbits(ids.is_null().to_numpy()[order]).tobytes()],
        "win_row": [_column(table, "row")[order].astype(np.int64).tobytes()], "n_rows": [_column(table, "n")[order].astype(np.int64).tobytes()],
    })


def _larger(a_id, a_null, a_row, b_id, b_null, b_row) -> np.ndarray:
    """Whether locator b is above locator a: by id, nulls lowest, then by row."""
    return np.where(a_null != b_null, a_null, np.where(a_null | (a_id == b_id), b_row > a_row, b_id > a_id))


def _lookup(index: pa.Table, batch: pa.Table) -> pa.Table:
    """The groups of one shard: the history's slots with the batch's repeats merged in, then the non-members."""
    new = _words(batch.column("digest").combine_chunks()) if batch.num_rows else np.zeros((0, 4), np.uint64)
    new_null = batch.column("doc_id").is_null().to_numpy() if batch.num_rows else np.zeros(0, bool)
    new_id, new_row, new_n = (_column(batch, "doc_id_or_0").astype(np.int64), _column(batch, "row").astype(np.int64), _column(batch, "n").astype(np.int64)) if batch.num_rows else (np.zeros(0, np.int64),) * 3
    if index.num_rows:
        one = index.to_pylist()[0]
        n, keys = one["n_keys"], np.frombuffer(one["slots"], np.uint64).reshape(-1, 4)
        bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8))[: sum(one["level_sizes"])].astype(bool)
        ids, rows, counts = (np.frombuffer(one[k], np.int64).copy() for k in ("win_id", "win_row", "n_rows"))
        nulls = np.unpackbits(np.frombuffer(one["win_null"], np.uint8))[:n].astype(bool)
        slot = find_slots(new, one["level_sizes"], bits)
        member = slot >= 0
        member[member] = (keys[slot[member]] == new[member]).all(axis=1)
        at = slot[member]
        counts[at] += new_n[member]
        up = _larger(ids[at], nulls[at], rows[at], new_id[member], new_null[member], new_row[member])
        to = at[up]
        ids[to], nulls[to], rows[to] = new_id[member][up], new_null[member][up], new_row[member][up]
    else:
        keys, ids, rows, counts, nulls = np.zeros((0, 4), np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool)
        member = np.zeros(len(new), bool)
    every = np.ascontiguousarray(np.concatenate([keys, new[~member]]))
    null = np.concatenate([nulls, new_null[~member]])
    raw = every.tobytes()
    return pa.table({
        "digest": pa.array([raw[32 * i : 32 * i + 32] for i in range(len(every))], pa.binary()), "keep_id": pa.array(np.concatenate([ids, new_id[~member]]), pa.int64(), mask=null), "keep_row": pa.array(np.concatenate([rows, new_row[~member]]), pa.int64()),
        "group_size": pa.array(np.concatenate([counts, new_n[~member]]), pa.int64()), "in_history": pa.array(np.arange(len(every)) < len(keys), pa.bool_()),
    })


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest: the SHA-256 of each whole text; null text is empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def _shard(n_shards: int) -> Column:
    return (F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % n_shards).cast("int")


def _distinct(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row"), "n")


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history: doc_id, row, digest. One row a shard, fit to be kept and looked up by later batches."""

    def build(table: pa.Table) -> pa.Table:
        return _build(table)

    return _distinct(history).withColumn("shard", _shard(n_shards)).groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


def merge_batch(index: DataFrame, batch: DataFrame, n_shards: int) -> DataFrame:
    """batch: doc_id, row, digest. One row a distinct digest of history and batch: its winner and its row count."""

    def lookup(left: pa.Table, right: pa.Table) -> pa.Table:
        return _lookup(left, right)

    new = _distinct(batch).withColumn("shard", _shard(n_shards)).withColumn("doc_id_or_0", F.coalesce("doc_id", F.lit(0)))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(lookup, GROUP_SCHEMA)


def exact_dedup(docs: DataFrame, *, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history: one row a row of docs.

    The lower half of the id range is the history, the rest the batch that is looked up in it.
    """
    rows = materialize(digests(docs).withColumn("row", F.monotonically_increasing_id()), "dedup-digests")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    n_shards = max(1, -(-n // (2 * shard_keys)))
    middle = ((low or 0) + (high or 0)) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    index = materialize(build_index(rows.filter(old), n_shards), "dedup-index")
    groups = materialize(merge_batch(index, rows.filter(~old), n_shards), "dedup-groups")
    out = lookup(rows, groups, ["digest"], "group_size", n)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called: of equal texts one.

    It is the row of the largest doc_id; a row whose id and text are repeated comes once, with the other columns of the
    one whose columns hash least. The texts are shuffled once.
    """
    kept = exact_dedup(docs).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return rows_of(docs, kept, row_key(docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS old FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size, bool_or(old) AS in_history FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256, g.in_history FROM d JOIN g USING (text_sha256)
"""
