"""Token counts from distinct pre-tokens, without materialising ids.

The tokenizer's units never reach across the start of a run of spaces, so a text splits into pre-tokens there, and its
token count is the sum over its pre-tokens of frequency times pieces.

1. The texts are read once. Neighbouring documents become a block of about BLOCK_BYTES: its distinct pre-tokens, dealt
   into buckets by their hash, and for each document the frequencies of its pre-tokens, which name a pre-token by its
   number in the block.
2. A bucket gathers what all blocks ask of it, each block a pre-token once, however many of its documents hold it. Its
   distinct pre-tokens are told apart and the pieces of each are counted once; the counts go to the blocks that asked.
   The commonest pre-token is asked for once a block, so no bucket is hot, and buckets grow in number with the corpus.
3. The pieces are joined to the frequencies by block, where frequencies times pieces are summed by document.

Lists of pre-tokens, numbers and counts are compressed where they are made, since they are shuffled. Nothing is encoded
on the driver, and no ids leave the counting.

Defined cases: null text counts as empty text, which has no token; repeated rows each get their own row; an empty
table gives an empty result; other columns of the input are never read, whatever they are called.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_cache

LIMIT = 4096
#: UTF-8 bytes of text after which a block ends.
BLOCK_BYTES = 16 << 20
#: The character that stands for a space inside the model; in a text it counts as a space.
SPACE = "▁"

#: A bucket for so many documents.
BUCKET_DOCS, LEAST_BUCKETS = 8000, 8
CODEC = "zstd"

BLOCK_SCHEMA = "block long, doc_id array<long>, n_bytes array<long>, n_words int, entries int, kinds binary, low binary, high binary, times binary, asked array<struct<bucket:int,start:int,n:int,n_bytes:int,lengths:binary,text:binary>>"
ANSWER_SCHEMA = "of_block long, start int, n int, pieces binary"
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one space (real or supplied) that it starts with.

    A model that writes a space as part of the following piece puts one before the text too; further spaces stay at
    the head of the pre-token.
    """
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts
    out, ahead = [], 0
    for i, part in enumerate(parts):  # "" between two spaces: one more space before the next part
        if part == "" and i < len(parts) - 1:
            ahead += 1
        else:
            out.append(" " * ahead + part)
            ahead = 0
    return out


def _model(model_file: str):
    import sentencepiece

    return worker_cache(f"pieces:{model_file}", lambda: sentencepiece.SentencePieceProcessor(model_file=model_file))


def pieces(model_file: str, words: list[str]) -> list[int]:
    """Pieces of each pre-token. An empty one is the lone space, which the library drops from an empty text."""
    model = _model(model_file)
    return [len(ids) if word else 1 for word, ids in zip(words, model.encode(words, num_threads=1), strict=True)]


def _packed(values: np.ndarray | bytes) -> bytes:
    return pa.compress(values if isinstance(values, bytes) else values.tobytes(), CODEC, asbytes=True)


def _unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, CODEC, asbytes=True), kind)


class Block:
    """Pre-tokens of some documents and how often each document has them; its name is the number of its first row."""

    def __init__(self, name: int) -> None:
        self.name, self.size = name, 0
        self.number: dict[str, int] = {}
        self.doc_id, self.n_bytes = [], []
        self.kinds, self.word, self.times = array("I"), array("I"), array("I")

    def add(self, doc_id: int | None, text: str) -> None:
        found = Counter(pretokens(text))
        number = self.number
        self.doc_id.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.size += self.n_bytes[-1]
        self.kinds.append(len(found))
        self.word.extend([number.setdefault(w, len(number)) for w in found])
        self.times.extend(found.values())

    def asked(self, buckets: int) -> tuple[list[dict], np.ndarray]:
        """What each bucket is asked, and the places of the pre-tokens in the order of buckets and letters."""
        words = list(self.number)
        held = np.empty(len(words), object)
        held[:] = words
        bucket = (pd.util.hash_array(held, categorize=False) % np.uint64(buckets)).astype(np.int32) if words else np.zeros(0, np.int32)
        order = pc.sort_indices(pa.table({"bucket": bucket, "word": pa.array(words, pa.string())}), sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy() if words else np.zeros(0, np.int64)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        out, bucket = [], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)] if words else []
        for a, b in zip(edges, edges[1:], strict=False):
            raw = [words[k].encode() for k in order[a:b]]
            text = b"".join(raw)
            out.append({"bucket": int(bucket[a]), "start": a, "n": b - a, "n_bytes": len(text), "lengths": _packed(np.array([len(r) for r in raw], np.uint32)), "text": _packed(text)})
        return out, place

    def written(self, buckets: int) -> pa.RecordBatch:
        asked, place = self.asked(buckets)
        kinds, times = np.array(self.kinds, np.uint32), np.array(self.times, np.uint32)
        word = place[np.array(self.word, np.int64)] if len(self.word) else np.zeros(0, np.int64)
        by = np.lexsort((word, np.repeat(np.arange(len(kinds)), kinds)))
        step = np.diff(word[by], prepend=0)  # numbers rise inside a document, so steps are small
        first = (np.cumsum(kinds) - kinds)[kinds > 0]
        step[first] = word[by][first]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))
        struct = pa.struct([("bucket", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("n_bytes", pa.int32()), ("lengths", pa.binary()), ("text", pa.binary())])
        columns = {
            "block": pa.array([self.name], pa.int64()), "doc_id": one(self.doc_id), "n_bytes": one(self.n_bytes), "n_words": pa.array([len(place)], pa.int32()), "entries": pa.array([len(word)], pa.int32()),
            "kinds": [_packed(kinds)], "low": [_packed((step & 255).astype(np.uint8))], "high": [_packed((step >> 8).astype(np.uint32))], "times": [_packed(times[by])], "asked": pa.array([asked], pa.list_(struct)),
        }
        return pa.RecordBatch.from_pydict(columns)


def splitter(buckets: int):
    """Blocks of row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                block = block or Block(row)
                block.add(doc_id, text or "")
                if block.size >= BLOCK_BYTES:
                    yield block.written(buckets)
                    block = None
        if block:
            yield block.written(buckets)

    return run


def piece_counter(model_file: str):
    """Answers of one bucket: for each block the pieces of the pre-tokens that it asked for, in its order."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words: list[str] = []
        for r in rows:
            text, at = pa.decompress(r["text"], r["n_bytes"], CODEC, asbytes=True), 0
            for n in _unpacked(r["lengths"], np.uint32, r["n"]).tolist():
                words.append(text[at : at + n].decode())
                at += n
        told = pa.array(words, pa.string()).dictionary_encode()
        counts = np.array(pieces(model_file, told.dictionary.to_pylist()), np.uint32)[told.indices.to_numpy()]
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        packed = [_packed(counts[e - r["n"] : e]) for r, e in zip(rows, ends, strict=True)]
        return pa.table({"of_block": table.column("block"), "start": table.column("start"), "n": table.column("n"), "pieces": pa.array(packed, pa.binary())})

    return run


def _sum(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums of one block: its frequencies, and the pieces of its pre-tokens by number."""
    one = {c: block.column(c)[0].as_py() for c in block.column_names if c not in ("doc_id", "n_bytes")}
    doc_id, n_bytes = (block.column(c)[0].values for c in ("doc_id", "n_bytes"))
    table = np.zeros(one["n_words"], np.int64)
    for r in answers.to_pylist():
        table[r["start"] : r["start"] + r["n"]] = _unpacked(r["pieces"], np.uint32, r["n"])
    kinds, entries = _unpacked(one["kinds"], np.uint32, len(doc_id)).astype(np.int64), one["entries"]
    last = np.cumsum(kinds)
    steps = np.cumsum(_unpacked(one["low"], np.uint8, entries) + (_unpacked(one["high"], np.uint32, entries).astype(np.int64) << 8))
    before = np.r_[0, steps][last - kinds]
    word = steps - np.repeat(before, kinds)
    ends = np.r_[0, np.cumsum(_unpacked(one["times"], np.uint32, entries) * table[word])]
    return pa.table({"doc_id": doc_id, "n_bytes": n_bytes, "n_tokens": pa.array(ends[last] - ends[last - kinds], pa.int64())})


def count_tokens(docs: DataFrame, model_file: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row a row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_DOCS))
    blocks = materialize(rows.mapInArrow(splitter(buckets), BLOCK_SCHEMA), "token-blocks")
    asked = blocks.select("block", F.explode("asked").alias("a")).select("block", "a.*")
    answers = asked.groupBy("bucket").applyInArrow(piece_counter(model_file), ANSWER_SCHEMA)

    def total_of(block: pa.Table, answer: pa.Table) -> pa.Table:
        return _sum(block, answer)

    summed = blocks.drop("asked").groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(total_of, COUNT_SCHEMA)
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
