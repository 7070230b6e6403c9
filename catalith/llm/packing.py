"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

One pass tokenizes the texts and cuts every document into full windows and one rest, itself cut into even parts of
at most GRAIN tokens; only lengths and checksums leave it. Pieces are then dealt into groups of about GROUP_WINDOWS
windows' worth, each packed on its own. In a group, k windows are filled by multiway differencing: a partial
partition is a vector of k window sums; the two with the largest spread are merged, the fullest window of one
meeting the emptiest of the other, until one is left, whose windows are near-equal. If its fullest window exceeds
the capacity, k rises and the differencing is done anew.

Defined cases: null text is empty text, and a document of empty text is the end id alone; repeated rows and rows of
equal doc_id are packed each on their own; an empty table gives an empty result; other columns of the input are
never read, whatever they are called.
"""

from __future__ import annotations

import heapq
import itertools
import operator
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_cache

CAPACITY = 4096
END_ID = 2
#: Tokens of the largest piece that is no full window. Smaller pieces make windows more equal, and cut more documents.
GRAIN = 1024
GROUP_WINDOWS = 128
#: Distinct words whose ids a worker keeps, about 200 bytes each, and an eighth of these ids; beyond this the table starts anew.
KEPT = 1_000_000
#: Bytes of text that are encoded at once, or one longer text: their ids take about ten times as much.
ENCODED = 4 << 20
#: Letters of the scripts whose words go to the tokenizer's model, where the tokenizer treats them as single letters.
LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x530)]

PIECE_SCHEMA = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def spread(ids: np.ndarray, stops: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[stops[i]:stops[i + 1]] for each i of index one after another, and where each of them begins and ends."""
    lengths = np.diff(stops)[index]
    at = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return ids[np.repeat(stops[index] - at[:-1], lengths) + np.arange(at[-1])], at


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids one after another,
    and the distinct chunks of many texts are encoded once. Letters, then ASCII punctuation to a chunk's end are two
    words to the tokenizer, which makes them lower case and encodes each on its own: such chunks are parted, and their
    letters go to the tokenizer's model as its own first steps would hand them over. All other chunks are encoded by the
    whole tokenizer, special tokens and white space beyond ASCII among them. Ids of distinct words are kept.
    """

    def __init__(self, tokenizer_file: str, kept: int = KEPT) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        self.tokenizer, self.kept = Tokenizer.from_file(tokenizer_file), kept
        self._forget()
        self.letters, self.symbols = self._letters()
        self.lower = re.compile(f"[{''.join(map(chr, self.symbols))}]+")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.stops = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _letters(self) -> tuple[str, dict[int, str]]:
        """Letters that Arrow makes lower case as the tokenizer does, and how the model spells the lower-case ones."""
        normal, words = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        found = {}
        for c in map(chr, LETTERS):
            low = pc.utf8_lower(c).as_py()
            spelt = words(f"a{low}a")
            if len(low) == len(spelt) == 1 and normal(f"{c} a{c}a{c}") == f"{low} a{low}a{low}":
                found[c] = low, spelt[0][0][1:-1]
        letters = [c for c, (low, _) in found.items() if low in found]
        return "".join(letters), {ord(low): spelt for low, spelt in map(found.get, letters)}

    def _learn(self, new: list[str]) -> None:
        lower, tokenize, symbols, number = self.lower.fullmatch, self.tokenizer.model.tokenize, self.symbols, operator.attrgetter("id")
        ids, stops = [], []
        for word in new:
            if lower(word):
                ids.extend(map(number, tokenize(word if word.isascii() else word.translate(symbols))))
            else:
                ids += self.tokenizer.encode(word, add_special_tokens=False).ids
            stops.append(len(ids))
        self.stops = np.append(self.stops, np.array(stops, np.int64) + len(self.table))
        self.table = np.append(self.table, np.fromiter(ids, "<u4", len(ids)))
        self.known.update(zip(new, range(len(self.known), len(self.stops))))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Where the table has the ids of each word."""
        if len(self.known) > self.kept or len(self.table) > 8 * self.kept:
            self._forget()
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None)))
            found = [self.known[w] if i is None else i for w, i in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat = chunks.flatten().dictionary_encode()
        word = pc.ascii_rtrim(flat.dictionary, string.punctuation)
        plain = pc.match_substring_regex(word, f"^[{self.letters}]*$")
        head = pc.if_else(plain, pc.utf8_lower(word), flat.dictionary).dictionary_encode()
        tail = pc.if_else(plain, pc.utf8_ltrim(flat.dictionary, self.letters), "").dictionary_encode()
        words = [w for part in (head, tail) for w in part.dictionary.to_numpy(zero_copy_only=False).tolist()]
        numbers = self._numbers(words)
        pairs = np.stack([numbers[head.indices.to_numpy()], numbers[tail.indices.to_numpy() + len(head.dictionary)]], 1).ravel()
        found, stops = spread(self.table, self.stops, pairs)
        found, stops = spread(found, stops[::2], flat.indices.to_numpy())
        return found, stops[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]

    def of(self, texts: list[str]) -> list[bytes]:
        ids, stops = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(stops.tolist())]


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest in even parts of at most grain."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = n - full * capacity, full * capacity
    parts = -(-rest // grain)
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        out.append((at, size))
        at += size
    return out


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts in runs of at most this many bytes, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def cutter(tokenizer_file: str, end_id: int, capacity: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"pack:{tokenizer_file}", lambda: Encoder(tokenizer_file))
        for batch in batches:
            rows = []
            keys = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            for some in slices(batch.column("text"), ENCODED):
                ids, stops = encoder.ids(some)
                ids, stops = np.insert(ids, stops[1:], end_id), (stops + np.arange(len(stops))).tolist()
                for (a, b), (row, doc_id) in zip(itertools.pairwise(stops), keys):
                    rows += [(row, doc_id, s, k, zlib.crc32(ids[a + s : a + s + k]), b - a) for s, k in cuts(b - a, capacity, grain)]
            columns = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items of each of k windows, near-equal in sum. Ties are broken by the order of the items."""
    n = len(sizes)
    left, right = [], []  # children of the nodes n, n + 1, ...; nodes below n are items; -1 is none
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], nodes[-1] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    made, turn = n, n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        b, b_nodes = b[::-1], b_nodes[::-1]
        sums = a + b
        both = (a_nodes >= 0) & (b_nodes >= 0)
        nodes = np.where(a_nodes >= 0, a_nodes, b_nodes)
        count = int(both.sum())
        left.append(a_nodes[both])
        right.append(b_nodes[both])
        nodes[both] = made + np.arange(count)
        made += count
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums = sums - sums[0]
        turn += 1
        heapq.heappush(heap, (-int(sums[-1]), turn, sums, nodes))
    lefts, rights = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (int(lefts[x - n]), int(rights[x - n]))
        out.append(sorted(items))
    return out


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most capacity. Each size is at most capacity; items of equal size may stand for each other."""
    windows = [[i] for i in np.flatnonzero(sizes == capacity).tolist()]
    rest = np.flatnonzero(sizes < capacity)
    if len(rest):
        k = max(1, -(-int(sizes[rest].sum()) // capacity))
        while True:
            found = difference(sizes[rest], k) if k < len(rest) else [[i] for i in range(len(rest))]
            loads = [int(sizes[rest[x]].sum()) for x in found]
            if max(loads) <= capacity:
                break
            k += 1
        windows += [rest[x].tolist() for x in found if x]
    return windows


def packer(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        group = table.column("group")[0].as_py()
        windows = pack(table.column("length").to_numpy(), capacity)
        order = np.array([i for w in windows for i in w], np.int64)
        sequence = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).take(order)
        length = out.column("length").to_numpy()
        ends = np.cumsum(length)
        first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        offset = ends - length - np.repeat((ends - length)[first], np.diff(np.r_[first, len(length)]))
        return out.append_column("sequence_id", pa.array((group << 24) + sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, *, end_id: int = END_ID, capacity: int = CAPACITY, grain: int = GRAIN, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(rows.mapInArrow(cutter(tokenizer_file, end_id, capacity, grain), PIECE_SCHEMA), "pack-pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_windows)))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(packer(capacity), PACKED_SCHEMA)
