"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's lower-cased UTF-8 bytes give overlapping subwords of 2, 3 and 4 bytes; each is hashed to a bucket with an
embedding, the embeddings are averaged over the whole text, and a linear softmax follows. Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample: at most SAMPLE_PER_LANGUAGE documents
a language outside the held-out fold, and SAMPLE_ROWS in all. Part of the sample is kept from training to fit the
softmax's temperature, so that confidences are probabilities, and the confidence below which a prediction is rejected:
the least at which the errors among the accepted ones, counted with one error more, stay within ERRORS.

The average and the softmax are linear, so for scoring each bucket's embedding is multiplied with the softmax
weights once; what is broadcast to tasks is buckets x languages numbers, whatever the corpus size.

Defined cases: null text, or text without any letter, is `und` with score 0; without any row to learn from every
document is `und`; repeated rows each get their own row; other columns of the input are never read, whatever they are
called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, per_value_ids, texts_of

FOLDS, HELD_OUT = 4, 2
SAMPLE_PER_LANGUAGE = 600
#: Rows of the whole sample, whatever the number of languages.
SAMPLE_ROWS = 60_000
BUCKET_BITS = 14
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 32, 2.0
#: Share of errors that may be among the predictions that aren't rejected.
ERRORS = 0.01
#: Bytes that are hashed at once.
SLICE = 1 << 20
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def buckets(raw: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The bucket of the subword that starts at each byte (those that reach over the end wrap; mask them)."""
    h = np.full(len(raw), length, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(length):
            h = h * np.uint32(0x01000193) + np.roll(raw, -k)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each followed by zeros; where each starts; which bytes are its own."""
    pad = b"\0" * (max(LENGTHS) - 1)
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) + len(pad) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    own = np.ones(int(sizes.sum()), bool)
    for k in range(1, len(pad) + 1):
        own[starts + sizes - k] = False
    return np.frombuffer(pad.join(raw) + pad, np.uint8).astype(np.uint32), starts, own


def counted(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords and each one's share."""
    raw, _, own = padded([text])
    found = np.concatenate([buckets(raw, n, bits)[own] for n in LENGTHS])
    kind, n = np.unique(found, return_counts=True)
    return kind, n / max(1, n.sum())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets + 1 rows (the last is zero) x languages
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < SLICE):
                size += len(texts[last])
                last += 1
            raw, starts, own = padded(texts[first:last])
            for n in LENGTHS:
                bucket = buckets(raw, n, BUCKET_BITS)
                bucket[~own] = len(self.table) - 1
                for k in range(len(self.languages)):
                    out[first:last, k] += np.add.reduceat(self.table[bucket, k], starts, dtype=np.float64)
            out[first:last] /= np.maximum(1, np.add.reduceat(own, starts, dtype=np.int64) * len(LENGTHS))[:, None]
            first = last
        return out


def train(texts_counted: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent on embeddings and softmax; every fifth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    size, kinds = 1 << BUCKET_BITS, len(languages)
    emb = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, kinds)).astype(np.float32)
    order = rng.permutation(len(labels))
    kept, used = (order[::5], np.setdiff1d(order, order[::5])) if len(order) >= 20 else (order, order)
    weight = 1 / np.maximum(1, np.bincount(labels[used], minlength=kinds))
    weight = weight / weight[labels[used]].mean()

    def averaged(rows):
        index = np.concatenate([texts_counted[i][0] for i in rows])
        share = np.concatenate([texts_counted[i][1] for i in rows]).astype(np.float32)
        of = np.repeat(np.arange(len(rows)), [len(texts_counted[i][0]) for i in rows])
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        np.add.at(x, of, emb[index] * share[:, None])
        return index, share, of, x

    steps, done = EPOCHS * -(-len(used) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            index, share, of, x = averaged(rows)
            p = _softmax(x @ out)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[labels[rows]][:, None] / len(rows)
            back = (p @ out.T).astype(np.float32)
            out -= rate * (x.T @ p).astype(np.float32)
            np.add.at(emb, index, -rate * BATCH * back[of] * share[:, None])
    logits = averaged(kept)[3] @ out if len(kept) else np.zeros((0, kinds))
    temperatures = np.geomspace(0.05, 5, 40)
    losses = [-np.log(np.maximum(1e-9, _softmax(logits / t)[np.arange(len(kept)), labels[kept]])).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    p = _softmax(logits / temperature)
    threshold = rejection_threshold(p.max(axis=1), p.argmax(axis=1) == labels[kept], ERRORS) if len(kept) else 0.0
    return Model(languages, np.vstack([emb @ out, np.zeros((1, kinds), np.float32)]).astype(np.float32), temperature, threshold)


def rejection_threshold(confidence: np.ndarray, right: np.ndarray, errors: float) -> float:
    """The least confidence from which on (errors + 1) / (accepted + 1) is within errors; 1 if there is none."""
    order = np.argsort(-confidence, kind="stable")
    confidence, wrong = confidence[order], np.cumsum(~right[order])
    last = np.r_[confidence[1:] != confidence[:-1], True]  # equal confidences are accepted or rejected together
    fits = last & (wrong + 1 <= errors * (np.arange(len(wrong)) + 2))
    if not fits.any():
        return 1.0
    at = int(np.flatnonzero(fits)[-1])
    return 0.0 if at == len(confidence) - 1 else float(confidence[at])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [counted(t or "", BUCKET_BITS) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([k.astype("<u4").tobytes() for k, _ in pairs], pa.binary()), pa.array([s.astype("<f4").tobytes() for _, s in pairs], pa.binary())], names=["doc_id", "label", "kinds", "shares"])


def fit(docs: DataFrame, *, most: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    ids = per_value_ids(docs, "lang", folds=FOLDS, not_fold=HELD_OUT, most=most, most_rows=SAMPLE_ROWS)
    rows = texts_of(docs, ids).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("string").alias("label"))
    found = rows.mapInArrow(_sample, "doc_id long, label string, kinds binary, shares binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("kinds", "ascending")])
    if not found.num_rows:
        return None
    labels = found.column("label").to_pylist()
    languages = sorted(set(labels))
    place = {name: i for i, name in enumerate(languages)}
    pairs = [(np.frombuffer(k, "<u4").astype(np.int64), np.frombuffer(s, "<f4")) for k, s in zip(found.column("kinds").to_pylist(), found.column("shares").to_pylist(), strict=True)]
    return train(pairs, np.array([place[x] for x in labels]), languages)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            name, score, rejected = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known:
                p = _softmax(model.logits([texts[i] for i in known]) / model.temperature)
                name[known] = np.array(model.languages, object)[p.argmax(axis=1)]
                score[known] = p.max(axis=1)
                rejected[known] = score[known] < model.threshold
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, *, most: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row a row of docs."""
    model = fit(docs, most=most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(predictor(model), SCHEMA)
