"""Quality classification by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are the training rows labelled as good; rows labelled as bad are not used. Unlabelled text is the whole
corpus outside the held-out fold, labels unseen. Every text is described by some tens of numbers, once, in a narrow
table. From it come, over all unlabelled rows and in sums and counts that do not depend on their order:

- the scale (mean and deviation of each number);
- the class prior, the share of good text: a first classifier learns to tell half of the sampled positives from half of
  the sampled unlabelled rows; it scores all unlabelled rows that it has not seen, counted in BINS bins, and the other
  positives; the prior is the share of unlabelled rows over the share of positives above the score where this quotient is
  least, sampling errors added; text above that score is almost all good;
- the intercept of the final model, which says where 0.5 lies: the one of least risk over all unlabelled rows, again in
  bins.

The direction of either model is found by gradient descent on at most SAMPLE positives and as many unlabelled rows. The
final model, on standardised numbers and their squares, minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

and steps against the second term's gradient whenever that term is negative, which keeps flexible models from
driving the risk below zero.

Defined cases: null text is empty text and is scored as such; without positives or without unlabelled text there is
nothing to learn and every score is 1; a repeated doc_id gives one row to the samples; repeated rows each get their own row; other columns of the input are
never read, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .sampling import fold, held_out, labelled_ids

FOLDS, HELD_OUT = 3, 1
#: Rows of either kind that the descents see at most, and bins of the scores of all unlabelled rows.
SAMPLE = 12_000
BINS = 8192
#: Numbers are summed as multiples of 2^-FIXED, so that sums don't depend on the order of rows; larger ones count as LARGEST.
FIXED, LARGEST = 16, 1e5
STEPS, PRIOR_STEPS, RATE, DECAY = 1500, 600, 0.05, 1e-3
THRESHOLD = 0.5

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "stop": b".,;:?'", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+=<>@^_`~{}[]/\\", "high": range(128, 256), "break": (10,),
}
_BYTES = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _BYTES[list(_members), _i] = 1


def statistics(text: str) -> list[float]:
    """Numbers that describe a text's form, from its whole length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    histogram = np.bincount(raw, minlength=256)
    share = histogram @ _BYTES / n
    p = histogram[histogram > 0] / n
    words = text.split()
    count = max(1, len(words))
    kinds = Counter(words)
    top = max(kinds.values(), default=0)
    again = sum(map(str.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    bare = sum(1 for w in kinds if not any(c.isalpha() for c in w))
    marked = sum(n for w, n in kinds.items() if not w[-1].isalnum() and w[-1] not in ".,;:?")
    return [
        np.log1p(len(words)), *share, -(p * np.log(p)).sum(), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(kinds) / count, np.log1p(len(kinds)) / np.log1p(count), top / count, again / count,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), bare / max(1, len(kinds)), marked / count, sum(n for w, n in kinds.items() if w[0].isupper()) / count,
    ]


def feature_rows(texts: list[str]) -> np.ndarray:
    return np.array([np.asarray(statistics(t), "<f4") for t in texts], np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([z, z * z / 4])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expanded(x) @ self.weights + self.intercept, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def standardised(mean: np.ndarray, scale: np.ndarray) -> Model:
    return Model(mean, scale, np.zeros(2 * len(mean)), 0.0)


def _descend(gradient, size: int, steps: int) -> np.ndarray:
    """Adam from zero weights and an intercept of 1; the intercept comes last."""
    w, m, v = np.r_[np.zeros(size), 1.0], np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        g = gradient(w) + DECAY * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def separate(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Model:
    """The first classifier: positives against unlabelled rows, by logistic loss."""
    model = standardised(mean, scale)
    p, u = model.expanded(positive), model.expanded(unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        dp, du = _sigmoid(p @ w[:-1] + w[-1]) - 1, _sigmoid(u @ w[:-1] + w[-1])
        return np.r_[dp @ p / len(p) + du @ u / len(u), dp.mean() + du.mean()]

    model.weights = _descend(gradient, p.shape[1], PRIOR_STEPS)[:-1]
    return model


def bin_of(z: np.ndarray) -> np.ndarray:
    """The bin of a score before its intercept, between -BINS / 2 and BINS / 2: even near 0, wider further out."""
    return np.rint(np.arcsinh(np.clip(z, -1e6, 1e6)) * (BINS / 30)).astype(np.int64)


def of_bin(k: np.ndarray) -> np.ndarray:
    return np.sinh(k * (30 / BINS))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, counts: np.ndarray) -> float:
    """positive: bins of positives; unlabelled, counts: bins of the unlabelled rows and how many lie in each."""
    sp, order = np.sort(positive), np.argsort(unlabelled)
    su, upto = unlabelled[order], np.r_[0, np.cumsum(counts[order])]
    above_p, above_u = 1 - np.searchsorted(sp, sp) / len(sp), 1 - upto[np.searchsorted(su, sp)] / upto[-1]
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(upto[-1]))
    at = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def risk(z_p: np.ndarray, z_u: np.ndarray, counts: np.ndarray, prior: float, intercept: float) -> float:
    """The non-negative risk of an intercept; z: scores before it, counts: rows of each in z_u."""
    called_p, called_u = _sigmoid(z_p + intercept).mean(), (_sigmoid(z_u + intercept) @ counts) / counts.sum()
    return prior * (1 - called_p) + max(0.0, called_u - prior * called_p)


def best_intercept(z_p: np.ndarray, z_u: np.ndarray, counts: np.ndarray, prior: float, start: float) -> float:
    """The intercept of least risk within 3 of the start; of equal ones the nearest to it."""
    tried = sorted((start + k / 50 for k in range(-150, 151)), key=lambda b: abs(b - start))
    return min(tried, key=lambda b: round(risk(z_p, z_u, counts, prior, b), 12))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray) -> Model:
    """Non-negative risk with the sigmoid loss l(z) = 1 / (1 + e^z)."""
    model = standardised(mean, scale)
    p, u = model.expanded(positive), model.expanded(unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w[:-1] + w[-1]), _sigmoid(u @ w[:-1] + w[-1])
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)  # slope of the risk of being called good
        gp, gu = np.r_[dp @ p, dp.sum()], np.r_[du @ u, du.sum()]
        # R_p(+) falls as sp rises; the estimated negative risk is pushed back up where it is below zero
        return gu - 2 * prior * gp if su.mean() >= prior * sp.mean() else prior * gp - gu

    w = _descend(gradient, p.shape[1], STEPS)
    model.weights, model.intercept = w[:-1], float(w[-1])
    return model


def described(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, free (neither held out nor without an id), x (the numbers, as 32-bit floats): one row a row of docs."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(statistics(t or ""), "<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "free")), pa.array(rows, pa.binary())], names=["doc_id", "held_out", "free", "x"])

    free = F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), free.alias("free"), "text")
    return rows.mapInArrow(describe, "doc_id long, held_out boolean, free boolean, x binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), len(statistics(""))).astype(np.float64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the number of rows, and the sums of each number and of its square, in whole multiples."""
    for batch in batches:
        if batch.num_rows:
            x = np.clip(matrix(batch.column("x")), -LARGEST, LARGEST)
            whole = [np.rint(v * (1 << FIXED)).astype(np.int64).sum(axis=0) for v in (x, x * x)]
            yield pa.RecordBatch.from_arrays([pa.array([[batch.num_rows, *whole[0].tolist(), *whole[1].tolist()]], pa.list_(pa.int64()))], names=["sums"])


def _scale(free: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, and the mean and deviation of each number."""
    k = len(statistics(""))
    parts = free.select("x").mapInArrow(_sums, "sums array<long>")
    total = parts.agg(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(2 * k + 1)]).first()
    n = int(total[0] or 0)
    if not n:
        return 0, np.zeros(k), np.ones(k)
    mean, square = (np.array([float(v) for v in total[1 + at : 1 + at + k]]) / n / (1 << FIXED) for at in (0, k))
    return n, mean, np.sqrt(np.maximum(0, square - mean * mean)) + 1e-6


def _bins(free: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all rows' scores before the intercept, and how many lie in each: BINS + 1 rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, n = np.unique(bin_of(model.expanded(matrix(batch.column("x"))) @ model.weights), return_counts=True) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(n, pa.int64())], names=["bin", "n"])

    found = free.select("x").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    return np.array([r["bin"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)


def _sampled(rows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The ids and the numbers of a bounded sample, one row an id, in order of id."""
    one = rows.groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by([("doc_id", "ascending")])
    return one.column("doc_id").to_pylist(), matrix(one.column("x")) if one.num_rows else np.zeros((0, len(statistics(""))))


def fit(rows: DataFrame, labels: DataFrame, *, most: int = SAMPLE) -> Model | None:
    """rows: as described() gives them, written. The model, or None where there is nothing to fit on."""
    free, spark = rows.filter("free"), rows.sparkSession
    ids = labelled_ids(labels.filter("quality = 1"), "quality", folds=FOLDS, not_fold=HELD_OUT, most=most).select("doc_id")
    _, positive = _sampled(free.join(F.broadcast(ids), "doc_id"))  # `most` ids
    n, mean, scale = _scale(free)
    if not n or not len(positive):
        return None
    known, unlabelled = _sampled(free.orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id", "x").limit(most))
    first = separate(positive[::2], unlabelled[::2], mean, scale)
    seen = spark.createDataFrame([(i,) for i in known[::2]], "doc_id long")  # half of `most` ids
    at, counts = _bins(free.join(F.broadcast(seen), "doc_id", "left_anti"), first)
    if not len(at):  # one row
        at, counts = _bins(free, first)
    prior = estimate_prior(bin_of(first.expanded(positive[1::2] if len(positive) > 1 else positive) @ first.weights), at, counts)
    model = train(positive, unlabelled, prior, mean, scale)
    at, counts = _bins(free, model)
    model.intercept = best_intercept(model.expanded(positive) @ model.weights, of_bin(at), counts, prior, model.intercept)
    return model


def scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return np.ones(len(x)) if model is None else model.scores(x)


def score_quality(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a row of docs."""
    rows = materialize(described(docs), "quality-numbers")
    model = fit(rows, labels, most=most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(model, matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns. Their texts are described once more, not shuffled."""
    rows = materialize(described(docs), "quality-numbers")
    model = fit(rows, labels, most=most)
    discard(rows)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores(model, feature_rows([t or "" for t in text])) if len(text) else np.zeros(0))

    return docs.filter(score(docs["text"]) >= THRESHOLD)
