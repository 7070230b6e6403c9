"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Lexicon. From a bounded sample of labelled rows outside the held-out fold: words that stand (almost) only in toxic
documents, in enough documents to be no accident and in enough different contexts to be no copied passage; and
stems, the heads that several such longer words share, so that inflected forms unseen in the sample count too. A head that
clean documents hold as well, but far more seldom, is a weak stem: one hit says little, several say much.

Matching. The terms form a trie. The Levenshtein automata of the permitted distance (0, 1 or 2 by the term's length;
any letter may be edited, the first too) are intersected with it, and the product is made deterministic state by state
as words ask for it. A word is walked once and its verdict is kept. Inexact matches that occur in clean sample documents are ordinary words
and are not counted. Terms that a stem covers stay in the trie: an inexact form of one counts as a hit of that stem,
pure or weak.

Scoring. Each hit looks at the window of WINDOW words around it: inside quotation marks, or beside a reporting verb,
it weighs QUOTED of a hit; further hits in the window raise it. The sums over the whole text go through a logistic
model fitted on the sample, with a prior that every kind of hit points to toxicity.

Defined cases: null text is empty text and has no hit; without toxic rows to learn from there is no lexicon and every
score is the base rate (0 without labels); repeated rows each get their own row; other columns of the input are never
read, whatever they are called.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .sampling import held_out, labelled_ids, texts_of

FOLDS, HELD_OUT = 3, 1
SAMPLE = 16_000
#: Ordinary words that come near to a term, at most; of more the ones in most sample documents, of equal ones the first.
ORDINARY = 400_000
PURITY = 0.97
STEM_LENGTHS = (4, 5, 6, 7, 8)
STEM_KINDS = 4
#: A weak stem is so many times as frequent among toxic documents, and its log-likelihood ratio at least so large.
LIFT, RATIO = 4.0, 30.0
WINDOW = 8
QUOTED = 0.4
THRESHOLD = 0.7
#: Words whose verdict a worker keeps, and nodes in the states of its automaton; beyond either they start anew.
KEPT, KEPT_NODES = 300_000, 2_000_000

#: Verbs that report speech, and marks that enclose it.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes reported dit écrit appelé sagte schrieb nannte dijo escribió llamó".split())
MARKS = "\"“”„«»"

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_exact long, n_stem long, n_fuzzy long"
WORD = re.compile(r"\w+")
#: Digits that stand for letters.
LOOKALIKE = str.maketrans("013457", "oieast")


def permitted(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms and stems, with the automaton that finds inexact terms."""

    NONE, EXACT, STEM, FUZZY, WEAK, FAINT, BENT = range(7)  # FAINT, BENT: an inexact form of a weak, a pure stem's term

    def __init__(self, terms: list[str], stems: list[str], weak: list[str] = (), ordinary: list[str] = ()) -> None:
        self.terms, self.stems, self.weak, self.ordinary = frozenset(terms), frozenset(stems), frozenset(weak), frozenset(ordinary)
        self.lengths = sorted({len(s) for s in [*stems, *weak]})
        self.children: list[dict[str, int]] = [{}]  # node 0 is the root
        self.ends: list[int] = [-1]  # edits permitted to the term that ends here
        self.kind: list[int] = [self.NONE]  # what an inexact form of that term counts as
        self.allow: list[int] = [0]  # the most edits that any term below permits
        for term in terms:
            node, most = 0, permitted(term)
            self.allow[node] = max(self.allow[node], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.kind.append(self.NONE)
                    self.allow.append(0)
                node = self.children[node][c]
                self.allow[node] = max(self.allow[node], most)
            self.ends[node] = most
            heads = {term[:k] for k in self.lengths if len(term) > k}
            self.kind[node] = self.BENT if heads & self.stems else self.FAINT if heads & self.weak or term in self.weak else self.FUZZY
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept: list[int] = []
        self.nodes = 0
        self.moves: list[dict[str, int]] = []
        self.known: dict[str, int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        """The number of a state, -1 if it is empty. Of a node's edit counts only the least matters."""
        best: dict[int, int] = {}
        todo = list(found)
        while todo:
            node, e = todo.pop()
            if e > self.allow[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]  # a letter of the term may be missing
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            ended = {self.kind[n] for n, e in key if e <= self.ends[n]}
            self.accept.append(next((k for k in (self.FUZZY, self.BENT, self.FAINT) if k in ended), self.NONE))
            self.nodes += len(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                found.add((self.children[node][c], e))
            found.add((node, e + 1))
            found.update((child, e + 1) for letter, child in self.children[node].items() if letter != c)
        self.moves[state][c] = out = self._state(found)
        return out

    def nearest(self, word: str) -> int:
        """FUZZY where some term lies within its permitted distance, BENT or FAINT where only forms of stems do."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return self.NONE
        return self.accept[state]

    def near(self, word: str) -> bool:
        """Whether some term lies within its permitted distance."""
        return self.nearest(word) != self.NONE

    def _verdict(self, word: str) -> int:
        if any(len(word) > k and word[:k] in self.stems for k in self.lengths):
            return self.STEM
        if word in self.terms:
            return self.EXACT
        if any(len(word) > k and word[:k] in self.weak for k in self.lengths):
            return self.WEAK
        plain = word if word.isalpha() else word.translate(LOOKALIKE)
        if len(plain) < 4 or word.isdigit() or word in self.ordinary or not self.terms:
            return self.NONE
        return self.FUZZY if plain in self.terms else self.nearest(plain)

    def verdicts(self, words: list[str]) -> list[int]:
        if len(self.known) > KEPT or self.nodes > KEPT_NODES:
            self._reset()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._verdict(w)
        return [known[w] for w in words]


#: Any hit of each kind, the weighted sums of each kind, the strongest window; then four about weak stems.
FEATURES = 11


def features(lexicon: Lexicon, text: str) -> list[float]:
    """The FEATURES numbers, then the plain counts of exact, stem and inexact hits."""
    low = text.lower()
    words = WORD.findall(low)
    marks = [lexicon.STEM if v == lexicon.BENT else v for v in lexicon.verdicts(words)]
    n_weak = marks.count(lexicon.WEAK) + marks.count(lexicon.FAINT)
    hits = [i for i, v in enumerate(marks) if v and v < lexicon.WEAK]
    weak = [math.log1p(n_weak), float(n_weak > 1), float(n_weak > 2), min(20.0, 100 * n_weak / (20 + len(words)))]
    if not hits:
        return [0.0] * 7 + weak + [0, 0, 0]
    at = [m.start() for m in WORD.finditer(low)]
    quotes = [i for i, c in enumerate(low) if c in MARKS] if any(c in low for c in MARKS) else []
    sums, counts, strongest = [0.0] * 4, [0] * 4, 0.0
    for k, i in enumerate(hits):
        line = low.rfind("\n", 0, at[i])
        enclosed = (bisect_left(quotes, at[i]) - bisect_right(quotes, line)) % 2 == 1
        reported = any(w in REPORTING for w in words[max(0, i - WINDOW) : i + WINDOW + 1])
        company = sum(1 for j in hits[max(0, k - WINDOW) : k + WINDOW + 1] if j != i and abs(j - i) <= WINDOW)
        weight = (QUOTED if enclosed or reported else 1.0) * (1 + 0.25 * company)
        sums[marks[i]] += weight
        counts[marks[i]] += 1
        strongest = max(strongest, weight)
    return [*(float(c > 0) for c in counts[1:]), *(math.log1p(s) for s in sums[1:]), min(strongest, 4.0), *weak, *counts[1:]]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def learn(sample: DataFrame) -> Lexicon:
    """sample: doc_id, text, label. Only the terms and stems reach the driver, which the sample bounds."""
    one = sample.select("label", "text").groupBy(F.sha2("text", 256).alias("doc")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    rows = materialize(one.select("doc", "label", _words(F.col("text")).alias("words")), "toxic-sample")
    toxic, clean = rows.filter("label = 1"), rows.filter("label = 0")
    pairs = toxic.select("doc", F.explode(F.arrays_zip(F.col("words").alias("w"), F.concat(F.array(F.lit("")), F.col("words")).alias("before"))).alias("p")).select("doc", "p.*").filter("w is not null")
    counts = lambda key: [F.countDistinct("doc").alias("t"), F.countDistinct("before").alias("contexts"), F.countDistinct("w").alias("kinds")]
    by_word = pairs.groupBy("w").agg(F.countDistinct("doc").alias("t"), F.countDistinct("before").alias("contexts"))
    heads = lambda df: df.filter(F.length("w") > STEM_LENGTHS[0]).withColumn("stem", F.explode(F.array_compact(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEM_LENGTHS]))))
    by_stem = heads(pairs).groupBy("stem").agg(*counts("stem"))
    other = materialize(clean.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "toxic-clean-words")
    n_toxic, n_all, n_words = toxic.count(), rows.count(), other.count()
    if not n_toxic or n_toxic == n_all:
        return Lexicon([], [])
    least = max(4, math.ceil(math.log(100 * max(n_words, 100)) / math.log(n_all / n_toxic)))
    def against_clean(found: DataFrame, key: str, clean_counts: DataFrame) -> DataFrame:
        """Adds n, the clean documents, and ratio, the log-likelihood ratio of the two frequencies."""
        both = found.join(clean_counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        t, n, every = F.col("t"), F.col("n"), float(n_toxic) / n_all
        part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
        return both.withColumn("ratio", 2 * (part(t, (t + n) * every) + part(n, (t + n) * (1 - every))))

    terms = against_clean(by_word.filter((F.col("t") >= least) & (F.col("contexts") >= least)), "w", other)
    terms = terms.filter(F.col("t") >= PURITY * (F.col("t") + F.col("n")))
    common = (F.col("t") >= least) & (F.col("contexts") >= least) & (F.col("kinds") >= STEM_KINDS)
    stems = against_clean(by_stem.filter(common), "stem", heads(other).groupBy("stem").agg(F.sum("n").alias("n")))
    lift = (F.col("t") / n_toxic) >= LIFT * (F.col("n") / (n_all - n_toxic))
    stems = stems.withColumn("pure", F.col("t") >= PURITY * (F.col("t") + F.col("n"))).filter(F.col("pure") | (lift & (F.col("ratio") >= RATIO)))
    words = sorted(r["w"] for r in terms.select("w").collect())
    found = stems.orderBy(F.desc("ratio"), F.desc(F.length("stem")), "stem").select("stem", "pure").collect()
    kept: set[str] = set()
    for stem in sorted((r["stem"] for r in found if r["pure"]), key=lambda x: (len(x), x)):  # a stem that a shorter one covers adds nothing
        if not any(stem[:k] in kept for k in STEM_LENGTHS if k < len(stem)):
            kept.add(stem)
    weak: set[str] = set()
    for stem in (r["stem"] for r in found if not r["pure"]):  # of one family the most telling
        if not any(stem.startswith(x) or x.startswith(stem) for x in weak):
            weak.add(stem)
    lexicon = Lexicon(words, sorted(kept), sorted(weak))

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [v in (Lexicon.FUZZY, Lexicon.FAINT, Lexicon.BENT) for v in lexicon.verdicts(batch.column("w").to_pylist())]
            yield batch.filter(pa.array(near, pa.bool_()))

    usual = [r["w"] for r in other.select("w", "n").mapInArrow(ordinary, "w string, n long").orderBy(F.desc("n"), "w").limit(ORDINARY).collect()]
    return Lexicon(words, sorted(kept), sorted(weak), sorted(usual))


#: The prior means of the weights: hits of any kind point to toxicity.
PRIOR = np.array([3.0, 3.0, 2.5, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.1])
RIDGE = 1.0


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR; the last weight is the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.r_[PRIOR, -3.0]
    center, pull = w.copy(), np.r_[np.full(FEATURES, RIDGE), 1e-3]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + pull * (w - center)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def scorer(lexicon: Lexicon, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(lexicon, t or "") for t in batch.column("text").to_pylist()], np.float64).reshape(-1, FEATURES + 3)
            score = 1 / (1 + np.exp(-np.clip(x[:, :FEATURES] @ weights[:-1] + weights[-1], -30, 30)))
            counts = x[:, FEATURES:].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *(pa.array(counts[:, k]) for k in range(3))], names=["doc_id", "held_out", "score", "predicted", "n_exact", "n_stem", "n_fuzzy"]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    ids = labelled_ids(labels, "toxic", folds=FOLDS, not_fold=HELD_OUT, most=most)
    sample = materialize(texts_of(docs, ids).withColumn("text", F.coalesce("text", F.lit(""))), "toxic-labelled")
    lexicon = learn(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(lexicon, t)[:FEATURES] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    found = sample.select("label", "text").mapInArrow(measure, "label int, x array<double>").toArrow()
    y = found.column("label").to_numpy().astype(np.float64)
    if not len(y):
        return lexicon, np.r_[np.zeros(FEATURES), -30.0]
    return lexicon, fit_weights(np.array(found.column("x").to_pylist(), np.float64), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_exact, n_stem, n_fuzzy: one row a row of docs."""
    lexicon, weights = fit(docs, labels, most=most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(scorer(lexicon, weights), SCHEMA)
