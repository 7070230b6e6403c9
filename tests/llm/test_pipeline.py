"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

import corpus_pipeline
from catalith.llm import mixing, quality
from catalith.llm.common import materialize, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The tables before and after each stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_DIR), "test"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_rejected_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = {r["doc_id"] for r in quality.score_quality(stages[0], labels).filter("predicted = 1").collect()}
    assert set(texts(stages[1])) == good
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(known[i] for i in good if i in known) >= 0.97 * sum(known.values())


def test_one_of_equal_texts_stays(stages):
    last = {}
    for i, t in texts(stages[1]).items():
        last[t or ""] = max(i, last.get(t or "", -1))
    assert set(texts(stages[2])) == set(last.values())


def test_one_of_near_texts_stays(stages):
    rows = texts(stages[2])
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(rows), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert set(texts(stages[3])) == {i for i in rows if find(i) == i}


def test_documents_come_as_often_as_the_mix_takes_them(stages):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(stages[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want


def test_windows_hold_every_token_once(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == want
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sha string, _hash long, _kept_id long, _gone long, key string, row long, `a.b` int"
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n", "de", None), (6, BASE + " more", "en", "b"), (7, " ".join(f"long{i}" for i in range(30_000)), "en", "b"), (8, "one", "fr", "c"),
    (9, "near " + BASE.replace("word3 ", "x "), "en", "a"), (9, "near " + BASE.replace("word3 ", "y "), "en", "a"), (10, "ONE two", "fr", "c"), (10, "ONE two", "fr", "c"), (None, "no id here at all", "en", "a"), (None, None, "en", "a"),
]


def odd_table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, "s", 1, 2, 3, "k", 4, 5) for i, t, lang, src in rows], ODD_SCHEMA)


def test_dedup_stages_on_odd_rows(spark):
    docs = odd_table(spark, ODD)
    one = corpus_pipeline.exact_duplicates(spark, docs, SF_DIR)
    rows = one.collect()
    assert one.columns == docs.columns
    assert Counter((r["text"] or "") for r in rows) == Counter({t or "" for _, t, _, _ in ODD})
    kept = {r["text"] or "": r["doc_id"] for r in rows}
    assert kept[BASE] == 2 and kept[""] == 4 and kept["ONE two"] == 10
    near = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert near.columns == docs.columns
    ids = Counter(r["doc_id"] for r in near.collect())
    # 1, 2, 6 and both of 9 are linked, so 1 stays; 10 comes once; texts without words stay
    assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 10: 1, None: 2})
    pair = corpus_pipeline.near_duplicates(spark, odd_table(spark, [r for r in ODD if r[0] == 9]), SF_DIR)
    assert pair.count() == 1


def test_other_stages_on_odd_rows(spark):
    docs = odd_table(spark, ODD)
    good = corpus_pipeline.quality_classifier(spark, docs, SF_DIR)
    assert good.columns == docs.columns and good.count() <= len(ODD)
    mixed = corpus_pipeline.source_mix(spark, docs, SF_DIR)
    want = Counter(r["doc_id"] for r in mixing.mix_sources(docs).collect() for _ in range(r["copies"]))
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == want
    pieces = corpus_pipeline.windows(spark, docs, SF_DIR).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(ODD)


def test_stages_on_an_empty_table(spark):
    docs = odd_table(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.windows(spark, docs, SF_DIR).count() == 0
