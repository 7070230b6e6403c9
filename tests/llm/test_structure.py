"""Manifest, conversation repair and HTML extraction against plain Python, on odd tables too."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import pytest

from catalith.llm import conversations, html_text, manifest

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Manifest.


def joined(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for i, source, lang, n, text in rows:
        leaf, bad = joined(*map(part, (i, source, lang, n, text))), i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups[lang].append((i, leaf, joined(*map(part, (i, source, lang, n + 1, text))) if bad else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in groups[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for g, lang in enumerate(langs):
        for k, (i, leaf, folded) in enumerate(groups[lang]):
            siblings = []
            for levels, at in ((trees[lang], k), (top, g)):
                for level in levels[:-1]:
                    if (at ^ 1) < len(level):
                        siblings.append(level[at ^ 1])
                        folded = joined(level[at ^ 1], folded) if at % 2 else joined(folded, level[at ^ 1])
                    else:
                        folded = joined(folded)
                    at //= 2
            out.append((i, leaf, trees[lang][-1][0], top[-1][0], joined(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos long, node string"
_random = random.Random(11)
MANIFESTS = {
    "none": [], "one": [(0, "a", "en", 1, "t")], "three": [(i, "a", "en", 1, "t") for i in range(3)],
    "wide ids": [(_random.randrange(-(2**62), 2**62), "s", _random.choice([None, "", "en", "é", "日"]), _random.choice([None, 5]), _random.choice([None, "", "text é"])) for _ in range(1500)],
    "one id for a third": [(7, "a", "en", 3, str(i % 300)) for i in range(1500)] + [(None, "a", "en", 3, str(i)) for i in range(700)] + [(i, "b", None, 1, "t") for i in range(2100)] + [(-5, "b", "en", None, "q")] * 600,
    "many groups": [(i, None, f"l{i % 1030}", 1, "t") for i in range(1100)],
}


@pytest.mark.parametrize("case", MANIFESTS)
def test_manifest_equals_plain_trees(spark, case):
    rows = MANIFESTS[case]
    df = spark.createDataFrame([(*r, "x", -1, "y") for r in rows], DOCS).repartition(3)
    assert rows_of(manifest.manifest(df)) == plain_manifest(rows)


def test_containers_rank_like_sorted_ids():
    import numpy as np

    for n in (0, 1, 5, manifest.SPARSE, manifest.SPARSE + 1, 3000, 1 << manifest.CHUNK_BITS):
        low = np.sort(np.array(_random.sample(range(1 << manifest.CHUNK_BITS), n), np.int64))
        data = manifest.encode(low)
        assert data[:1] == (b"a" if n <= manifest.SPARSE else b"b") and manifest.decode(data).tolist() == low.tolist()
        every = np.arange(1 << manifest.CHUNK_BITS)
        assert manifest.rank(data, manifest.directory(data), every).tolist() == np.searchsorted(low, every).tolist()


def test_manifest_of_a_table_and_its_sql(spark):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    want = plain_manifest(rows)
    assert sorted(map(tuple, con.sql(manifest.ORACLE_SQL).fetchall()), key=str) == want
    assert rows_of(manifest.manifest(spark.read.parquet(f"{SF_DIR}/documents.parquet"))) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 4


# Conversations.


def cheapest(rows):
    """rows: (role, text, fault). Dynamic programming over whole (cost, audit, output)."""
    label = {0: (0, "", ())}

    def insert(label):
        label = dict(label)
        for _ in range(3):
            for q, (c, a, o) in list(label.items()):
                to = 3 if q == 2 else 2
                new = (c + 3, a + "I", (*o, ("assistant" if to == 3 else "user") + ":"))
                label[to] = min(label.get(to, new), new)
        return label

    for role, text, fault in rows:
        then = defaultdict(list)
        for q, (c, a, o) in insert(label).items():
            then[q].append((c + 4, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            more, to = 3 * (fault == "truncated"), 3 if q == 2 else 2
            then[to].append((c + 3 + more, a + "R", (*o, ("assistant" if to == 3 else "user") + ":" + text)))
            state = {"s": 1 if q == 0 else None, "u": 2 if to == 2 else None, "a": 3 if to == 3 else None}.get(role[:1])
            if state:
                then[state].append((c + more, a + "K", (*o, role + ":" + text)))
        label = {q: min(v) for q, v in then.items()}
    return min(v for q, v in insert(label).items() if q in (0, 3))


def plain_repair(rows):
    kept = defaultdict(list)
    for c, t, role, text in rows:
        kept[c] += []
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, found in kept.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            end = text.rstrip("\x20\t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, said = cheapest([(r, x, f) for (_, r, x), f in zip(found, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, joined("\n".join(said))))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, times int, blank string, ended double"
ODD = [(_random.choice([None, 1, 2, 3, 4]), _random.choice([None, 0, 1, 2, 5, 9]), _random.choice([None, "", "user", "assistant", "system", "User"]), _random.choice([None, "", " \t", "Hi.", "Hi", "What? \n", "é。"])) for _ in range(120)]
CASES = {"none": [], "odd": ODD, "one long": [(5, i, "user" if i % 3 else "assistant", f"t{i % 90}" + "." * (i % 4 > 0)) for i in range(1300)], "all dropped": [(i, 0, "user", "Hi.") for i in range(200)], "repeated": [(1, 1, "user", "Hi.")] * 5, "long text": [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "x" * 900_000)]}


@pytest.mark.parametrize("case", CASES)
def test_repair_equals_dynamic_programming(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame([(*r, 7, "q", 0.5) for r in rows], CONVERSATIONS)
    assert rows_of(conversations.repair(df)) == plain_repair(rows)


def test_searches_meet_at_the_least_audit():
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for _ in range(600):
        shape = "".join(_random.choice("suaxSUAX-") for _ in range(_random.randrange(12)))
        want = cheapest([(names[c.lower()], "t", "blank" if c == "-" else "truncated" if c.isupper() else "") for c in shape])[:2]
        assert conversations.search(shape, conversations.NOTHING, conversations.ENDS) == want
        assert all(conversations.solve(shape, segment) == want for segment in (1, 2, 5))


def test_waiting_texts_spill(monkeypatch):
    monkeypatch.setattr(conversations, "HELD_BYTES", 300)
    held = conversations._Texts()
    rows = [(f"r{i}", "é\n" * i) for i in range(20)]
    for r in rows:
        held.add(*r)
    assert held.file is not None and list(held) == rows == list(held)


def test_repair_of_a_table_and_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF_DIR}/conversations.parquet'")
    want = plain_repair(con.sql("select * from conversations").fetchall())
    assert sorted(map(tuple, con.sql(conversations.ORACLE_SQL).fetchall()), key=str) == want
    assert rows_of(conversations.repair(spark.read.parquet(f"{SF_DIR}/conversations.parquet"))) == want


# Pages.


def plain_article(source):
    """The text of a page of the test tables, by its article tags."""
    blocks = (html.unescape(re.sub("<[^>]*>", " ", b)).split() for b in re.split("</?(?:p|h1)>", re.search("<article>(.*?)(?:</article>|$)", source, re.DOTALL)[1]))
    return "\n".join(" ".join(b) for b in blocks if b)


def test_every_page_gives_its_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = plain_article(r["html"])
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


PLAIN = """<!doctype html><html><head><title>T</title><style>x</style></head><body class="has-sidebar"><div id="page"><div class="site-header"><div class="logo">The best site, ever.</div></div><div class="top-menu"><a href=x>Home</a></div>
<div class="col"><h2>Heading one</h2><p>First paragraph, with text; it is long enough, I think. And more text, more commas, more of everything.</p><p>Second &amp; last <a href=q>link</a>, again with text. It is long, it is good.<br>line&nbsp;two</p>
<ul><li>item one, short<li>item two.</ul><table><tr><td>a<td>b<tr><td>c</table></div><div class="box"><a href=1>Read more</a><a href=2>Other</a></div><form><input><p>Subscribe, now. Please, enter your mail, here.</p></form>
<div class="comments"><p>Great article, I loved it. Really, really good!</p></div><div id=cookie-notice>We use cookies, of course.</div></div></body></html>"""
PAGES = [
    (PLAIN, "Heading one\nFirst paragraph, with text; it is long enough, I think. And more text, more commas, more of everything.\nSecond & last link, again with text. It is long, it is good. line two\nitem one, short\nitem two.\na b\nc"),
    ("", ""), ("<p>a", "a"), ("a < b & c &lt;p&gt;", "a < b & c <p>"), ("<article><p>one<b>bold</b>two</p>tail<script>if(a<b){}</script>end<!-- c", "oneboldtwo\ntail end"),
    ("<nav><ul><li>a</ul><p>in nav</nav><p>Out, there.</p>", "Out, there."), ("<form id=f><header>h</header><main><p>Text here.</p></main></form>", "Text here."), ("<article class=comment>no</article><article>yes</article>", "yes"),
    ('<div hidden>no</div><p title="a>b">yes</p>', "yes"), ("<nav>only, a menu.</nav>", ""), ("<article><header><h1>Title</h1></header><p>One.</p><aside>no</aside><footer>no</footer><div class='share-bar'>no</div></article>", "Title\nOne."),
    ("<article><p>" + "word " * 50_000 + "</p></article>", ("word " * 50_000).strip()),
]


def test_pages_of_other_kinds(spark):
    df = spark.createDataFrame([(i, None, h, -1, "x") for i, (h, _) in enumerate(PAGES)] + [(None, "u", None, 0, "y")] * 2, "page_id long, url string, html string, n_chars long, text string")
    got = sorted((tuple(r)[:4] for r in html_text.main_texts(df).collect()), key=str)
    assert got == sorted([(i, None, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, "u", "", 0)] * 2, key=str)
    assert html_text.main_texts(df.limit(0)).collect() == []


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 20_000 + "a", "<p class='x " * 20_000, "<div><p>t <b>" * 10_000, "</q>" * 50_000 + "<div><b>" * 5_000 + "</i>" * 5_000, "<" * 100_000, "&" * 100_000, "<!--" * 20_000):
        html_text.extract(page)
    assert time.time() - began < 20


def test_tag_path_ratios_ignore_chaff():
    pieces = ["<", ">", "<p>", "</div>", "<b", "'", '"', "&am", "<!--", "-->", "<script>", "x", "<article>", "</article>", " "]
    for _ in range(500):
        text, _, _ = html_text.extract("".join(_random.choice(pieces) for _ in range(30)))
        assert text == "\n".join(" ".join(line.split()) for line in text.split("\n")) and not text.startswith("\n")
