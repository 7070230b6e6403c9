"""Main text of web pages by tag-path ratios.

1. A page is cut into tags and text. Open elements (with the ends that HTML implies) give each piece of text its path
   from the root; inline elements are not part of it. Equal paths are one node of a trie.
2. Each path gathers the length of its text, of its links, and its punctuation marks.
3. Ratios: characters outside links a block, and punctuation marks a block. They are smoothed along the trie: a path
   takes part of what its parent, children, siblings, grandparent and grandchildren have, less the further they are, so
   that headings and short paragraphs of an article go with it. Paths inside an `article`, `main` or an element
   named like one are as near to each other as can be.
4. The two ratios are multiplied (fused), with the share of text outside links. What elements say of themselves enters as a
   factor: PRIOR inside an article, 0 inside menus, footers, adverts and so on (tags, roles, names, hidden elements).
5. Paths that reach THRESHOLD of the page's best are content; on a page that names no article, so are the paths of which
   less than half is links below the element that holds all these. Their blocks are decoded, white space is made one
   space, and they are joined in page order.

A page is one row, and its work is linear in its length: nothing is shuffled and nothing is gathered across pages.

Defined cases: null html is empty; a page without content paths has the empty text; unclosed, misnested and cut-off tags,
comments and references are read as browsers do, as far as text goes; `br` is white space; a table's row is one block;
white space is what Unicode says; repeated rows each get their own row; an empty table gives an empty result; other
columns are never read, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long, n_paths long, n_content_paths long"

#: Shares that a path takes of paths one and two steps away; how much an article's paths count; how near to the best.
NEAR, FAR = 0.6, 0.3
PRIOR = 20.0
THRESHOLD = 0.35

# Element names by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img td th".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "option": ("option",)}
#: An implied end never reaches beyond these.
_SCOPE = frozenset("ul ol dl table article section aside nav main body html div form".split())
_LEFT_OUT = frozenset("nav footer aside form head noscript object svg canvas audio video button select menu dialog template math datalist fieldset".split())
_RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp|template"
_ARTICLE = frozenset(("article", "main"))

# Words by which elements name what they hold, in classes, ids and roles.
_BOILERPLATE = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar menu menus nav navbar navigation navigate breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond toolbar pagination pager widget widgets copyright legal disclaimer alert "
    "contentinfo complementary search searchbox toc skip outbrain taboola paywall reactions discussion feedback responses "
    "kommentar kommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicité publicidad".split()
)
_CONTENT = frozenset("article articlebody post postbody entry story content maincontent maintext".split())
_LINKING = frozenset("has with no without is".split())
_MARKS = re.compile(r"[.,;:!?\"'…。、，；：！？¿¡«»“”„()]")

_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+(?:/>|>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+(?![a-z])")

LEFT_OUT, PLAIN, ARTICLE = 0, 1, 2


def standing(tag: str, attributes: str, inside: int) -> int:
    """Whether an element, and what is in it, is left out, plain, or part of an article; `inside`: its parent's."""
    if tag in _LEFT_OUT or (tag == "header" and inside != ARTICLE):
        return LEFT_OUT
    found = {}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), next((v for v in values if v), ""))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return LEFT_OUT
    names = [[w.lower() for w in _WORD.findall(name)] for key in ("class", "id", "role") for name in found.get(key, "").split()]
    if any("comment" in n or "comments" in n for n in names) and not any(_LINKING & set(n) for n in names):
        return LEFT_OUT  # even where it is an article
    if tag in ("html", "body"):
        return inside
    if tag in _ARTICLE or found.get("role", "").lower() in _ARTICLE:
        return ARTICLE if inside != LEFT_OUT else LEFT_OUT
    if any(n and (n[-1] in _BOILERPLATE or n[0] in _BOILERPLATE) and not _LINKING & set(n) for n in names):
        return LEFT_OUT
    if inside == PLAIN and any(n and "header" in (n[0], n[-1]) and n[0] not in _CONTENT for n in names):
        return LEFT_OUT
    if inside == PLAIN and tag not in _INLINE and any(n and (n[-1] in _CONTENT or "".join(n) in _CONTENT) for n in names):
        return ARTICLE
    return inside


class _Page:
    """The trie of a page's paths and its blocks."""

    def __init__(self) -> None:
        self.children: dict[tuple[int, str, int], int] = {}
        self.parent, self.standing, self.depth = [0], [PLAIN], [0]
        self.chars, self.linked, self.marks, self.n = [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []

    def node(self, parent: int, tag: str, standing: int) -> int:
        key = (parent, tag, standing)
        if key not in self.children:
            self.children[key] = len(self.parent)
            self.parent.append(parent)
            self.standing.append(standing)
            self.depth.append(self.depth[parent] + 1)
            for counts in (self.chars, self.linked, self.marks, self.n):
                counts.append(0)
        return self.children[key]

    def block(self, path: int, pieces: list[tuple[str, bool]]) -> None:
        text = " ".join("".join(p for p, _ in pieces).split())
        if not text:
            return
        self.blocks.append((path, text))
        self.n[path] += 1
        self.chars[path] += len(text)
        self.linked[path] += min(len(text), sum(len(p) for p, link in pieces if link))
        self.marks[path] += len(_MARKS.findall(text))

    def content(self) -> set[int]:
        """The paths that hold content."""
        size = len(self.parent)
        used = [x for x in range(size) if self.n[x] and self.standing[x] != LEFT_OUT]
        own = {x: (self.chars[x] - self.linked[x], self.chars[x], self.marks[x], self.n[x]) for x in used}
        nothing = (0, 0, 0, 0)
        add = lambda a, b, w=1.0: tuple(p + w * q for p, q in zip(a, b, strict=True))
        below, far_below, article = {}, {}, nothing
        for x, counts in own.items():
            below[self.parent[x]] = add(below.get(self.parent[x], nothing), counts)
            up = self.parent[self.parent[x]]
            far_below[up] = add(far_below.get(up, nothing), counts)
            if self.standing[x] == ARTICLE:
                article = add(article, counts)
        score = {}
        for x, counts in own.items():
            if self.standing[x] == ARTICLE:
                total = article
            else:
                up = self.parent[x]
                near = add(own.get(up, nothing), below.get(x, nothing))
                far = add(add(own.get(self.parent[up], nothing), add(below[up], counts, -1.0)), far_below.get(x, nothing))
                total = add(add(counts, near, NEAR), far, FAR)
            plain, chars, marks, n = total
            score[x] = (1 + plain / n) * (1 + marks / n) * ((1 + plain) / (1 + chars)) * (PRIOR if self.standing[x] == ARTICLE else 1.0)
        best = max(score.values(), default=0.0)
        chosen = {x for x, s in score.items() if s >= THRESHOLD * best}
        if not article[3] and chosen:  # headings, lists and tables in the element that holds what was chosen
            held = [int(x in chosen) for x in range(size)]
            for x in range(size - 1, 0, -1):  # a path comes after its parent
                held[self.parent[x]] += held[x]
            home = max((x for x in range(size) if held[x] == len(chosen) and x not in chosen), default=0)  # the lowest above all
            if self.depth[home] > 2:
                inside = [x == home for x in range(size)]
                for x in range(1, size):
                    inside[x] = inside[x] or inside[self.parent[x]]
                chosen |= {x for x in own if inside[x] and x != home and 2 * self.linked[x] < self.chars[x]}
        return chosen


def read(source: str) -> _Page:
    """A page's paths and blocks. Text of elements that are left out is not kept."""
    page, at = _Page(), 0
    stack: list[tuple[str, int, int]] = []  # tag, path, standing
    pieces: list[tuple[str, bool]] = []
    links, open_now = 0, Counter()

    def path() -> int:
        return stack[-1][1] if stack else 0

    def standing_now() -> int:
        return stack[-1][2] if stack else PLAIN

    def flush() -> None:
        nonlocal pieces
        if pieces:
            page.block(path(), pieces)
            pieces = []

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            if stack[-1][0] not in _INLINE or stack[-1][2] != (stack[-2][2] if len(stack) > 1 else PLAIN):
                flush()
            tag = stack.pop()[0]
            links -= tag == "a"
            open_now[tag] -= 1

    def say(text: str) -> None:
        if text and standing_now() != LEFT_OUT:
            pieces.append((html.unescape(text), links > 0))

    def find(tags: tuple[str, ...], scope: bool) -> int:
        """The place in the stack of the nearest open one of these elements; -1 where none is open in scope."""
        if not any(open_now[t] for t in tags):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if scope and stack[i][0] in _SCOPE:
                return -1
        return -1

    for m in _TOKEN.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                say(" ")
            continue
        tag = tag.lower()
        if m["end"]:
            i = find((tag,), tag in ("p", "li", "dt", "dd"))
            if tag == "br":
                say(" ")
            elif i >= 0:
                if tag not in _INLINE:
                    flush()
                    close(i)
                elif all(t in _INLINE for t, _, _ in stack[i:]):
                    close(i)
            elif tag not in _INLINE:
                flush()
            continue
        if tag in ("br", "hr") or tag in ("td", "th"):
            say(" ")
        if tag in _CLOSES_P and (i := find(("p",), True)) >= 0:
            flush()
            close(i)
        if tag in _SIBLINGS and (i := find(_SIBLINGS[tag], True)) >= 0:
            while i and stack[i - 1][0] in _SIBLINGS[tag]:
                i -= 1
            close(i)
        if tag not in _INLINE and tag not in ("br",):
            flush()
        if tag in _VOID:
            continue
        inside = standing_now()
        if inside == LEFT_OUT and tag in _ARTICLE and all(s != LEFT_OUT or t == "form" for t, s in ((t, s) for k, (t, _, s) in enumerate(stack) if k == 0 or stack[k - 1][2] != LEFT_OUT)):
            inside = PLAIN  # a form around the whole page
        now = standing(tag, m["attributes"], inside)
        if now != standing_now():
            flush()
        stack.append((tag, path() if tag in _INLINE and now == standing_now() else page.node(path(), tag, now), now))
        links += tag == "a"
        open_now[tag] += 1
    say(source[at:])
    flush()
    return page


def extract(source: str) -> tuple[str, int, int]:
    """The main text of a page, its number of paths with text, and of those that are content."""
    page = read(source)
    chosen = page.content()
    return "\n".join(text for path, text in page.blocks if path in chosen), sum(1 for n in page.n if n), len(chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(source or "") for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_paths", "n_content_paths"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_paths, n_content_paths: one row a row of pages."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, SCHEMA)
