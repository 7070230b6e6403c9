"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidates: three base kinds by pattern, and a further kind, `token`, of long
mixed-character strings whose letters are close to random. Only their places and hashes leave that pass; no value is
written anywhere. They are then counted over the whole corpus by hash: in how many distinct repositories and for how
many distinct owners a value occurs, and in how many places. A value that many owners or repositories share, or that
stands in many places of one of them, is a widely copied example; one that stays with few of each looks live. Base
spans are always reported; a `token` candidate becomes a span only if its value looks live.

Distinct repositories and owners are counted after a partial distinct, so a value that stands in a third of all
documents sends one row for each task and repository, not one for each document; the counts of such values go back to
their places by a bounded broadcast.

Defined cases: null text is empty text and has no span; the null repository or owner counts as one of its own; an
empty table gives an empty result; repeated rows each get their own result row; offsets are code points, end
exclusive; other columns of the input are never read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

# The base patterns of the query contract, with the lengths it asks for.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "token")

#: The method's own candidates: strings of 20 or more of these, with letters and digits, of this entropy a character.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
TOKEN_BITS = 3.5
#: A value looks live that at most so many owners and repositories share and that stands in at most so many places.
LIVE_OWNERS, LIVE_REPOS, LIVE_PLACES = 2, 4, 20

SCAN_SCHEMA = "row long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,end:long,kind:int,value_sha256:string>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


class Scanner:
    """Finds the candidates of one text: (start, end, index of the kind, value)."""

    def __init__(self) -> None:
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.words = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
        # A run that is too short holds no shorter match, so the length may stand in the pattern.
        self.access = re.compile(r"AKIA[A-Z0-9]{16,}")
        self.hex = re.compile(r"[0-9a-f]{24,}")
        self.token = re.compile(TOKEN)
        self.long_word = re.compile(r"[!-~]{20,}")

    def base(self, text: str) -> list[tuple[int, int, int, str]]:
        found = []
        if self.words.search(text):
            found += [(m.start(), m.end(), 0, m[2]) for m in self.assign.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
        if "AKIA" in text:
            found += [(m.start(), m.end(), 1, m[0]) for m in self.access.finditer(text)]
        return found

    def scan(self, text: str) -> list[tuple[int, int, int, str]]:
        found, more = self.base(text), []
        for run in self.long_word.finditer(text):  # both further kinds lie in long runs of printable ASCII
            found += [(m.start(), m.end(), 2, m[0]) for m in self.hex.finditer(text, run.start(), run.end())]
            for m in self.token.finditer(text, run.start(), run.end()):
                value = m[0]
                if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= TOKEN_BITS:
                    more.append((m.start(), m.end(), 3, value))
        taken = sorted((s, e) for s, e, _, _ in found)
        more = [x for x in more if not any(s < x[1] and x[0] < e for s, e in taken)]
        return sorted(found + more, key=lambda x: (x[0], x[2]))


def spans(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        out = []
        for text in batch.column("text"):
            found = scanner.scan(text.as_py() or "")
            base = [x for x in found if x[2] < 3]
            n = Counter(x[2] for x in base)
            out.append((n[0], n[1], n[2], hashlib.sha256(spans(base).encode()).hexdigest(), [{"start": s, "end": e, "kind": k, "value_sha256": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in found]))
        a, b, c, sha, found = zip(*out) if out else ((),) * 5
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value_sha256", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("repo"), batch.column("owner"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(sha, pa.string()), pa.array(found, kind)],
            names=["row", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def candidates(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    """One row a document with its candidates. The text itself goes no further."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.expr(repo).cast("string").alias("repo"), F.expr(owner).cast("string").alias("owner"), F.col("text")
    )
    return rows.mapInArrow(_scan, SCAN_SCHEMA)


def ownership(rows: DataFrame) -> DataFrame:
    """value_sha256, n_repos, n_owners, n_places, live: one row a distinct candidate value of the corpus."""
    each = rows.select("repo", "owner", F.explode("found").alias("f")).select("repo", "owner", "f.value_sha256")
    some = each.groupBy("value_sha256", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    marks = [F.coalesce(F.col(c), F.lit("\0")) for c in ("repo", "owner")]
    counted = some.groupBy("value_sha256").agg(F.countDistinct(marks[0]).alias("n_repos"), F.countDistinct(marks[1]).alias("n_owners"), F.sum("n").alias("n_places"))
    return counted.withColumn("live", (F.col("n_owners") <= LIVE_OWNERS) & (F.col("n_repos") <= LIVE_REPOS) & (F.col("n_places") <= LIVE_PLACES))


def find_secrets(docs: DataFrame, *, repo: str = "to_json(struct(source, lang))", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, secrets (with their ownership)."""
    rows = materialize(candidates(docs, repo, owner), "secret-candidates")
    owned = materialize(ownership(rows), "secret-owners")
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    total = rows.agg(F.sum(F.size("found"))).first()[0] or 0
    each = lookup(each, owned, ["value_sha256"], "n_places", total).filter((F.col("kind") < 3) | F.col("live"))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", "kind", names.alias("name"), "end", "value_sha256", "n_repos", "n_owners", "n_places", "live")
    found = each.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("secrets"))
    out = rows.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").join(found, "row", "left")
    text = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("secrets", lambda x: x["live"])), F.lit(0)).cast("long").alias("n_live"), F.coalesce(F.size(F.filter("secrets", lambda x: ~x["live"])), F.lit(0)).cast("long").alias("n_examples"),
        F.to_json("secrets").alias("secrets"),
    )
