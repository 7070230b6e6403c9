"""Repair of conversation structure: the cheapest edits, by bidirectional Dijkstra over the edit lattice.

Damage first (for measuring): a checksum of conversation and turn decides which rows are dropped, emptied, stripped of
their sentence ends, repeated or given to the user. Then each conversation's rows are read in order, the first fault of
each is noted, and the cheapest edits are looked for that make its roles `(s?(ua)+)?`.

Lattice. A node is (rows read, state of the role pattern); keep, rerole and delete lead to the next row, insert to
another state of the same row. A forward heap starts at the first node, a reverse heap at the accepting last nodes; the
nearer one goes on. They meet at the least cost of a crossing; both go on until no crossing of that cost can be
missing, i.e. until their tops add up to more. Then the least audit from the start to each forward node, and from each
reverse node to the end, are put together at every crossing of the least cost, and the least whole audit wins. (Of two
cheapest ways to one node neither audit is a prefix of the other, so least parts make a least whole.)

Scale. One shuffle by conversation, sorted; a task reads its rows as a stream. Of a row the search sees one letter;
conversations of one shape are solved once. A long one is cut into segments of SEGMENT rows: the search runs between
each pair of states of a segment, and the segments' answers are put together. Its texts wait in task-local scratch
beyond HELD_BYTES. The digest of a repaired conversation is sequential, so one conversation is one task's work.

Defined cases: a null in role or text counts as one space, and so it does where the checksum takes conversation or
turn; rows of a null conv_id are one conversation; rows of one turn are ordered by role, then text, null turns first;
an empty role has no initial and fits no pattern; without rows after damage the counts are 0, the audit is empty and
the digest is that of an empty string; an empty table gives an empty result; other columns are never read, whatever
they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, worker_cache

SEGMENT = 512
HELD_BYTES = 64 << 20
#: Shapes that a worker remembers, of conversations of at most so many rows.
SHAPES, SHAPE_ROWS = 200_000, 64
OUT_ROWS = 2000

# The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; a conversation may end in these.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
LEGAL = frozenset(("su", "ua", "au"))

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and times: how often the row is there, 0 where it is dropped."""
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))


# The lattice. A shape has a letter a row: its initial (x where it is none of s, u, a), upper case if the row is
# truncated, - if it must go. Node 4 * i + state: i rows are read.


def following(shape: str, node: int) -> Iterable[tuple[int, int, str]]:
    """(node, cost, edit) of the edits at a node."""
    i, state = divmod(node, 4)
    turned = ASSISTANT if state == USER else USER  # what a rerole or an insert gives here
    yield 4 * i + turned, INSERT, "I"
    if i == len(shape):
        return
    yield node + 4, DELETE, "D"
    letter = shape[i]
    if letter == "-":
        return
    more = TRUNCATED if letter.isupper() else 0
    yield 4 * (i + 1) + turned, REROLE + more, "R"
    kept = {"s": SYSTEM if state == NOTHING else -1, "u": USER if turned == USER else -1, "a": ASSISTANT if turned == ASSISTANT else -1}.get(letter.lower(), -1)
    if kept >= 0:
        yield 4 * (i + 1) + kept, more, "K"


def leading(shape: str, node: int) -> Iterable[tuple[int, int, str]]:
    """(node, cost, edit) of the edits that lead to a node."""
    i, state = divmod(node, 4)
    for before in (*range(4 * i, 4 * i + 4), *(range(4 * i - 4, 4 * i) if i else ())):
        for to, cost, edit in following(shape, before):
            if to == node:
                yield before, cost, edit


def search(shape: str, start: int, ends: Iterable[int]) -> tuple[int, str]:
    """The least cost from state `start` before the rows to one of the states `ends` after them, and its least audit."""
    sides = []
    for roots, edges in (((start,), following), (tuple(4 * len(shape) + e for e in ends), leading)):
        sides.append(({r: 0 for r in roots}, [(0, r if edges is following else -r) for r in roots], {}, edges))
        heapq.heapify(sides[-1][1])
    (ahead, ahead_heap, ahead_done, _), (back, back_heap, back_done, _) = sides
    far = 1 << 60
    least = min((0 for n in ahead if n in back), default=far)
    while ahead_heap or back_heap:
        tops = [heap[0][0] if heap else far for heap in (ahead_heap, back_heap)]
        if sum(tops) > least:  # every crossing of the least cost has been met
            break
        one = 0 if tops[0] <= tops[1] else 1
        reached, heap, done, edges = sides[one]
        other = sides[1 - one][0]
        cost, key = heapq.heappop(heap)
        node = abs(key)
        if node in done:
            continue
        done[node] = cost
        for to, more, _ in edges(shape, node):
            if cost + more < reached.get(to, far):
                reached[to] = cost + more
                heapq.heappush(heap, (cost + more, to if one == 0 else -to))
            if to in other:
                least = min(least, cost + more + other[to])
    # Keeps cost nothing and lead to a higher node, so this order never meets a node before its predecessors.
    prefix, suffix = {start: ""}, {n: "" for n, c in back.items() if c == 0 and n >= 4 * len(shape) and n - 4 * len(shape) in ends}
    for node, cost in sorted(ahead_done.items(), key=lambda x: (x[1], x[0])):
        for to, more, edit in following(shape, node):
            if ahead_done.get(to) == cost + more and to != start and (to not in prefix or prefix[node] + edit < prefix[to]):
                prefix[to] = prefix[node] + edit
    roots = frozenset(suffix)
    for node, cost in sorted(back_done.items(), key=lambda x: (x[1], -x[0])):
        for to, more, edit in leading(shape, node):
            if back_done.get(to) == cost + more and to not in roots and (to not in suffix or edit + suffix[node] < suffix[to]):
                suffix[to] = edit + suffix[node]
    found = [prefix[n] + suffix[n] for n in prefix.keys() & suffix.keys() if ahead[n] + back[n] == least]
    found += [prefix[n] + edit + suffix[to] for n in prefix for to, more, edit in following(shape, n) if to in suffix and ahead[n] + more + back[to] == least]
    return least, min(found)


def solve(shape: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Least cost and least audit of a whole conversation."""
    if len(shape) <= segment:
        return search(shape, NOTHING, ENDS)
    known = {NOTHING: (0, "")}
    for at in range(0, len(shape), segment):
        part, then = shape[at : at + segment], {}
        for state, (cost, audit) in known.items():
            for end in range(4):
                if end == NOTHING and state != NOTHING or end == SYSTEM and state not in (NOTHING, SYSTEM):
                    continue  # no edit leads back there
                if end == SYSTEM and state == NOTHING and not any(c in "sS" for c in part):
                    continue
                more, tail = search(part, state, (end,))
                then[end] = min(then.get(end, (1 << 60, "")), (cost + more, audit + tail))
        known = then
    return min(known[e] for e in ENDS if e in known)


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The rows after the edits."""
    rows, state = iter(rows), NOTHING
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        turned = ASSISTANT if state == USER else USER
        if edit in "RI":
            role = "assistant" if turned == ASSISTANT else "user"
        state = SYSTEM if edit == "K" and role[:1] == "s" else turned
        yield role, text


class _Texts:
    """Rows that wait for their audit, in memory up to HELD_BYTES, then in scratch that goes with the task."""

    def __init__(self) -> None:
        self.rows, self.bytes, self.file = [], 0, None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.bytes += len(text) + 100
        if self.bytes > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for r, t in self.rows:
                for raw in (r.encode(), t.encode()):
                    self.file.write(len(raw).to_bytes(8, "little") + raw)
            self.rows, self.bytes = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file is not None:
            self.file.seek(0)
            while size := self.file.read(8):
                role = self.file.read(int.from_bytes(size, "little")).decode()
                yield role, self.file.read(int.from_bytes(self.file.read(8), "little")).decode()
        yield from self.rows


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.texts, self.letters, self.seen = conv_id, _Texts(), [], set()
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, ended: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=20).digest()
        fault = "blank" if blank else "duplicate" if mark in self.seen else "" if ended else "truncated"
        self.seen.add(mark)
        if fault:
            self.counts[fault] += 1
        letter = initial if initial in ("s", "u", "a") else "x"
        self.letters.append("-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        self.texts.add(role, text)

    def result(self, shapes: dict[str, tuple[int, str]]) -> tuple:
        shape = "".join(self.letters)
        answer = shapes.get(shape) or solve(shape)
        if len(shape) <= SHAPE_ROWS and len(shapes) < SHAPES:
            shapes[shape] = answer
        digest = hashlib.sha256()
        for k, (role, text) in enumerate(repaired(self.texts, answer[1])):
            digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), self.illegal, *answer, digest.hexdigest()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place -> one row a conversation."""
    shapes = worker_cache("conversation-shapes", dict)
    now, out = None, []

    def full() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for conv_id, turn, role, text, times, blank, ended in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "blank", "ended")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result(shapes))
                if len(out) >= OUT_ROWS:
                    yield full()
                    out = []
                now = _Conversation(conv_id)
            for _ in range(times):
                now.add(turn, role, text, blank, ended)
    if now is not None:
        out.append(now.result(shapes))
    if out:
        yield full()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation."""
    rows = damage(conversations)
    rows = rows.withColumn("blank", ~F.col("text").rlike(WORD_PATTERN)).withColumn("ended", F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair, SCHEMA)


#: crc32 is spelled out bit by bit. The edits of a row, with up to two inserts before it, are a table; the least label of
#: each state is carried from row to row (two inserts in a row lead to either later state, more of them never pay).
ORACLE_SQL = r"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
    xor(list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')], lambda crc, b:
      list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295), 4294967295) % 20 AS kind
  FROM conversations
), kept AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role0 END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM damaged WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM kept
), judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM numbered
), pairs AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY conv_id
), ins(q, to_q, cost, op) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')
), eat(q, to_q, initial, cost, op) AS (VALUES (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (3, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'), (0, 2, NULL, 3, 'R'), (1, 2, NULL, 3, 'R'), (3, 2, NULL, 3, 'R'), (2, 3, NULL, 3, 'R')
), label AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])} AS best FROM counted
  UNION ALL
  SELECT conv_id, k, q, min(best) FROM (
    SELECT l.conv_id, l.k + 1 AS k, e.to_q AS q, {'cost': l.best.cost + i.cost + e.cost + CASE WHEN p.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': l.best.audit || i.op || e.op,
      'said': list_concat(list_concat(l.best.said, CASE i.op WHEN 'II' THEN ['user:', 'assistant:'] WHEN 'I' THEN [CASE WHEN i.to_q = 2 THEN 'user:' ELSE 'assistant:' END] ELSE [] END), [CASE WHEN e.op = 'K' THEN p.role WHEN e.to_q = 2 THEN 'user' ELSE 'assistant' END || ':' || p.text])} AS best
    FROM label l JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.k = l.k + 1 AND p.fault NOT IN ('blank', 'duplicate') JOIN ins i ON i.q = l.q JOIN eat e ON e.q = i.to_q AND (e.initial IS NULL OR e.initial = p.initial)
    UNION ALL
    SELECT l.conv_id, l.k + 1, i.to_q, {'cost': l.best.cost + i.cost + 4, 'audit': l.best.audit || i.op || 'D', 'said': list_concat(l.best.said, CASE i.op WHEN 'II' THEN ['user:', 'assistant:'] WHEN 'I' THEN [CASE WHEN i.to_q = 2 THEN 'user:' ELSE 'assistant:' END] ELSE [] END)}
    FROM label l JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.k = l.k + 1 JOIN ins i ON i.q = l.q
  ) GROUP BY conv_id, k, q
), ended AS (
  SELECT l.conv_id, min({'cost': l.best.cost + i.cost, 'audit': l.best.audit || i.op, 'said': list_concat(l.best.said, CASE WHEN i.op = 'I' THEN ['assistant:'] WHEN i.op = 'II' THEN ['user:', 'assistant:'] ELSE [] END)}) AS best
  FROM label l JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.n = l.k JOIN ins i ON i.q = l.q AND i.to_q IN (0, 3) GROUP BY l.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
