"""Repair of conversation structure: the cheapest edits that give well-formed turns.

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  A Viterbi search over
four states (nothing yet, after a system turn, after a user turn, after an assistant turn) finds
the cheapest edits: keep, change the role, delete, insert an empty turn.  Survivors are leaves of a
tree of back pointers whose nodes count what points at them; branches that no survivor needs go at
once, and as soon as all survivors share an ancestor, its edits are final, go out and are
forgotten.  What is held is the part on which survivors still differ, not the conversation; ties
compare the differing parts of both edit strings in full.

Rows are dealt by conversation, sorted on disk where need be, and streamed: no conversation is
collected.  One conversation is one stream, as its digest is of its whole text in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.functions.shared import shuffle_partitions

# Characters and costs of the edits.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
UNDELETED_TRUNCATED = 5
ENDS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
NAME = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that an edit can make
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


class Node:
    """An edit after those of ``parent``; ``refs`` counts the children and survivors that hold it."""

    __slots__ = ("depth", "edit", "parent", "refs", "turn")

    def __init__(self, parent: Node | None, edit: str, turn: tuple[str, str] | None) -> None:
        self.parent, self.edit, self.turn, self.refs = parent, edit, turn, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def before(p: Node, e: str, q: Node, f: str) -> bool:
    """Whether the edits up to ``p`` and then ``e`` come before those up to ``q`` and then ``f`` (or
    nothing more): both are compared in full from where they part."""
    left, right = [e] * (e != ""), [f] * (f != "")
    while p is not q:
        if p.depth >= q.depth:
            left.append(p.edit)
            p = p.parent
        else:
            right.append(q.edit)
            q = q.parent
    return left[::-1] < right[::-1]


class Repair:
    """The cheapest edits of one conversation, row by row; ``emit`` gets each edit once it is final,
    with the (role, text) that it leaves or None."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]) -> None:
        self.emit = emit
        self.root = Node(None, "", None)
        self.alive: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self.root.refs += 1
        self.n_held = self.most_held = 0  # nodes of the tree

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            above, node.parent = node.parent, None
            node = above
            self.n_held -= 1

    def _set(self, alive: list, state: int, found: tuple[int, Node, str, tuple[str, str] | None] | None) -> None:
        if found is not None:
            cost, parent, edit, turn = found
            node = Node(parent, edit, turn)
            node.refs += 1
            alive[state] = (cost, node)
            self.n_held += 1
            self.most_held = max(self.most_held, self.n_held)

    @staticmethod
    def _better(best: tuple | None, cost: int, parent: Node, edit: str, turn: tuple[str, str] | None) -> tuple:
        if best is None or cost < best[0] or cost == best[0] and before(parent, edit, best[1], best[2]):
            return (cost, parent, edit, turn)
        return best

    def _insert(self) -> None:
        """Empty turns before the next row, or at the end: where they are the cheapest way."""
        for state, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best = None
            for s in sources:
                if self.alive[s] is not None:
                    cost, node = self.alive[s]
                    best = self._better(best, cost + COST[INSERT], node, INSERT, (NAME[state], ""))
            had = self.alive[state]
            if best is not None and (had is None or best[0] < had[0] or best[0] == had[0] and before(best[1], INSERT, had[1], "")):
                self._set(self.alive, state, best)
                if had is not None:
                    self._release(had[1])

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self._insert()
        extra = UNDELETED_TRUNCATED if truncated else 0
        found: list[tuple | None] = [None] * 4
        for state, survivor in enumerate(self.alive):
            if survivor is None:
                continue
            cost, node = survivor
            found[state] = self._better(found[state], cost + COST[DELETE], node, DELETE, None)
            if must_go:
                continue
            to = KEPT.get((state, role[:1]))
            if to is not None:
                found[to] = self._better(found[to], cost + COST[KEEP] + extra, node, KEEP, (role, text))
            to = NEXT[state]
            found[to] = self._better(found[to], cost + COST[REROLE] + extra, node, REROLE, (NAME[to], text))
        self._prune(found)
        now: list[tuple[int, Node] | None] = [None] * 4
        for state in range(4):
            self._set(now, state, found[state])
        old, self.alive = self.alive, now
        for survivor in old:
            if survivor is not None:
                self._release(survivor[1])
        self._coalesce()

    @staticmethod
    def _prune(found: list) -> None:
        """Drop states that lose strictly, whatever follows: from after an assistant turn all goes
        that goes from the start, but for keeping a system turn, which a deletion replaces."""
        done = found[ASSISTANT]
        if done is not None:
            if found[START] is not None and done[0] + COST[DELETE] < found[START][0]:
                found[START] = None
            if found[SYSTEM] is not None and done[0] < found[SYSTEM][0]:
                found[SYSTEM] = None

    def _coalesce(self) -> None:
        """Emit what all survivors share."""
        if self.root.refs != 1:
            return
        path, node = [], next(s[1] for s in self.alive if s is not None)
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            if self.root.refs != 1:
                return
            self._advance(node)

    def _advance(self, node: Node) -> None:
        self.emit(node.edit, node.turn)
        node.parent, node.turn = None, None
        self.root = node
        self.n_held -= 1

    def end(self) -> int:
        """Emit the rest; the cost of all edits."""
        self._insert()
        ends = [self.alive[s] for s in (START, ASSISTANT) if self.alive[s] is not None]
        cost, node = ends[0]
        for other in ends[1:]:
            if other[0] < cost or other[0] == cost and before(other[1], "", node, ""):
                cost, node = other
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit, node.turn)
        return cost


class _Conversation:
    """Faults, edits and digest of one conversation as its rows arrive in order."""

    def __init__(self, name: object, each: Callable | None) -> None:
        self.name, self.each = name, each
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: list[int] = []  # first, last
        self.n_turns = 0
        self.initial: str | None = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.n_out = 0
        self.repair = Repair(self._emit)

    def _emit(self, edit: str, turn: tuple[str, str] | None) -> None:
        if self.each:
            self.each(self.name, len(self.audit), edit, *(turn or (None, None)))
        self.audit.append(edit)
        if turn is not None:
            self.digest.update(("\n" if self.n_out else "").encode() + f"{turn[0]}:{turn[1]}".encode())
            self.n_out += 1

    def row(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.n_turns += 1
        bare = text.rstrip(BLANKS)
        blank, truncated = not bare, False
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif bare[-1] not in ENDS:
            self.truncated += 1
            truncated = True
        initial = role[:1]
        if self.rows and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.rows += 1
        self.repair.row(role, text, blank or again, truncated)

    def end(self) -> list:
        cost = self.repair.end()
        gaps = self.turns[1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return [self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the rows with the faults that the hash of
    ``conv_id:turn`` calls for; nulls in it, in role and in text count as one space.

    A dropped row stays with ``present`` false and without its texts, so that its conversation is
    still known.  Extra columns don't come back."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    present = kind != 0
    copies = F.explode(F.array_repeat(present, F.when(kind == 3, 2).otherwise(1))).alias("present")
    return conversations.select("conv_id", "turn", F.when(present, role).otherwise("").alias("role"), F.when(present, text).otherwise("").alias("text"), copies)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted, with ``_again``: role and text were seen before."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts, "present").repartition(shuffle_partitions(rows.sparkSession), "conv_id")
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return dealt.withColumn("_again", F.row_number().over(same) > 1).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_again")


def _stream(batches: Iterator[pa.RecordBatch], each: Callable | None) -> Iterator[list | None]:
    """A summary of each conversation, whose rows lie side by side, and None after each batch."""
    at: _Conversation | None = None
    for batch in batches:
        for name, turn, role, text, present, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is None or name != at.name:
                if at is not None:
                    yield at.end()
                at = _Conversation(name, each)
            if present:
                at.row(turn, role, text, again)
        yield None
    if at is not None:
        yield at.end()


def _as_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repair_summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost
    (longs), audit, repaired_sha256.

    ``rows`` is (conv_id, turn, role, text) and, optionally, ``present``: a conversation whose rows
    are all absent has zeros, an empty audit and the digest of nothing, like one without rows.
    Rows are taken by turn, nulls first, ties by role and text.  Null roles and texts count as one
    space; the null conv_id is a conversation.  Repeated rows are duplicates.  Extra columns don't
    come back; an empty table gives no rows."""
    kinds = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
    schema = T.StructType([rows.schema["conv_id"]])
    for name, kind in kinds:
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        for summary in _stream(batches, None):
            if summary is not None:
                found.append(summary)
            elif found:
                yield _as_batch(found, arrow)
                found = []
        if found:
            yield _as_batch(found, arrow)

    return _ordered(rows).mapInArrow(run, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit in order, from 0, and the turn that it leaves;
    role and text are null for a deletion.  Odd rows as in ``repair_summaries``."""
    schema = T.StructType([rows.schema["conv_id"]]).add("place", "long").add("edit", "string").add("role", "string").add("text", "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for _ in _stream(batches, lambda *edit: made.append(edit)):
            if len(made) >= 1000:
                yield _as_batch(made, arrow)
                made.clear()
        if made:
            yield _as_batch(made, arrow)

    return _ordered(rows).mapInArrow(run, schema)


def _edits_sql() -> str:
    """(s, t, e, w, i, o): from state to state by the edits ``e`` of cost ``w``, the last of them the
    row's; ``i`` is the initial that a kept row needs, ``o`` what inserts leave, and ``n`` the role of
    the row's turn: null for none, a space for its own."""
    moves = []
    inserts = [(s, s, "", "") for s in range(4)] + [(s, t, "I", f"{NAME[t]}:") for s, t in NEXT.items()] + [(s, ASSISTANT, "II", "user:\nassistant:") for s in (START, SYSTEM)]
    for s, m, e, o in inserts:
        cost = COST[INSERT] * len(e)
        moves.append((s, m, e, cost, "", o, None))  # no row: the end
        moves.append((s, m, e + DELETE, cost + COST[DELETE], "", o, None))
        moves.append((s, NEXT[m], e + REROLE, cost + COST[REROLE], "", o, NAME[NEXT[m]]))
        moves += [(s, t, e + KEEP, cost, i, o, " ") for (f, i), t in KEPT.items() if f == m]
    values = ", ".join("({}, {}, '{}', {}, '{}', '{}', {})".format(*m[:6], "NULL" if m[6] is None else f"'{m[6]}'") for m in moves)
    return f"moves(s, t, e, w, i, o, n) AS (VALUES {values})"


# CRC-32 bit by bit; a dynamic programme over rows whose states hold the least (cost, edits, text).
QUERY_SQL = (
    f"WITH RECURSIVE {_edits_sql()}, named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations), "
    "hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST(xor(list_reduce(list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(key[j]) AS UBIGINT)),"
    " lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS BIGINT) AS kind FROM named), "
    "left_over AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0), "
    "met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM left_over), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail FROM met), "
    "judged AS (SELECT *, tail = '' AS blank, tail <> '' AND again AS duplicate, tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS truncated, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed), "
    "best(conv_id, k, s, b) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} FROM conversations UNION ALL (SELECT t.conv_id, j.k, m.t, min({'c': CAST(b.c + m.w + CASE WHEN j.truncated AND m.n IS NOT NULL THEN 5 ELSE 0 END AS BIGINT), 'a': b.a || m.e,"
    " 'r': concat_ws(chr(10), nullif(b.r, ''), nullif(m.o, ''), CASE WHEN m.n = ' ' THEN j.role ELSE m.n END || ':' || j.text)}) FROM best t JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.k = t.k + 1"
    " JOIN moves m ON m.s = t.s AND m.e NOT IN ('', 'I', 'II') AND (m.i = '' OR m.i = j.role[1]) AND (m.n IS NULL OR NOT (j.blank OR j.duplicate)) GROUP BY ALL)), "
    "ends AS (SELECT conv_id, min({'c': b.c + m.w, 'a': b.a || m.e, 'r': concat_ws(chr(10), nullif(b.r, ''), nullif(m.o, ''))}) AS b FROM best t JOIN moves m ON m.s = t.s AND m.e IN ('', 'I', 'II') AND m.t IN (0, 3) WHERE k = (SELECT coalesce(max(j.k), 0) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM t.conv_id) GROUP BY conv_id), "
    "counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (k > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id) "
    "SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(b.r) AS repaired_sha256 FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"
)
