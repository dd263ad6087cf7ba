"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation should be a system turn or none, then pairs of a user's and an assistant's turn. Rows may be kept,
given another role or deleted, and empty turns inserted, each at a cost; of equally cheap edits the ASCII-least
string of their initials (Delete, Insert, Keep, Rerole) wins. A Viterbi pass holds one survivor a state of that
grammar. Survivors are leaves of a tree of backpointers whose nodes count their references: a path that loses its
last survivor is freed, and the edits that all survivors share are emitted at once, so a task holds only what is
still open. Survivors of one row never begin one another (each has as many row edits, and ends in one), so the
order of their complete open strings is carried on as a rank, and a tie costs no second look at them. A survivor
that another can imitate for less, whatever follows, is dropped, so regular conversations settle within a few rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketpanel.llm.common import query, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
# States: nothing yet, after the system turn, after a user's, after an assistant's. A user's turn may follow
# all but a user's, an assistant's only a user's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# What it can cost a survivor of one state at most to go on as one of another would, by (imitated, imitating): turns
# inserted first, and a system turn deleted that only a conversation not yet begun may keep.
IMITATION = {
    ASSISTANT: {USER: INSERT, SYSTEM: 2 * INSERT, START: 2 * INSERT},
    USER: {ASSISTANT: INSERT, SYSTEM: INSERT, START: INSERT},
    SYSTEM: {START: 0, ASSISTANT: 0, USER: INSERT},
    START: {SYSTEM: max(2 * INSERT, DELETE), ASSISTANT: DELETE, USER: INSERT + DELETE},
}
LEGAL = ("su", "ua", "au")
OUT_ROWS, OUT_CHARS = 2000, 2 << 20


def _after(state: int) -> int:
    """Where a user's or an assistant's turn, whichever may follow, leads."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, deletes_only: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row: insertions as far as they reach a new state, then an edit of the row."""
    out = []
    for state in range(4):
        at, cost, letters = state, 0, ""
        for _ in range(3 if state in (START, SYSTEM) else 2):
            out.append((state, at, cost + DELETE, letters + "D"))
            if not deletes_only:
                held = cost + truncated * TRUNCATED
                if initial == "s" and at == START:
                    out.append((state, SYSTEM, held + KEEP, letters + "K"))
                if initial == "u" and at != USER or initial == "a" and at == USER:
                    out.append((state, _after(at), held + KEEP, letters + "K"))
                out.append((state, _after(at), held + REROLE, letters + "R"))
            at, cost, letters = _after(at), cost + INSERT, letters + "I"
    return out


class _Node:
    """One edit: a letter, the state that it leads to, and how many children and survivors refer to it."""

    __slots__ = ("parent", "letter", "state", "refs", "children")

    def __init__(self, parent: _Node | None, letter: str, state: int):
        self.parent, self.letter, self.state, self.refs, self.children = parent, letter, state, 0, []
        if parent is not None:
            parent.refs += 1
            parent.children.append(self)


def _release(node: _Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        parent = node.parent
        if parent is not None:
            parent.children.remove(node)
        node.parent, node = None, parent


class Viterbi:
    """Feeds rows of one conversation in order and yields (letter, state after it) of each edit as it is settled."""

    _known: dict[tuple[str, bool, bool], list[tuple[int, int, int, str]]] = {}

    def __init__(self):
        self.root = _Node(None, "", START)
        self.root.refs = 1
        # state -> (cost, rank among the survivors, node)
        self.survivors: dict[int, tuple[int, int, _Node]] = {START: (0, 0, self.root)}
        self.cost = 0

    def row(self, initial: str, deletes_only: bool, truncated: bool) -> Iterator[tuple[str, int]]:
        kind = (initial if initial in ("s", "u", "a") else "", deletes_only, truncated)
        if kind not in self._known:
            self._known[kind] = _moves(*kind)
        best: dict[int, tuple[int, int, str, int]] = {}
        for origin, state, cost, letters in self._known[kind]:
            if origin in self.survivors:
                held, rank, _ = self.survivors[origin]
                candidate = (held + cost, rank, letters, origin)
                if state not in best or candidate < best[state]:
                    best[state] = candidate
        costs = {state: cost for state, (cost, _, _, _) in best.items()}
        for state, cost in costs.items():
            if any(other in costs and costs[other] + extra < cost for other, extra in IMITATION[state].items()):
                del best[state]  # whatever would follow, another survivor ends cheaper
        order = sorted((rank, letters, state) for state, (_, rank, letters, _) in best.items())
        ranks = {state: place for place, (_, _, state) in enumerate(order)}
        fresh = {}
        for state, (cost, _, letters, origin) in best.items():
            node = self.survivors[origin][2]
            for k, letter in enumerate(letters):
                last = k == len(letters) - 1
                node = _Node(node, letter, state if last else _after(node.state))
            node.refs += 1
            fresh[state] = (cost, ranks[state], node)
        self._replace(fresh)
        yield from self._settled()

    def finish(self) -> Iterator[tuple[str, int]]:
        """The rest, once there are no more rows; `cost` is then that of all edits."""
        ends = []
        for state, (cost, rank, node) in self.survivors.items():
            at, letters = state, ""
            for _ in range(3):
                if at in ACCEPTED:
                    ends.append((cost + INSERT * len(letters), rank, letters, state))
                at, letters = _after(at), letters + "I"
        self.cost, _, letters, state = min(ends)
        node = self.survivors[state][2]
        for letter in letters:
            node = _Node(node, letter, _after(node.state))
        node.refs += 1
        self._replace({node.state: (self.cost, 0, node)})
        yield from self._settled()

    def _replace(self, fresh: dict[int, tuple[int, int, _Node]]) -> None:
        for _, _, node in self.survivors.values():
            _release(node)
        self.survivors = fresh

    def _settled(self) -> Iterator[tuple[str, int]]:
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self.root.letter, self.root.state


def _fault(role: str, text: str, seen: bool) -> str:
    held = text.rstrip(BLANKS)
    return "blank" if not held else "duplicate" if seen else "truncated" if held[-1] not in ".!?" else ""


class _Conversation:
    """Rows that wait for their edits, and the edits of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.viterbi, self.waiting, self.place = conv_id, Viterbi(), deque(), 0

    def add(self, turn, role: str, text: str, seen: bool) -> Iterator[tuple]:
        fault = _fault(role, text, seen)
        self.waiting.append((turn, role, text, fault))
        yield from self._edits(self.viterbi.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def end(self) -> Iterator[tuple]:
        yield from self._edits(self.viterbi.finish())
        if not self.place:
            yield (self.conv_id, None, None, None, None, None, None, None, 0)

    def _edits(self, settled: Iterator[tuple[str, int]]) -> Iterator[tuple]:
        for letter, state in settled:
            if letter == "I":
                out = (None, None, "", ROLES[state], "", INSERT)
            else:
                turn, role, text, fault = self.waiting.popleft()
                cut = TRUNCATED * (fault == "truncated" and letter != "D")
                if letter == "D":
                    out = (turn, role, fault, None, None, DELETE)
                else:
                    out = (turn, role, fault, role if letter == "K" else ROLES[state], text, cut + (KEEP if letter == "K" else REROLE))
            yield (self.conv_id, self.place, letter, *out)
            self.place += 1


_EDITS = (
    "conv_id bigint, place bigint, edit string, turn bigint, old_role string, fault string, role string, text string, cost bigint"
)
_EDIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
_EDIT_NAMES = [c.split()[0] for c in _EDITS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _EDIT_NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EDIT_TYPES)], names=_EDIT_NAMES)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of rows sorted by conversation and place. Beside a conversation's open rows a task holds one row and the
    batch that it fills."""
    now: _Conversation | None = None
    before = later = None  # the last row, and the last mark of a text seen in an earlier turn
    out: list[tuple] = []
    chars = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "mark", "text")]
        for conv_id, turn, role, digest, mark, text in zip(*columns):
            new: list[tuple] = []
            if now is None or now.conv_id != conv_id:
                new += now.end() if now else ()
                now, before, later = _Conversation(conv_id), None, None
            key = (turn, role, digest)
            if mark == 0:
                later = key
            elif text is not None:  # rows that the conversation has lost tell only that it exists
                new += now.add(turn, role, text, key == before or key == later)
                before = key
            out += new
            chars += sum(len(r[7] or "") for r in new)
            if len(out) >= OUT_ROWS or chars > OUT_CHARS:
                yield _batch(out)
                out, chars = [], 0
    out += now.end() if now else ()
    yield _batch(out)


def repair_conversations(turns: DataFrame, kept: str | None = None) -> DataFrame:
    """One row an edit: (conv_id, place, edit, turn, old_role, fault, role, text, cost) of `turns` (conv_id, turn,
    role, text). `place` counts the edits of a conversation from 0, and the rows of a conversation come in that order
    in one partition. `role` and `text` are those after the edit, null for a deleted row; `fault` is blank, duplicate
    (role and text seen earlier in the conversation), truncated or empty.

    Rows are taken by turn, nulls first, those of one turn by role and the SHA-256 of their text. A null role or text
    is one blank. Rows of a null conv_id are a conversation. `kept` may name a column that is not true in rows that are
    lost: a conversation without other rows gives one row without an edit. An empty table gives an empty result, and
    other columns are not read.

    Copies in one turn lie side by side once sorted. Those in later turns are found beforehand by a window over narrow
    rows, and a mark is sorted in front of each, so no task holds the texts that a conversation has had. What a task
    reads is one conversation after another: a long one is sorted outside memory and streamed.
    """
    lost = ~F.coalesce(F.col(kept), F.lit(False)) if kept else F.lit(False)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.lit(1).alias("mark"), F.when(~lost, text).alias("text"),
    )
    full = rows.filter(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    keys = ["conv_id", "role", "digest"]
    turn = F.col("turn").asc_nulls_first()
    again = (
        full.select(*keys, "turn").distinct().withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(turn)))
        .filter("n > 1").select("conv_id", "turn", "role", "digest", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("text"))
    )
    dealt = rows.unionByName(again).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), turn, "role", "digest", "mark")
    return dealt.mapInArrow(_repaired, _EDITS)


_SUMMARY = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


class _Summary:
    """Counts, audit and digest of a conversation; the repaired text itself is never held."""

    def __init__(self, conv_id):
        self.conv_id, self.cost, self.illegal, self.distinct = conv_id, 0, 0, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.digest, self.lines = bytearray(), hashlib.sha256(), 0
        self.initial = self.first = self.last = None

    def add(self, edit, turn, old_role, fault, role, text, cost) -> None:
        if edit is None:
            return
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + old_role[:1] not in LEGAL
            self.initial = old_role[:1]
            if turn is not None and turn != self.last:  # turns come in order
                self.first = turn if self.first is None else self.first
                self.last, self.distinct = turn, self.distinct + 1
        if edit != "D":
            self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    now: _Summary | None = None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "old_role", "fault", "role", "text", "cost")]
        for conv_id, *edit in zip(*columns):
            if now is None or now.conv_id != conv_id:
                out += [now.row()] if now else []
                now = _Summary(conv_id)
            now.add(*edit)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 9, types)], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types)], names=names)


def summaries(edits: DataFrame) -> DataFrame:
    """One row a conversation: gaps between the turns, rows of each fault, adjacent roles that may not follow one
    another, cost, initials of the edits and SHA-256 of the repaired `role:text` lines. `edits` must come as
    repair_conversations gives them, each conversation in order and in one partition; nothing is shuffled again."""
    return edits.mapInArrow(_summed, _SUMMARY)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of op13: dropped (not `kept`), emptied, stripped of sentence ends, doubled or made the user's, as the
    CRC-32 of conversation and turn says. Nulls are one blank, in that key too."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), which.alias("which"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("which") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("which") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("which") != 0).alias("kept"), copies.alias("_"),
    ).drop("_")


def _oracle() -> str:
    """The grammar as a fold over the rows of a conversation. The four survivors are texts of cost, audit and repaired
    lines, so that the least text is the cheapest with the least audit."""
    add = lambda c, cost, letter, line="''": (
        f"lpad(CAST(CAST(left({c}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr(split_part({c}, chr(1), 1), 10) || '{letter}' || chr(1)"
        f" || substr({c}, instr({c}, chr(1)) + 1) || {line}"
    )
    insert = lambda c, role: add(c, INSERT, "I", f"chr(10) || '{role}:'")
    row = lambda c, cost, letter, role: add(c, f"({cost} + r[2]::INTEGER)", letter, f"chr(10) || {role} || ':' || r[5]")
    keep = lambda c, initial: f"CASE WHEN r[1] = '0' AND r[3] = '{initial}' THEN {row(c, KEEP, 'K', 'r[4]')} END"
    rerole = lambda c, name: f"CASE WHEN r[1] = '0' THEN {row(c, REROLE, 'R', repr(name))} END"
    delete = lambda c: add(c, DELETE, "D")
    first = f"least(a[3], {insert('a[1]', 'user')}, {insert('a[2]', 'user')})"
    closed = f"""list_transform([[a[1], a[2], {first}, a[4]]], lambda a:
      list_transform([[a[1], a[2], a[3], least(a[4], {insert('a[3]', 'assistant')})]], lambda a: [a[1], a[2], least(a[3], {insert('a[4]', 'user')}), a[4]])[1])[1]"""
    users = ", ".join(f(c, x) for c in ("c[1]", "c[2]", "c[4]") for f, x in ((keep, "u"), (rerole, "user")))
    step = f"""[{delete('c[1]')}, least({delete('c[2]')}, {keep('c[1]', 's')}), least({delete('c[3]')}, {users}),
      least({delete('c[4]')}, {keep('c[3]', 'a')}, {rerole('c[3]', 'assistant')})]"""
    blanks = r"\x20\x09-\x0D"
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)) AS t),
keyed AS (
  SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
  SELECT keyed.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda k: ascii(substr(key, k, 1))::BIGINT)),
    lambda c, b: xor(crc.t[((xor(c, b)) & 255) + 1], c >> 8))) % 20 AS h FROM keyed, crc
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows_
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{blanks}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{blanks}]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
), grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list([CASE WHEN fault IN ('blank', 'duplicate') THEN '1' ELSE '0' END, CASE fault WHEN 'truncated' THEN '1' ELSE '0' END, left(role, 1), role, text] ORDER BY i) AS rs
  FROM judged GROUP BY conv_id
), folded AS (
  SELECT * EXCLUDE (rs), list_transform([list_reduce(list_prepend(['000000000' || chr(1), NULL, NULL, NULL], rs),
    lambda a, r: list_transform([{closed}], lambda c: {step})[1])], lambda a: {closed})[1] AS f FROM grouped
), ended AS (SELECT * EXCLUDE (f), least(f[1], f[4]) AS best FROM folded)
SELECT id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(split_part(best, chr(1), 1), 10), '') AS audit,
  sha256(coalesce(substr(best, instr(best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS id FROM conversations) ids LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.id
"""


@query("op13_conversations", _oracle())
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(repair_conversations(damaged(table(spark, sf_dir, "conversations")), "kept"))
