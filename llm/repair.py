"""Conversation structure repair: generalised LR parsing over the role grammar with weighted edits.

A conversation should read `(s?(ua)+)?` by role initials. An SLR automaton is built from that grammar; its stacks are
kept as nodes (state, node below), so that stacks share what they have in common. The frontier holds, for each top
state, the nodes below it with the least (cost, audit) of all edits that lead there: equal tops merge by that minimum.
Every row is kept (shifted with its own initial), reroled, or deleted; an inserted turn is shifted without a row.

Spark damages, counts equal rows, finds repeats and faults; each conversation then streams in turn order through one
parser. What all audits of the frontier have in common is final: it goes to the running hash and is forgotten, so a
conversation of any length needs memory for the undecided rows and its audit (one character a row, the result) alone.
A SHA-256 over a whole conversation has to see it in order, so one conversation is one task's stream, never a list.

Nulls: one space in conv_id and turn of the damage key, in role and in text; rows without a turn come first, and rows
without a conv_id are one conversation. Rows of one turn are ordered by role and text; equal rows count as often as
they occur. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import BATCH_ROWS, slices, stage
from sitelens.session import read_table

#: Fixed values of the contract.
DAMAGES, DROP, EMPTY, UNMARK, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
#: (s?(ua)+)? as productions; the first is the start.
GRAMMAR = (
    ("All", ()), ("All", ("Lead", "Pairs")), ("Lead", ()), ("Lead", ("s",)),
    ("Pairs", ("Pairs", "Pair")), ("Pairs", ("Pair",)), ("Pair", ("u", "a")),
)
END = "$"
#: Two inserted turns and one deletion at most lead from any top to what another one would become.
REGRET = 2 * INSERT + DELETE
#: Characters of undecided audit from which the decided part is looked for.
LOOK = 64


class Automaton:
    """SLR automaton of a grammar without left context; stacks are interned nodes (state, node below)."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = (("", (grammar[0][0],)), *grammar)
        self.kinds = {left for left, _ in self.grammar}
        self.follow = self._follow()
        self.states: list[frozenset] = []
        self.goto: list[dict] = []
        self._state(frozenset([(0, 0)]))
        self.nodes: dict[tuple, int] = {}
        self.of: list[tuple[int, int]] = []
        self.moves: dict[tuple, tuple] = {}

    def _follow(self) -> dict[str, set]:
        empty, first, follow = set(), defaultdict(set), defaultdict(set)
        follow[""].add(END)
        while True:
            before = len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))
            for left, right in self.grammar:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first[x] if x in self.kinds else {x}
                    if x not in empty:
                        break
                after = set(follow[left])
                for x in reversed(right):
                    follow[x] |= after
                    start = first[x] if x in self.kinds else {x}
                    after = after | start if x in empty else set(start)
            if before == len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values())):
                return follow

    def _state(self, kernel: frozenset) -> int:
        items, new = set(kernel), list(kernel)
        while new:
            rule, dot = new.pop()
            wanted = self.grammar[rule][1][dot : dot + 1]
            more = {(i, 0) for i, (left, _) in enumerate(self.grammar) if (left,) == wanted} - items
            items |= more
            new += more
        whole = frozenset(items)
        if whole in self.states:
            return self.states.index(whole)
        number = len(self.states)
        self.states.append(whole)
        self.goto.append({})
        beside = defaultdict(set)
        for rule, dot in whole:
            if dot < len(self.grammar[rule][1]):
                beside[self.grammar[rule][1][dot]].add((rule, dot + 1))
        for symbol, moved in sorted(beside.items()):
            self.goto[number][symbol] = self._state(frozenset(moved))
        return number

    def node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.nodes:
            self.nodes[key] = len(self.of)
            self.of.append(key)
        return self.nodes[key]

    def after(self, state: int, below: int, symbol: str) -> tuple:
        """The (state, node below) pairs that shifting `symbol` (after reductions) leads to; at the END the accepted ones."""
        key = (state, below, symbol)
        if key not in self.moves:
            found, todo, seen = set(), [(state, below)], set()
            while todo:
                top = todo.pop()
                if top in seen:
                    continue
                seen.add(top)
                if symbol in self.goto[top[0]]:
                    found.add((self.goto[top[0]][symbol], self.node(*top)))
                for rule, dot in self.states[top[0]]:
                    left, right = self.grammar[rule]
                    if dot < len(right) or symbol not in self.follow[left]:
                        continue
                    if rule == 0:
                        found.add(top)
                        continue
                    base = top
                    for _ in right:
                        base = self.of[base[1]]
                    todo.append((self.goto[base[0]][left], self.node(*base)))
            self.moves[key] = tuple(sorted(found))
        return self.moves[key]


class Repair:
    """One conversation: push its rows in order, then finish."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.tops = {0: {-1: (0, "")}}  # top state -> node below -> least (cost, audit) that is not yet decided
        self.forced = 0  # deletions at the end of every audit
        self.waiting: deque = deque()  # rows (role, text) or counts of forced deletions, undecided
        self.decided: list[str] = []
        self.hash, self.lines, self.expect, self.look = hashlib.sha256(), 0, "u", LOOK

    def delete(self, times: int) -> None:
        """Rows that must go."""
        self.forced += times
        if self.waiting and isinstance(self.waiting[-1], int):
            self.waiting[-1] += times
        else:
            self.waiting.append(times)

    def push(self, role: str, text: str, late: bool) -> None:
        """A row that may stay; late: it is truncated."""
        self._settle()
        extra = TRUNCATED if late else 0
        new: dict = {}
        for state, links in self.tops.items():
            for below, (cost, audit) in links.items():
                self._merge(new, state, below, (cost + DELETE, audit + "D"))
        for state, links in self._inserted().items():
            for below, (cost, audit) in links.items():
                for symbol, edit, price in ((role[:1], "K", 0), ("u", "R", REROLE), ("a", "R", REROLE)):
                    for top in self.automaton.after(state, below, symbol) if symbol in ("s", "u", "a") else ():
                        self._merge(new, *top, (cost + price + extra, audit + edit))
        most = min(cost for links in new.values() for cost, _ in links.values()) + REGRET  # costlier tops never win
        kept = {s: {b: w for b, w in links.items() if w[0] <= most} for s, links in new.items()}
        self.tops = {s: links for s, links in kept.items() if links}
        self.waiting.append((role, text))
        if max(len(a) for links in self.tops.values() for _, a in links.values()) > self.look:
            self._forget()

    @staticmethod
    def _merge(tops: dict, state: int, below: int, weight: tuple) -> bool:
        links = tops.setdefault(state, {})
        if below in links and links[below] <= weight:
            return False
        links[below] = weight
        return True

    def _settle(self) -> None:
        if self.forced:
            more = "D" * self.forced
            price = DELETE * self.forced
            self.tops = {s: {b: (c + price, a + more) for b, (c, a) in links.items()} for s, links in self.tops.items()}
            self.forced = 0

    def _inserted(self) -> dict:
        """The frontier with any number of inserted turns (an insertion before a deleted row is never the least audit)."""
        tops = {s: dict(links) for s, links in self.tops.items()}
        todo = [(s, b) for s, links in tops.items() for b in links]
        while todo:
            state, below = todo.pop()
            cost, audit = tops[state][below]
            for symbol in NAMES:
                for top in self.automaton.after(state, below, symbol):
                    if self._merge(tops, *top, (cost + INSERT, audit + "I")):
                        todo.append(top)
        return tops

    def _forget(self) -> None:
        """What all audits begin with is decided."""
        same = os.path.commonprefix([a for links in self.tops.values() for _, a in links.values()])
        self._write(same)
        self.tops = {s: {b: (c, a[len(same) :]) for b, (c, a) in links.items()} for s, links in self.tops.items()}
        self.look = max(LOOK, 2 * max(len(a) for links in self.tops.values() for _, a in links.values()))

    def _write(self, audit: str) -> None:
        self.decided.append(audit)
        at = 0
        while at < len(audit):
            edit = audit[at]
            row = None if edit == "I" else self.waiting.popleft()
            if isinstance(row, int):  # forced deletions, as far as the audit goes
                run = min(row, len(audit) - at)
                if run < row:
                    self.waiting.appendleft(row - run)
                at += run
                continue
            at += 1
            if edit == "D":
                continue
            role, text = (NAMES[self.expect], "") if row is None else row
            if edit == "R":
                role = NAMES[self.expect]
            if role[:1] != "s":
                self.expect = "a" if role[:1] == "u" else "u"
            self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

    def finish(self) -> tuple[int, str, str]:
        """cost, audit, repaired_sha256."""
        self._settle()
        ends = [
            weight for state, links in self._inserted().items() for below, weight in links.items()
            if self.automaton.after(state, below, END)
        ]
        cost, audit = min(ends)
        self._write(audit)
        return cost, "".join(self.decided), self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, equal ones as one with their number; a conversation's dropped
    rows are one row with n 0."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % DAMAGES
    text = F.when(kind == EMPTY, F.lit("")).when(kind == UNMARK, F.regexp_replace(spaced("text"), "[.!?]", ""))
    gone = lambda c, x: F.when(kind != DROP, x).alias(c)
    rows = conversations.select(
        "conv_id",
        gone("turn", F.col("turn")),
        gone("role", F.when(kind == AS_USER, F.lit("user")).otherwise(spaced("role"))),
        gone("text", text.otherwise(spaced("text"))),
        F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1).cast("long").alias("__n"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("__n").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """rows of `damaged` with blank, seen (an earlier row has its role and text) and late (truncated), a conversation in
    one partition and in turn order."""
    bare = F.rtrim("text", F.lit(SPACE))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    known = rows.repartition("conv_id").select(
        "*",
        F.coalesce(bare == "", F.lit(True)).alias("blank"),
        (F.row_number().over(earlier) > 1).alias("seen"),
        (~F.coalesce(F.right(bare, F.lit(1)), F.lit("")).isin(".", "!", "?")).alias("late"),
    )
    return known.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


_RESULT = """gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
 repaired_sha256 string"""
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """Counts of one conversation beside its repair."""

    def __init__(self, automaton: Automaton):
        self.repair = Repair(automaton)
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, text, n, blank, seen, late) -> None:
        if not n:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.last is not None:
            self.illegal += self.last + role[:1] not in _LEGAL
        self.illegal += n - 1  # no initial may follow itself
        self.last = role[:1]
        if blank:
            self.blank += n
            self.repair.delete(n)
            return
        if not seen:
            self.truncated += late
            self.repair.push(role, text, late)
            n -= 1
        if n:
            self.duplicate += n
            self.repair.delete(n)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id with its faults, the least cost, the edits and the hash of the repaired rows."""
    kind = conversations.schema["conv_id"].dataType

    def emit(batches):
        automaton, now, held = Automaton(), None, None
        automaton.node(0, -1)
        for batch in slices(batches):
            out = []
            for conv_id, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if held is None or conv_id != now:
                    if held is not None:
                        out.append((now, *held.result()))
                    now, held = conv_id, _Conversation(automaton)
                held.add(*row)
            if out:
                yield _record(out, batch.schema.field(0).type)
        if held is not None:
            yield _record([(now, *held.result())], batch.schema.field(0).type)

    def _record(rows, key):
        types = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv_id", *(x.split()[0] for x in _RESULT.split(","))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = faults(damaged(conversations))
    found = rows.mapInArrow(emit, f"conv_id {kind.simpleString()}, {_RESULT}")
    return stage(found, "conversations", BATCH_ROWS)


#: The same rows in DuckDB: states 0 start, 1 after s, 2 after u, 3 after a pair; CRC-32 bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         (4294967295 - list_reduce(
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
            lambda crc, b: list_reduce(range(8), lambda x, k: xor(x // 2, (x % 2) * 3988292384), xor(crc, b)), 4294967295::BIGINT)) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM spaced, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
), numbered AS (
  SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM damaged
), bare AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM numbered
), faulty AS (
  SELECT conv_id, pos, turn, role, text, left(role, 1) AS initial, bare = '' AS blank, seen AND bare <> '' AS duplicate,
         NOT seen AND bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM bare
), moves(a, symbol, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserted(a, b, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2)),
steps AS (
  SELECT i.a, m.b, i.k, m.symbol, e.edit FROM inserted i JOIN moves m ON m.a = i.b
  CROSS JOIN (VALUES ('K'), ('R')) e(edit) WHERE e.edit = 'K' OR m.symbol <> 's'
), dp AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, min(best) FROM (
    SELECT f.conv_id, f.pos, d.state, {'cost': d.best.cost + 4, 'audit': d.best.audit || 'D'} AS best
    FROM dp d JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
    UNION ALL
    SELECT f.conv_id, f.pos, s.b, {'cost': d.best.cost + 3 * s.k + CASE WHEN s.edit = 'R' THEN 3 ELSE 0 END + CASE WHEN f.truncated THEN 3 ELSE 0 END,
                                   'audit': d.best.audit || repeat('I', s.k) || s.edit}
    FROM dp d JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
    JOIN steps s ON s.a = d.state AND (s.edit = 'R' OR s.symbol = f.initial)
    WHERE NOT f.blank AND NOT f.duplicate
  ) GROUP BY conv_id, pos, state
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id
), best AS (
  SELECT d.conv_id, min({'cost': d.best.cost + 3 * i.k, 'audit': d.best.audit || repeat('I', i.k)}) AS best
  FROM dp d JOIN inserted i ON i.a = d.state AND i.b IN (0, 3)
  LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id WHERE d.pos = coalesce(s.n, 0) GROUP BY d.conv_id
), edits AS (
  SELECT conv_id, j, best.audit[j] AS edit, length(replace(best.audit, 'D', '')) % 2 AS led,
         length(replace(best.audit[:j], 'I', '')) AS pos, length(replace(best.audit[:j], 'D', '')) AS place
  FROM best, range(1, length(best.audit) + 1) t(j)
), lines AS (
  SELECT e.conv_id, e.j, CASE WHEN e.edit = 'K' THEN f.role WHEN (e.place + e.led) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS line
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE e.edit <> 'D'
), texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS hash FROM lines GROUP BY conv_id)
SELECT b.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank,
       coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
       coalesce(s.illegal, 0)::BIGINT AS illegal, b.best.cost::BIGINT AS cost, b.best.audit AS audit,
       coalesce(t.hash, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(read_table(spark, sf_dir, "conversations"))
