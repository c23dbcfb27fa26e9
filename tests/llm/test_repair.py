"""Conversation repair against a search over all edit sequences, and its odd inputs."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from llm.repair import ORACLE_SQL, Automaton, Repair, op13_conversation_repair, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


def legal_lists(n):
    """Role lists of (s?(ua)+)? with n turns."""
    if n == 0:
        return [""]
    if n == 1:
        return []
    return ["s" * (n % 2) + "ua" * (n // 2)]


def slow_best(rows):
    """rows (initial, must go, late) -> least (cost, audit), over all edit strings with at most len + 2 inserts."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(r[1] and e != "D" for r, e in zip(rows, edits)):
            continue
        kept = sum(e != "D" for e in edits)
        for n in range(kept, kept + len(rows) + 2):
            for target in legal_lists(n):
                for places in itertools.combinations(range(n + len(rows) - kept), n - kept):
                    audit, cost, rest, at, fine = [], 0, iter(zip(rows, edits)), 0, True
                    for k in range(n + len(rows) - kept):
                        if k in places:
                            audit.append("I")
                            cost += 3
                            fine &= target[at] in "ua"
                            at += 1
                            continue
                        (initial, _, late), e = next(rest)
                        audit.append(e)
                        if e == "D":
                            cost += 4
                            continue
                        cost += 3 * late
                        fine &= target[at] == initial if e == "K" else target[at] in "ua"
                        cost += 3 * (e == "R")
                        at += 1
                    if fine:
                        found = (cost, "".join(audit))
                        best = found if best is None else min(best, found)
    return best


def slow(rows):
    """The contract, row by row, over (conv_id, turn, role, text)."""
    groups = {}
    spaced = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv_id)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        groups.setdefault(conv_id, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv_id, given in groups.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in given if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in given:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        cost, audit = slow_best([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(given, faults)])
        n = len(audit) - audit.count("D")
        target, lines, rest, at = (legal_lists(n) or [""])[0], [], iter(given), 0
        for e in audit:
            _, role, text = ("", "", "") if e == "I" else next(rest)
            if e != "D":
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[target[at]]) + ":" + text)
                at += 1
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(given, given[1:]))
        counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_parser_against_all_edits():
    rnd, automaton = random.Random(5), Automaton()
    automaton.node(0, -1)
    for _ in range(150):
        rows = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(0, 5))]
        one = Repair(automaton)
        for initial, gone, late in rows:
            one.delete(1) if gone else one.push(initial, "", late)
        assert one.finish()[:2] == slow_best(rows), rows


def test_long_conversation_forgets_what_is_decided():
    automaton = Automaton()
    automaton.node(0, -1)
    rnd, long, whole = random.Random(3), Repair(automaton), Repair(automaton)
    whole.look = 1 << 60
    most = 0
    for _ in range(20_000):
        role, text, late = rnd.choice(["user", "assistant", "system"]), str(rnd.random()), rnd.random() < 0.1
        if rnd.random() < 0.1:
            long.delete(3)
        else:
            long.push(role, text, late)
        most = max(most, len(long.waiting))
    assert most < 1000
    long.finish()
    rnd = random.Random(3)
    for _ in range(2000):
        role, text, late = rnd.choice(["user", "assistant", "system"]), str(rnd.random()), rnd.random() < 0.1
        whole.delete(3) if rnd.random() < 0.1 else whole.push(role, text, late)
    short, rnd = Repair(automaton), random.Random(3)
    for _ in range(2000):
        role, text, late = rnd.choice(["user", "assistant", "system"]), str(rnd.random()), rnd.random() < 0.1
        short.delete(3) if rnd.random() < 0.1 else short.push(role, text, late)
    assert short.finish() == whole.finish()


@pytest.fixture(scope="module")
def odd_conversations():
    rnd = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["One.", "Two!", "three", "", None, " \n\x0b", "é?", "x. \t", "One."]
    rows = []
    for conv_id in [*range(60), None]:
        turns = rnd.sample([0, 1, 2, 3, 5, 9], rnd.randrange(0, 4))
        rows += [(conv_id, t, rnd.choice(roles), rnd.choice(texts)) for t in turns]
        if rnd.random() < 0.3:
            rows += [(conv_id, None, rnd.choice(roles), rnd.choice(texts))]
    return rows + [rows[3], rows[3]]


def found(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_odd_conversations(spark, odd_conversations):
    df = spark.createDataFrame(odd_conversations, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "blank", "seen", "late", "__n0")})
    result = repair_conversations(df)
    assert result.count() == len({r[0] for r in odd_conversations})
    assert found(result) == slow(odd_conversations)


def test_oracle_on_odd_conversations(spark, odd_conversations):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd_conversations)
    rows = con.execute(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({ORACLE_SQL})").fetchall()
    assert {r[0]: r[1:] for r in rows} == slow(odd_conversations)


def test_small_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    few = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) <= 4}
    want = slow([r for r in rows if r[0] in few])
    got = found(op13_conversation_repair(spark, sf))
    assert len(got) == len({r[0] for r in rows})
    assert {k: got[k] for k in want} == want


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t % 1000}." if t % 3 else "same.") for t in range(30_000)]
    row = repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()[0]
    assert len(row.audit) >= 28_000 and row.gaps == row.audit.count("x") + 30_000 - len({r[1] for r in rows if zlib.crc32(f"1:{r[1]}".encode()) % 20})


def test_empty_conversations(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
