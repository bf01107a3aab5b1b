"""Conversation repair against dynamic programming over whole conversations, and against its SQL."""

import hashlib
import random
import re
from zlib import crc32

import duckdb
import pytest

from marketloom.llm import conversations
from marketloom.llm.conversations_sql import duckdb_sql

R = random.Random(5)
SCHEMA = "conv_id long, turn long, role string, text string, kind string, steps int"
TEXTS = ["Yes.", "No", "why?", "", " \t", "long answer without end", "A!\n", "one. two. three", None]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", None, "umpire"]


def random_rows():
    rows = [(c, t, R.choice(ROLES), R.choice(TEXTS)) for c in range(40) for t in range(R.randint(1, 9)) if R.random() < 0.9]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]
    rows += [(101, t // 3, R.choice(ROLES), f"{R.choice(TEXTS)}{R.randint(0, 60)}") for t in range(400)]
    rows += [(102, t, R.choice(ROLES), R.choice(TEXTS)) for t in range(200)]
    rows += [(None, t, "user", "x.") for t in range(3)] + [(103, None, "assistant", f"{i % 5}.") for i in range(9)]
    rows += [(104, 2, "user", "same.")] * 30 + [(105, -5, "user", "far."), (105, 9, "assistant", "off."), (106, 0, "user", "w " * 40000)]
    rows += [(i, 0, "user", "alone.") for i in range(200, 260)]
    return rows


def best_edits(rows):
    """(cost, audit, lines) by states after every row; rows: (role, text, ok, cut)."""
    def less(a, b):
        return b if a is None else a if b is None else min(a, b)

    def close(s):
        ins = lambda p, role: p and (p[0] + 5, p[1] + "I", (*p[2], f"{role}:"))
        user = s[2]
        for q in (0, 1, 3):
            user = less(user, ins(s[q], "user"))
        return [s[0], s[1], user, less(s[3], ins(user, "assistant"))]

    states = [(0, "", ()), None, None, None]
    for role, text, ok, cut in rows:
        before, states = close(states), [None] * 4
        for q, p in enumerate(before):
            if p is None:
                continue
            states[q] = less(states[q], (p[0] + 2, p[1] + "D", p[2]))
            if not ok:
                continue
            nxt = 3 if q == 2 else 2
            want = {"s": 1, "u": 2, "a": 3}.get(role[:1])
            if want == nxt or (want == 1 and q == 0):
                states[want] = less(states[want], (p[0] + 5 * cut, p[1] + "K", (*p[2], f"{role}:{text}")))
            spelled = "assistant" if nxt == 3 else "user"
            states[nxt] = less(states[nxt], (p[0] + 1 + 5 * cut, p[1] + "R", (*p[2], f"{spelled}:{text}")))
    states = close(states)
    return less(states[0], states[3])


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        say = lambda v: " " if v is None else str(v)
        fault = crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else say(role), "" if fault == 1 else say(text)
        text = re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [(turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).digest(), role, text)] * (
            0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort()
        seen, steps, blank, dup, truncated = set(), [], 0, 0, 0
        for *_, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            again, cut = (role, text) in seen, bool(bare) and bare[-1] not in ".!?"
            seen.add((role, text))
            blank, dup = blank + (not bare), dup + (bool(bare) and again)
            truncated += cut and not again
            steps.append((role, text, bool(bare) and not again, cut))
        cost, audit, lines = best_edits(steps)
        turns = {t for known, t, *_ in mine if known}
        pairs = [a[3][:1] + b[3][:1] for a, b in zip(mine, mine[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, dup, truncated,
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    return random_rows()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(5)


def test_repair(spark, rows, monkeypatch):
    want = brute(rows)
    assert sorted(map(tuple, conversations.repair(frame(spark, rows)).collect()), key=repr) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(duckdb_sql()).fetchall(), key=repr) == want


def test_heavy_blocks_are_spread(spark, rows, monkeypatch):
    monkeypatch.setattr(conversations, "HEAVY", 20)
    rows = rows + [(107, 4, "user", f"burst {i}.") for i in range(300)]
    light = conversations.lattice_rows(conversations.damaged(frame(spark, rows)))
    assert conversations.placed(light).filter("c = 107 and p != ''").select("p").distinct().count() > 100
    assert sorted(map(tuple, conversations.repair(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_repair_of_nothing(spark):
    assert conversations.repair(frame(spark, [])).collect() == []


def test_auction_agrees_with_all_paths():
    """Costs and least initials of small lattices against listing every path."""
    def paths(arcs, node, budget):
        if node == len(arcs) - 1:
            yield 0, ""
        for cost, label, to in arcs[node]:
            if cost <= budget:
                for more, rest in paths(arcs, to, budget - cost):
                    yield cost + more, label + rest

    for _ in range(60):
        n = R.randint(1, 4)
        steps, copies = bytes(R.randint(0, 11) for _ in range(n)), [R.choice((1, 1, 2)) for _ in range(n)]
        after = [R.randint(0, 6) for _ in range(4)]
        _, ops, costs = conversations.trace_unit(steps, copies, after, range(4))
        for state in range(4):
            arcs, _ = conversations.arcs_of(steps, copies, after, False)
            assert min(paths(arcs, state, costs[state])) == (costs[state], ops[state])
