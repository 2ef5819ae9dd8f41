"""Conversation repair (operator 12) against a plain search."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WS = r"\x20\x09-\x0D"
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Least (cost, initials, lines) by Dijkstra's search; ``rows`` are (role,
    text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in GRAMMAR[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, must, late = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if not must:
                for new, price, c in [(role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")]:
                    if new[:1] in GRAMMAR[state] and new:
                        heapq.heappush(heap, (cost + price + 3 * late, audit + c, i + 1, new[0], (*lines, f"{new}:{text}")))


def brute(rows):
    """Contract over (conv_id, turn, role, text) rows."""
    kept = {r[0]: [] for r in rows}
    for at, (conv, turn, role, text) in enumerate(rows):
        told = lambda x: " " if x is None else str(x)
        role, text, dice = told(role), told(text), zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        kept[conv] += [] if dice == 0 else [(turn, "user" if dice == 4 else role, text)] * (1 + (dice == 3))
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:256]))
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in own:
            last = re.sub(f"[{WS}]", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def query(df):
    return C.repair(C.damaged(df), lost=F.col("lost"))


@pytest.fixture
def spread(spark):
    """Keep small shuffles in many tasks, so that conversations are cut."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, "true")


@pytest.mark.parametrize("block", [1, 2, 3, 4, 5])
def test_tables_equal_search(block):
    rng, t = random.Random(block), C.Tables(block)
    roles = ["system", "user", "assistant", "tool"]
    for _ in range(150):
        rows = [(rng.choice(roles), str(i), rng.random() < 0.2, rng.random() < 0.4) for i in range(rng.randrange(14))]
        rows = [(r, x, must, late and not must) for r, x, must, late in rows]
        s = np.array([C.symbol(r[0], must, late) for r, _, must, late in rows], np.int64)
        edges, cost = t.edges(s, 0)
        audit, state = t.trace(s, 0)
        lines = "\n".join(f"{r}:{x}" for _, r, x in C.apply(audit, [r[:2] for r in rows]))
        assert (cost + t.vectors[edges[-1]][C.START], audit, lines) == cheapest(rows) and state in (C.START, C.ASSISTANT)


def test_pieces_compose():
    rng, t = np.random.default_rng(3), C.tables()
    for _ in range(50):
        s = rng.integers(0, C.SYMBOLS, 40)
        cuts = [0, *sorted(rng.integers(0, 41, 4).tolist()), 40]
        v, cost, state, audit = 0, 0, C.START, ""
        ends = []
        for a, b in reversed(list(zip(cuts, cuts[1:]))):
            ends.append(v)
            to, added = t.piece(s[a:b])
            v, cost = to[v], cost + added[v]
        assert (t.edges(s, 0)[0][-1], t.edges(s, 0)[1]) == (v, cost)
        for (a, b), end in zip(zip(cuts, cuts[1:]), reversed(ends)):
            more, state = t.trace(s[a:b], end, state, b == 40 and a == cuts[-2])
            audit += more
        assert audit == t.trace(s, 0)[0]


def conversations(seed, n, hot=0):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "well", " \n\t", "", "a b.", "So?", "x" * 300 + "1.", "x" * 300 + "2.", None, " ", "¿"]
    rows = []
    for _ in range(n):
        conv = 7 if rng.random() < hot else rng.choice([None, *range(n // 6 + 1)])
        rows.append((conv, rng.choice([None, *range(12)]) if conv != 7 else len(rows), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)))
    return rows


def test_equals_search(spark):
    rows = conversations(1, 400)
    assert got(query(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_conversations_cut_by_tasks(spread):
    """One conversation holds most rows and spreads over all tasks."""
    rows = conversations(2, 500, hot=0.7)
    df = spread.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "seg", "pos", "lost", "dice", "uid")})
    assert got(query(df)) == brute(rows)
    sizes = [r["count"] for r in C._ordered(df.drop("lost"), "conv_id", "turn", "role", "text", None).groupBy("seg").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)


def test_repaired_turns_make_the_digest(spread):
    df = C.damaged(spread.createDataFrame(conversations(3, 300, hot=0.5), SCHEMA))
    lines = {}
    for r in sorted(C.repaired_turns(df, lost=F.col("lost")).collect(), key=lambda r: (r.seg, r.pos)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in C.repair(df, lost=F.col("lost")).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines.get(r.conv_id, [])))


def test_repeats_only_and_all_dropped(spread):
    drop = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:6]
    rows = [(c, t, "user", "Hi.") for c, t in drop] + [(1000, 5, "user", "Hi.")] * 300 + [(2000, None, None, None)] * 3
    assert got(query(spread.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty(spark):
    out = query(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns[0] == "conv_id" and out.columns[-1] == "repaired_sha256"


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "word " * 200_000 + "end.")]
    assert got(query(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
