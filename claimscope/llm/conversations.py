"""Conversation structure repair by Four-Russians block tables (operator 12).

Method.  A conversation is a string of symbols, one a row: its role (system,
user, assistant, other) and its fault (must go, truncated, none).  The cheapest
edits that give ``(s?(ua)+)?`` follow from cost-to-go vectors over the four
grammar states: what is left to pay from each state before a row.  Vectors are
normalised (smallest entry 0); only a few dozen exist, since insertions bound
their differences.  For every vector and every block of ``BLOCK`` symbols the
table holds the vector before the block and the cost added, built once in a
worker from single steps.  A conversation is processed from its end, a block a
lookup, keeping the vector at each block's right edge.  Tracing goes forward
and expands one block backward from that vector at a time; it knows the exact
cost-to-go of every state, so all cheapest edits are seen and the ASCII-least
one is taken (a state and an initial name one edit).

Rows are range-sorted by conversation and turn, so a conversation of any size
spreads over tasks.  One that lies inside a task is finished there.  Those
that touch a task's edge (at most two a task) go on in pieces: a piece gives
its table (vector after -> vector before, cost), pieces are composed per
conversation, each piece is traced for all four states it could begin in, and
the fitting traces are chained.  The digest of a conversation is a running
SHA-256, which no method computes in pieces: one task reads the repaired lines
of a conversation as a stream, in bounded memory.

Defined results.  Null role, text (and ids inside the damage key) are one
space; null conversation ids are one conversation; null turns come first.
Rows of one turn are ordered by role, then the first 256 characters of the
text, then as read.  A role's initial decides its class, an empty role has
none and cannot be kept.  Very long texts are rows like any other.  Repeated
rows are duplicates.  Empty tables give empty results.  Only the four columns
are read, so further ones may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4            # symbols of a table entry
SYMBOLS = 9          # must go; then 4 roles sound; then 4 roles truncated
TIE_CHARS = 256
LEGAL = ("su", "ua", "au")
_SPACE = r"\x20\x09-\x0D"
# Next state of an added user/assistant row, and of a kept row by role class.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)  # to go after the last row


# ------------------------------------------------------------- block tables
def edits(state: int, symbol: int):
    """``(initial, cost, next state)`` of the edits that consume a row."""
    yield "D", DELETE, state
    if symbol:
        late, role = divmod(symbol - 1, 4)
        if role in _KEEP[state]:
            yield "K", TRUNCATED * late, _KEEP[state][role]
        yield "R", REROLE + TRUNCATED * late, _NEXT[state]


def before(after, symbol: int) -> tuple[int, ...]:
    """Cost-to-go before a row, from that after it, insertions included."""
    g = [min(cost + after[to] for _, cost, to in edits(q, symbol)) for q in range(4)]
    user, assistant = min(g[USER], INSERT + g[ASSISTANT]), min(g[ASSISTANT], INSERT + g[USER])
    return min(g[START], INSERT + user), min(g[SYSTEM], INSERT + user), user, assistant


class Tables:
    """All normalised vectors and the transitions of single symbols and of
    blocks of ``block`` symbols."""

    def __init__(self, block: int = BLOCK):
        import numpy as np
        self.block, self.vectors = block, [_END]
        ids, steps = {_END: 0}, []
        for v in self.vectors:  # grows while it is read
            row = []
            for x in range(SYMBOLS):
                g = before(v, x)
                low = min(g)
                g = tuple(c - low for c in g)
                if g not in ids:
                    ids[g] = len(self.vectors)
                    self.vectors.append(g)
                row.append((ids[g], low))
            steps.append(row)
        step = np.array(steps, np.int64)
        self.step, self.step_cost = step[:, :, 0], step[:, :, 1]
        at, cost = np.arange(len(steps))[:, None], np.zeros((len(steps), 1), np.int64)
        for _ in range(block):  # one more symbol in front: it becomes the highest digit
            cost = (cost[:, None, :] + self.step_cost[at].transpose(0, 2, 1)).reshape(len(steps), -1)
            at = self.step[at].transpose(0, 2, 1).reshape(len(steps), -1)
        self.jump, self.jump_cost = at, cost
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1, dtype=np.int64)

    def codes(self, symbols):
        """Short head, and the codes of the full blocks behind it."""
        head = len(symbols) % self.block
        return head, symbols[head:].astype("int64").reshape(-1, self.block) @ self.weights

    def edges(self, symbols, end: int) -> tuple[list[int], int]:
        """Vector ids at each block's right edge, from the front (the short
        head's first), then the vector before all; and the cost added."""
        head, codes = self.codes(symbols)
        out, cost, v = [], 0, end
        for c in codes[::-1].tolist():
            out.append(v)
            cost += int(self.jump_cost[v, c])
            v = int(self.jump[v, c])
        out.append(v)
        for x in symbols[:head][::-1].tolist():
            cost += int(self.step_cost[v, x])
            v = int(self.step[v, x])
        return [*out[::-1], v], cost

    def piece(self, symbols):
        """Vector before and cost added, for every vector after."""
        import numpy as np
        head, codes = self.codes(symbols)
        v, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for c in codes[::-1].tolist():
            cost += self.jump_cost[v, c]
            v = self.jump[v, c]
        for x in symbols[:head][::-1].tolist():
            cost += self.step_cost[v, x]
            v = self.step[v, x]
        return v, cost

    def trace(self, symbols, end: int, state: int = START, last: bool = True) -> tuple[str, int]:
        """ASCII-least initials of the cheapest edits from ``state``, and the
        state reached; insertions behind the last row only where ``last``."""
        right, _ = self.edges(symbols, end)
        head = len(symbols) % self.block
        stops = list(range(head, len(symbols) + 1, self.block))
        out, at = [], 0
        for stop, v in zip(stops, right):
            rows = symbols[at:stop].tolist()
            go = [self.vectors[v]]
            for x in reversed(rows):  # expand the block backward
                go.append(before(go[-1], x))
            go.reverse()
            for i, x in enumerate(rows):
                while True:
                    best = min((c, to, taken) for c, cost, to, taken in
                               [*((c, cost, to, True) for c, cost, to in edits(state, x)), ("I", INSERT, _NEXT[state], False)]
                               if cost + go[i + taken][to] == go[i][state])
                    out.append(best[0])
                    state = best[1]
                    if best[2]:
                        break
            at = stop
        while last and _END[state]:
            out.append("I")
            state = _NEXT[state]
        return "".join(out), state


@functools.cache
def tables() -> Tables:
    return Tables()


def apply(audit: str, rows, state: int = START):
    """``(index of the row consumed, role, text)`` of the repaired turns;
    ``rows`` are (role, text) pairs."""
    i = 0
    for c in audit:
        if c == "I":
            state = _NEXT[state]
            yield i, _ROLE[state], ""
            continue
        role, text = rows[i]
        if c == "K":
            state = _KEEP[state][_CLASS[role[0]]]
            yield i, role, text
        elif c == "R":
            state = _NEXT[state]
            yield i, _ROLE[state], text
        i += 1


_CLASS = {"s": 0, "u": 1, "a": 2}


def symbol(initial: str, must_go: bool, cut: bool) -> int:
    return 0 if must_go else 1 + _CLASS.get(initial, 3) + 4 * cut


# ------------------------------------------------------------- Spark
def _ordered(df: DataFrame, key: str, turn: str, role: str, text: str, lost: Column | None) -> DataFrame:
    """Rows sorted by conversation and turn over all tasks, with the faults
    that a row shows by itself."""
    rows = df.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias("lost"),
                     F.monotonically_increasing_id().alias("uid"))
    order = ["key", "turn", "role", F.substring("text", 1, TIE_CHARS), "uid"]
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("key", F.spark_partition_id().alias("seg"), "turn", "role", "text", "lost", blank.alias("blank"),
                    (~blank & ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("cut")))


class _Stats:
    """Counts over the rows of a conversation, or of a piece of one."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, initial, blank, duplicate, cut):
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += cut and not duplicate
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, other: _Stats):
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + getattr(other, c))
        if other.first is not None:
            self.illegal += self.first is not None and self.last + other.first not in LEGAL
            self.first, self.last = other.first if self.first is None else self.first, other.last
        if other.low is not None:
            self.turns -= other.low == self.high
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def numbers(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROW = "turn long, role string, text string, lost boolean, is_blank boolean, is_cut boolean"


def _within(kind: str, turns: bool):
    """Finish the conversations inside a task; pass on the rows of those that
    touch its edges.  A finished one gives its result and the digest of its
    lines or, with ``turns``, its repaired turns."""
    names = ["key", "seg", "pos", *[c.split()[0] for c in (_ROW + ", " + _RESULT).split(", ")], "sha"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def finished(key, seg, rows):
        import numpy as np
        t, stats, seen, symbols, kept = tables(), _Stats(), set(), [], []
        for turn, role, text, lost, blank, cut in rows:
            if lost:
                continue
            again = (role, text) in seen
            seen.add((role, text))
            stats.add(turn, role[:1], blank, again, cut)
            symbols.append(symbol(role[:1], blank or again, cut))
            kept.append((role, text))
        s = np.array(symbols, np.int64)
        audit, _ = t.trace(s, 0)
        made = apply(audit, kept)
        if turns:
            for i, (_, role, text) in enumerate(made):
                yield [key, seg, i, None, role, text, *[None] * 11]
            return
        edges, cost = t.edges(s, 0)
        sha = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in made).encode()).hexdigest()
        yield [key, seg, None, *[None] * 6, *stats.numbers(), cost + t.vectors[edges[-1]][START], audit, sha]

    def run(batches):
        key_type, out = None, []

        def flush():
            cols = list(zip(*out)) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k or key_type) for c, k in zip(cols, types)], names=names)
            out.clear()
            return batch

        def opened(key, seg, rows, at):
            for i, r in enumerate(rows):
                out.append([key, seg, at + i, *r, *[None] * 8])

        now, first, rows, at, seg = None, True, [], 0, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, seg, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    if now is not None:
                        if first:
                            opened(now[0], seg, rows, at)
                        else:
                            out.extend(finished(now[0], seg, rows))
                        first = False
                    now, rows, at = (key,), [], 0
                rows.append(row)
                if first and len(rows) >= 1000:  # an edge conversation streams through
                    opened(key, seg, rows, at)
                    rows, at = [], at + len(rows)
                if len(out) >= 1000:
                    yield flush()
        if now is not None:
            opened(now[0], seg, rows, at)
        if key_type is not None:
            yield flush()

    schema = f"key {kind}, seg int, pos long, {_ROW}, {_RESULT}, sha string"
    return run, schema


def _same(a: DataFrame, b: DataFrame, *cols: str) -> DataFrame:
    """Left join where null keys meet."""
    b = b.select(*[F.col(c).alias(f"__{c}") if c in cols else F.col(c) for c in b.columns])
    on = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])
    return a.join(b, on, "left").drop(*[f"__{c}" for c in cols])


def _sorted(group: pa.Table, *by: str):
    return group.sort_by([(c, "ascending") for c in by]).to_pylist()


def _pieces(opened: DataFrame, kind: str) -> DataFrame:
    """Open rows without text: turn, initial, faults, symbol; duplicates are
    found over all pieces of a conversation."""
    rows = opened.where(~F.col("lost")).select("key", "seg", "pos", "turn", F.substring("role", 1, 1).alias("initial"), F.col("is_blank").alias("blank"),
                                              F.col("is_cut").alias("cut"), F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("same"))
    # written, so that a crowded key is a bare shuffle that AQE can split
    first = written(rows.groupBy("key", "same").agg(F.min(F.struct("seg", "pos")).alias("first")), "conv-first")
    known = _same(rows, first, "key", "same").withColumn("again", F.struct("seg", "pos") > F.col("first"))
    lost = opened.where("lost").select("key", "seg").distinct()  # a piece of dropped rows only is a piece, too
    return written(known.select("key", "seg", "pos", "turn", "initial", "blank", "cut", "again")
                   .unionByName(lost, allowMissingColumns=True), "conv-open")


def _symbols(rows):
    import numpy as np
    return np.array([symbol(r["initial"], r["blank"] or r["again"], r["cut"]) for r in rows], np.int64)


def _summary(group: pa.Table) -> pa.Table:
    rows = [r for r in _sorted(group, "pos") if r["pos"] is not None]
    stats = _Stats()
    for r in rows:
        stats.add(r["turn"], r["initial"], r["blank"], r["again"], r["cut"])
    to, cost = tables().piece(_symbols(rows))
    one = {"key": group.column("key")[:1], "seg": group.column("seg")[:1], "to": pa.array([to.tolist()], pa.list_(pa.int32())), "added": pa.array([cost.tolist()], pa.list_(pa.int64()))}
    return pa.table(one | {c: pa.array([getattr(stats, c)], pa.string() if c in ("first", "last") else pa.int64()) for c in _STATS})


_STATS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")


def _compose(group: pa.Table) -> pa.Table:
    """For each piece the vector at its right edge; counts and cost of the
    conversation stand on its first piece."""
    rows, total = _sorted(group, "seg"), _Stats()
    for r in rows:
        one = _Stats()
        for c in _STATS:
            setattr(one, c, r[c])
        total.join(one)
    v, cost, ends = 0, 0, []
    for r in reversed(rows):
        ends.append(v)
        cost += r["added"][v]
        v = r["to"][v]
    ends.reverse()
    numbers = [*total.numbers(), cost + tables().vectors[v][START]]
    key = group.column("key")
    return pa.table({"key": pa.array([key[0].as_py()] * len(rows), key.type), "seg": pa.array([r["seg"] for r in rows], pa.int32()),
                     "end": pa.array(ends, pa.int32()), "last": [i + 1 == len(rows) for i in range(len(rows))]}
                    | {c.split()[0]: pa.array([n, *[None] * (len(rows) - 1)], pa.int64()) for c, n in zip(_RESULT.split(", "), numbers)})


def _traces(group: pa.Table) -> pa.Table:
    rows = [r for r in _sorted(group, "pos") if r["pos"] is not None]
    end, last, s = group.column("end")[0].as_py(), group.column("last")[0].as_py(), _symbols(rows)
    got = [tables().trace(s, end, q, last) for q in range(4)]
    key = group.column("key")
    return pa.table({"key": pa.array([key[0].as_py()] * 4, key.type), "seg": pa.array([group.column("seg")[0].as_py()] * 4, pa.int32()),
                     "start": pa.array(range(4), pa.int32()), "stop": pa.array([q for _, q in got], pa.int32()), "audit": [a for a, _ in got]})


def _chain(group: pa.Table) -> pa.Table:
    """The trace of each piece that begins where the one before ends."""
    state, chosen = START, []
    for _, four in itertools.groupby(_sorted(group, "seg", "start"), key=lambda r: r["seg"]):
        r = list(four)[state]
        chosen.append(r)
        state = r["stop"]
    key = group.column("key")
    return pa.table({"key": pa.array([r["key"] for r in chosen], key.type), "seg": pa.array([r["seg"] for r in chosen], pa.int32()),
                     "start": pa.array([r["start"] for r in chosen], pa.int32()), "audit": [r["audit"] for r in chosen],
                     "whole": pa.array(["".join(r["audit"] for r in chosen), *[None] * (len(chosen) - 1)], pa.string())})


def _edited(group: pa.Table) -> pa.Table:
    rows = [r for r in _sorted(group, "pos") if not r["lost"]]
    made = list(apply(group.column("audit")[0].as_py(), [(r["role"], r["text"]) for r in rows], group.column("start")[0].as_py()))
    key = group.column("key")
    return pa.table({"key": pa.array([key[0].as_py()] * len(made), key.type), "seg": pa.array([group.column("seg")[0].as_py()] * len(made), pa.int32()),
                     "pos": pa.array(range(len(made)), pa.int64()), "role": pa.array([m[1] for m in made], pa.string()),
                     "text": pa.array([m[2] for m in made], pa.string())})


def _digests(turns: DataFrame, kind: str) -> DataFrame:
    """``(key, sha)``: SHA-256 of each conversation's lines, as a stream."""
    def run(batches):
        now, sha, key_type = None, None, None
        for batch in itertools.chain(batches, [None]):
            done = []
            rows = () if batch is None else zip(*(batch.column(c).to_pylist() for c in range(5)))
            key_type = key_type if batch is None else batch.schema.field(0).type
            for key, _, _, role, text in rows:
                if now is None or now[0] != key:
                    if now is not None:
                        done.append((now[0], sha.hexdigest()))
                    now, sha = (key,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if batch is None and now is not None:
                done.append((now[0], sha.hexdigest()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type), pa.array([d[1] for d in done], pa.string())], names=["key", "sha"])

    return turns.repartition("key").sortWithinPartitions("key", "seg", "pos").mapInArrow(run, f"key {kind}, sha string")


def _run(df: DataFrame, key: str, turn: str, role: str, text: str, lost: Column | None, turns: bool) -> DataFrame:
    kind = df.select(key).schema[0].dataType.simpleString()
    run, schema = _within(kind, turns)
    rows = _ordered(df, key, turn, role, text, lost)
    done = written(rows.mapInArrow(run, schema), "conv-done")
    opened = done.where("lost is not null")
    closed = done.where("lost is null")
    pieces = _pieces(opened, kind)
    table = pieces.groupBy("key", "seg").applyInArrow(
        _summary, f"key {kind}, seg int, to array<int>, added array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string")
    numbers = ", ".join(_RESULT.split(", ")[:-1])
    joints = written(table.groupBy("key").applyInArrow(_compose, f"key {kind}, seg int, end int, last boolean, {numbers}"), "conv-joints")
    asked = _same(pieces, joints.select("key", "seg", "end", "last"), "key", "seg")
    four = asked.groupBy("key", "seg").applyInArrow(_traces, f"key {kind}, seg int, start int, stop int, audit string")
    chain = written(four.groupBy("key").applyInArrow(_chain, f"key {kind}, seg int, start int, audit string, whole string"), "conv-chain")
    made = (_same(opened.select("key", "seg", "pos", "role", "text", "lost"), chain.drop("whole"), "key", "seg").groupBy("key", "seg")
            .applyInArrow(_edited, f"key {kind}, seg int, pos long, role string, text string"))
    if turns:
        return closed.select("key", "seg", "pos", "role", "text").unionByName(made)
    told = joints.where("cost is not null").select("key", *[c.split()[0] for c in numbers.split(", ")])
    told = _same(told, chain.where("whole is not null").select("key", F.col("whole").alias("audit")), "key")
    told = _same(told, _digests(made, kind), "key")
    return closed.select(*told.columns).unionByName(told).withColumn("sha", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())))


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)``, a row a conversation.  Rows where ``lost`` holds only
    say that their conversation exists."""
    return _run(df, key, turn, role, text, lost, False).withColumnsRenamed({"key": key, "sha": "repaired_sha256"})


def repaired_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """``(key, seg, pos, role, text)``: the repaired turns, in the order of
    ``seg`` and ``pos`` within a conversation."""
    return _run(df, key, turn, role, text, lost, True).withColumnRenamed("key", key)


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with reproducible faults, by the CRC-32 of ``key:turn``
    modulo 20: 0 drops the row (``lost``), 1 empties the text, 2 removes its
    sentence marks, 3 repeats the row, 4 makes it a user's."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice = F.crc32(F.concat(told(key), F.lit(":"), told(turn)).cast("binary")) % 20
    rows = df.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"), dice.alias("dice"))
    return rows.select("conv_id", "turn", F.when(F.col("dice") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("dice") == 1, "").when(F.col("dice") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("dice") == 0).alias("lost"),
                       F.explode(F.when(F.col("dice") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
