"""SimHash near-duplicates by the generalised pigeonhole principle
(operator 7).

Method.  Each text gets a 64-bit fingerprint: lower-cased (A-Z) words, word
shingles, XXH64 of each shingle (seed 42), majority vote per bit.  Equal
fingerprints are one class.  To find all classes at ``max_distance`` or fewer
differing bits:

* joint bit counts over all classes give the correlation of bits; correlated
  bits are grouped greedily into the same partition of the 64 bits;
* if partition i gets the threshold T_i and the sum of (T_i + 1) is
  ``max_distance`` + 1, two near fingerprints differ in at most T_i bits
  somewhere.  A dynamic programme picks the thresholds (unequal; -1 skips a
  partition) that cost least, from key counts and candidate counts estimated
  from the bit frequencies; it is run for 1 to 6 partitions and the cheapest
  plan wins, so more data moves the plan to fewer, wider partitions;
* probe: each class sends its key, and the keys at T_i or fewer flipped bits,
  of each partition.  Classes that meet under a key are verified by their
  full distance.  A key with many classes is cut into blocks and its block
  pairs are spread over tasks; inside a task only a spanning forest of the
  links leaves it, never all pairs;
* components of the links by distributed star contraction.

Defined results.  Null and wordless texts have fingerprint 0 and link like
any other; fewer words than a shingle make one shingle of the whole sequence.
Repeated rows share a class.  A null id is never the smallest; a component of
null ids only has a null component id.  Empty tables give empty results; only
the id and text columns are read.
"""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import components, written

SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
BLOCK = 1024          # classes of one key in one block
HOT = 4096            # keys with more rows than a block and 1 / HOT of the fingerprints are joined by broadcast
KEY_COST, PAIR_COST = 1.0, 0.02   # a shuffled key row against a verified pair
_CHUNK = 1 << 16      # shingles voted at once
_SMALL = 32           # groups up to this size are verified by shifted arrays


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    import numpy as np
    import xxhash
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter((h64(join(words[i:i + shingle]), SEED) for i in range(at, min(n, at + _CHUNK))), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)``: the fingerprint of each whole text as a signed long."""
    def run(batches):
        import numpy as np
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return df.select(key, F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, fp long")


def bit_statistics(classes: DataFrame) -> tuple[int, list[list[int]]]:
    """Number of fingerprints and joint counts of set bits, over all rows;
    64 x 64 partial sums leave each task."""
    def run(batches):
        import numpy as np
        n, joint = 0, np.zeros((64, 64))
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            n, joint = n + len(bits), joint + bits.T @ bits
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
             pa.array(np.append(joint, n).astype(np.int64))], names=["i", "j", "c"])

    got = classes.select("fp").mapInArrow(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    n, joint = 0, [[0] * 64 for _ in range(64)]
    for r in got:  # 4097 rows at most
        if r.i < 0:
            n = r.c
        else:
            joint[r.i][r.j] = r.c
    return n, joint


def partition_bits(n: int, joint: list[list[int]], parts: int) -> list[list[int]]:
    """Group the 64 bits into ``parts`` groups of near-equal width, each grown
    by the free bit that correlates most with the bits already in it."""
    p = [joint[i][i] / max(n, 1) for i in range(64)]

    def corr(i: int, j: int) -> float:
        s = math.sqrt(p[i] * (1 - p[i]) * p[j] * (1 - p[j]))
        return abs(joint[i][j] / n - p[i] * p[j]) / s if s > 0 else 0.0

    free, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        start = max(sorted(free), key=lambda i: sum(corr(i, j) for j in free if j != i))
        group, pull = [start], {j: corr(start, j) for j in free if j != start}
        while len(group) < width:
            j = max(sorted(pull), key=pull.get)
            group.append(j)
            del pull[j]
            for x in pull:
                pull[x] += corr(j, x)
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(n: int, joint: list[list[int]], groups: list[list[int]], max_distance: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum(T + 1) = max_distance + 1, by dynamic
    programming over the partitions."""
    pairs = n * (n - 1) / 2
    costs = []
    for g in groups:
        tail = [1.0]  # distribution of the number of differing bits in this partition
        for b in g:
            q = joint[b][b] / max(n, 1)
            d = 2 * q * (1 - q)
            tail = [(tail[k] if k < len(tail) else 0) * (1 - d) + (tail[k - 1] if k else 0) * d for k in range(len(tail) + 1)]
        row = [0.0]
        for t in range(max_distance + 1):
            keys = sum(math.comb(len(g), e) for e in range(t + 1))
            row.append(KEY_COST * n * keys + PAIR_COST * pairs * sum(tail[:t + 1]) * (1 if t == 0 else 2))
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, plan) in best.items():
            for units in range(max_distance + 2 - used):
                total = (cost + row[units], plan + [units - 1])
                if used + units not in nxt or total < nxt[used + units]:
                    nxt[used + units] = total
        best = nxt
    return best[max_distance + 1]


def plan(n: int, joint: list[list[int]], max_distance: int) -> list[tuple[int, list[int]]]:
    """``(bit mask, masks to flip)`` for each partition that is probed."""
    options = []
    for parts in range(1, min(6, max_distance + 3) + 1):
        groups = partition_bits(n, joint, parts)
        cost, thresholds = allocate(n, joint, groups, max_distance)
        options.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(options)
    return [(sum(1 << b for b in g),
             [sum(1 << b for b in c) for e in range(t + 1) for c in itertools.combinations(g, e)])
            for g, t in zip(groups, thresholds) if t >= 0]


def keys(classes: DataFrame, probes: list[tuple[int, list[int]]]) -> DataFrame:
    """``(part, key, fp)`` for each class, partition and flip mask."""
    def run(batches):
        import numpy as np
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for part, (mask, flips) in enumerate(probes):
                own = fp & np.uint64(mask)
                for f in flips:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), part, np.int32)), pa.array((own ^ np.uint64(f)).view(np.int64)),
                         pa.array(fp.view(np.int64))], names=["part", "key", "fp"])

    return classes.select("fp").mapInArrow(run, "part int, key long, fp long")


def _forest(f, max_distance: int):
    """Spanning forest of the links among the fingerprints ``f``, as pairs
    (member, smallest member of its component)."""
    import numpy as np
    left, out = np.arange(len(f)), []
    while len(left) > 1:
        todo, left, seen = [left[0]], left[1:], [left[0]]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(f[left] ^ f[x]) <= max_distance
            new = left[near]
            left = left[~near]
            todo.extend(new)
            seen.extend(new)
        if len(seen) > 1:
            own = f[np.array(seen)].view(np.int64)
            out.append((own, np.full(len(own), own.min())))
    return out


def _links(part, key, bi, bj, fp, max_distance: int):
    """Links among rows sorted by their group (part, key, bi, bj)."""
    import numpy as np
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    out = []
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= _SMALL, sizes)
    for k in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        hit = np.flatnonzero((group[k:] == group[:-k]) & small[k:])
        if not len(hit):
            break
        a, b = fp[hit], fp[hit + k]
        ok = np.bitwise_count(a ^ b) <= max_distance
        if ok.any():
            out.append((a[ok].view(np.int64), b[ok].view(np.int64)))
    for g in np.flatnonzero(sizes > _SMALL):
        out += _forest(fp[starts[g]:starts[g] + sizes[g]], max_distance)
    return out


def links(classes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of distinct
    fingerprints at ``max_distance`` or fewer differing bits."""
    n, joint = bit_statistics(classes)
    rows = keys(classes, plan(n, joint, max_distance))
    crowd = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    # Rows of crowded keys stay where they are, so their blocks do not all
    # leave one task; the table of these keys is bounded by HOT and the parts.
    many = max(BLOCK, n // HOT)
    hot = F.broadcast(crowd.where(F.col("n") > many))
    others = rows.join(hot, ["part", "key"], "left_anti").join(crowd.where(F.col("n") <= many), ["part", "key"])
    met = (rows.join(hot, ["part", "key"]).unionByName(others).withColumn("blocks", blocks).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("part", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "fp"))
    cols = ["part", "key", "bi", "bj"]

    def run(batches):
        import numpy as np
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cur = [np.asarray(batch.column(i)) for i in range(5)]
                if rest is not None:
                    cur = [np.concatenate(x) for x in zip(rest, cur)]
                if not len(cur[0]):
                    continue
                # the last group may go on in the next batch
                last = [c[-1] for c in cur[:4]]
                same = np.logical_and.reduce([c == v for c, v in zip(cur[:4], last)])
                cut = int(np.argmax(same))
                rest, cur = [c[cut:] for c in cur], [c[:cut] for c in cur]
            else:
                cur, rest = rest, None
            if cur is not None and len(cur[0]):
                found = _links(*cur[:4], cur[4].view(np.uint64), max_distance)
                if found:
                    a, b = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(key, fp, component_id)`` for each row: the smallest key that its
    fingerprint reaches by links, itself included."""
    docs = written(fingerprints(df, key, text, shingle), "simhash-fp")
    classes = written(docs.groupBy("fp").agg(F.min(key).alias("__first")), "simhash-classes")
    found = components(links(classes, max_distance))
    member = (classes.join(found, classes.fp == found.node, "left")
              .select("fp", "__first", F.coalesce("component", "fp").alias("__root")))
    root = member.groupBy("__root").agg(F.min("__first").alias("component_id"))
    return docs.join(member.join(root, "__root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def as_hex(fp: str = "fp"):
    """A signed long fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
