"""Operators 3 and 7 against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimscope.llm import imi, simhash
from claimscope.llm.common import components, table
from tests.conftest import SF_SMALL


def roots(n, links):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 900)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = roots(1000, links)
    assert got == {x: want[x] for x in range(1000) if want[x] != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7 -------------------------------------------------------------------

def plain_fingerprint(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    odd = [(9001, None), (9002, ""), (9003, " \x0b"), (9004, "One"), (9005, "one TWO"), (9006, "É é x É"), (9007, "a b c d " * 30000)]
    df = table(spark, SF_SMALL, "documents").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(df).select("doc_id", simhash.as_hex().alias("fingerprint")).collect()}
    assert got == {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in df.collect()}
    assert got[9001] == got[9002] == got[9003] == "0" * 16


@pytest.mark.parametrize("block,distance", [(1024, 3), (16, 3), (16, 5), (1024, 0)])
def test_links_find_every_component(spark, monkeypatch, block, distance):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_SMALL", 8)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(400)} | {0}
    for centre in rng.sample(sorted(fps), 30):  # near copies, and chains of them
        for _ in range(rng.choice([1, 3, 60])):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(centre)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (rng.getrandbits(9) << 20) for _ in range(300)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    u = np.array(fps, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= distance).tolist() if i < j]
    want = {fps[i]: fps[r] for i, r in enumerate(roots(len(fps), near))}
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance)
    got = {x: x for x in fps} | dict(map(tuple, components(edges).collect()))
    assert got == want


def test_thresholds_are_complete():
    rng, plans = np.random.default_rng(0), {}
    for n in (10, 10 ** 4, 10 ** 7, 10 ** 10):
        x = (rng.random((2000, 64)) < rng.uniform(.2, .8, 64)).astype(float)
        joint = (x.T @ x * (n / 2000)).astype(int).tolist()
        probes = simhash.plan(n, joint, 3)
        masks = [m for m, _ in probes]
        assert len(set(masks)) == len(masks) and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
        assert sum(max(f.bit_count() for f in flips) + 1 for _, flips in probes) == 4  # sum of (T + 1)
        plans[n] = len(probes)
    assert plans[10 ** 10] < plans[10 ** 4]  # wider when there is more


def test_near_duplicate_rows(spark):
    data = [(5, "a b c d e f g"), (3, "A B C d e f g"), (3, "A B C d e f g"), (None, "a b c d e f g"), (8, None), (7, ""), (None, "zz top"), (11, "other words are here")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("component_id", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (8, 7), (7, 7), (None, None), (11, 11)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- 3 -------------------------------------------------------------------

def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    a = np.array([rows[i][1] for i in ok], float)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.9
    links = [(ok[i], ok[j]) for i, j in zip(*np.nonzero(near)) if i != j]
    n = np.zeros(len(rows), int)
    for i, _ in links:
        n[i] += 1
    return n, links


@pytest.mark.parametrize("block", [2048, 40])
def test_links_of_vectors(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(800, 16))
    near = base[rng.integers(0, 40, 700)] + rng.normal(scale=.16, size=(700, 16))
    same = np.repeat(base[:1], 200, axis=0)
    vecs = [list(map(float, v)) for v in np.concatenate([base, near, same, 3 * base[:20]])]
    vecs += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vecs)) + 10, vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("uid", F.lit(1)).withColumn("v", F.lit(1))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    n, links = brute(exact)
    got = {r.vec_id: r for r in imi.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    found = np.array([got[i].n_links for i, _ in rows])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    comp = roots(len(rows), links)
    small = {}
    for k, c in enumerate(comp):
        small[c] = min(small.get(c, 1 << 60), rows[k][0])
    right = sum(got[i].component_id == small[c] for (i, _), c in zip(rows, comp))
    assert right >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    for i, v in rows[-6:]:
        assert (got[i].n_links, got[i].component_id) == (0, i)


def test_vector_edge_rows(spark):
    data = [(4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.05]), (9, [-1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (None, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in imi.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (None, 3, 2, False), (9, 0, 9, True), (1, 0, 1, True),
                          (None, 0, None, True)], key=str)
    assert imi.near_duplicates(df.limit(0)).count() == 0
    assert imi.near_duplicates(df.where("embedding is null")).count() == 1


def test_recall_on_the_table(spark):
    df = table(spark, SF_SMALL, "embeddings")
    n, _ = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = {r.vec_id: r.n_links for r in imi.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.9 * n.sum()


@pytest.mark.parametrize("grids, block", [(64, 2048), (3, 16), (1, 7)])
def test_vectors_of_several_lengths(spark, monkeypatch, grids, block):
    """Each length links within itself, whether it has a grid or is rare."""
    monkeypatch.setattr(imi, "GRIDS", grids)
    rng = np.random.default_rng(5)
    rows = []
    for width, n in ((4, 120), (6, 60), (2, 25), (1, 9)):
        base = rng.normal(size=(max(1, n // 4), width))
        rows += [(base[i % len(base)] * rng.uniform(0.5, 2) + rng.normal(size=width) * rng.choice([0, 0.02])).tolist() for i in range(n)]
    rows += [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [], [0.0, 0.0], None]
    order = rng.permutation(len(rows)).tolist()
    table = [(i, rows[j]) for i, j in enumerate(order)]
    got = {r.vec_id: r for r in imi.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>"), block=block).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in table if v and any(v)}
    near = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    assert len(got) == len(table)
    for i, _ in table:
        assert got[i].n_links == len(near.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
