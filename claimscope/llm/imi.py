"""Embedding near-duplicates by an inverted multi-index (operator 3).

Method.  Unit vectors are cut into two halves; an independent codebook of K
codewords is fitted to each half (k-means in numpy on a bounded sample).  The
K x K product grid is the index: every vector lies in the cell of its nearest
codeword pair.  Every vector is also a query: it visits cells in increasing
order of summed half distances (multi-sequence traversal) until a cell's
excess over the nearest one passes a radius.  The radius is calibrated on
sample pairs, real ones and made ones at the threshold, to ``TARGET_RECALL``.
Vectors of visited cells are verified by the cosine in double precision.

Equal vectors are first collapsed to one weighted class.  Rows of the grid
(first codeword) are the join key; a row with many vectors or visitors is cut
into blocks, and block pairs are spread over tasks.  What leaves a task is a
link count per vector and a spanning forest, never all pairs.  A pair counts
once: if both vectors visit each other's cell, each credits itself, otherwise
the visitor credits both.

Defined results.  Null and zero vectors, and vectors with a null or
non-finite component, have no links and are their own component.  Vectors of
different lengths never link; each length with a share of ``1 / GRIDS`` of all
or more has a grid of its own, the vectors of rarer lengths are compared
exactly, in blocks.  Repeated rows are other vectors, linked at cosine 1.  A
null id is never the smallest.  Empty tables give empty results.  Only the id
and vector columns are read.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import components, written

COSINE = 0.9
TARGET_RECALL = 0.99
SAMPLE = 16_384       # vectors for codebooks and calibration, chosen by hash
MAX_K = 512           # codewords a half; both codebooks stay under a megabyte or so
PER_CELL = 16         # vectors a cell that K aims at
BLOCK = 2048          # vectors of one grid row in one block
ROUNDS = 12           # k-means rounds
GRIDS = 64            # lengths with this part of all vectors have a grid, so there are at most as many
_SEED = 42


def parse(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, h, v)``: unit vector as float64 bytes and its digest; both null
    where the vector links with nothing."""
    def run(batches):
        import numpy as np
        for batch in batches:
            hs, vs = [], []
            for x in batch.column(1):
                x = x.as_py()
                h = v = None
                if x and not any(c is None for c in x):
                    a = np.array(x, np.float64) + 0.0  # -0.0 becomes 0.0
                    top = np.abs(a).max()
                    if np.isfinite(a).all() and top > 0:
                        h = hashlib.blake2b(a.tobytes(), digest_size=16).digest()
                        a = a / top
                        v = (a / np.sqrt(a @ a)).tobytes()
                hs.append(h)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hs, pa.binary()), pa.array(vs, pa.binary())],
                                             names=[key, "h", "v"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, h binary, v binary")


def _half_distances(v, book):
    """Squared distances of half vectors to all codewords, always summed in
    the same way, so that both ends of a pair get equal values."""
    import numpy as np
    out = np.empty((len(v), len(book)))
    step = max(1, 4_000_000 // max(1, book.size))
    for at in range(0, len(v), step):
        out[at:at + step] = ((v[at:at + step, None, :] - book[None]) ** 2).sum(-1)
    return out


def _kmeans(x, k: int, rng):
    import numpy as np
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((x ** 2).sum(1)[:, None] - 2 * x @ book.T + (book ** 2).sum(1)[None]).argmin(1)
        for c in range(k):
            own = x[near == c]
            book[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return book


class Grid:
    """Codebooks of both halves and the traversal radius."""

    def __init__(self, first, second, radius: float = 0.0):
        self.first, self.second, self.radius = first, second, radius
        self.cut = first.shape[1]

    def distances(self, v):
        return _half_distances(v[:, :self.cut], self.first), _half_distances(v[:, self.cut:], self.second)

    def cells(self, d1, d2):
        return d1.argmin(1), d2.argmin(1)


def fit(sample, n: int, cosine: float = COSINE, target: float = TARGET_RECALL) -> Grid:
    """Codebooks and calibrated radius from sample unit vectors of ``n``."""
    import numpy as np
    rng = np.random.default_rng(_SEED)
    cut = (sample.shape[1] + 1) // 2
    k = int(min(MAX_K, len(sample), max(2, round((n / PER_CELL) ** 0.5))))
    grid = Grid(_kmeans(sample[:, :cut], k, rng), _kmeans(sample[:, cut:], k, rng) if cut < sample.shape[1] else np.zeros((1, 0)))
    pairs = []
    for at in range(0, min(len(sample), 2048), 256):  # real pairs: sample queries against the whole sample
        i, j = np.nonzero(sample[at:at + 256] @ sample.T >= cosine)
        i = i + at
        keep = np.flatnonzero(i != j)
        keep = rng.choice(keep, 2500, replace=False) if len(keep) > 2500 else keep
        pairs.append((sample[i[keep]], sample[j[keep]]))
    real = tuple(np.concatenate(x) for x in zip(*pairs))
    base = sample[rng.integers(len(sample), size=2000)]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    size = np.linalg.norm(noise, axis=1)
    ok = size > 1e-9  # one dimension has no other direction
    made = (base[ok], cosine * base[ok] + (1 - cosine ** 2) ** 0.5 * noise[ok] / size[ok, None])
    radius = 0.0
    for a, b in (real, made):
        if len(a):
            radius = max(radius, float(np.quantile(np.minimum(_excess(grid, a, b), _excess(grid, b, a)), target)))
    grid.radius = radius + 1e-9
    return grid


def _excess(grid: Grid, a, b):
    """How much farther than its nearest cell b's cell is from a."""
    import numpy as np
    d1, d2 = grid.distances(a)
    i, j = grid.cells(*grid.distances(b))
    rows = np.arange(len(a))
    return d1[rows, i] + d2[rows, j] - d1.min(1) - d2.min(1)


def _stack(column):
    import numpy as np
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _row_counts(classes: DataFrame, grid) -> tuple[dict[int, int], dict[int, int]]:
    """Vectors in, and visitors of, each grid row: at most 2 K numbers."""
    def run(batches):
        import numpy as np
        g = grid.value
        members, visitors = np.zeros(len(g.first), np.int64), np.zeros(len(g.first), np.int64)
        for batch in batches:
            if batch.num_rows:
                d1, d2 = g.distances(_stack(batch.column(0)))
                members += np.bincount(d1.argmin(1), minlength=len(members))
                visitors += (d1 - d1.min(1)[:, None] <= g.radius).sum(0)
        n = len(members)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(members), pa.array(visitors)],
                                         names=["i", "m", "q"])

    got = classes.select("v").mapInArrow(run, "i int, m long, q long").groupBy("i").agg(F.sum("m").alias("m"), F.sum("q").alias("q"))
    rows = got.collect()
    return {r.i: r.m for r in rows}, {r.i: r.q for r in rows}


def _probe_rows(classes: DataFrame, grid, members: dict[int, int], visitors: dict[int, int], block: int) -> DataFrame:
    """Index rows and query rows by (grid row, index block, query block)."""
    schema = "i int, ib int, qb int, query boolean, uid long, n long, v binary"

    def run(batches):
        import numpy as np
        g = grid.value
        nib = {i: -(-m // block) for i, m in members.items()}
        nqb = {i: -(-q // block) for i, q in visitors.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _stack(batch.column(2))
            d1, _ = g.distances(v)
            own = d1.argmin(1)
            # every visited cell of row i has at least this excess
            reach = d1 - d1.min(1)[:, None] <= g.radius
            mix = (np.asarray(batch.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in range(at, min(batch.num_rows, at + 256)):
                    i = int(own[r])
                    ib = int(mix[r] % nib[i])
                    out += [(i, ib, qb, False, r) for qb in range(nqb[i])]
                    for i in np.flatnonzero(reach[r]).tolist():
                        if nib[i]:
                            qb = int(mix[r] % nqb[i])
                            out += [(i, ib, qb, True, r) for ib in range(nib[i])]
                i_, ib_, qb_, query, r_ = zip(*out)
                take = pa.array(r_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i_, pa.int32()), pa.array(ib_, pa.int32()), pa.array(qb_, pa.int32()), pa.array(query),
                     *(batch.column(c).take(take) for c in range(3))], names=["i", "ib", "qb", "query", "uid", "n", "v"])

    return classes.select("uid", "n", "v").mapInArrow(run, schema)


def _local_roots(a, b, n: int):
    """Smallest member of each component among n items with links (a, b)."""
    import numpy as np
    lab = np.arange(n)
    while True:
        m = lab.copy()
        np.minimum.at(m, a, lab[b])
        np.minimum.at(m, b, lab[a])
        m = m[m]
        if (m == lab).all():
            return lab
        lab = m


def links(classes: DataFrame, grid, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(uid, credit, root)``: link counts and forest edges of each block."""
    members, visitors = _row_counts(classes, grid)

    def verify(group: pa.Table) -> pa.Table:
        import numpy as np
        g = grid.value
        i = group.column("i")[0].as_py()
        query = np.asarray(group.column("query"))
        uid, n = np.asarray(group.column("uid")), np.asarray(group.column("n"))
        v = _stack(group.column("v"))
        q, x = np.flatnonzero(query), np.flatnonzero(~query)
        empty = pa.table({"uid": pa.array([], pa.int64()), "credit": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(q) or not len(x):
            return empty
        q1, q2 = g.distances(v[q])
        x1, x2 = g.distances(v[x])
        jx = x2.argmin(1)
        spare = g.radius + q1.min(1) + q2.min(1) - q1[:, i]  # what is left for the second half
        found = []
        for j in np.unique(jx):
            visiting, own = np.flatnonzero(q2[:, j] <= spare), np.flatnonzero(jx == j)
            a, b = np.nonzero(v[q[visiting]] @ v[x[own]].T >= cosine)
            found.append((visiting[a], own[b]))
        a, b = (np.concatenate(c) for c in zip(*found))
        other = uid[q[a]] != uid[x[b]]
        a, b = a[other], b[other]
        if not len(a):
            return empty
        # does the found vector visit the cell of the one that found it?
        qi, qj = g.cells(q1, q2)
        back = x2[b, qj[a]] <= g.radius + x1[b].min(1) + x2[b].min(1) - x1[b, qi[a]]
        ids, at = np.unique(np.concatenate([uid[q[a]], uid[x[b]]]), return_inverse=True)
        ia, ib = at[:len(a)], at[len(a):]
        credit = np.bincount(ia, n[x[b]], len(ids)) + np.bincount(ib, np.where(back, 0, n[q[a]]), len(ids))
        root = ids[_local_roots(ia, ib, len(ids))]
        return pa.table({"uid": pa.array(ids), "credit": pa.array(credit.astype(np.int64)), "root": pa.array(root)})

    rows = _probe_rows(classes, grid, members, visitors, block)
    return rows.groupBy("i", "ib", "qb").applyInArrow(verify, "uid long, credit long, root long")


def rare_links(classes: DataFrame, counts: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(uid, credit, root)`` of vectors of the lengths in ``counts(w,
    count)``: all pairs of blocks of one length, compared exactly.  A length
    here has less than ``1 / GRIDS`` of all vectors."""
    blocks = F.ceil(F.col("count") / block).cast("int")
    rows = (classes.withColumn("w", F.octet_length("v")).join(counts, "w").withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("w", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "uid", "n", "v"))

    def verify(group: pa.Table) -> pa.Table:
        import numpy as np
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        own, uid, n, v = *(np.asarray(group.column(c)) for c in ("own", "uid", "n")), _stack(group.column("v"))
        first = np.flatnonzero(own == bi)
        second = first if bi == bj else np.flatnonzero(own == bj)
        a, b = np.nonzero(v[first] @ v[second].T >= cosine)
        a, b = first[a], second[b]
        if bi == bj:
            a, b = a[a < b], b[a < b]
        ids, at = np.unique(np.concatenate([uid[a], uid[b]]), return_inverse=True)
        credit = np.zeros(len(ids), np.int64)
        np.add.at(credit, at[:len(a)], n[b])
        np.add.at(credit, at[len(a):], n[a])
        root = ids[_local_roots(at[:len(a)], at[len(a):], len(ids))] if len(ids) else ids
        return pa.table({"uid": pa.array(ids, pa.int64()), "credit": pa.array(credit), "root": pa.array(root, pa.int64())})

    return rows.groupBy("w", "bi", "bj").applyInArrow(verify, "uid long, credit long, root long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                    target: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row."""
    import numpy as np
    spark = df.sparkSession
    rows = written(parse(df, key, vector), "imi-rows")
    classes = (rows.where("h is not null").groupBy("h").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min(key).alias("__first"))
               .withColumn("uid", F.monotonically_increasing_id()))
    classes = written(classes, "imi-classes")  # fixes the uid of each class
    widths = classes.groupBy(F.octet_length("v").alias("w")).count()
    total = classes.count()
    alone = rows.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"),
                        F.lit(True).alias("kept"))
    if not total:
        return alone
    parts = []
    often = widths.where(F.col("count") * GRIDS >= total).collect()  # at most GRIDS rows
    for width in often:
        usable = classes.where(F.octet_length("v") == width.w)
        sample = usable.select("v").orderBy(F.xxhash64("h"), "uid").limit(SAMPLE).collect()
        grid = spark.sparkContext.broadcast(fit(np.frombuffer(b"".join(r.v for r in sample)).reshape(len(sample), -1), width["count"], cosine, target))
        parts.append(links(usable, grid, cosine, block))
    if sum(width["count"] for width in often) < total:
        parts.append(rare_links(classes, widths.where(F.col("count") * GRIDS < total), cosine, block))
    found = written(functools.reduce(DataFrame.union, parts), "imi-links")
    credit = found.groupBy("uid").agg(F.sum("credit").alias("credit"))
    comp = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    member = (classes.join(credit, "uid", "left").join(comp, F.col("uid") == F.col("node"), "left")
              .select("h", "__first", (F.col("n") - 1 + F.coalesce("credit", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "uid").alias("__root")))
    root = member.groupBy("__root").agg(F.min("__first").alias("component_id"))
    per_class = member.join(root, "__root").select("h", "n_links", "component_id")
    out = rows.select(key, "h").join(per_class, "h", "left")
    comp_id = F.when(F.col("n_links").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col(key) == comp_id, F.col("n_links").isNull()).alias("kept"))
