"""Hard-negative mining (operator 11) against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from claimscope.llm import hardneg, queries
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50):
    ok = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(c is None or c != c or abs(c) == float("inf") for c in v):
            continue
        ok.append((i, vec_id, [int(c * 256 // 1) if abs(c) < 1e300 else int(c) * 256 for c in v], label))
    last = lambda x: (x is None, x or 0)
    out = []
    for i, a, v, label in ok:
        if a is None or a % every:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), b, j, lab) for j, b, w, lab in ok if j != i and len(w) == len(v)]
        score.sort(key=lambda s: (-s[0], last(s[1]), s[2]))
        for p, b, _, _ in [s for s in score if s[3] == label][:positives]:
            far = [s for s in score if s[3] != label and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(a, b, k + 1, n, p, s) for k, (s, n, _, _) in enumerate(far)]
    return out


def clipped(rows):
    return [tuple(x if x is None else min(max(x, -2 ** 63), 2 ** 63 - 1) for x in r) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize("seed,size,blocks", [(1, 0.3, (4096, 16384)), (2, 40.0, (7, 3)), (3, 3e4, (16, 2)), (4, 1e7, (5, 5))])
def test_equals_brute_force_over_many_blocks(spark, seed, size, blocks):
    rng = random.Random(seed)
    pool = [[rng.uniform(-size, size) for _ in range(3)] for _ in range(25)]  # few vectors: many ties
    rows = [(i, rng.choice(pool), rng.randrange(3)) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = hardneg.mine(df, anchor="vec_id % 10 = 0", row_block=blocks[0], anchor_block=blocks[1])
    want = clipped(brute(rows, every=10))
    assert want and got(out) == sorted(want, key=key)


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in df.collect()]
    want = brute(rows)
    assert want and got(queries.op11_kronecker_hard_negatives(spark, SF_SMALL)) == sorted(want, key=key)


def test_nulls_lengths_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (50, [1.0, 0.9], 1), (1, [0.9, 0.7], 2), (2, [0.9, 0.7], 2), (None, [0.9, 0.7], 2),
            (3, [1.0, None], 1), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, None, 1), (100, [1.0, 1.0], None), (7, [1.0], 1),
            (150, [1.0], 1), (8, [0.8], 2), (200, [], 1), (9, [], 1), (10, [], 2), (11, [0.0, 0.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("uid", "score", "rank", "positive", "v", "n", "anchor")})
    out = hardneg.mine(df)
    assert got(out) == sorted(brute(rows), key=key)
    assert any(r[3] is None for r in got(out))  # a null id comes last among ties, but it comes
    assert [r for r in got(out) if r[0] == 200] == [(200, 9, 1, 10, 0, 0)]


def test_components_beyond_64_bits_are_compared_exactly(spark):
    rows = [(0, [1e200, 0.0], 1), (1, [1e200, 1.0], 1), (2, [7e199, 5.0], 2), (3, [7e199, 3.0], 2), (4, [2e306, 0.0], 1), (50, [1e307, 1.0], 1), (5, [9e306, 1.0], 2),
            (100, [3e11, 1.0], 1), (6, [2e11, 1.0], 2)]
    out = got(hardneg.mine(spark.createDataFrame(rows, SCHEMA)))
    assert out == sorted(clipped(brute(rows)), key=key)


def test_empty(spark):
    out = hardneg.mine(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_one_hot_label_and_vector_spread_over_the_blocks(spark):
    """A label and a vector that hold most rows: still every task of the grid
    gets its even share."""
    rows = [(i, [1.0, 0.5] if i % 3 else [0.5, float(i)], 1 if i % 4 else 2) for i in range(2000)]
    df = hardneg.parse(spark.createDataFrame(rows, SCHEMA), F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") % 50 == 0)
    dealt = hardneg._grid(df, df.where("anchor").withColumn("wanted", F.lit(None)), 10, 2).count().collect()
    sizes = [r["count"] for r in dealt]
    assert len(sizes) == 20 and max(sizes) < 2 * min(sizes)
