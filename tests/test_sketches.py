"""Quantile sketches: merged from months, bounded error, no reading of lines."""

import random

import numpy as np
import pytest

from claimscope.operators import sketches as S
from claimscope.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("shape", ["lognormal", "signed", "ties", "tiny"])
def test_bounds_hold_the_exact_quantile(spark, shape):
    rng = random.Random(shape)
    one = {"lognormal": lambda: rng.lognormvariate(8, 2), "signed": lambda: rng.uniform(-50, 50), "ties": lambda: float(rng.randrange(3)), "tiny": lambda: rng.random() * 1e-9}[shape]
    rows = [(rng.randrange(7), one()) for _ in range(3000)] + [(1, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "month int, v double")
    monthly = S.build(df, "v", ["month"])
    values = np.sort([v for _, v in rows if v is not None and v == v])
    for r in S.quantiles(monthly, PROBS).collect():
        exact = values[int(np.floor(r.p * (len(values) - 1)))]
        assert r.low <= exact <= r.high and abs(r.q - exact) <= S.ERROR * abs(exact)
    by_month = {(r.month, r.p): r for r in S.quantiles(monthly, PROBS, ["month"]).collect()}
    for m in range(7):
        own = np.sort([v for k, v in rows if k == m and v is not None and v == v])
        for p in PROBS:
            assert by_month[m, p].low <= own[int(np.floor(p * (len(own) - 1)))] <= by_month[m, p].high


def test_merging_equals_building_at_once(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(5), rng.gauss(0, 100)) for _ in range(2000)], "month int, v double")
    merged = S.merge(S.build(df, "v", ["month"])).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, S.build(df, "v").collect()))


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, v double")
    assert [(r.g, r.q) for r in S.quantiles(S.build(df, "v", ["g"]), [0.5], ["g"]).collect()] == [(None, 1.0)]
    assert S.quantiles(S.build(df.limit(0), "v"), [0.5]).collect() == []


def test_a_period_is_answered_from_the_stored_sketch(spark):
    files = REGISTRY["p07_sketched_percentiles"](spark, SF_SMALL).inputFiles()
    stored = REGISTRY["s04_stored_claims_scan"](spark, SF_SMALL).inputFiles()
    assert files and not set(files) & set(stored)
