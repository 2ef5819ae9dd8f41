"""Property checks on the small fixture."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.operators import breakdown as A
from claimscope.operators import forecast as M
from claimscope.operators import fraud as R
from claimscope.operators import stats as P
from claimscope.operators import temporal as W
from claimscope.plans.distributed import exact_quantiles, running_total


def test_shares_sum_to_one(claims):
    s = A.treatment_distribution(claims).agg(F.sum("share")).first()[0]
    assert abs(s - 1.0) < 1e-9


def test_lorenz_rises_and_ends_at_one(claims):
    rows = A.lorenz(claims).orderBy("position").collect()
    assert abs(rows[-1]["amount_share"] - 1.0) < 1e-12
    assert abs(rows[-1]["provider_share"] - 1.0) < 1e-12
    shares = [r["amount_share"] for r in rows]
    assert shares == sorted(shares)


def test_histogram_counts_sum_to_rows(claims):
    n = claims.count()
    assert P.histogram(claims, "amount", 7).agg(F.sum("count")).first()[0] == n


def test_threshold_monotone(claims):
    s = R.rule_score(claims, max_lines=3, amount_factor=1.9).cache()
    counts = [R.run_summary(s, t).first()["fraud_count"] for t in (0.1, 0.2, 0.35, 0.5, 0.7, 1.0)]
    assert counts == sorted(counts, reverse=True)


def test_score_is_exact_weight_sum(claims):
    s = R.rule_score(claims, max_lines=3, amount_factor=1.9)
    w = {"rule_claim_total_outlier": Decimal("0.35"), "rule_member_diagnosis_repeat": Decimal("0.25"),
         "rule_member_month_lines": Decimal("0.15"), "rule_quantity_p99": Decimal("0.15"),
         "rule_amount_vs_diagnosis_mean": Decimal("0.10")}
    for r in s.select("fraud_score", *w).collect():
        assert r["fraud_score"] == sum((v for k, v in w.items() if r[k]), Decimal("0.00"))


def test_rollup_subtotals_equal_leaves(claims):
    r = A.two_level(claims)
    leaves = r.where("level = 0").groupBy("benefit").agg(F.sum("total_amount").alias("s"))
    subs = r.where("level = 1").select("benefit", F.col("total_amount").alias("t"))
    assert leaves.join(subs, "benefit").where("s != t").count() == 0
    grand = r.where("level = 3").first()["total_amount"]
    assert grand == claims.agg(F.sum("amount")).first()[0]


def test_contributions_add_up(claims):
    c = M.lag_contributions(claims, ["benefit"])
    bad = c.where(F.abs(F.col("base_value") + F.col("lag_1_contribution") - F.col("prediction")) > 0.02)
    assert bad.count() == 0


def test_empty_input_keeps_schema(claims):
    empty = claims.limit(0)
    for df in (A.summary(empty), A.by_benefit(empty), W.rollup(empty, "month"),
               R.rule_score(empty), P.describe(empty, ["amount"])):
        df.collect()
        assert df.columns


def test_exact_quantiles_match_percentile(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), float(rnd.randint(-50, 50)) + rnd.random()) for _ in range(3000)]
    rows += [("hot", 1.0)] * 2000 + [("hot", 2.5)] + [(None, 1e-9 * i) for i in range(50)] + [("b", None), ("big", 1e300), ("big", -1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    mine = {(r.g, r.p): r.q for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    ref = df.groupBy("g").agg(*[F.percentile("v", p).alias(str(p)) for p in probs]).collect()
    for r in ref:
        for p in probs:
            assert abs(mine[(r.g, p)] - r[str(p)]) < 1e-9


def test_running_total_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id").alias("k")).repartition(7)
    mine = {r.k: (r.row_pos, r.v_cum) for r in running_total(df, ["v", "k"], ["v"]).collect()}
    w = Window.orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
    for r in df.select("k", F.row_number().over(Window.orderBy("v", "k")).alias("rn"),
                       F.sum("v").over(w).alias("cs")).collect():
        assert mine[r.k] == (r.rn, r.cs)


def test_no_python_udf_in_plans(spark, claims):
    from claimscope.plans.registry import REGISTRY
    from tests.conftest import SF_SMALL
    for name in ("a06_by_benefit", "r04_rule_score", "w06_monthly_box", "m01_forecast", "p01_describe"):
        plan = REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_date_range_refuses_reversed(claims):
    from claimscope.operators.filters import date_range
    with pytest.raises(ValueError):
        date_range(claims, "2000-02-01", "2000-01-01")


def test_stream_equals_batch(spark):
    from claimscope.plans.registry import REGISTRY
    from tests.conftest import SF_SMALL
    a = sorted(tuple(r) for r in REGISTRY["st_w01_daily_event_rollup"](spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in REGISTRY["w01_daily_event_rollup_batch"](spark, SF_SMALL).collect())
    assert a == b
