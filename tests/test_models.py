"""Linear models, exact AUC, k-means and the two-stage ARIMA against numpy and
the evaluators of pyspark.ml."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from claimscope.operators import forecast as M
from claimscope.operators import linear as L
from claimscope.operators import ml
from claimscope.plans.distributed import exact_quantiles, order_bucket, rank_sum_auc
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("scores", ["ties", "many", "tiny", "signed"])
def test_auc_equals_the_evaluator(spark, scores):
    rng = random.Random(scores)
    one = {"ties": lambda: rng.randrange(4) / 4, "many": rng.random, "tiny": lambda: rng.random() * 1e-6, "signed": lambda: rng.uniform(-1, 1)}[scores]
    rows = [(one(), float(rng.random() < 0.3)) for _ in range(3000)]
    rows = [(s + (0.1 * y if scores == "many" else 0), y) for s, y in rows]
    df = spark.createDataFrame(rows, "score double, label double")
    # the evaluator groups scores into bins unless told not to
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert rank_sum_auc(df).first()["roc_auc"] == pytest.approx(want, abs=1e-9)


def test_auc_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0.1, 1.0), (None, 0.0), (0.3, None)], "score double, label double")
    assert tuple(rank_sum_auc(df).first()) == (None, 1, 0) and tuple(rank_sum_auc(df.limit(0)).first()) == (None, 0, 0)


def test_buckets_spread_small_values_and_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted({rng.uniform(0, 1e-4) for _ in range(10_000)} | {0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0000001}
                    | {-10 ** rng.uniform(-300, 300) for _ in range(500)})
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select("v", order_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)
    sizes = np.unique(got, return_counts=True)[1]
    assert sizes.max() < 30
    rates = spark.createDataFrame([(v,) for v in values if 0 < v < 1e-4], "v double")
    assert exact_quantiles(rates, "v", [0.37]).first()["q"] == pytest.approx(np.quantile([v for v in values if 0 < v < 1e-4], 0.37), rel=1e-12)


def test_least_squares_with_missing_and_rare_categories(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal()) if i % 9 else None, ["a", "b", None, "c", f"r{i}"][min(int(rng.integers(40)) // 8, 4) if i % 7 else 4]) for i in range(400)]
    y = [3.0 + 2.0 * (x or 0.0) + (0.7 if c == "b" else 0.0) + float(rng.normal()) for x, c in rows]
    df = spark.createDataFrame([(*r, v) for r, v in zip(rows, y)], "x double, c string, y double")
    shape = L.design(df, ["x"], ["c"], limit=4)
    assert set(dict(shape.categories)["c"]) == {None, "a", "b", "c"}  # the rare ones share the base
    fit = L.least_squares(df, shape, F.col("y"), ridge=0.0)
    x = np.array([[1.0, a or 0.0, float(a is None), *[float(c == v) for v in dict(shape.categories)["c"][1:]]] for a, c in rows])
    assert np.allclose(fit.coefficients, np.linalg.lstsq(x, np.array(y), rcond=None)[0], atol=1e-9)
    assert L.Fit.of(fit.frame(spark)) == fit
    m = L.regression_metrics(df.select(F.col("y").alias("target"), fit.predict().alias("prediction"))).first()
    e = np.array(y) - x @ fit.coefficients
    assert m["rmse"] == pytest.approx((e @ e / 400) ** 0.5) and m["rows"] == 400


def _many_categories(seed, rows, count):
    """Rows of two categories of ``count`` values each, with gaps, and a target
    that every value moves."""
    rng = np.random.default_rng(seed)
    c, d = rng.integers(0, count, rows), rng.integers(0, count, rows)
    x = rng.normal(size=rows)
    y = 2.0 + 0.5 * x + np.sin(c) * 3 + np.cos(d * 7) + rng.normal(size=rows) * 0.1
    return [(None if i % 50 == 0 else float(x[i]), None if c[i] == 1 else f"c é{c[i]}", f"d{d[i]}", float(y[i])) for i in range(rows)]


@pytest.mark.parametrize("dense", [L.DENSE, 0])
def test_every_category_value_has_a_column(spark, monkeypatch, dense):
    """More values than any fixed number of columns: none shares the base."""
    rows = _many_categories(3, 3000, 60)
    df = spark.createDataFrame(rows, "x double, c string, d string, y double")
    shape = L.design(df, ["x"], ["c", "d"])
    found = dict(shape.categories)
    assert set(found["c"]) == {r[1] for r in rows} and set(found["d"]) == {r[2] for r in rows} and found["c"][0] is None
    monkeypatch.setattr(L, "DENSE", dense)
    fit = L.least_squares(df, shape, F.col("y"))
    a = np.array([[1.0, x or 0.0, float(x is None), *[float(c == v) for v in found["c"][1:]], *[float(d == v) for v in found["d"][1:]]] for x, c, d, _ in rows])
    y = np.array([r[3] for r in rows])
    want = np.linalg.solve(a.T @ a + np.diag([0.0] + [1e-3] * (a.shape[1] - 1)), a.T @ y)
    assert np.allclose(fit.coefficients, want, atol=1e-8)
    assert L.Fit.of(fit.frame(spark)) == fit
    got = [r.p for r in df.union(spark.createDataFrame([(1.0, "new", "d0", 0.0)], df.schema)).coalesce(1).select(fit.predict().alias("p")).collect()]
    assert np.allclose(got[:-1], a @ want, atol=1e-8)
    assert got[-1] == pytest.approx(want[0] + want[1] + dict(zip(shape.names(), want)).get("d=d0", 0.0), abs=1e-8)  # a value that was not learned


def test_linear_classifier_learns_rare_categories(spark):
    """L3: a label that depends on one of 40 cost centres is found in each."""
    n = F.col("id")
    lines = spark.range(6000).select(
        n.cast("string").alias("line_id"), (n % 5).cast("int").alias("quantity"), F.lit(1).cast("decimal(12,2)").alias("amount"), F.lit(None).cast("date").alias("dob"),
        F.lit(None).cast("date").alias("claim_prov_date"), *[F.lit("x").alias(c) for c in ("benefit", "gender", "dependent_type", "encounter")],
        F.concat(F.lit("centre "), n % 40).alias("cost_center"), (n % 40 >= 20).cast("int").alias("label"))
    got = ml.linear_metrics(ml.fit_linear_classifier(lines), lines).first()
    assert (got.accuracy, got.fp, got.fn) == (1.0, 0, 0)


def test_least_squares_of_nothing(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert L.least_squares(df, L.Design(("x",)), F.col("y")).coefficients == (0.0, 0.0, 0.0)


def test_two_stage_arima_equals_numpy(claims):
    got = {r.benefit: r for r in M.arima111(claims, ["benefit"]).collect()}
    series = {}
    for r in M.monthly_series(claims, ["benefit"]).orderBy("benefit", "month").collect():
        series.setdefault(r.benefit, []).append(r.y)
    assert set(got) == set(series)
    for name, y in series.items():
        x = np.diff(y)
        far = np.column_stack([np.ones(len(x) - 3), x[2:-1], x[1:-2], x[:-3]])
        e = x[3:] - far @ np.linalg.lstsq(far, x[3:], rcond=None)[0]
        near = np.column_stack([np.ones(len(e) - 1), x[3:-1], e[:-1]])
        c, ar, ma = np.linalg.lstsq(near, x[4:], rcond=None)[0]
        assert (got[name].ar, got[name].ma, got[name].n) == (pytest.approx(ar, rel=1e-6), pytest.approx(ma, rel=1e-6), len(e) - 1)
        assert got[name].next_amount == pytest.approx(y[-1] + c + ar * x[-1] + ma * e[-1], rel=1e-6)


def test_arima_of_short_and_constant_series(spark):
    rows = [("short", f"2024-0{m}-03", 5 * m) for m in (1, 2, 3)] + [("flat", f"20{y}-{m:02d}-09", 7) for y in (22, 23) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "benefit string, d string, a int").select("benefit", F.col("d").cast("date").alias("claim_prov_date"), F.col("a").cast("decimal(12,2)").alias("amount"))
    got = {r.benefit: r for r in M.arima111(df, ["benefit"]).collect()}
    assert got.keys() == {"short", "flat"} and all(r.ar is None and r.ma is None and r.next_amount is None for r in got.values())


def test_lloyd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) + rng.integers(0, 3, (300, 1))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    start = [[-1.0] * 3, [0.0] * 3, [1.0] * 3, [90.0] * 3]  # the last one stays without rows
    got = np.array(ml.lloyd(df, ["a", "b", "c"], start, 6))
    want = np.array(start)
    for _ in range(6):
        near = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([x[near == k].mean(0) if (near == k).any() else want[k] for k in range(4)])
    assert np.allclose(got, want, atol=1e-9) and (got[3] == 90.0).all()


def test_fit_rows_bound_the_training_sample_only(spark, claims):
    from pyspark.ml.classification import LogisticRegression
    models, test = ml.fit_models(claims, models={"lr": LogisticRegression(labelCol="label", maxIter=2)}, fit_rows=500)
    assert test.count() == ml.split(claims)[1].count()
    assert ml.evaluate(models, test).first()["roc_auc"] > 0


def test_stored_model_is_loaded_not_trained(spark, monkeypatch):
    from claimscope.plans import registry
    first = registry.REGISTRY["m13_batch_predict"](spark, SF_SMALL)
    monkeypatch.setattr(ml, "fit_linear_classifier", None)  # a second training would fail
    again = registry.REGISTRY["m13_batch_predict"](spark, SF_SMALL)
    assert first.count() == again.count() > 0


def test_permutation_importance(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", rng.random(), rng.random(), 0) for i in range(800)]
    rows = [(k, a, b, int(a > 0.5)) for k, a, b, _ in rows] + [("none", 0.1, 0.1, None)]
    df = spark.createDataFrame(rows, "line_id string, a double, b double, label int")
    got = {r.feature: r for r in ml.permutation_importance(F.col("a") + F.lit(0.0), df, ["a", "b"]).collect()}
    assert got["b"].importance == 0.0 and got["a"].rows == 800
    assert 0.4 < got["a"].importance < 0.6  # a coin's toss is left
    again = {r.feature: r.importance for r in ml.permutation_importance(F.col("a") + F.lit(0.0), df.repartition(5), ["a", "b"]).collect()}
    assert again == {k: r.importance for k, r in got.items()}
    # dealing keeps the values: the mean of a score that is the feature itself stays
    assert ml.permutation_importance(F.lit(1.0), df, ["a"]).first()["importance"] == 0.0


def test_permutation_over_many_groups_equals_plain_sorting(spark):
    """Values meet by place whatever the groups; repeated and missing values."""
    import hashlib
    rng = random.Random(8)
    rows = [(f"r{i}", None if i % 11 == 0 else rng.random(), rng.choice(["x", "y", None, "z"]), rng.randrange(5), rng.randrange(2)) for i in range(700)]
    df = spark.createDataFrame(rows, "line_id string, a double, b string, c int, label int")
    score = F.coalesce(F.col("a"), F.lit(0.2)) + F.when(F.col("b") == "x", 0.3).when(F.col("b").isNull(), -0.2).otherwise(0.0) + F.col("c") * 0.05
    plain = lambda a, b, c: (0.2 if a is None else a) + (0.3 if b == "x" else -0.2 if b is None else 0.0) + c * 0.05

    def order(seed):
        return sorted(range(700), key=lambda i: (int(hashlib.md5(f"r{i}:{seed}".encode()).hexdigest()[:12], 16), f"r{i}"))

    right = lambda values: sum((plain(*v) >= 0.5) == (r[4] == 1) for r, v in zip(rows, values))
    base, to, want = right([r[1:4] for r in rows]), order("to"), {}
    for k, name in enumerate("abc"):
        values = [list(r[1:4]) for r in rows]
        for i, j in zip(to, order(name)):
            values[i][k] = rows[j][1 + k]
        want[name] = (base - right(values)) / 700
    for places in (13, 100, 10_000):
        got = ml.permutation_importance(score, df, ["a", "b", "c"], places=places).collect()
        assert {r.feature: r.importance for r in got} == pytest.approx(want) and {r.rows for r in got} == {700}


def test_permutation_of_nothing_and_without_keys(spark):
    df = spark.createDataFrame([(None, float(i % 2), i % 2, i) for i in range(300)], "line_id string, a double, label int, n int")
    got = ml.permutation_importance(F.col("a"), df, ["a"], places=20).first()
    assert got.rows == 300 and 0.3 < got.importance < 0.7
    assert tuple(ml.permutation_importance(F.col("a"), df.limit(0), ["a"]).first()) == ("a", None, 0)


def test_features_are_dealt_in_one_move(spark):
    df = spark.createDataFrame([(f"r{i}", float(i), i % 2, i % 2) for i in range(50)], "line_id string, a double, b int, label int")
    plan = ml.permutation_importance(F.col("a") + F.col("b"), df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    start = plan[plan.index("AdaptiveSparkPlan"):]
    moves = [x for x in start.splitlines() if "Exchange hashpartitioning(__group" in x and "__order" not in x]
    assert len(moves) == 1 and "SortMergeJoin" not in start
