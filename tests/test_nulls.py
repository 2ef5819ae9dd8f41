"""Missing values: nothing is lost, nothing falls into a wrong class."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.functions import scalar as X
from claimscope.operators import breakdown as A
from claimscope.operators import filters as Fl
from claimscope.operators import forecast as M
from claimscope.operators import fraud as R
from claimscope.operators import ml
from claimscope.operators import stats as P
from claimscope.operators import temporal as W
from claimscope.plans.registry import nulled


def test_member_month_rule_counts_lines_without_diagnosis(spark):
    rows = [(f"l{i}", "c", "m", None, 1, Decimal("10.00"), dt.date(2024, 1, i + 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "line_id string, claim_ce string, claim_me string, icd10_code string, quantity int, amount decimal(12,2), claim_prov_date date")
    got = R.rule_score(df, max_lines=3).collect()
    assert len(got) == 6 and all(r.rule_member_month_lines and not r.rule_member_diagnosis_repeat for r in got)


def test_null_series_and_providers_stay(spark):
    rows = [(b, p, Decimal(a) if a else None, dt.date(2024, m, 1)) for b, p, a, m in [
        ("x", "p1", "5", 1), ("x", "p1", "6", 2), ("x", "p2", "7", 3), (None, "p2", "10", 1), (None, "p2", "40", 2), (None, "p2", "20", 3), ("x", "p3", None, 3)]]
    df = spark.createDataFrame(rows, "benefit string, prov_name string, amount decimal(12,2), claim_prov_date date")
    dense = {(r.benefit, r.month.month): float(r.amount) for r in W.dense_months(df, ["benefit"]).collect()}
    assert dense[(None, 1)] == 10 and dense[(None, 2)] == 40
    for out in (M.forecast(df, ["benefit"]), M.fitted(df, ["benefit"]), M.accuracy(df, ["benefit"]), M.forecast_table(df, ["benefit"]),
                M.next_month(df, ["benefit"]), M.lag_contributions(df, ["benefit"]), M.partial_dependence(df, ["benefit"])):
        assert {r.benefit for r in out.select("benefit").distinct().collect()} == {"x", None}
    rank = {r.prov_name: r["rank"] for r in W.ranked(df).collect()}
    assert rank == {"p2": 1, "p1": 2, "p3": 3}


def test_unknown_is_its_own_class(spark):
    df = spark.createDataFrame([(None, 1), (70, 2), (0, 3)], "age int, k int")
    assert {r.k: r.b for r in df.select("k", P.age_band("age").alias("b")).collect()} == {1: "Unknown", 2: "65+", 3: "0-17"}
    s = spark.createDataFrame([(None,), (0.9,)], "fraud_score double").select(Fl.risk_level().alias("l")).collect()
    assert [r.l for r in s] == ["Unknown", "High"]
    m = spark.createDataFrame([("a", None), ("b", Decimal("1.00"))], "claim_me string, amount decimal(12,2)")
    assert {r.claim_me: r.segment for r in W.member_segments(m).collect()} == {"a": "Unknown", "b": "Low"}


def test_text_defaults_and_rounding(spark):
    one = spark.range(1)
    got = one.select(X.default_text(F.lit("0")).alias("text0"), X.default_text(F.lit(0)).alias("int0"),
                     X.default_text(F.lit(Decimal("0.00"))).alias("dec0"), X.default_text(F.lit(0.0)).alias("dbl0"),
                     X.default_text(F.lit("")).alias("blank"), X.default_text(F.lit(7)).alias("seven"),
                     X.number_text(F.lit(2.5), 0).alias("half"), X.key_title(F.lit("fraud_pie")).alias("t1"),
                     X.key_title(F.lit("other_key")).alias("t2")).first()
    assert (got.text0, got.int0, got.dec0, got.dbl0, got.blank, got.seven) == ("0", "N/A", "N/A", "N/A", "N/A", "7")
    assert (got.half, got.t1, got.t2) == ("3", "Fraud Risk Distribution", "Other Key")


def test_wide_form_loses_no_service(claims):
    c = claims.withColumn("service_code", F.when(F.col("quantity") == 3, F.lit("NEW-1")).otherwise(F.col("service_code")))
    long, wide = A.diagnosis_treatment(c), A.diagnosis_treatment(c, wide=True)
    total = sum(sum(v for k, v in r.asDict().items() if k != "icd10_code") for r in wide.collect())
    assert total == long.agg(F.sum("line_count")).first()[0] == c.count() and "NEW-1" in wide.columns


@pytest.fixture(scope="module")
def models(claims):
    from pyspark.ml.classification import LogisticRegression
    return ml.fit_models(nulled(claims), models={"lr": LogisticRegression(labelCol="label", maxIter=3)})


def test_every_line_is_scored(claims, models):
    c = nulled(claims)
    fitted, test = models
    assert ml.predict_claims(fitted["lr"], c).count() == c.count()
    assert ml.kmeans_distance(c).count() == c.count()
    row = ml.evaluate(fitted, test).first()
    assert 0 <= row.accuracy <= 1


def test_split_is_by_key(claims):
    a, b = ml.split(claims.select("line_id", "amount"))
    c, d = ml.split(claims.select("line_id", "amount").repartition(7))
    assert a.count() + b.count() == claims.count()
    assert {r.line_id for r in b.collect()} == {r.line_id for r in d.collect()}
    assert 0.25 < b.count() / claims.count() < 0.35
