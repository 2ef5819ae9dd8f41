"""Scalar functions (X1-X15, F12, F13, F16, F17, A25) on literal rows."""

from pyspark.sql import functions as F

from claimscope.functions import scalar as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("r")).first()["r"]


def test_multiply_div_abs(spark):
    assert one(spark, X.multiply(F.lit("2"), F.lit(3.5))) == 7.0
    assert one(spark, X.multiply(F.lit("x"), F.lit(3))) == 0.0
    assert one(spark, X.div(F.lit(7), F.lit(2))) == 3.5
    assert one(spark, X.div(F.lit(7), F.lit(0))) == 0.0
    assert one(spark, X.div(F.lit(7), F.lit(None).cast("double"))) == 0.0
    assert one(spark, X.abs_or_zero(F.lit("-4.5"))) == 4.5
    assert one(spark, X.abs_or_zero(F.lit("bad"))) == 0.0
    assert one(spark, X.abs_or_same(F.lit("bad"))) == "bad"


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.create_map(F.lit("null_count"), F.lit(2)),
                     F.lit("b"), F.create_map(F.lit("x"), F.lit(1)))
    assert one(spark, X.dict_sum(m, "null_count")) == 2.0
    assert one(spark, X.get_item(F.create_map(F.lit("k"), F.lit(1)), "z")) is None
    assert one(spark, X.get_keys(F.create_map(F.lit("k"), F.lit(1)))) == ["k"]
    corr = F.create_map(F.lit("a"), F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.5)),
                        F.lit("b"), F.create_map(F.lit("b"), F.lit(1.0)))
    assert one(spark, X.to_matrix(corr)) == [[1.0, 0.5], [0.0, 1.0]]


def test_membership_and_equality(spark):
    assert one(spark, X.in_list(F.lit("b"), " a, B ,c")) is True
    assert one(spark, X.in_list(F.lit(None).cast("string"), "a")) is False
    assert one(spark, X.isin_text(F.lit(""), "a,")) is False
    assert one(spark, X.equals_text(F.lit(1), F.lit("1"))) is True


def test_text(spark):
    assert one(spark, X.mask_member(F.lit("12345678"))) == "1234****"
    assert one(spark, X.default_text(F.lit(""))) == "N/A"
    assert one(spark, X.default_text(F.lit(0))) == "N/A"
    assert one(spark, X.capfirst(F.lit("hello World"))) == "Hello World"
    assert one(spark, X.key_title(F.lit("avg_fraud_score"))) == "Average Fraud Score"
    assert one(spark, X.key_title(F.lit("total_amount"))) == "Total Amount"
    assert one(spark, X.money_text(F.lit(1234567.5))) == "KES 1,234,567.50"
    assert one(spark, X.amount_from_text(F.lit("KES 1,234.50"))) == 1234.5
    assert one(spark, X.date_text(F.lit("2024-03-05").cast("date"), "F")) == "March"
    assert one(spark, X.zip_lists(F.array(F.lit(1)), F.array(F.lit("a"))))[0][0] == 1
