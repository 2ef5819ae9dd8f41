"""Datasets, columns, exports and report bundles."""

import os

from pyspark.sql import functions as F

from claimscope.operators.fraud import rule_score
from claimscope.sources import catalog as C


def test_list_columns(claims):
    cols = {r["column"]: r["type"] for r in C.list_columns(claims).collect()}
    assert cols["amount"] == "decimal(12,2)" and cols["claim_prov_date"] == "date"


def test_list_datasets(spark, claims):
    claims.limit(5).createOrReplaceTempView("claims_sample")
    names = [r["name"] for r in C.list_datasets(spark).collect()]
    assert "claims_sample" in names
    assert C.dataset(spark, "claims_sample").count() == 5


def test_aliases_fall_back(spark):
    df = spark.createDataFrame([("c1", "p1")], "claim_ce string, prov_name string")
    r = C.resolve_aliases(df).first()
    assert r["claim_id"] == "c1" and r["provider_name"] == "p1" and r["date"] is None


def test_export_csv_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1)], "name string, n int")
    out = C.export_csv(df, str(tmp_path / "x"), single_file=True)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    text = open(os.path.join(out, files[0])).read()
    assert '"a,b"' in text and text.startswith("name,n")


def test_report_bundles(claims, tmp_path):
    scored = rule_score(claims, max_lines=3, amount_factor=1.9)
    for kind in ("forecast", "fraud", "provider", "member"):
        bundle = C.report_bundle(scored, kind, 0.35)
        assert bundle and all(df.columns for df in bundle.values())
    paths = C.write_bundle(C.report_bundle(scored, "provider", 0.35), str(tmp_path / "rep"))
    assert all(os.path.isdir(p) for p in paths)


def test_date_filters_reach_the_scan(spark):
    from claimscope.plans.registry import REGISTRY
    from tests.conftest import SF_SMALL
    plan = REGISTRY["f02_calendar_year"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(claim_prov_date), GreaterThanOrEqual(claim_prov_date" in plan


def test_filter_values_sorted(claims):
    vals = [r["value"] for r in C.filter_values(claims, "benefit").collect()]
    assert vals == sorted(vals) and len(vals) == len(set(vals))
    rng = C.filter_ranges(claims).first()
    assert rng["min_date"] <= rng["max_date"]
    assert claims.where(F.col("amount") < rng["min_amount"]).count() == 0
