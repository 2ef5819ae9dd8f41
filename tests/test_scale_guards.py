"""Scale guards on the optimized logical plans of the
registered claims queries: no Python UDF, and no window without
``partitionBy`` (one task) but over rows that the calendar or the value
buckets bound."""

import pytest

from claimscope.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

SKIP = ("l0", "m12", "m13", "m02_pooled", "st_", "s01")
PASS_THROUGH = {"Project", "Filter", "Sort", "Window", "SubqueryAlias", "Repartition",
                "RepartitionByExpression", "Generate", "Expand", "Join", "Union",
                "LocalLimit", "GlobalLimit", "Offset", "ResolvedHint", "Deduplicate"}


def _children(node):
    ch = node.children()
    return [ch.apply(i) for i in range(ch.size())]


# Grouping keys whose number of values does not grow with the data.
BOUNDED = {"period", "month", "__r_month", "__b", "__c"}


def _reaches_scan(node):
    """True when a path from ``node`` reaches a file scan without passing a
    grouping on bounded keys first."""
    name = node.nodeName()
    if name == "Aggregate":
        outs = node.output()
        groups = node.groupingExpressions()
        names = {groups.apply(i).toString().split("#")[0].strip("'") for i in range(groups.size())}
        shown = {outs.apply(i).name() for i in range(outs.size())}
        if groups.isEmpty() or names <= BOUNDED or (not names <= shown and shown & BOUNDED):
            return False
        return True
    if name in ("LogicalRelation", "Relation"):
        return True
    if name not in PASS_THROUGH:
        return False
    return any(_reaches_scan(c) for c in _children(node))


def _bad_windows(node, out):
    if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
        if any(_reaches_scan(c) for c in _children(node)):
            out.append(node.toString()[:200])
    for c in _children(node):
        _bad_windows(c, out)
    return out


NAMES = sorted(n for n in REGISTRY if not n.startswith(SKIP))


@pytest.mark.parametrize("name", NAMES)
def test_no_global_window_over_raw_rows(spark, name):
    df = REGISTRY[name](spark, SF_SMALL)
    qe = df._jdf.queryExecution()
    assert _bad_windows(qe.optimizedPlan(), []) == []
    assert "PythonUDF" not in qe.optimizedPlan().toString()


def test_guard_catches_a_global_window_over_the_scan(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from claimscope.sources.tables import table
    bad = table(spark, SF_SMALL, "lineitem").withColumn(
        "c", F.sum("l_quantity").over(Window.orderBy("l_orderkey")))
    assert _bad_windows(bad._jdf.queryExecution().optimizedPlan(), [])


def test_guard_catches_a_global_window_over_an_unbounded_grouping(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from claimscope.sources.tables import table
    bad = table(spark, SF_SMALL, "lineitem").groupBy("l_orderkey").count().withColumn(
        "c", F.sum("count").over(Window.orderBy("l_orderkey")))
    assert _bad_windows(bad._jdf.queryExecution().optimizedPlan(), [])


DATED = ["f01_period_12m", "f02_calendar_year", "f03_last_90_days", "f04_date_range", "f08_custom_filter", "r21_potential_cases", "a26_period_breakdown", "flagship_monthly_by_benefit_12m"]


@pytest.mark.parametrize("name", DATED)
def test_date_filters_skip_month_folders(spark, name):
    plan = REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(claim_month" in plan and "PushedFilters: [" in plan


def test_efficiency_reads_the_lines_once(spark):
    df = REGISTRY["a23_provider_efficiency"](spark, SF_SMALL)
    assert all("/a23-providers-" in f for f in df.inputFiles())  # the claims were read when it was written
