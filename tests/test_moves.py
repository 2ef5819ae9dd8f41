"""What the stores move and write (bytes of shuffles and files at scale)."""

import itertools
import os
import re

from pyspark.sql import functions as F

from claimscope.operators import fraud
from claimscope.operators.clean import distinct_rows
from claimscope.plans.registry import REGISTRY, scored
from claimscope.session import scratch_path
from claimscope.sources import tables as T
from claimscope.sources.csv_import import export_source_csv, import_claims
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _lines(spark):
    """300 lines with null keys, a busy member and repeated lines."""
    n = F.col("id")
    df = spark.range(300).select(
        F.concat(F.lit("text of line "), n).alias("payload"),
        F.when(n % 17 != 0, (n % 90).cast("string")).alias("claim_ce"), F.when(n % 13 != 0, F.when(n % 3 == 0, "hot").otherwise((n % 40).cast("string"))).alias("claim_me"),
        F.when(n % 11 != 0, F.concat(F.lit("D"), n % 7)).alias("icd10_code"), F.when(n % 19 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 70).cast("int"))).alias("claim_prov_date"),
        F.when(n % 23 != 0, (n * n % 997).cast("decimal(12,2)")).alias("amount"), (n % 50).cast("int").alias("quantity"))
    return df.union(df.where("payload like '%7'"))


def test_lines_move_once_to_be_scored(spark):
    out = fraud.rule_score(_lines(spark), max_lines=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    start = plan[plan.index("AdaptiveSparkPlan"):]
    # a join or a grouping by a key of the lines would be an exchange above the one that deals them
    dealt = [x for x in start.splitlines() if "Exchange hashpartitioning(__mon" in x and "__piece" in x]
    assert len(dealt) == 1
    above = start[:start.index(dealt[0])]
    keys = re.findall(r"Exchange hashpartitioning\(([a-z_0-9]+)#", above)
    assert set(keys) <= {"icd10_code"}  # the means of the diagnoses, which AQE broadcasts
    # the lines' own columns are in the dealt rows alone
    assert out.columns[:7] == _lines(spark).columns


def test_scores_equal_plain_counting(spark):
    df = _lines(spark)
    got = fraud.rule_score(df, max_lines=3)
    assert got.count() == df.count()
    rows = [r.asDict() for r in df.collect()]
    month = lambda r: r["claim_prov_date"] and r["claim_prov_date"].strftime("%Y-%m")
    def count(f):
        found = {}
        for r in rows:
            found[f(r)] = found.get(f(r), 0) + 1
        return found
    mdm, mm = count(lambda r: (r["claim_me"], r["icd10_code"], month(r))), count(lambda r: (r["claim_me"], month(r)))
    total = {}
    for r in rows:
        total.setdefault(r["claim_ce"], []).append(r["amount"])
    sums = {k: float(sum(x for x in v if x is not None)) for k, v in total.items() if any(x is not None for x in v)}
    ordered = sorted(sums.values())
    at = lambda p: (lambda i: ordered[int(i)] + (ordered[min(int(i) + 1, len(ordered) - 1)] - ordered[int(i)]) * (i - int(i)))(p * (len(ordered) - 1))
    fence = at(0.75) + 1.5 * (at(0.75) - at(0.25))
    want = sorted(str((r["payload"], r["claim_ce"] is not None and sums.get(r["claim_ce"], 0) > fence,
                       None not in (r["claim_me"], r["icd10_code"], month(r)) and mdm[r["claim_me"], r["icd10_code"], month(r)] > 1,
                       None not in (r["claim_me"], month(r)) and mm[r["claim_me"], month(r)] > 3)) for r in rows)
    rules = got.select("payload", "rule_claim_total_outlier", "rule_member_diagnosis_repeat", "rule_member_month_lines").collect()
    assert sorted(str(tuple(r)) for r in rules) == want


def test_stored_lines_hold_no_text_that_follows_from_a_key(spark):
    stored = T.stored_lines(spark, SF_SMALL)
    assert sorted(stored.columns) == sorted([*T.LINE_COLUMNS, "claim_month"])
    assert _rows(T.claims_table(spark, SF_SMALL)) == _rows(T.claims_view(spark, SF_SMALL))
    assert all(f.endswith(".zstd.parquet") for f in stored.inputFiles())
    assert all(f.endswith(".zstd.parquet") for f in scored(spark, SF_SMALL).inputFiles())


def test_compressed_source_files_come_back(spark):
    c = T.claims_table(spark, SF_SMALL)
    path = export_source_csv(c, scratch_path(spark, "packed-csv"), compression="gzip")
    assert {f.rsplit(".", 1)[1] for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")} == {"gz"}
    plain = export_source_csv(c, scratch_path(spark, "plain-csv"))
    assert _rows(import_claims(spark, path)[0]) == _rows(import_claims(spark, plain)[0])
    assert REGISTRY["c03_accepted"](spark, SF_SMALL).agg(F.sum("lines")).first()[0] > 0


def test_wide_rows_that_come_once_stay_in_place(spark):
    df = _lines(spark).withColumn("rate", F.when(F.col("quantity") % 5 != 0, F.col("quantity") / F.col("quantity") * F.lit(float("nan"))).otherwise(F.lit(-0.0)))
    df = df.union(df.where("quantity = 10").withColumn("rate", F.lit(0.0)))
    out = distinct_rows(df)
    assert _rows(out) == _rows(df.dropDuplicates()) and out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    alone = plan[:plan.index("HashAggregate")]  # the rows that are compared come after
    assert "LeftAnti" in alone and "Exchange hashpartitioning" not in alone
    assert distinct_rows(df.limit(0)).count() == 0


def test_all_rows_repeated(spark):
    df = _lines(spark)
    many = df.union(df).union(df)
    assert _rows(distinct_rows(many)) == _rows(df.dropDuplicates())


def test_hot_and_other_members_are_counted(spark):
    """One member with a third of the lines, others with few, null keys."""
    n = F.col("id")
    df = spark.range(12000).select(
        n.alias("payload"), (n % 3100).cast("string").alias("claim_ce"), F.when(n % 13 != 0, F.when(n % 3 == 0, "hot").otherwise((n % 611).cast("string"))).alias("claim_me"),
        F.when(n % 11 != 0, F.concat(F.lit("D"), n * n % 7)).alias("icd10_code"), F.when(n % 19 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n * 7 % 160).cast("int"))).alias("claim_prov_date"),
        (n * n % 997).cast("decimal(12,2)").alias("amount"), (n % 50).cast("int").alias("quantity"))
    base = df.withColumn("__mon", F.date_trunc("month", "claim_prov_date").cast("date"))
    heavy = {r[0] for r in fraud._heavy(base.where("claim_me is not null and __mon is not null")).collect()}
    buckets = {r["b"]: r["me"] for r in base.groupBy(fraud._bucket().alias("b")).agg(F.collect_set("claim_me").alias("me")).collect()}
    assert heavy and all("hot" in buckets[b] for b in heavy) and len(heavy) < 12
    plain = base.selectExpr(
        "payload", "claim_me is not null and __mon is not null and icd10_code is not null and count(1) over (partition by claim_me, icd10_code, __mon) > 1 as repeated",
        "claim_me is not null and __mon is not null and count(1) over (partition by claim_me, __mon) > 3 as busy")
    got = fraud.rule_score(df, max_lines=3).select("payload", "rule_member_diagnosis_repeat", "rule_member_month_lines")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert 0 < plain.where("busy and claim_me <> 'hot'").count() < plain.where("claim_me <> 'hot'").count()


def test_claim_totals_move_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the first plan names reused exchanges
    try:
        plan = fraud.rule_score(_lines(spark), max_lines=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"HashAggregate\(keys=\[claim_ce#\d+\], functions=\[partial_sum", plan)) == 1


def test_stored_run_holds_what_the_pages_read(spark):
    from claimscope.plans.registry import scored_lines
    out = scored(spark, SF_SMALL)
    files = spark.read.parquet(out.inputFiles()[0])
    flags = [c for c in out.columns if c.startswith(("rule_", "fraud_"))]
    assert sorted(files.columns) == sorted([*T.SCORED_LINE_COLUMNS, *flags])
    assert set(out.columns) == (set(T.CLAIM_COLUMNS) - T.UNSCORED_CLAIM_COLUMNS) | set(flags)
    whole = T.claim_columns(scored_lines(spark, SF_SMALL), *flags)
    assert _rows(out) == _rows(whole.select(*out.columns))


def test_lines_carry_no_column_of_a_small_side(spark, monkeypatch):
    """Large sides come before the lines grow wide, small ones where they lie
    by month."""
    plan = T.line_keys(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    on = re.findall(r"Join Inner, \((\w+)#", plan)  # the last join is printed first
    assert on[:3] == ["order_key", "supp_key", "part_key"]
    from claimscope.plans import stored as S
    from claimscope.sources import csv_import
    whole, seen = _rows(T.claims_view(spark, SF_SMALL)), []
    monkeypatch.setattr(csv_import, "write_by_month", lambda dealt, path: seen.append(dealt))
    monkeypatch.setattr(S, "stored", lambda spark, key, build, write, sources: write(build(), "unused"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most, small in (("10m", ("part_key", "supp_key", "cust_key")), ("-1", ())):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            assert T.small_sides(spark, SF_SMALL) == small
            T.stored_lines(spark, SF_SMALL)
            plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString().splitlines()
            at = next(i for i, x in enumerate(plan) if "RebalancePartitions" in x)
            depth = plan[at].index("RebalancePartitions")
            moved = "\n".join(itertools.takewhile(lambda x: re.search("[A-Za-z]", x).start() > depth, plan[at + 1:]))
            assert [c in moved for c in ("p_name", "s_name", "c_name")] == [not small] * 3
            assert _rows(T.claim_columns(seen[-1])) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_the_month_is_dealt_as_a_number(spark, monkeypatch):
    from claimscope.sources import csv_import
    seen = []
    monkeypatch.setattr(csv_import, "write_by_month", lambda dealt, path: seen.append(dealt))
    df = _lines(spark)
    csv_import.write_claims(df, "unused")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "claim_month" not in plan[plan.index("RebalancePartitions"):]
    want = df.withColumn("claim_month", F.date_format("claim_prov_date", "yyyy-MM"))
    assert _rows(seen[0]) == _rows(want)


def test_lines_do_not_move_by_diagnosis(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fraud.rule_score(_lines(spark), max_lines=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not re.search(r"SortMergeJoin \[icd10_code", plan) and re.search(r"BroadcastHashJoin \[icd10_code", plan)
