"""Rows packed while they move, and shuffle files freed after a write."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from claimscope.operators import fraud
from claimscope.plans.packed import TEXTS, Packing
from claimscope.plans.stored import cut
from claimscope.plans.versions import VersionedTable
from claimscope.session import freed_shuffles
from claimscope.sources import tables as T
from tests.conftest import SF_SMALL
from tests.test_moves import _lines, _rows


def _odd(spark):
    """Nulls, negative numbers, days before 1970, numbers of 61 and 64 bits."""
    n = F.col("id")
    return spark.range(700).select(
        n.alias("k"), F.when(n % 7 != 0, n * -3).cast("int").alias("a"), F.when(n % 5 != 0, (n * n - 5000) / 100).cast("decimal(12,2)").alias("m"),
        F.when(n % 9 != 0, F.date_add(F.lit("1960-01-01").cast("date"), (n * 9).cast("int"))).alias("d"), F.when(n % 3 != 0, F.concat(F.lit("t"), n % 11)).alias("t"),
        F.concat(F.lit("x"), n).alias("u"), F.when(n % 4 != 0, n % 2 == 0).alias("b"), F.lit(None).cast("int").alias("none"),
        F.when(n == 3, F.lit(-2 ** 63)).otherwise(n).alias("whole"), (n / 3).alias("f"), F.when(n % 2 == 0, F.lit(2 ** 61 - 9)).otherwise(n).alias("wide"))


def test_packed_rows_come_back(spark):
    df, seen = _odd(spark), []
    p = Packing.fit(df, ["t", "u"])
    assert len(df.select("u").distinct().collect()) > TEXTS and sorted(p.fields) == sorted(["k", "a", "m", "d", "t", "b", "none", "wide"])
    rows = p.numbers(df, df.drop("k").columns)

    def move(packed):
        seen.append(packed.columns)
        return packed.repartition(5, "k")

    got = p.through(rows, ["k"], move)
    got = p.values(got.withColumn("k", p.fields["k"].number("k")))
    assert got.dtypes == df.dtypes and _rows(got) == _rows(df)
    assert seen == [["__word0", "__word1", "k", "u", "whole", "f"]]
    empty = Packing.fit(df.limit(0), ["t"])
    assert empty.values(empty.through(empty.numbers(df.limit(0)), [], lambda r: r)).dtypes == df.dtypes


def test_reach_of_a_key_of_two_tables_is_the_wider(spark):
    a, b = spark.range(5, 9).toDF("k"), spark.range(-3, 200).toDF("k")
    both = Packing.fit(a) | Packing.fit(b.withColumn("x", F.col("k") * 2))
    assert (both.fields["k"].low, both.fields["k"].high) == (-3, 199)
    for df in (a, b):
        assert _rows(both.values(both.through(both.numbers(df), [], lambda r: r.repartition(3)))) == _rows(df)
    assert "k" not in (Packing.fit(a) | Packing.fit(b.select(F.col("k").cast("int")))).fields


def test_star_join_of_packed_lines(spark, tmp_path):
    """Keys without a partner, beyond the reach of the other side, null and
    repeated, in every table."""
    def odd(name, key, columns):
        own = T.table(spark, SF_SMALL, name)
        n = own.agg(F.max(key)).first()[0]
        more = own.limit(40)
        far = more.withColumn(key, F.col(key) + n * 3 + 7)
        away = more.withColumn(key, -F.col(key) - 1)
        gaps = more.withColumns({c: F.lit(None).cast(own.schema[c].dataType) for c in columns})
        own.unionByName(far).unionByName(away).unionByName(gaps).unionByName(more.withColumn(key, F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/{name}.parquet")

    odd("lineitem", "l_orderkey", ["l_extendedprice", "l_shipdate", "l_linestatus", "l_returnflag"])
    odd("orders", "o_orderkey", ["o_orderpriority", "o_orderstatus"])
    odd("customer", "c_custkey", ["c_mktsegment", "c_nationkey"])
    odd("part", "p_partkey", ["p_name", "p_size"])
    odd("supplier", "s_suppkey", ["s_name"])
    for name in ("nation", "region"):
        T.table(spark, SF_SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain, carry = T.line_keys(spark, str(tmp_path)), T.line_packing(spark, str(tmp_path))
    assert plain.count() > T.line_keys(spark, SF_SMALL).count()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert _rows(carry.values(T.line_keys(spark, str(tmp_path), (), carry))) == _rows(plain)
        assert _rows(T.claims_table(spark, str(tmp_path))) == _rows(T.claims_view(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_joined_lines_are_moved_in_a_few_columns(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        carry = T.line_packing(spark, SF_SMALL)
        plan = T.line_keys(spark, SF_SMALL, (), carry)._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def joins(node):
        ch = [node.children().apply(i) for i in range(node.children().size())]
        return ([(ch[0].output().size(), ch[1].output().size())] if node.nodeName() == "Join" else []) + [x for c in ch for x in joins(c)]

    # lines (with the texts of their supplier) and orders, then suppliers, parts, customers
    assert sorted(joins(plan), reverse=True)[0] <= (5, 4) and all(a <= 5 and b <= 4 for a, b in joins(plan))


def test_scores_of_packed_lines(spark):
    df = _lines(spark)
    carry = fraud.score_packing(df, ["claim_ce", "claim_me", "icd10_code"])
    assert _rows(fraud.rule_score(df, max_lines=3, carry=carry)) == _rows(fraud.rule_score(df, max_lines=3))


def test_a_write_frees_its_shuffle_files(spark, tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.ui.enabled": "false", "spark.local.dir": "{tmp_path}/local", "spark.checkpoint.dir": "{tmp_path}/kept", "spark.sql.shuffle.partitions": "3"}}).getOrCreate()
from claimscope.plans.stored import cut, stored
files = lambda: sum(f.startswith("shuffle_") for _, _, fs in os.walk("{tmp_path}/local") for f in fs)
rows = lambda: spark.range(1000).repartition(4, "id").groupBy("id").count()
kept = rows()
first, second = cut(rows(), "t"), stored(spark, "x", rows)
assert files() == 0, files()
assert first.count() == second.count() == 1000
assert kept.collect() and files() > 0
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=200)


def test_the_setting_is_put_back(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
    VersionedTable(spark, str(tmp_path / "t")).replace(spark.range(3), "a")
    cut(spark.range(3), "t")
    assert spark.conf.get(name, None) == before
