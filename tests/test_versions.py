"""Tables that outlive an application."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from claimscope.plans.versions import VersionedTable, kept, source_state
from claimscope.sources.csv_import import write_claims
from tests.conftest import ROOT, SF_SMALL


def ids(df):
    return sorted(r.id for r in df.collect())


def test_written_once_until_the_source_changes(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    root = str(tmp_path / "t")
    assert ids(kept(spark, root, "a", build)) == ids(kept(spark, root, "a", build)) == [0, 1, 2] and len(built) == 1
    kept(spark, root, "b", build)
    assert len(built) == 2 and VersionedTable(spark, root).commits() == [1, 2]


def test_a_reader_during_a_replace_sees_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(3), "a")
    before = t.read()

    def slow(df, path):
        df.write.parquet(path)
        assert ids(t.read()) == [0, 1, 2]  # data written, not committed

    t.replace(spark.range(5), "b", slow)
    assert ids(before) == [0, 1, 2] and ids(t.read()) == [0, 1, 2, 3, 4] and ids(t.read(1)) == [0, 1, 2]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(3), "a")

    def dies(df, path):
        df.write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.replace(spark.range(5), "b", dies)
    assert t.commits() == [1] and ids(t.read()) == [0, 1, 2]


def test_two_writers_take_different_numbers(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))

    def meanwhile(df, path):
        df.write.parquet(path)
        b.replace(spark.range(1), "b")

    def first_number():
        return a.replace(spark.range(2), "a", meanwhile)

    assert first_number() == 2 and a.commits() == [1, 2] and ids(a.read(1)) == [0] and ids(a.read()) == [0, 1]
    assert not a._create(2, "{}")  # a number is taken once


def test_vacuum_keeps_the_newest(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for n in range(4):
        t.replace(spark.range(n + 1), str(n))
    t.vacuum(2)
    assert t.commits() == [3, 4] and ids(t.read()) == [0, 1, 2, 3]
    assert len([f for f in os.listdir(t.root) if f.startswith("data-")]) == 2


def test_source_state_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    state = source_state(spark, [path])
    assert state == source_state(spark, [path])
    spark.range(1).write.mode("append").parquet(path)
    assert state != source_state(spark, [path])


SECOND = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
from claimscope.sources.tables import claims_table
print("ROWS", claims_table(spark, {SF_SMALL!r}).count())
"""


def test_a_second_application_writes_nothing(tmp_path):
    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "claimscope") for f in names}

    seen = []
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", SECOND, str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=ROOT)
        seen.append((out.stdout.split("ROWS")[-1].strip(), files()))
    assert seen[0] == seen[1] and seen[0][0].isdigit() and seen[0][1]


def test_tasks_and_files_grow_with_the_bytes(spark, tmp_path):
    """A month with most lines is written by many tasks, the rest by few."""
    rows = spark.range(40_000).select(F.col("id").alias("line_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"),
                                      F.expr("date_add(date'2024-01-01', if(id % 4 = 0, cast(id % 366 as int), 5))").alias("claim_prov_date"))
    name, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    for size in ("64m", "300k"):
        spark.conf.set(name, size)
        try:
            path = write_claims(rows, str(tmp_path / size))
        finally:
            spark.conf.unset(name)
        count.append({m: len([f for f in os.listdir(os.path.join(path, m)) if f.endswith(".parquet")]) for m in os.listdir(path) if m.startswith("claim_month")})
        assert spark.read.parquet(path).count() == 40_000
    assert max(count[0].values()) == 1 and count[1]["claim_month=2024-01"] > 4 and len(count[1]) == 12
