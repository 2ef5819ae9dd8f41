"""Helpers shared by the operators: tables, scratch tables, components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path Spark can open)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of a local session.  On
    a cluster the user ships it as usual (``--py-files`` or PYTHONPATH)."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and "cluster" not in sc.master and sc.applicationId not in _SHIPPED:
        sc.addFile(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), recursive=True)
        _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the
    lineage, so a lost executor rereads files instead of recomputing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast hint behind a size check: ``rows`` is the counted size;
    above ``limit`` the plain join (sort-merge, AQE skew split) is used."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (longs).

    Returns ``(node, component)`` with the smallest node of each component;
    a node without a row is its own component.  Alternates
    large-star and small-star steps: every step is an aggregate (minimum per
    node, map-side combined) and one join on the node.  The links of one node
    meet in a task there: the smallest node of a component ends with one for
    each member.  Each round is written to the shared folder; it stops when
    a round changes nothing, after O(log^2) rounds at most.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    cur = written(edges.where("a <> b").select(hi, lo).distinct(), "cc")
    seen = _mark(cur)
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        step = (pairs.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                .select("e.u", "e.v").where("u <> v").distinct())
        cur = written(step, "cc")
        mark = _mark(cur)
        if mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark


def _mark(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge table (count, two hash sums)."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first()
    return tuple(r)
