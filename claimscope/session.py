"""Session helpers: build a local session for tests/bench, find the shared
checkpoint folder of whatever session we are given."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "claimscope") -> SparkSession:
    """Session for tests and the bench.  On a cluster the caller brings its
    own session; only the settings below that are *unset* would matter."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared (HDFS/S3/...) folder and is used
    as is.  Only when it is unset and the session is local (unit tests) do we create
    a scratch folder; any other master without it is refused.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not _one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="claimscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate
    tables (lineage cuts, exports in tests)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"


def shared_root(spark: SparkSession) -> str:
    """The folder of tables that outlive the application: below the configured
    ``spark.checkpoint.dir`` itself, not the subfolder that Spark makes in it
    for each application."""
    own = ensure_checkpoint_dir(spark).rstrip("/")
    base = spark.conf.get("spark.checkpoint.dir", None) or own.rsplit("/", 1)[0]
    return f"{base.rstrip('/')}/claimscope"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it a table that is written frees the shuffle files of its plan when
    it is whole; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
