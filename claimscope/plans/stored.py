"""Derived tables written once and read by every later query.

The dashboard imports its claims once and scores them once per run, then
answers every page from the stored result.  ``stored`` does the same: the
first caller builds the DataFrame and writes it as parquet below the shared
folder (``spark.checkpoint.dir``); later callers read it, those of later
applications too, as long as the source files and the building code are the
same (see :mod:`claimscope.plans.versions`).  The write also cuts the lineage,
so a lost executor re-reads files instead of recomputing joins.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.util
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from claimscope.plans.versions import kept, source_state
from claimscope.session import freed_shuffles, scratch_path, shared_root

_TABLES: dict[tuple[str, str], tuple[SparkSession, DataFrame]] = {}
_LOCK = threading.RLock()  # builders may call stored() for their inputs


def data_key(path: str) -> str:
    """A stable key for a data location: URIs as given, local paths made
    absolute."""
    import os
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet below the shared checkpoint folder and read it
    back: columns and statistics are kept, the lineage ends there."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MAKERS = ("definitions", "operators.filters", "operators.fraud", "operators.linear", "operators.lookup", "operators.ml", "operators.sketches", "operators.stats",
           "plans.distributed", "plans.packed", "plans.registry", "sources.csv_import", "sources.tables")


@functools.cache
def _code() -> str:
    """Fingerprint of the modules that decide what a stored table holds."""
    sha = hashlib.sha1()
    for name in _MAKERS:
        spec = importlib.util.find_spec(f"claimscope.{name}")
        sha.update(spec.loader.get_source(spec.name).encode())
    return sha.hexdigest()


def stored(spark: SparkSession, key: str, build: Callable[[], DataFrame],
           write: Callable[[DataFrame, str], object] | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """The table ``key``, written if no application has done so from the same
    files (``sources``) by the same code; a reader is kept per session, so its
    folders are listed once."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        found = _TABLES.get((app, key))
        if found is None or found[0] is not spark:
            root = f"{shared_root(spark)}/tables/{hashlib.sha1(key.encode()).hexdigest()[:16]}"
            made_of = f"{source_state(spark, sources)}|{_code()}" if sources else app
            found = _TABLES[(app, key)] = (spark, kept(spark, root, made_of, build, write))
    return found[1]
