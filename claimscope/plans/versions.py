"""Tables that outlive an application: versioned folders on shared storage.

A version is a data folder that is written completely before a numbered
commit names it.  A reader takes the highest commit, so during a replace it
sees the whole old version, and a writer that dies leaves none.  The commit is
a file created under its number only if nobody else has: of two writers one
wins the number, the other takes the next.  Old versions stay readable until
``vacuum``.  Works on any file system that Spark opens.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from claimscope.session import freed_shuffles


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def source_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Fingerprint of input files: names, lengths, times of change."""
    sha = hashlib.sha1()
    for path in paths:
        fs, p = _fs(spark, path)
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        sha.update(repr(sorted(found)).encode())
    return sha.hexdigest()


class VersionedTable:
    """One table below ``root``: ``data-*`` folders and ``commits``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getLen() > 0 and s.getPath().getName().isdigit())

    def commit(self, number: int | None = None) -> dict | None:
        """What a commit names (the newest, unless a number is given)."""
        numbers = self.commits()
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.root}/commits/{(numbers[-1] if number is None else number):020d}", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, number: int | None = None) -> DataFrame | None:
        found = self.commit(number)
        if found is None:
            return None
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.root}/{found['data']}")

    def replace(self, df: DataFrame, source: str, write: Callable[[DataFrame, str], object] | None = None) -> int:
        """Write a new version of ``df``, then commit it; returns its number.
        ``source`` says what it was made of."""
        data = f"data-{uuid.uuid4().hex}"
        path = f"{self.root}/{data}"
        with freed_shuffles(self.spark):
            if write is None:
                df.write.parquet(path)
            else:
                write(df, path)
        schema = json.loads(self.spark.read.parquet(path).schema.json())
        text = json.dumps({"data": data, "source": source, "schema": schema})
        number = (self.commits() or [0])[-1] + 1
        while not self._create(number, text):
            number += 1
        return number

    def _create(self, number: int, text: str) -> bool:
        fs, p = _fs(self.spark, f"{self.root}/commits/{number:020d}")
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)  # False: fails where the file exists
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` versions; folders that no commit
        names (a write under way) are left alone."""
        for number in self.commits()[:-keep]:
            old = self.commit(number)
            for path, folder in ((f"commits/{number:020d}", False), (old["data"], True)):
                fs, p = _fs(self.spark, f"{self.root}/{path}")
                fs.delete(p, folder)


def kept(spark: SparkSession, root: str, source: str, build: Callable[[], DataFrame],
         write: Callable[[DataFrame, str], object] | None = None) -> DataFrame:
    """The table below ``root``, written only if its newest version was made
    of something else than ``source``."""
    table = VersionedTable(spark, root)
    newest = table.commit()
    if newest is None or newest["source"] != source:
        table.replace(build(), source, write)
        table.vacuum()
    return table.read()
