"""Versioned Parquet tables: each state is a folder of its own, and readers take the newest complete one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="spark-marquee-"))
    return made


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: it is computed once, and lost executors cost a few tasks."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """States of one table under ``root``. One writer at a time; a half-written state has no _SUCCESS and is never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(p.getName()[1:]) for p in names if self._fs.exists(self._path(f"{p.toString()}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(f"{self.root}/v{known[-1] if version is None else version}") if known else None

    def write(self, state: DataFrame) -> int:
        """Commit a state, which may be computed from the version before."""
        version = (self.versions() or [0])[-1] + 1
        state.write.parquet(f"{self.root}/v{version}")
        return version


class TableSet:
    """Several tables that change together: one version holds a state of each, and one marker makes all of them visible.

    A version is the number of the batch that made it. A batch that failed half-way left folders without a marker, which
    the next attempt replaces; a batch that is tried again after its marker was set changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(p.getName()[1:]) for p in names if self._fs.exists(self._path(f"{p.toString()}/_COMMITTED")))

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The newest state of a table, or the newest one before a version."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v{known[-1]}/{name}") if known else None

    def commit(self, version: int, states: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]]) -> bool:
        """Write the states in turn, each of which may read those written before it, then show all; False if the version is there."""
        if version in self.versions():
            return False
        read = lambda name: self.spark.read.parquet(f"{self.root}/v{version}/{name}")
        for name, state in states.items():
            state(read).write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        self._fs.create(self._path(f"{self.root}/v{version}/_COMMITTED"), False).close()
        return True
