"""Sharding by size-tiered compaction over a versioned manifest.

Arrivals are written as small immutable shards. As soon as ``FAN_IN`` runs have similar sizes they are merged into one
run of target-sized files. Every change is a new manifest version that becomes visible by one rename which fails if the
version exists, so readers see a whole version and of two writers one has to try again. Files are written before the
manifest names them: a job that dies leaves only files that no manifest names, which ``vacuum`` removes.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of one tier that are merged, how far a run's size may be from its tier's mean, and the size of merged files.
FAN_IN, LOW, HIGH, TARGET_BYTES = 4, 0.5, 1.5, 128 << 20


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class _MergedElsewhere(Exception):
    """Another writer has merged runs of this merge."""


class ShardStore:
    """Shards under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/manifest")) if s.getPath().getName().startswith("v"))

    def runs(self, version: int | None = None) -> list[dict]:
        """Runs of a version, the newest by default: name, path, rows, bytes, in order of arrival."""
        known = self.versions()
        if not known:
            return []
        stream = self._fs.open(self._path(self._file(known[-1] if version is None else version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["runs"]
        finally:
            stream.close()

    def _file(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:010d}.json"

    def commit(self, version: int, runs: list[dict]) -> None:
        """Make ``runs`` the given version, or raise CommitConflict if it exists."""
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "runs": runs}).encode()))
        out.close()
        try:
            self._context.rename(temporary, self._path(self._file(version)), self._spark_array())
        except Exception as error:
            self._fs.delete(temporary, False)
            if self._fs.exists(self._path(self._file(version))):
                raise CommitConflict(f"version {version} exists") from error
            raise

    def _spark_array(self):
        return self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _run(self, name: str, path: str, rows: int) -> dict:
        return {"name": name, "path": path, "rows": rows, "bytes": self._fs.getContentSummary(self._path(path)).getLength()}

    def append(self, arrivals: DataFrame, by: str) -> None:
        """Write ``arrivals`` in one job as one run per value of the integer column ``by``, and commit each in turn."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.partitionBy(by).parquet(folder)
        written = self.spark.read.schema(arrivals.schema).parquet(folder)
        counts = {r[0]: r[1] for r in written.groupBy(by).count().collect()}  # one row per arrival
        for value in sorted(counts):
            run = self._run(f"a{value:04d}", f"{folder}/{by}={value}", counts[value])
            self._change(lambda runs, run=run: [*runs, run])
            self.compact()

    def _change(self, edit) -> None:
        for _ in range(20):
            version = (self.versions() or [0])[-1]
            try:
                return self.commit(version + 1, edit(self.runs(version) if version else []))
            except CommitConflict:
                continue
        raise CommitConflict("too many writers")

    def due(self, runs: list[dict]) -> list[dict] | None:
        """The smallest tier with enough runs: runs whose sizes are between ``LOW`` and ``HIGH`` times their mean."""
        tier: list[dict] = []
        for run in sorted(runs, key=lambda r: (r["bytes"], r["name"])):
            mean = sum(r["bytes"] for r in tier) / len(tier) if tier else run["bytes"]
            if not LOW * mean <= run["bytes"] <= HIGH * mean:
                tier = []
            tier.append(run)
            if len(tier) == FAN_IN:
                return sorted(tier, key=lambda r: r["name"])
        return None

    def compact(self, target_bytes: int = TARGET_BYTES) -> None:
        """Merge tiers until none is due. A merge reads each row once and has one task per target-sized file."""
        while tier := self.due(self.runs()):
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            files = max(1, math.ceil(sum(r["bytes"] for r in tier) / target_bytes))
            first, *rest = (self.spark.read.parquet(r["path"]) for r in tier)
            for more in rest:
                first = first.unionByName(more)
            first.coalesce(files).write.parquet(folder)
            merged = self._run(f"{tier[0]['name'].split('-')[0]}-{tier[-1]['name'].split('-')[-1]}", folder, sum(r["rows"] for r in tier))
            gone = {r["path"] for r in tier}

            def replaced(runs: list[dict], merged=merged, gone=gone) -> list[dict]:
                if not gone <= {r["path"] for r in runs}:
                    raise _MergedElsewhere
                return [*(r for r in runs if r["path"] not in gone), merged]

            try:
                self._change(replaced)
            except _MergedElsewhere:  # another writer was first: its runs count, and this one's files go
                self._fs.delete(self._path(folder), True)

    def read(self, version: int | None = None, run_col: str = "run") -> DataFrame | None:
        """All rows of a version with the name of their run in ``run_col``; None if there are no runs."""
        whole = None
        for run in self.runs(version):
            part = self.spark.read.parquet(run["path"]).withColumn(run_col, F.lit(run["name"]))
            whole = part if whole is None else whole.unionByName(part)
        return whole

    def vacuum(self, keep: int = 1) -> None:
        """Delete data that the newest ``keep`` versions don't name, and older manifests; not while writers are at work."""
        known = self.versions()
        named = {self._path(r["path"]).toUri().getPath() for v in known[-keep:] for r in self.runs(v)}
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            path = folder.getPath()
            parts = [s.getPath() for s in self._fs.listStatus(path) if "=" in s.getPath().getName()]
            for p in parts or [path]:
                if p.toUri().getPath() not in named:
                    self._fs.delete(p, True)
        for v in known[:-keep]:
            self._fs.delete(self._path(self._file(v)), False)


def shard(docs: DataFrame, root: str, arrivals: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Store ``docs`` as arrivals by id modulo ``arrivals``, compacted; every row back from the newest version, with ``run``.

    Null ids arrive first, with 0. All columns are kept under their names; where one is called ``run``, the operator's own
    column is ``_run``, or has as many more underscores as it takes. Null and long texts and repeated rows are stored as
    they are; an empty table gives no runs and an empty result.
    """
    run, arrival = "run", "_arrival"
    while run in docs.columns:
        run = f"_{run}"
    while arrival in docs.columns:
        arrival = f"_{arrival}"
    store = ShardStore(docs.sparkSession, root)
    store.append(docs.withColumn(arrival, F.coalesce(F.pmod(F.col(id_col), F.lit(arrivals)), F.lit(0)).cast("int")), arrival)
    store.vacuum()
    whole = store.read(run_col=run)
    return docs.limit(0).withColumn(run, F.lit("")) if whole is None else whole
