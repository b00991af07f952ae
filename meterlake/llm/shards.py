"""Sharding by size-tiered compaction with atomically committed, versioned manifests.

A store is a folder: ``data/run-*`` holds immutable runs of Parquet shards, ``manifest/v*.json`` lists the runs
of each version. Appending writes a small run and commits a version that adds it. Compaction groups runs
into tiers by size (tier k: up to ``base * ratio^(k + 1)`` bytes); a tier with ``fan_in`` runs or more is merged
into one run of files of about ``target`` bytes, without a shuffle, and a version that swaps them is committed.
A version appears by a rename that fails if the name exists, so readers see whole versions and of two writers
one must retry. That rename is one step on HDFS; on local disks and object stores, which check first and then rename,
two writers of one store must take turns. A job that dies leaves only unlisted files; vacuum() removes those older than a
given age, so that it takes none that another writer is about to list.

Defined results: all rows are kept as they are, null or repeated keys, texts and extra columns included;
appending an empty table commits nothing; compacting with too few runs changes nothing; a store without a
version reads as None, has no placements, and vacuum() leaves it as it is.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_tools import file_system

TARGET = 128 << 20
BASE, RATIO, FAN_IN = 1 << 20, 4, 4


@dataclass(frozen=True)
class Run:
    name: str
    tier: int
    bytes: int
    files: int


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, base: int = BASE, ratio: int = RATIO, fan_in: int = FAN_IN):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.base, self.ratio, self.fan_in = target, base, ratio, fan_in

    def _at(self, name: str):
        return file_system(self.spark, f"{self.path}/{name}")

    def version(self) -> int:
        fs, at = self._at("manifest")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        fs, at = self._at(f"manifest/v{version:08d}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], version: int) -> int:
        """Make ``version`` consist of ``runs``; Conflict if it exists."""
        jvm = self.spark.sparkContext._jvm
        fs, temporary = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        _, final = self._at(f"manifest/v{version:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, final, none)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(version) from e
            raise
        return version

    def _measure(self, name: str) -> Run:
        fs, at = self._at(f"data/{name}")
        sizes = [s.getLen() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")]
        return Run(name, self.tier(sum(sizes)), sum(sizes), len(sizes))

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.base, self.ratio))) if size > self.base else 0

    def append(self, df: DataFrame) -> int:
        """Write ``df`` as one run of shards, one per task, and commit it."""
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{name}")
        # Tasks without rows may leave files all the same.
        return self.version() if self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{name}").isEmpty() else self._add([name])

    def append_arrivals(self, df: DataFrame, arrival_col: str) -> int:
        """Write arrivals that come together in one pass; each value of ``arrival_col`` is a run and a version."""
        stem = f"run-{uuid.uuid4().hex}"
        df.write.partitionBy(arrival_col).parquet(f"{self.path}/data/{stem}")
        fs, at = self._at(f"data/{stem}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        return self._add([f"{stem}/{n}" for n in names])

    def _add(self, names: list[str]) -> int:
        version = self.version()
        for name in names:
            run = self._measure(name)
            while run.files and run.bytes:
                try:
                    version = self.commit([*self.runs(version), run], version + 1)
                    break
                except Conflict:
                    version = self.version()
        return version

    def compact(self) -> int:
        """Merge tiers until none has ``fan_in`` runs; returns the version."""
        while True:
            version = self.version()
            runs = self.runs(version)
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                if r.bytes < self.target * r.files or r.files > 1:
                    tiers.setdefault(r.tier, []).append(r)
            ready = [k for k in sorted(tiers) if len(tiers[k]) >= self.fan_in]
            if not ready:
                return version
            merged = tiers[ready[0]]
            total = sum(r.bytes for r in merged)
            name = f"run-{uuid.uuid4().hex}"
            self._read(merged).coalesce(max(1, math.ceil(total / self.target))).write.parquet(f"{self.path}/data/{name}")
            kept = [r for r in runs if r not in merged]
            try:
                self.commit([*kept, self._measure(name)], version + 1)
            except Conflict:
                continue

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{r.name}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame | None:
        runs = self.runs(version)
        return self._read(runs) if runs else None

    def vacuum(self, age_s: float = 86_400) -> None:
        """Remove runs and manifests of that age or more, but for those of the latest version."""
        version = self.version()
        if not version:
            return
        oldest = (time.time() - age_s) * 1000
        live = {r.name for r in self.runs(version)}
        fs, at = self._at("data")
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name in live or s.getModificationTime() > oldest:
                continue
            inner = [x for x in live if x.startswith(name + "/")]
            if not inner:
                fs.delete(s.getPath(), True)
            else:
                for t in fs.listStatus(s.getPath()):
                    if t.isDirectory() and f"{name}/{t.getPath().getName()}" not in live:
                        fs.delete(t.getPath(), True)
        fs, at = self._at("manifest")
        for s in fs.listStatus(at):
            if s.getPath().getName() != f"v{version:08d}.json" and s.getModificationTime() <= oldest:
                fs.delete(s.getPath(), False)


def placements(store: ShardStore, id_col: str, id_type: str = "long") -> DataFrame:
    """(id, run, shard, tier, version) of every row in the store's latest version; ``id_type`` is for a store without one."""
    version = store.version()
    runs = store.runs(version)
    if not runs:
        return store.spark.createDataFrame([], f"{id_col} {id_type}, run string, shard string, tier int, version int")
    tiers = store.spark.createDataFrame([(r.name, r.tier) for r in runs], "run string, tier int")
    file = F.col("_metadata.file_path")
    rows = store.read(version).select(F.col(id_col), F.regexp_extract(file, r"/data/(.*)/part-[^/]*$", 1).alias("run"), F.regexp_extract(file, r"/(part-\d+)[^/]*$", 1).alias("shard"))
    # A store has few runs: fan_in a tier, and tiers grow with the logarithm of its size.
    return rows.join(F.broadcast(tiers), "run").withColumn("version", F.lit(version))
