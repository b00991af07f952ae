"""Scratch tables, size-checked restrictions, merged count tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a list of keys may be broadcast (16 bytes each, so 16 MB); longer lists are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
BLOCK = 1 << 20


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to 4 MB in this session, unless fewer bytes are set: texts can be long."""
    at = str(spark.conf.get(BATCH_BYTES)).lower().rstrip("b")
    if not at.isdigit() or int(at) > 4 << 20:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine a folder of our own where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.held: dict[str, DataFrame] = {}
        bound_batches(spark)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.held[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        for df in tables:
            fs, at = file_system(self.spark, df.scratch_path)
            fs.delete(at, True)
            self.held.pop(df.scratch_path, None)

    def drop_all(self, *but: DataFrame) -> None:
        """Delete all tables of this run but those that its result reads."""
        kept = {df.scratch_path for df in but}
        self.drop(*(df for path, df in list(self.held.items()) if path not in kept))


def restrict(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in the written table ``keys``; broadcast only up to BROADCAST_KEYS keys."""
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``keys`` (one column, written); null stays."""
    small = keys.count() <= BROADCAST_KEYS
    key = keys.select(F.col(keys.columns[0]).alias("__gone"))
    return df.join(F.broadcast(key) if small else key, df[column] == F.col("__gone"), "left_anti")


def merge_tables(rows: DataFrame, dtype: str, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], wide: str = "") -> np.ndarray:
    """Merge fixed-size tables that tasks emit as (block int, packed data binary) rows into one array.

    Blocks merge on the executors, as numbers of type ``wide`` where given; the driver gets one table of the fixed size.
    """
    wide = wide or dtype
    schema = "block int, data binary"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                own = np.frombuffer(zlib.decompress(data.as_buffer()), dtype).astype(wide)
                held[block] = merge(held[block], own) if block in held else own
        if held:
            keys = sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(held[k].tobytes(), 1) for k in keys], pa.binary())], names=["block", "data"])

    n = max(1, min(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = rows.repartition(n, "block").mapInArrow(step, schema)
    parts = [np.frombuffer(zlib.decompress(r["data"]), wide) for r in merged.sort("block").collect()]
    return np.concatenate(parts) if parts else np.zeros(0, wide)


def emit_table(table: np.ndarray) -> pa.RecordBatch:
    """A table as rows for merge_tables."""
    step = BLOCK // table.itemsize
    parts = [zlib.compress(table[i : i + step].tobytes(), 1) for i in range(0, len(table), step)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "data"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) by alternating large-star and small-star.

    Returns (id, component_id) for every id that has an edge; component_id is the smallest id
    of the component. Each round's edges are written; convergence is tested on one row of sums.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        kept = down.join(least, "a")
        return kept.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = mark(at)
    for _ in range(rounds):
        new = scratch.table(small(large(at)))
        scratch.drop(at)
        at, now = new, mark(new)
        if now == before:
            roots = at.select(F.col("b").alias("id")).distinct()
            return at.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots.select("id", F.col("id").alias("component_id")))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def bucket_of(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
