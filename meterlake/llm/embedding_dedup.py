"""Embedding near-duplicates by an exact metric range join.

Vectors of one label and length are points under the angle, a metric. Pivots, a bounded sample, partition
them: each vector's home is the nearest pivot's cell. A pair within the range angle r whose homes are p and
q is met in cell p if its other end v obeys, by the triangle inequality, ``angle(v, p) <= angle(v, q) + 2 r``
and ``angle(v, p) <= radius(p) + r``, radius(p) being that of p's home members. So v is replicated to those
cells of lower number as a guest; every pair is met in one cell.

Cells join independently: home members against each other and against guests, in pairs of blocks of
about ``BLOCK`` vectors, with exact cosines in double precision. A pair of blocks returns link counts per
vector and a spanning forest of its links, never the pairs. Equal vectors of one label collapse to one
weighted member first, so a hot vector costs one row.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (n_links 0, own component); so do vectors whose label is null; vectors of different lengths never
link; of rows with one id, the largest by label and vector counts; null ids are left out; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import Scratch, components

#: Pivots in all, at most about this many; with 64 dimensions they take 2 MB.
PIVOTS = 4096
PER_CELL = 512
BLOCK = 1024
#: Slack for rounding, in radians: replication misses no pair by it.
SLACK = 1e-6
MEMBER = "group string, rep long, weight long, v array<double>, cell int, angle double"


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((top > 1e100) | (top < 1e-100), x / top, x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def assign(pivots: dict[str, np.ndarray]):
    """Home cell of each member and its angle there; groups without pivots are one cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame = frame.assign(cell=np.int32(0), angle=0.0)
            for group, rows in frame.groupby("group").indices.items():
                if group in pivots:
                    angles = _angles(_unit(_matrix(frame["v"].iloc[rows])), pivots[group])
                    frame.iloc[rows, frame.columns.get_loc("cell")] = angles.argmin(axis=1).astype("int32")
                    frame.iloc[rows, frame.columns.get_loc("angle")] = angles.min(axis=1)
            yield frame

    return run


def guests(pivots: dict[str, np.ndarray], radius: dict[str, np.ndarray], reach: float):
    """The members again, as guests of the cells of lower number that they may link into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for group, part in frame.groupby("group"):
                if group in pivots:
                    angles = _angles(_unit(_matrix(part["v"])), pivots[group])
                    limit = np.minimum(part["angle"].to_numpy()[:, None] + 2 * reach, radius[group][None] + reach) + SLACK
                    row, cell = np.nonzero((angles <= limit) & (np.arange(angles.shape[1])[None] < part["cell"].to_numpy()[:, None]))
                    for lo in range(0, len(row), 20_000):
                        yield part.iloc[row[lo : lo + 20_000]].assign(cell=cell[lo : lo + 20_000].astype("int32"))

    return run


def join_blocks(least: float):
    """Links of one pair of blocks: (a, null, links found) per vector, (a, b, 0) for forest edges."""

    def run(table: pa.Table) -> pa.Table:
        rep, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
        own, guest = table["own"].to_numpy(), table["guest"].to_numpy(zero_copy_only=False)
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        unit = _unit(x)
        i, g = table["i"][0].as_py(), table["g"][0].as_py()
        left = np.flatnonzero(~guest & (own == i))
        right = np.flatnonzero(guest) if g >= 0 else np.flatnonzero(~guest & (own == -1 - g))
        same = g == -1 - i
        links, root, edges = np.zeros(len(rep), np.int64), np.arange(len(rep)).tolist(), []

        def find(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            hit = unit[part] @ unit[right].T >= least
            if same:
                hit &= np.arange(lo, lo + len(part))[:, None] < np.arange(len(right))[None]
            a, b = np.nonzero(hit)
            a, b = part[a], right[b]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[p] = q
                    edges.append((int(rep[p]), int(rep[q])))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(rep[some].tolist() + [e[0] for e in edges], pa.int64()),
                "b": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
                "n": pa.array(links[some].tolist() + [0] * len(edges), pa.int64()),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", least: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) per vector; links are pairs of one label with cosine >= least."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    rows = scratch.table(rows.groupBy("id").agg(F.max(F.struct("label", "v")).alias("x")).select("id", "x.*"))
    good = rows.where(
        "label is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or x = double('inf') or x = double('-inf')) and exists(v, x -> x != 0)"
    ).withColumn("group", F.concat_ws(":", F.size("v").cast("string"), "label"))
    classes = scratch.table(good.groupBy("group", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))

    total = classes.count()
    large = [(r["group"], r["n"]) for r in classes.groupBy("group").agg(F.count("*").alias("n")).where((F.col("n") > PER_CELL) & (F.col("n") * PIVOTS >= 2 * total)).collect()]
    pivots: dict[str, np.ndarray] = {}
    if large:
        wanted = spark.createDataFrame([(g, min(1.0, min(math.ceil(n / PER_CELL), PIVOTS * n // total) / n)) for g, n in large], "group string, share double")
        drawn = classes.join(F.broadcast(wanted), "group").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        for group, part in drawn.select("group", "rep", "v").orderBy("group", "rep").toPandas().groupby("group"):
            pivots[group] = _unit(_matrix(part["v"]))
    homes = scratch.table(classes.select("group", "rep", "weight", "v").mapInPandas(assign(pivots), MEMBER))
    radius = {g: np.full(len(p), -math.pi) for g, p in pivots.items()}
    for group, cell, far in homes.where(F.col("group").isin(list(pivots))).groupBy("group", "cell").agg(F.max("angle")).collect():
        radius[group][cell] = far
    visiting = homes.mapInPandas(guests(pivots, radius, math.acos(least)), MEMBER)
    members = scratch.table(homes.withColumn("guest", F.lit(False)).union(visiting.withColumn("guest", F.lit(True))))

    blocks = lambda guest: F.ceil(F.sum(F.when(F.col("guest") == guest, 1).otherwise(0)) / BLOCK).cast("int")
    sizes = members.groupBy("group", "cell").agg(blocks(False).alias("homes"), blocks(True).alias("visits"), F.count("*").alias("n")).where("n > 1")
    units = (
        members.join(sizes, ["group", "cell"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("visits")).otherwise(F.col("homes"))).cast("int"))
        .withColumn(
            "unit",
            F.explode(
                F.expr(
                    "if(guest, transform(sequence(0, homes - 1), k -> named_struct('i', k, 'g', own)), concat("
                    "transform(sequence(0, homes - 1), k -> named_struct('i', least(own, k), 'g', -1 - greatest(own, k))),"
                    "if(visits > 0, transform(sequence(0, greatest(visits, 1) - 1), k -> named_struct('i', own, 'g', k)), array())))"
                )
            ),
        )
        .select("group", "cell", "unit.i", "unit.g", "rep", "weight", "own", "guest", "v")
    )
    found = scratch.table(units.groupBy("group", "cell", "i", "g").applyInArrow(join_blocks(least), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    placed = components(found.where("b is not null").select("a", "b"), scratch)
    classes = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(placed.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = classes.select("group", "v", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = good.select("id", "group", "v").join(of_class, ["group", "v"]).select("id", "n_links", "component_id")
    out = rows.select("id").join(linked, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
