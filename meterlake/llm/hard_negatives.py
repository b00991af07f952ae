"""Hard negatives by shared lists of anchor clusters, walked until termination is certified.

Anchors are clustered by direction. For a cluster with centre c whose members lie within an angle s of it, a
candidate y at angle a from c has an inner product with any member x of at most ``|x| |y| cos(max(0, a - s))``.
So one list of the candidates by ``|y| cos(max(0, a - s))`` serves all members: each walks it from the front, in steps of
``STEP``, and stops where the bound says that nothing behind can enter its result. Scores are exact whole numbers.

Groups of whole clusters meet the candidates in blocks, as Spark's cogroups; each block has its own lists, a walk
returns at most as many rows a member as are wanted, and these are merged by a window. One walk over
an anchor's label finds its positives; a second over all candidates finds, for each positive, the best of
other labels whose score is between ``low`` and ``high`` per cent of the positive's.

Defined results: vectors hold whole numbers; rows with a null id or label, a null or empty vector, or a null or non-finite
component take no part; of rows with one id the largest by label and vector counts; vectors of other lengths
have no score with an anchor; equal scores go by the smaller id; a positive with a negative score has no negatives;
scores beyond 64 bits count as the nearest of 64; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import BROADCAST_KEYS, Scratch

#: Anchors that the cluster centres are fitted on, at most about so many; anchors a cluster; clusters at most.
FIT_ANCHORS, CLUSTER, CLUSTERS = 4096, 128, 1024
#: Numbers in a block of vectors, and vectors at most; few candidates are still dealt to PARTS tasks.
CELLS, MOST, PARTS = 1 << 22, 65_536, 8
STEP, MEMBERS = 1024, 512
LEAST, LARGEST = -(2**63) + 1, 2**63 - 1


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def directions(x: np.ndarray) -> np.ndarray:
    size = norms(x)
    return x / np.where(size > 0, size, 1)[:, None]


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    whole = [[[int(c) for c in row] for row in part.tolist()] for part in (x, y)]
    return np.array([[min(max(sum(a * b for a, b in zip(p, q, strict=True)), LEAST), LARGEST) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(x), len(y))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of k clusters, by spherical means from evenly spaced rows."""
    unit = directions(sample)
    out = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        home = (unit @ out.T).argmax(axis=1)
        total = np.zeros_like(out)
        np.add.at(total, home, unit)
        out = np.where(norms(total)[:, None] > 0, directions(total), out)
    return out


class Best:
    """The k best (score, smaller id) of each row."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), LEAST), np.full((rows, k), LARGEST)

    def beaten(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        last, at = self.score[row, -1][:, None], self.id[row, -1][:, None]
        return (score > last) | ((score == last) & (ids[None] < at))

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k, touched = self.score.shape[1], np.unique(row)
        row = np.concatenate([np.repeat(touched, k), row])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, touched)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = rank < k
        self.score[row[keep], rank[keep]], self.id[row[keep], rank[keep]] = score[keep], ids[keep]


def walk(x: np.ndarray, centre: np.ndarray, y: np.ndarray, ids: np.ndarray, need: Callable[[np.ndarray], np.ndarray], take: Callable) -> int:
    """Walk members ``x`` of one cluster along its list of ``y``; the steps that members took, in all.

    need(members) is the least score that could still change their results, take(members, scores, places) enters scores.
    """
    angle = lambda rows: np.arccos(np.clip(directions(rows) @ centre, -1, 1))
    size, length = norms(x), norms(y)
    bound = length * np.cos(np.clip(angle(y) - angle(x).max(), 0, np.pi))
    order = np.lexsort((ids, -bound))
    slack = 1e-9 * length.max(initial=0)
    steps = 0
    for lo in range(0, len(x), MEMBERS):
        active = np.arange(lo, min(lo + MEMBERS, len(x)))
        for at in range(0, len(order), STEP):
            active = active[size[active] * (bound[order[at]] + slack) >= need(active)]
            if not len(active):
                break
            places = order[at : at + STEP]
            steps += len(active)
            take(active, inner(x[active], y[places]), places)
    return steps


def walk_clusters(anchors: pa.Table, candidates: pa.Table, need, take) -> int:
    x, y = matrix(anchors["v"]), matrix(candidates["v"])
    ids, cluster = candidates["id"].to_numpy(), anchors["cluster"].to_numpy()
    steps = 0
    for c in np.unique(cluster):
        rows = np.flatnonzero(cluster == c)
        mean = directions(directions(x[rows]).sum(axis=0, keepdims=True))[0]
        steps += walk(x[rows], mean, y, ids, lambda m, rows=rows: need(rows[m]), lambda m, s, places, rows=rows: take(rows[m], s, places))
    return steps


POSITIVE = "anchor long, id long, score long"
NEGATIVE = "anchor long, positive_id long, positive_score long, id long, score long"


def find_positives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        own, ids, best = anchors["id"].to_numpy(), candidates["id"].to_numpy(), Best(len(anchors), k)

        def take(m: np.ndarray, score: np.ndarray, places: np.ndarray) -> None:
            i, j = np.nonzero(best.beaten(m, score, ids[places]) & (ids[places][None] != own[m][:, None]))
            best.offer(m[i], score[i, j], ids[places[j]])

        if len(anchors) and len(candidates):
            walk_clusters(anchors, candidates, lambda m: np.where(best.id[m, -1] == LARGEST, -np.inf, best.score[m, -1]), take)
        i, j = np.nonzero(best.id != LARGEST)
        return pa.table({"anchor": own[i], "id": best.id[i, j], "score": best.score[i, j]}).cast(pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    return run


def find_negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        own, ids = anchors["id"].to_numpy(), candidates["id"].to_numpy()
        positives = anchors["positives"].to_pylist()
        width = max((len(p) for p in positives), default=0)
        least, most = np.full((len(own), width), LARGEST), np.full((len(own), width), LEAST)
        for i, found in enumerate(positives):
            for j, p in enumerate(found):
                least[i, j], most[i, j] = -(-low * p["score"] // 100), high * p["score"] // 100
        _, label = np.unique(np.concatenate([anchors["label"].to_numpy(zero_copy_only=False), candidates["label"].to_numpy(zero_copy_only=False)]).astype(str), return_inverse=True)
        of, to = label[: len(own)], label[len(own) :]
        best = [Best(len(own), k) for _ in range(width)]

        def need(m: np.ndarray) -> np.ndarray:
            every = [np.where(least[m, j] > most[m, j], np.inf, np.maximum(least[m, j], best[j].score[m, -1]).astype(np.float64)) for j in range(width)]
            return np.min(every, axis=0) if every else np.full(len(m), np.inf)

        def take(m: np.ndarray, score: np.ndarray, places: np.ndarray) -> None:
            other = of[m][:, None] != to[places][None]
            for j in range(width):
                i, c = np.nonzero(other & (score >= least[m, j][:, None]) & (score <= most[m, j][:, None]) & best[j].beaten(m, score, ids[places]))
                if len(i):
                    best[j].offer(m[i], score[i, c], ids[places[c]])

        if len(anchors) and len(candidates):
            walk_clusters(anchors, candidates, need, take)
        rows = [(int(own[i]), p["id"], p["score"], int(a), int(s)) for i, found in enumerate(positives) for j, p in enumerate(found) for a, s in zip(best[j].id[i], best[j].score[i], strict=True) if a != LARGEST]
        names = [c.split()[0] for c in NEGATIVE.split(", ")]
        return pa.table({n: pa.array([r[c] for r in rows], pa.int64()) for c, n in enumerate(names)})

    return run


def assign(fitted: dict[int, np.ndarray]):
    """The cluster of each anchor; lengths without centres are one cluster."""

    def run(batches):
        for batch in batches:
            dim = batch["dim"].to_numpy()
            cluster = np.zeros(len(dim), np.int32)
            for d in np.unique(dim):
                if int(d) in fitted:
                    rows = np.flatnonzero(dim == d)
                    cluster[rows] = (directions(matrix(pa.chunked_array([batch["v"].take(pa.array(rows))]))) @ fitted[int(d)].T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(cluster))

    return run


def meet(anchors: DataFrame, candidates: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """All anchors of a key with all candidates of that key: groups of clusters against blocks of candidates."""
    most = F.greatest(F.lit(256), F.least(F.lit(MOST), F.floor(CELLS / F.col("dim"))))
    n_of = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / most).cast("int").alias(name))
    groups = n_of(anchors, by, "groups")
    blocks = candidates.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(PARTS), F.ceil(F.col("n") / STEP))).cast("int").alias("blocks"))
    sizes = groups.join(blocks, by)
    small = sizes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    sizes = F.broadcast(sizes) if small else sizes
    # Whole clusters go to one group, but for those that are larger than one.
    of_cluster = n_of(anchors, [*by, "cluster"], "pieces")
    of_cluster = F.broadcast(of_cluster) if of_cluster.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else of_cluster
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = anchors.join(of_cluster, [*by, "cluster"]).join(sizes, by).withColumn("group", F.pmod(F.xxhash64("cluster", piece), F.col("groups")).cast("int")).withColumn("block", every("blocks"))
    c = candidates.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("group", every("groups"))
    unit = [*by, "group", "block"]
    a, c = a.drop("pieces", "groups", "blocks"), c.select(*unit, "id", *{"label", "v"} - set(by))
    return a.groupBy(*unit).cogroup(c.groupBy(*unit)).applyInArrow(run, schema)


def best_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on the column id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(
        "id is not null and label is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    )
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.max(F.struct("label", "v")).alias("x")).select("id", "x.*")
    rows = scratch.table(rows.withColumn("dim", F.size("v")))
    asked = rows.where(is_anchor)
    total = asked.count()
    share = min(1.0, FIT_ANCHORS / max(1, total))
    sample = asked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("id", "dim", "v").orderBy("id").limit(2 * FIT_ANCHORS).toArrow()
    fitted = {}
    for d in set(sample["dim"].to_pylist()):
        own = sample.filter(pa.compute.equal(sample["dim"], d))
        fitted[d] = centres(matrix(own["v"]), max(1, min(CLUSTERS, len(own), total * len(own) // len(sample) // CLUSTER)))
    anchors = scratch.table(asked.mapInArrow(assign(fitted), "id long, label string, v array<double>, dim int, cluster int"))
    found = best_of(meet(anchors, rows, ["dim", "label"], find_positives(positives), POSITIVE), ["anchor"], positives)
    listed = scratch.table(found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")))
    asking = scratch.table(anchors.join(listed.withColumnRenamed("anchor", "id"), "id"))
    mined = best_of(meet(asking, rows, ["dim"], find_negatives(negatives, low, high), NEGATIVE), ["anchor", "positive_id"], negatives)
    return mined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
