"""MinHash near-duplicate detection with banding, verification and connected components.

Documents are sets of word shingles. A signature of ``bands * rows`` universal-hash minima is cut
into bands; documents that agree on a band share a bucket. Links are confirmed on the full sets,
so a reported link is exact; a pair at the threshold shares no bucket with probability
(1 - 0.85^5)^25 < 5e-7 for the default, and (1 - 0.8^4)^32 < 5e-8 for 80 per cent with 32 bands of 4. No other
step drops a link: a signature only decides which members of a bucket of three or more are verified first.

How the work stays linear in a group's size:

* documents with equal sets collapse to one class before anything is paired;
* a bucket first links its classes to its first one only (a star, signature-checked, then verified);
* a bucket whose members then lie in several components is open; only open buckets are compared
  further, in blocks of ``BLOCK_DOCS`` members, by an exact incidence product per pair of blocks that
  returns a spanning forest of the links found, never the pairs.

Defined results: null, empty or blank texts have no shingles (n_shingles 0) and link with nothing;
rows that share an id are one document that holds each of their sets (n_shingles is the largest), so what is near any
of them is one component with it; repeated rows of one id count once; an empty table gives an empty result; other columns are ignored.
A null id can name no component, so such rows are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import Scratch, components, restrict, without
from .text_arrays import distinct, mix, runs, shingles, words

BLOCK_DOCS = 512
SIGNATURE = "id long, n_shingles long, h1 long, h2 long, bands array<long>, bytes binary"
SETS = "n_shingles long, h1 long, h2 long, items binary"
SET = ["n_shingles", "h1", "h2"]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) of each run of texts: sorted distinct shingle hashes per text."""
    for run in runs(texts):
        value, text = shingles(words(run), width)
        yield run.first, *distinct(text, value, len(run))


def set_hashes(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, as two columns of longs."""
    h1, h2 = np.zeros((2, len(bounds) - 1), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        h1[some] = np.add.reduceat(items, bounds[some])
        h2[some] = np.add.reduceat(mix(items, 3), bounds[some])
    return h1.view(np.int64), h2.view(np.int64)


def signature_batches(width: int, bands_n: int, rows_n: int):
    hashes = bands_n * rows_n
    slope = mix(np.arange(hashes, dtype=np.uint64), 101) | np.uint64(1)
    offset = mix(np.arange(hashes, dtype=np.uint64), 202)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, items, bounds in shingle_sets(batch["text"], width):
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                minima = np.full((len(n), hashes), np.uint64(2**64 - 1))
                if len(some):
                    starts = bounds[some]
                    for j in range(hashes):
                        minima[some, j] = np.minimum.reduceat(items * slope[j] + offset[j], starts)
                h1, h2 = set_hashes(items, bounds)
                rows = minima.reshape(len(n), bands_n, rows_n) * (mix(np.arange(rows_n, dtype=np.uint64), 5) | np.uint64(1))
                bands = mix(rows.sum(axis=2, dtype=np.uint64), 9).view(np.int64)
                offsets = np.arange(len(n) + 1, dtype=np.int32) * bands_n
                byte = np.ascontiguousarray((mix(minima, 11) >> np.uint64(56)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(first, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(h1),
                        pa.array(h2),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                        pa.array([x.tobytes() for x in byte], pa.binary()),
                    ],
                    names=["id", "n_shingles", "h1", "h2", "bands", "bytes"],
                )

    return run


def set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, items, bounds in shingle_sets(batch["text"], width):
                h1, h2 = set_hashes(items, bounds)
                data = pa.array([items[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds), pa.int64()), pa.array(h1), pa.array(h2), data], names=[*SET, "items"])

    return run


def _set(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint64)


def linked(same: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * same >= percent * (a + b - same)


def verify_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["items_a"], batch["items_b"], strict=True):
                x, y = _set(x), _set(y)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(bool(linked(same, len(x), len(y), percent)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs of a block, by incidence products in column chunks."""
    item = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    new = np.ones(len(item), bool)
    new[1:] = item[1:] != item[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 2048, 2048))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[a:b], column[a:b] - 2048 * k] = 1
        out += part @ part.T
    return out


def forest_of_block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A spanning forest of the links that join different components."""
        ids, comp = table["id"].to_numpy(), table["component_id"].to_numpy()
        sets = [_set(x) for x in table["items"]]
        n = np.array([len(x) for x in sets])
        same = overlaps(sets)
        left, right = np.nonzero(np.triu(linked(same, n[:, None], n[None], percent), 1) & (comp[:, None] != comp[None]))
        root = {c: c for c in set(comp.tolist())}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(comp[i]), find(comp[j])
            if a != b:
                root[a] = b
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = 25, rows_per_band: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document; see the module's text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = scratch.table(rows.mapInArrow(signature_batches(width, bands, rows_per_band), SIGNATURE))
    # A class is one set; its number, not an id, stands for it below, because rows of one id may differ.
    classes = scratch.table(
        signed.where("n_shingles > 0").groupBy(*SET).agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "bytes"), "id").alias("s")).withColumn("node", F.monotonically_increasing_id())
    )
    sizes = classes.select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), "s.bytes")
    member = classes.select(F.col("node").alias("id"), F.posexplode("s.bands").alias("band", "hash"))
    shared = member.groupBy("band", "hash").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1")
    buckets = scratch.table(member.join(shared, ["band", "hash"]))

    # Bound of the overlap that sizes give, and signatures 5 standard deviations below the threshold; the latter only where a bucket has
    # more members than two, because those are compared again if a link is missing.
    t = percent / 100
    hashes = bands * rows_per_band
    least = int(hashes * (t - 5 * (t * (1 - t) / hashes) ** 0.5))

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, hashes) for v in (x, y))
        return pd.Series((x == y).sum(axis=1), dtype="int32")

    stars = buckets.where("id > pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.bool_or(F.col("size") == 2).alias("alone"))
    stars = (
        stars.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bytes").alias("sa")), "a")
        .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bytes").alias("sb")), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .where(F.col("alone") | (agree("sa", "sb") >= least))
        .select("a", "b")
    )
    stars = scratch.table(stars)
    in_buckets = scratch.table(classes.join(buckets.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(*SET, "rep", "node"))
    texts = restrict(rows, scratch.table(in_buckets.select(F.col("rep").alias("id")).distinct()), ["id"])
    sets = texts.mapInArrow(set_batches(width), SETS).dropDuplicates(SET)
    sets = scratch.table(sets.join(in_buckets, SET).select(F.col("node").alias("id"), "items"))
    checked = (
        stars.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
        .mapInArrow(verify_batches(percent), "a long, b long")
    )
    # Classes that hold rows of one id are linked through it.
    twice = signed.where("n_shingles > 0").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    through = signed.join(scratch.table(twice), "id", "left_semi").join(classes.select(*SET, "node"), SET)
    first_of = through.groupBy("id").agg(F.min("node").alias("b"))
    links = scratch.table(checked.union(through.join(first_of, "id").where("node > b").select(F.col("node").alias("a"), "b").distinct()))
    first = scratch.table(components(links, scratch))

    # Buckets that still hold several components: all pairs of blocks, only across components.
    placed = buckets.join(first, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    open_buckets = (
        placed.groupBy("band", "hash").agg(F.first("size").alias("n"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi and n > 2")
    )
    blocks = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    units = (
        placed.join(open_buckets.select("band", "hash", "n"), ["band", "hash"])
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "component_id", "band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    more = units.join(sets, "id").groupBy("band", "hash", "i", "j").applyInArrow(forest_of_block(percent), "a long, b long")
    more = scratch.table(more)
    if not more.isEmpty():
        first = scratch.table(components(first.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more), scratch))

    # From numbers of classes to the smallest id of each component.
    named = classes.select(*SET, "rep", "node").join(first.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component_id", "node"))
    named = scratch.table(named.select(*SET, "rep", "root", F.col("component_id").isNotNull().alias("linked")))
    least_id = named.where("linked").groupBy("root").agg(F.min("rep").alias("least"))
    reps = named.join(least_id, "root", "left").select(*SET, F.coalesce("least", "rep").alias("component_id"))
    out = signed.select("id", *SET).join(reps, SET, "left").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = scratch.table(out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id")))
    scratch.drop_all(out)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. Rows with a null id stay."""
    gone = near_duplicates(docs, id_col, **options).where(~F.col("kept")).select(id_col)
    return without(docs, Scratch(docs.sparkSession, "copies").table(gone), id_col)
