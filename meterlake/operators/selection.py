"""Exact order statistics of large groups in bounded memory.

``percentiles`` selects by repeated histograms. The first has bins that need no knowledge of the data (64 to an octave,
either sign), so counting them is one aggregation with map-side combine. The bin that holds a rank is then cut into
``BINS`` equal parts between its least and greatest value, and so on, until a bin holds one value or at
most ``FEW`` rows, which are ranked. Only rows of chosen bins are read on, and no task holds a group.

``weighted_percentiles`` cuts the rows into ranges of (group, value, weight). Sums of the ranges give each the weight before
it; only the ranges that hold a row beside a wanted position are summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

BINS, FEW = 1024, 4096
QUANTILES = [0.10, 0.25, 0.50, 0.75, 0.90]
#: Rows of a range of ``weighted_percentiles``.
RANGE_ROWS = 500_000
#: Rows up to which a small side is broadcast (some 100 bytes each).
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _octave(x: Column) -> Column:
    """A whole number that never falls as x grows: its sign, octave and 64th of one."""
    size = F.floor(64 * F.log2(F.abs(x))).cast("long") + 100_000
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0))


def _ranked(counts: DataFrame, by: list[str], wanted: DataFrame, spot: str) -> DataFrame:
    """The bin of each wanted rank (columns by, rank, skipped: rows before the bins), from counts (by, spot, n, lo, hi)."""
    w = Window.partitionBy(*by).orderBy(spot)
    placed = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = placed.join(wanted, by)
    inside = (F.col("rank") - F.col("skipped") < F.col("upto")) & (F.col("rank") - F.col("skipped") >= F.col("upto") - F.col("n"))
    return met.where(inside).withColumn("skipped", F.col("skipped") + F.col("upto") - F.col("n")).drop("upto")


def percentiles(rows: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(by, q, x): by interpolation between the ranks about q (n - 1). Nulls and NaN are left out; a group of neither is not there."""
    ok = rows.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    g = [f"g{i}" for i in range(len(by))]
    ok = ok.withColumn("g", F.struct(*g)).select("g", "x")  # structs of nulls are equal
    ok = ok.withColumn("spot", F.when(F.abs("x") == float("inf"), F.signum("x").cast("long") * 1_000_000).otherwise(_octave(F.col("x"))))
    counts = cut(ok.groupBy("g", "spot").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    total = counts.groupBy("g").agg(F.sum("n").alias("total"))
    share = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    place = total.select("g", "total", share).withColumn("position", F.col("q") * (F.col("total") - 1))
    place = place.withColumns({"low": F.floor("position"), "high": F.ceil("position")})
    wanted = place.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct().withColumn("skipped", F.lit(0).cast("long"))
    found = cut(_ranked(counts, ["g"], wanted, "spot"))
    settled = lambda df: df.where("lo = hi").select("g", "rank", F.col("lo").alias("x"))
    values = settled(found)
    # Rows of the chosen bins; ranks of one bin share them.
    bins = found.where("lo < hi").groupBy("g", "spot", "lo", "hi", "n", "skipped").agg(F.collect_set("rank").alias("ranks"))
    left = ok.join(_small(bins), ["g", "spot"])
    for _ in range(60):
        left = cut(left)
        few = left.where(F.col("n") <= FEW)
        w = Window.partitionBy("g", "lo").orderBy("x")
        at = few.withColumn("rank", F.row_number().over(w) - 1 + F.col("skipped")).where(F.array_contains("ranks", F.col("rank")))
        values = values.union(at.select("g", "rank", "x"))
        many = left.where(F.col("n") > FEW)
        if many.isEmpty():
            break
        # Halves first, so that the width of a bin of huge values stays finite.
        part = ((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS).cast("int")
        fine = many.withColumn("part", part)
        again = fine.groupBy("g", "lo", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo2"), F.max("x").alias("hi2"))
        asked = bins.where(F.col("n") > FEW).select("g", "lo", "skipped", F.explode("ranks").alias("rank"))
        found = cut(_ranked(again, ["g", "lo"], asked, "part"))
        values = values.union(found.where("lo2 = hi2").select("g", "rank", F.col("lo2").alias("x")))
        bins = found.where("lo2 < hi2").groupBy("g", "lo", "part", "lo2", "hi2", "n", "skipped").agg(F.collect_set("rank").alias("ranks"))
        left = fine.select("g", "lo", "part", "x").join(_small(bins), ["g", "lo", "part"]).drop("lo", "part").withColumnsRenamed({"lo2": "lo", "hi2": "hi"})
        bins = bins.drop("lo", "part").withColumnsRenamed({"lo2": "lo", "hi2": "hi"})
    else:
        raise RuntimeError("selection did not settle")
    values = cut(values)
    low, high = (values.select(F.col("g"), F.col("rank").alias(c), F.col("x").alias(f"x_{c}")) for c in ("low", "high"))
    share = F.col("position") - F.col("low")
    x = F.when(F.col("low") == F.col("high"), F.col("x_low")).otherwise(F.col("x_low") * (1 - share) + F.col("x_high") * share)
    return place.join(low, ["g", "low"]).join(high, ["g", "high"]).select(*[F.col(f"g.g{i}").alias(c) for i, c in enumerate(by)], "q", x.alias("x"))


def median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): the exact median."""
    return percentiles(rows, by, value, [0.5]).select(*by, F.col("x").alias(name))


def median_and_mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): and the median of the distances to it."""
    middle = cut(median(rows, by, value))
    off = rows.join(_small(middle), by).withColumn("off", F.abs(F.col(value) - F.col("median")))
    return middle.join(median(off, by, "off", "mad"), by)


def weighted_percentiles(rows: DataFrame, by: list[str], value: str, weight: str, quantiles: list[float] = QUANTILES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(by, q, x): by interpolation between weighted mid-points (A18). Each row has its own mid-point, so equal values are not
    merged; before the first and after the last it is theirs. Values and weights that are no finite numbers, and weights of 0 or less, are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = rows.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).where(finite("v") & finite("w") & (F.col("w") > 0))
    n = max(1, -(-ok.count() // range_rows))
    dealt = cut(ok.repartitionByRange(n, "g", "v", "w").withColumn("block", F.spark_partition_id()))
    ends = dealt.groupBy("g", "block").agg(F.sum("w").alias("sum"), F.min(F.struct("v", "w")).alias("first"), F.max(F.struct("v", "w")).alias("last"))
    w = Window.partitionBy("g").orderBy("block")
    upto = F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("sum").over(Window.partitionBy("g"))
    ends = cut(ends.withColumns({"upto": upto, "total": whole}))
    share = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    at = ends.withColumn("q", share).withColumns({"target": F.col("q") * F.col("total"), "p_first": F.col("upto") - F.col("sum") + F.col("first.w") / 2, "p_last": F.col("upto") - F.col("last.w") / 2})
    # The last range that begins at or before a position, and the first that ends after it, hold the rows beside it.
    held = at.groupBy("g", "q", "target").agg(F.max(F.when(F.col("p_first") <= F.col("target"), F.col("block"))).alias("a"), F.min(F.when(F.col("p_last") > F.col("target"), F.col("block"))).alias("b"))
    held = held.withColumn("block", F.explode(F.array_distinct(F.array_compact(F.array("a", "b"))))).select("g", "q", "target", "block")
    needed = cut(held.join(ends.select("g", "block", (F.col("upto") - F.col("sum")).alias("before")), ["g", "block"]))
    near = dealt.join(_small(needed.select("g", "block", "before").distinct()), ["g", "block"])
    run = F.sum("w").over(Window.partitionBy("g", "block").orderBy("v", "w").rowsBetween(Window.unboundedPreceding, 0))
    placed = near.withColumn("p", F.col("before") + run - F.col("w") / 2).select("g", "block", "p", "v")
    met = placed.join(_small(needed.select("g", "block", "q", "target")), ["g", "block"])
    left = F.max(F.when(F.col("p") <= F.col("target"), F.struct("p", "v"))).alias("l")
    right = F.min(F.when(F.col("p") > F.col("target"), F.struct("p", "v"))).alias("r")
    both = met.groupBy("g", "q", "target").agg(left, right)
    inside = F.col("l.v") + (F.col("r.v") - F.col("l.v")) * (F.col("target") - F.col("l.p")) / (F.col("r.p") - F.col("l.p"))
    x = F.when(F.col("l").isNull(), F.col("r.v")).when(F.col("r").isNull(), F.col("l.v")).otherwise(inside)
    return both.select(*[F.col("g")[c].alias(c) for c in by], "q", x.alias("x"))
