"""Coverage-weighted distributions of timeline bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .selection import QUANTILES, weighted_percentiles


def distribution(rows: DataFrame, by: list[str], value: str, weight: str, digits: int = 4) -> DataFrame:
    """Percentiles, extremes, spreads and means of a measure."""
    q = weighted_percentiles(rows, by, value, weight)
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("q") == p, F.col("x"))).alias(f"p{round(p * 100)}") for p in QUANTILES])
    ok = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    rest = ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.sum(weight), 3).alias("weight"),
        F.round(F.min(value), 4).alias("min"),
        F.round(F.max(value), 4).alias("max"),
        F.round(X.weighted_mean(value, weight), 4).alias("mean"),
        F.round(X.db(X.weighted_mean(X.power(value), weight)), 4).alias("power_mean"),
    )
    return rest.join(wide, by).select(*by, "n", "weight", "min", "max", "mean", "power_mean", *[F.round(f"p{round(p * 100)}", digits).alias(f"p{round(p * 100)}") for p in QUANTILES], F.round(F.col("p75") - F.col("p25"), digits).alias("iqr"), F.round(F.col("p90") - F.col("p10"), digits).alias("spread"))


def accepted(bins: DataFrame, by: list[str], start: int, end: int, least: float = 0.5) -> DataFrame:
    """How many of a range's seconds have a bin of enough coverage, too little, or none."""
    covered = F.bit_count("coverage_mask") / 10.0
    inside = bins.where((F.col("bin_index") + 1 > start) & (F.col("bin_index") < end))
    return inside.groupBy(*by).agg(
        F.count_if(covered >= least).alias("accepted"),
        F.count_if(covered < least).alias("rejected"),
        (F.lit(end - start) - F.count("*")).alias("missing"),
        F.round(F.sum(covered), 3).alias("covered_seconds"),
        F.round(F.sum(F.when(covered >= least, covered).otherwise(0.0)), 3).alias("accepted_seconds"),
    )


def scope(start: float | None = None, end: float | None = None, section: tuple[int, int] | None = None, span: tuple[int, int] | None = None) -> tuple[int, int]:
    """The seconds a question is about (C15): a section, or both ends of a range, or the span of a pass; never two of them."""
    if section is not None:
        if start is not None or end is not None:
            raise ValueError("a section excludes a range")
        return section
    if (start is None) != (end is None):
        raise ValueError("a range needs both ends")
    if start is not None:
        if end <= start:
            raise ValueError("a range ends after it starts")
        return int(start // 1), int(-(-end // 1))
    if span is None:
        raise ValueError("no pass to take the span of")
    return span


def exact_pass(bins: DataFrame, start: int, end: int, epoch: int) -> DataFrame:
    """A range's bins of the pass asked for, whatever its coverage."""
    return bins.where((F.col("transport_epoch") == epoch) & (F.col("bin_index") + 1 > start) & (F.col("bin_index") < end))


#: Measure, statistic and name of the seven shifts.
SHIFTS = [
    ("rms_db", "p50", "median_rms_db"), ("lufs_s", "p50", "median_lufs_s_lu"), ("crest_db", "p50", "crest_p50_db"), ("crest_db", "p90", "crest_p90_db"),
    ("peak_db", "p50", "sample_peak_p50_db"), ("rms_db", "spread", "rms_p90_p10_spread_db"), ("lufs_s", "spread", "lufs_s_p90_p10_spread_lu"),
]


def section_comparison(bins: DataFrame, primary: tuple[int, int], other: tuple[int, int], by: list[str], least: float = 0.5) -> DataFrame:
    """Seven shifts of the other range's distributions against the primary's (C17): (by, shift, delta)."""
    where = F.when(F.col("bin_index").between(primary[0], primary[1] - 1), "primary").when(F.col("bin_index").between(other[0], other[1] - 1), "other")
    inside = bins.where(F.col("coverage_ratio") >= least).withColumn("side", where).where("side is not null")
    long = inside.unpivot([*by, "side", "covered_seconds"], [F.col(c).cast("double").alias(c) for c in ("rms_db", "lufs_s", "crest_db", "peak_db")], "measure", "v")
    q = weighted_percentiles(long, [*by, "side", "measure"], "v", "covered_seconds", [0.10, 0.50, 0.90])
    at = lambda p, s: F.max(F.when((F.col("q") == p) & (F.col("side") == s), F.col("x")))
    wide = q.groupBy(*by, "measure").agg(*[at(p, s).alias(f"{s}_p{round(p * 100)}") for p in (0.10, 0.50, 0.90) for s in ("primary", "other")])
    value = lambda s, stat: F.col(f"{s}_p90") - F.col(f"{s}_p10") if stat == "spread" else F.col(f"{s}_{stat}")
    every = F.array(*[F.struct(F.lit(name).alias("shift"), F.lit(m).alias("m"), F.round(value("other", stat) - value("primary", stat), 4).alias("delta")) for m, stat, name in SHIFTS])
    return wide.withColumn("s", F.explode(every)).where("s.m = measure").select(*by, "s.shift", "s.delta")
