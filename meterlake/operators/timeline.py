"""One-second timeline partials, and what is finalised from them.

``accumulate`` is the only aggregation over frames; it is keyed (runtime_id, transport_epoch, bin_index) and
combines on the map side. Its result is the rollup to keep as a table; everything else merges partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import expr as X

KEY = ["runtime_id", "transport_epoch"]
MEANS = {"crest_db": "crest", "centroid_hz": "centroid", "stereo_correlation": "stereo_corr", "stereo_width": "stereo_width", "spectral_flux_mean": "flux"}
POWERS = ["rms_db", "lufs_s"]
MAXIMA = ["peak_db", "true_peak_dbtp"]


def bin_index(t: Column) -> Column:
    return F.floor(t).cast("int")


def _region_columns() -> dict[str, Column]:
    """Mean power of each region of one frame, over its bands above the floor."""
    out = {}
    for r, (name, *_) in enumerate(dims.REGIONS):
        inside = [F.get("bands_db", F.lit(i)) for i, c in enumerate(dims.BAND_CENTERS) if dims.region_of(c) == r]
        usable = F.filter(F.array(*inside), lambda x: x > X.FLOOR_DB)
        total = F.aggregate(usable, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x / 10))
        out[f"region_{name}"] = F.when(F.size(usable) > 0, total / F.size(usable))
    return out


def accumulate(frames: DataFrame, spectra: bool = False, also: list[Column] | None = None) -> DataFrame:
    """Timeline partials of playing frames (A14); with spectra, region powers and chroma sums too; ``also`` adds to the key."""
    playing = frames.where("transport_v12_supported and transport_is_playing and transport_time_seconds is not null")
    playing = playing.withColumn("bin_index", bin_index(F.col("transport_time_seconds")))
    aggs = [
        F.count("*").alias("frame_count"),
        F.count_if("signal_present").alias("active_count"),
        F.bit_or(F.pow(F.lit(2.0), X.slot("transport_time_seconds")).cast("int")).alias("coverage_mask"),
        F.min("received_at").alias("first_received_at"),
        F.max("received_at").alias("last_received_at"),
        F.max("arrival_seq").alias("last_arrival_seq"),
    ]
    for c in POWERS:
        usable = F.when(F.col(c) > X.FLOOR_DB, X.power(c))
        aggs += [F.coalesce(F.sum(usable), F.lit(0.0)).alias(f"{c}_power_sum"), F.count(usable).alias(f"{c}_count")]
    aggs += [F.max(c).alias(f"{c}_max") for c in MAXIMA]
    for c, n in MEANS.items():
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{n}_sum"), F.count(c).alias(f"{n}_count")]
    lag = F.greatest(F.lit(0.0), F.col("estimated_analysis_lag_ms"))
    # Whole microseconds, so that sums don't depend on their order.
    aggs += [F.coalesce(F.sum(F.round(lag * 1000).cast("long")), F.lit(0)).alias("lag_sum"), F.count(lag).alias("lag_count"), F.max(lag).alias("lag_max"), F.max("dropped_blocks").alias("dropped_blocks_max")]
    if spectra:
        playing = playing.withColumns(_region_columns())
        for name, *_ in dims.REGIONS:
            aggs += [F.coalesce(F.sum(f"region_{name}"), F.lit(0.0)).alias(f"region_{name}_sum"), F.count(f"region_{name}").alias(f"region_{name}_count")]
        usable = F.col("chroma_energy_ratio") > 0
        weight = F.when(usable & F.col("chroma").isNotNull(), F.greatest(F.lit(1e-6), F.col("chroma_energy_ratio")))
        aggs += [F.coalesce(F.sum(weight * F.get("chroma", F.lit(i))), F.lit(0.0)).alias(f"chroma_{i}") for i in range(12)] + [F.coalesce(F.sum(weight), F.lit(0.0)).alias("chroma_weight")]
    return playing.groupBy(*KEY, "bin_index", *(also or [])).agg(*aggs)


def merge(partials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Partials of the same bins from several sources as one each."""
    how = {"coverage_mask": F.bit_or, "last_received_at": F.max, "last_arrival_seq": F.max, "first_received_at": F.min}
    by = by or [*KEY, "bin_index"]

    def total(c: str) -> Column:
        return how.get(c, F.max if c.endswith("_max") else F.sum)(c).alias(c)

    return partials.groupBy(*by).agg(*[total(c) for c in partials.columns if c not in by and c != "received_window"])


def finalize(partials: DataFrame, by: list[str], expected: Column | None = None) -> DataFrame:
    """Merge partials into one summary row per ``by`` (A16); ``expected`` seconds default to the observed span."""
    nodes = "covered_tenths" in partials.columns  # nodes of a tree in place of bins
    first, last = (F.min("first_bin"), F.max("last_bin")) if nodes else (F.min("bin_index"), F.max("bin_index"))
    span = last + 1 - first
    covered = F.sum("covered_tenths" if nodes else F.bit_count("coverage_mask")) / 10.0
    aggs = [
        first.cast("int").alias("start_seconds"),
        (last + 1).cast("int").alias("end_seconds"),
        F.sum("frame_count").alias("frame_count"),
        F.round(F.sum("active_count") / F.greatest(F.lit(1), F.sum("frame_count")), 4).alias("active_ratio"),
        F.round(covered, 3).alias("covered_seconds"),
        F.round(F.least(F.lit(1.0), covered / (expected if expected is not None else F.greatest(F.lit(1), span))), 4).alias("coverage_ratio"),
    ]
    aggs += [F.when(F.sum(f"{c}_count") > 0, F.round(X.db(F.try_divide(F.sum(f"{c}_power_sum"), F.sum(f"{c}_count"))), 4)).alias(c) for c in POWERS]
    aggs += [F.round(F.max(f"{c}_max"), 4).alias(c) for c in MAXIMA]
    digits = {"crest": 4, "centroid": 2, "stereo_corr": 5, "stereo_width": 5, "flux": 6}
    aggs += [F.round(F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_count")), digits[n]).alias(c) for c, n in MEANS.items()]
    aggs += [
        (F.when(F.sum("lag_count") > 0, F.floor((2 * F.sum("lag_sum") + F.sum("lag_count")) / (2 * F.sum("lag_count")))) / 1000).alias("mean_lag_ms"),
        F.max("lag_max").alias("max_lag_ms"),
        F.max("dropped_blocks_max").alias("dropped_blocks"),
        F.max("last_received_at").alias("last_received_at"),
        F.min("first_received_at").alias("first_received_at"),
    ]
    if "chroma_weight" in partials.columns:
        for name, *_ in dims.REGIONS:
            aggs.append(F.when(F.sum(f"region_{name}_count") > 0, F.round(X.db(F.try_divide(F.sum(f"region_{name}_sum"), F.sum(f"region_{name}_count"))), 4)).alias(f"region_{name}"))
        total = sum((F.sum(f"chroma_{i}") for i in range(1, 12)), F.sum("chroma_0"))
        aggs += [F.when((F.sum("chroma_weight") > 0) & (total > 1e-12), F.round(F.try_divide(F.sum(f"chroma_{i}"), total), 5)).alias(f"chroma_{i}") for i in range(12)]
    return partials.groupBy(*by).agg(*aggs)


def song_timeline(partials: DataFrame, resolution: int = 5) -> DataFrame:
    """Summaries per group of ``resolution`` seconds (T31); groups claim the whole interval."""
    step = dims.nearest_resolution(resolution)
    grouped = partials.withColumn("group_index", F.floor(F.col("bin_index") / step).cast("int"))
    return finalize(grouped, [*KEY, "group_index"], F.lit(float(step)))


def first_groups(rows: DataFrame, most: int, order: str = "group_index") -> DataFrame:
    """The first ``most`` groups of each pass, and whether the pass has more (O04): the count is one aggregate, not a sort."""
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("group_count"))
    w = Window.partitionBy(*KEY).orderBy(order)
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return first.join(counts, KEY).withColumn("truncated", F.col("group_count") > most)


def pass_summary(partials: DataFrame, last: int = 12) -> DataFrame:
    """One row per pass of a track, at most the last 12 passes each."""
    out = finalize(partials, KEY).withColumn("bins", F.col("end_seconds") - F.col("start_seconds"))
    bins = partials.groupBy(*KEY).agg(F.count("*").alias("bin_count"))
    w = Window.partitionBy("runtime_id").orderBy(F.desc("transport_epoch"))
    return out.join(bins, KEY).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= last).drop("rank", "bins")


def overlapping(partials: DataFrame, start: float, end: float) -> DataFrame:
    """Bins that overlap the range, half open; they count whole."""
    return partials.where((F.col("bin_index") + 1 > start) & (F.col("bin_index") < end))


def resolve_range(partials: DataFrame, start: float, end: float, minimum: float = 0.8, fence: float | None = None) -> DataFrame:
    """Per track the pass with the best coverage of a range.

    The range is widened to whole seconds. Passes first received at or before ``fence`` don't count. Ties go to
    the pass received last, then the larger number.
    """
    lo, hi = float(int(start // 1)), float(-int(-end // 1))
    merged = finalize(overlapping(partials, lo, hi), KEY, F.lit(hi - lo))
    if fence is not None:
        merged = merged.where(F.col("first_received_at") > fence)
    w = Window.partitionBy("runtime_id").orderBy(F.desc("coverage_ratio"), F.desc("last_received_at"), F.desc("transport_epoch"))
    best = merged.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    return best.withColumn("adequate", F.col("coverage_ratio") >= minimum)


#: Levels of a tree: its largest nodes are 4096 seconds.
LEVELS = 12


def tree(partials: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Partials of 1, 2, 4, ... 2^levels seconds: (track, pass, level, node), node n of level k for bins n 2^k to (n + 1) 2^k - 1.

    Every sum, count and extreme of bins merges, so a node holds what its bins do; its coverage is the tenths of seconds that
    have a frame. One aggregation with map-side combine; the table is at most twice as large as the bins for one pass, less what the upper levels share.
    """
    kept = {c: "sum" for c in partials.columns if c.endswith(("_sum", "_count")) or c == "chroma_weight" or c.startswith("chroma_")}
    kept |= {c: "max" for c in partials.columns if c.endswith("_max")} | {"last_received_at": "max", "last_arrival_seq": "max", "first_received_at": "min"}
    leaves = partials.withColumns({"covered_tenths": F.bit_count("coverage_mask"), "first_bin": F.col("bin_index"), "last_bin": F.col("bin_index")})
    kept |= {"covered_tenths": "sum", "first_bin": "min", "last_bin": "max"}
    every = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr("shiftright(bin_index, level)"))
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    return every.groupBy(*KEY, "level", "node").agg(*[how[f](c).alias(c) for c, f in kept.items() if c in every.columns])


def range_nodes(requests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes that make up each range of (request, start, end) in whole seconds: two a level at most, and what is left at the top."""
    bound = requests.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"lo": F.expr("shiftright(start + shiftleft(1, level) - 1, level)"), "hi": F.expr("shiftright(end, level)")}).where("lo < hi")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    ends = F.array_compact(F.array(F.when(odd("lo"), F.col("lo")), F.when(odd("hi"), F.col("hi") - 1)))
    return bound.select("request", "level", F.explode(F.when(F.col("level") == levels, F.sequence("lo", F.col("hi") - 1)).otherwise(ends)).alias("node"))


def resolve_ranges(nodes: DataFrame, requests: DataFrame, minimum: float = 0.8, levels: int = LEVELS) -> DataFrame:
    """``resolve_range`` of many ranges (request, start, end, fence; a null fence lets all passes count) over a ``tree``: a range reads
    a number of rows that grows with its length's logarithm. Rows are (request, track) with the pass chosen."""
    asked = requests.select("request", F.floor("start").cast("int").alias("start"), F.ceil("end").cast("int").alias("end"), F.col("fence").cast("double").alias("fence")).where("end > start")
    met = nodes.join(range_nodes(asked, levels), ["level", "node"]).join(asked, "request")
    merged = finalize(met, ["request", "fence", "start", "end", *KEY], F.max(F.col("end") - F.col("start")).cast("double")).where("fence is null or first_received_at > fence")
    w = Window.partitionBy("request", "runtime_id").orderBy(F.desc("coverage_ratio"), F.desc("last_received_at"), F.desc("transport_epoch"))
    best = merged.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank", "start", "end", "fence")
    return best.withColumn("adequate", F.col("coverage_ratio") >= minimum)


def gaps(partials: DataFrame) -> DataFrame:
    """Seconds without a bin between two bins of a pass."""
    before = F.lag("bin_index").over(Window.partitionBy(*KEY).orderBy("bin_index"))
    return partials.select(*KEY, "bin_index", before.alias("previous")).where("bin_index - previous > 1").select(*KEY, (F.col("previous") + 1).alias("gap_start"), F.col("bin_index").alias("gap_end"))


def retain(partials: DataFrame, n: int = 1200) -> DataFrame:
    """The bins of each track touched last (W04): by arrival, not by song time."""
    w = Window.partitionBy("runtime_id").orderBy(F.desc("last_arrival_seq"))
    return partials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")
