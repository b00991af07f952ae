"""Track pairs: spectral overlap, time alignment and interaction evidence.

Tracks of a project are few (64 at most), so pairs are a triangular join of per-track summaries, never of
frames. Frames meet only in the alignment, per pair and stretch of time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import expr as X
from ..plans.lineage import cut


def tracks_in_pairs(tracks: DataFrame, by: str = "runtime_id", master: Column | None = None) -> DataFrame:
    """All unordered pairs (J04), without the master, and without tracks of one mixer track if both are bound."""
    kept = tracks if master is None else tracks.where(~F.coalesce(master, F.lit(False)))
    index = F.col("fl_track_index") if "fl_track_index" in tracks.columns else F.lit(None).cast("int")
    a = kept.select(F.col(by).alias("a"), index.alias("ia"))
    b = kept.select(F.col(by).alias("b"), index.alias("ib"))
    return a.join(b, (F.col("a") < F.col("b")) & ~F.coalesce(F.col("ia") == F.col("ib"), F.lit(False))).select("a", "b")


def _sides(values: DataFrame, value: str, band: str, by: str) -> tuple[DataFrame, DataFrame]:
    top = F.max(value).over(Window.partitionBy(by))
    rel = values.select(by, band, F.col(value).alias("db"), F.pow(F.lit(10.0), (F.col(value) - top) / 10).alias("rel"))
    return (rel.select(F.col(by).alias(s), F.col(band).alias("band"), F.col("db").alias(f"db_{s}"), F.col("rel").alias(f"rel_{s}")) for s in "ab")


def overlap(means: DataFrame, pairs: DataFrame, value: str = "plain_db", band: str = "band", by: str = "runtime_id") -> DataFrame:
    """Overlap of two spectra, each relative to its own maximum, band by band."""
    a, b = _sides(means, value, band, by)
    return pairs.join(a, "a").join(b, ["b", "band"]).select("a", "b", "band", "db_a", "db_b", F.least("rel_a", "rel_b").alias("overlap"))


def compare(means: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of each pair: mean of its five strongest overlaps (T09; O03), with the strongest band."""
    bands = overlap(means, pairs)
    w = Window.partitionBy("a", "b").orderBy(F.desc("overlap"), "band")
    top = bands.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return top.groupBy("a", "b").agg(F.round(F.avg("overlap"), 4).alias("score"), F.min(F.when(F.col("rank") == 1, F.col("band"))).alias("strongest_band"))


def detect(means: DataFrame, pairs: DataFrame, least: float = 0.15) -> DataFrame:
    """Bands whose rounded overlap reaches the threshold."""
    return overlap(means, pairs).select("a", "b", "band", F.round("overlap", 4).alias("overlap")).where(F.col("overlap") >= least)


def top_pairs(scores: DataFrame, k: int = 8, by: str = "score") -> DataFrame:
    """The k strongest pairs."""
    return scores.orderBy(F.desc(by), "a", "b").limit(k)


ALIGNED = "a string, b string, a_seq long, b_seq long, dt double"


def _two_pointers(tolerance: float):
    """Pairs from rows sorted by (a, b, t, side): what waits is of one side and at most ``tolerance`` old, so memory is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, waiting = None, deque()
        for batch in batches:
            out: list[tuple] = []
            for a, b, t, side, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != pair:
                    pair, waiting = (a, b), deque()
                while waiting and t - waiting[0][0] > tolerance:
                    waiting.popleft()
                if waiting and waiting[0][1] != side:
                    u, _, other = waiting.popleft()
                    out.append((a, b, other, seq, u - t) if side else (a, b, seq, other, t - u))
                else:
                    waiting.append((t, side, seq))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "a_seq", "b_seq", "dt"])

    return run


def align(frames: DataFrame, pairs: DataFrame, tolerance: float = 0.08, clock: str = "received_at") -> DataFrame:
    """Greedy one-to-one pairing of two tracks' frames in time (J07): (a, b, a_seq, b_seq, dt), dt being a's time less b's.

    Both sides are merged by time. An item meets the oldest waiting item of the other side that is at most
    ``tolerance`` old, else it waits itself. Nothing waits across a pause longer than the tolerance, so the merge is cut
    at such pauses, and a stretch between two is sorted by Spark and read once in its order.
    """
    # A frame looks up the stretches of all its pairs at once, before it is repeated for them.
    cell = F.floor(F.col("t") / tolerance).cast("long")
    f = frames.where(F.col(clock).isNotNull()).select("runtime_id", F.col(clock).cast("double").alias("t"), F.col("arrival_seq").alias("seq")).withColumn("cell", cell)
    sides = pairs.select(F.col("a").alias("runtime_id"), "a", "b", F.lit(0).alias("side")).union(pairs.select(F.col("b").alias("runtime_id"), "a", "b", F.lit(1).alias("side")))
    # Pauses are found between non-empty cells of the tolerance's length, which are counted by track before they meet in pairs.
    cells = f.groupBy("runtime_id", "cell").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).join(sides, "runtime_id")
    w = Window.partitionBy("a", "b").orderBy("cell")
    both = cells.groupBy("a", "b", "cell").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.collect_list(F.struct("runtime_id", "side")).alias("in"))  # two at most
    pause = F.coalesce(F.col("t0") - F.lag("t1").over(w) > tolerance, F.lit(True)).cast("long")
    stretches = both.withColumn("pause", pause).select("a", "b", "cell", "in", F.sum("pause").over(w).alias("stretch"))
    # A track is in fewer than 64 pairs.
    places = stretches.select("cell", F.struct("a", "b", "stretch").alias("pair"), F.explode("in").alias("i")).groupBy("i.runtime_id", "cell").agg(F.collect_list(F.struct("pair", "i.side")).alias("places"))
    placed = f.join(places.hint("merge"), ["runtime_id", "cell"]).select("t", "seq", F.explode("places").alias("p")).select("p.pair.a", "p.pair.b", "p.pair.stretch", "t", "p.side", "seq")
    placed = placed.repartition("a", "b", "stretch").sortWithinPartitions("a", "b", "t", "side", "seq")
    return placed.select("a", "b", "t", "side", "seq").mapInArrow(_two_pointers(tolerance), ALIGNED)


def _onset() -> Column:
    return F.coalesce((F.col("rms_rise_peak_db") >= 3) | (F.col("spectral_flux_peak") >= 0.18), F.lit(False)) & F.coalesce("temporal_valid", F.lit(False))


def _joined(aligned: DataFrame, side: DataFrame) -> DataFrame:
    """Aligned pairs with both frames' columns of ``side`` (arrival_seq and values), as <name>_a and <name>_b.

    Merged, because Spark takes frames for smaller than they are (an array counts as one number, and files are compressed) and
    would send some hundred MB through the driver.
    """
    values = [c for c in side.columns if c != "arrival_seq"]
    a, b = (side.select(F.col("arrival_seq").alias(f"{s}_seq"), *[F.col(c).alias(f"{c}_{s}") for c in values]) for s in "ab")
    return aligned.join(a.hint("merge"), "a_seq").join(b.hint("merge"), "b_seq")


def frame_levels(edges: list[tuple[float, float]]) -> Column:
    """An active frame's level in each range of Hz: mean power, in dB, of its bands there above the floor, null without any."""

    def level(low: float, high: float) -> Column:
        inside = [F.get("bands_db", F.lit(i)) for i, c in enumerate(dims.BAND_CENTERS) if low <= c < high]
        if not inside:
            return F.lit(None).cast("double")
        n = sum((F.when(x > X.FLOOR_DB, 1).otherwise(0) for x in inside), F.lit(0))
        return F.when(n > 0, X.db(sum((F.when(x > X.FLOOR_DB, X.power(x)).otherwise(0.0) for x in inside), F.lit(0.0)) / n))

    return F.when(F.col("signal_present") & F.col("bands_db").isNotNull(), F.array(*[level(lo, hi) for lo, hi in edges]))


def _normalised_overlap(levels: DataFrame, by: list[str]) -> DataFrame:
    """``levels`` (level_a, level_b), which is read twice, with least: the smaller relative power, each side relative to its own
    maximum over ``by``, a pair or a pair's region (A09). The maxima are few, so no level is moved for them."""
    tops = levels.groupBy(*by).agg(F.max("level_a").alias("top_a"), F.max("level_b").alias("top_b"))
    relative = [F.pow(F.lit(10.0), (F.col(f"level_{s}") - F.col(f"top_{s}")) / 10) for s in "ab"]
    return levels.join(F.broadcast(tops), by).withColumn("least", F.least(*relative)).drop("top_a", "top_b")


def _of_regions(met: DataFrame) -> DataFrame:
    """Per pair and region of ``met`` (a, b, on_a, on_b, levels_a, levels_b), which is read several times: what ``region_temporal`` returns."""
    key = ["a", "b", "region"]
    both = met.groupBy("a", "b").agg(F.round(F.count_if(F.col("on_a") & F.col("on_b")) / F.count("*"), 6).alias("coactive_ratio"))
    levels = met.where("levels_a is not null and levels_b is not null").select("a", "b", F.posexplode(F.arrays_zip("levels_a", "levels_b")).alias("region", "l"))
    levels = levels.select(*key, F.col("l.levels_a").alias("level_a"), F.col("l.levels_b").alias("level_b")).where("level_a is not null and level_b is not null")
    found = _normalised_overlap(levels, key).groupBy(*key).agg(F.count("*").alias("usable_pairs"), F.round(X.pearson("level_a", "level_b"), 6).alias("band_correlation"), F.avg("least").alias("temporal"))
    return found.join(both, ["a", "b"])


def _side(frames: DataFrame, edges: list[tuple[float, float]], *also: Column) -> DataFrame:
    return frames.select("arrival_seq", F.coalesce("signal_present", F.lit(False)).alias("on"), frame_levels(edges).alias("levels"), *also)


def region_temporal(aligned: DataFrame, frames: DataFrame, edges: list[tuple[float, float]]) -> DataFrame:
    """Per pair and region over aligned frames (C18): usable pairs, coactive ratio, correlation and overlap of its levels.

    Each aligned pair meets its two frames once, with the levels of all regions side by side.
    """
    return _of_regions(cut(_joined(aligned.select("a", "b", "a_seq", "b_seq"), _side(frames, edges)).drop("a_seq", "b_seq")))


def temporal_compare(aligned: DataFrame, frames: DataFrame, low_hz: float = 40.0, high_hz: float = 160.0) -> DataFrame:
    """Two tracks over aligned frames (T19): onsets together (P07), correlations of flux and of the level between ``low_hz``
    and ``high_hz`` (A08), and the level's overlap (A09)."""
    also = F.when(F.col("temporal_valid"), F.col("spectral_flux_mean")).alias("flux"), _onset().alias("onset")
    met = cut(_joined(aligned, _side(frames, [(low_hz, high_hz)], *also)).drop("a_seq", "b_seq"))
    both = met.groupBy("a", "b").agg(
        F.count("*").alias("aligned"),
        F.count_if(F.col("onset_a") & F.col("onset_b")).alias("onsets_together"),
        F.round(X.pearson("flux_a", "flux_b"), 4).alias("correlation"),
        F.round(F.avg(F.abs("dt")), 6).alias("mean_abs_dt"),
    )
    return both.join(_of_regions(met).select("a", "b", "usable_pairs", "coactive_ratio", "band_correlation", F.round("temporal", 6).alias("band_overlap")), ["a", "b"], "left")


def temporal_overlap(aligned: DataFrame, frames: DataFrame, value: str = "rms_db") -> DataFrame:
    """Mean of the smaller relative power over aligned frames, each side relative to its own maximum."""
    met = cut(_joined(aligned, frames.select("arrival_seq", F.col(value).alias("level"))).select("a", "b", "level_a", "level_b"))
    return _normalised_overlap(met, ["a", "b"]).groupBy("a", "b").agg(F.avg("least").alias("temporal"))


def evidence(erb: DataFrame, pairs: DataFrame, temporal: DataFrame, k: int = 8) -> DataFrame:
    """Interaction evidence per pair and ERB region (C01), the k strongest of each pair.

    spectral is the overlap weighted towards the louder track; combined adds the region's overlap in time, if any.
    """
    bands = overlap(erb, pairs, "erb_db", "erb").join(temporal.withColumnRenamed("region", "band"), ["a", "b", "band"], "left")
    w = X.direction_weight(F.col("db_a") - F.col("db_b"))
    sides = {"ab": F.col("overlap") * w, "ba": F.col("overlap") * (1 - w)}
    combined = {d: c * (0.25 + 0.75 * F.col("temporal")) for d, c in sides.items()}
    strength = F.greatest(*[F.coalesce(combined[d], sides[d]) for d in sides])
    rounded = bands.select(
        "a", "b", F.col("band").alias("erb"), F.round("overlap", 6).alias("overlap"),
        *[F.round(c, 6).alias(f"spectral_{d}") for d, c in sides.items()], *[F.round(c, 6).alias(f"combined_{d}") for d, c in combined.items()],
        "usable_pairs", "coactive_ratio", "band_correlation", F.round("temporal", 6).alias("temporal"), F.round(strength, 6).alias("strength"),
    )
    order = Window.partitionBy("a", "b").orderBy(F.desc("strength"), "erb")
    return rounded.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def evidence_score(rows: DataFrame, least: int = 4) -> DataFrame:
    """Mean strength of each pair's strongest ``least`` regions."""
    return rows.where(F.col("rank") <= least).groupBy("a", "b").agg(F.round(F.avg("strength"), 5).alias("score"))


def directional_deltas(levels: DataFrame, pairs: DataFrame, k: int = 3, region: str = "region", value: str = "region_db") -> DataFrame:
    """The k regions of a pair where its tracks differ most (X43, O09): b's level less a's, and the stronger track."""
    a, b = (levels.select(F.col("runtime_id").alias(s), region, F.col(value).alias(f"db_{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, ["b", region]).withColumn("delta_db", F.round(F.col("db_b") - F.col("db_a"), 5)).where("delta_db is not null")
    stronger = F.when(F.col("delta_db") > 0, F.col("b")).when(F.col("delta_db") < 0, F.col("a"))
    w = Window.partitionBy("a", "b").orderBy(F.desc(F.abs("delta_db")), region)
    return both.select("a", "b", region, "delta_db", stronger.alias("stronger"), F.row_number().over(w).cast("int").alias("rank")).where(F.col("rank") <= k)
