"""Aggregates over a recent window, for all tracks in one group-by.

``as_of`` is a parameter: no plan reads a clock. Means are over active frames; disabled families are null
already and stay so. Per-band results are long: one row per track and band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import expr as X
from . import compare


def window(frames: DataFrame, as_of: float, seconds: float, lo: float = 0.1, hi: float = 60.0) -> DataFrame:
    """Frames received in the last seconds, clamped."""
    return frames.where((F.col("received_at") >= as_of - min(hi, max(lo, seconds))) & (F.col("received_at") <= as_of))


def active(c: str) -> Column:
    return F.when(F.col("signal_present"), F.col(c))


def average(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Summary of each track (T07; A01-A04, A22)."""
    return frames.groupBy(by).agg(
        F.count("*").alias("frames"),
        F.count_if("signal_present").alias("active_frames"),
        F.round(F.count_if("signal_present") / F.count("*"), 4).alias("active_ratio"),
        F.round(F.max("peak_db"), 4).alias("peak_db"),
        F.round(X.power_mean(active("rms_db")), 4).alias("rms_db"),
        F.round(X.power_mean(active("lufs_s")), 4).alias("lufs_s"),
        F.round(F.avg(active("crest_db")), 4).alias("crest_db"),
        F.round(F.avg(active("centroid_hz")), 2).alias("centroid_hz"),
        F.round(F.avg(active("stereo_correlation")), 4).alias("stereo_correlation"),
        F.round(F.min(active("stereo_correlation")), 4).alias("stereo_correlation_min"),
        F.round(F.avg(active("stereo_width")), 4).alias("stereo_width"),
        F.round(F.max_by("true_peak_dbtp", F.when(F.col("true_peak_dbtp").isNotNull(), F.col("arrival_seq"))), 4).alias("true_peak_latest"),
    )


def bands(frames: DataFrame, column: str = "bands_db", by: str = "runtime_id") -> DataFrame:
    """Frames' band arrays in long form: (by, band, x)."""
    return frames.where(f"signal_present and {column} is not null").select(by, F.posexplode(column).alias("band", "x"))


def band_means(frames: DataFrame, column: str = "bands_db", by: str = "runtime_id") -> DataFrame:
    """The dB mean rules of a band side by side.

    plain: all values; above: values above -120 only; zero: values at or below -120 count as no power and the
    mean is floored at -120; ratio: arithmetic.
    """
    zero = F.avg(F.when(F.col("x") > X.FLOOR_DB, X.power("x")).otherwise(0.0))
    return bands(frames, column, by).groupBy(by, "band").agg(
        F.round(X.band_power_mean("x"), 4).alias("plain_db"),
        F.round(X.power_mean("x"), 4).alias("above_db"),
        F.round(X.db(zero), 4).alias("zero_db"),
        F.round(F.avg("x"), 4).alias("ratio_db"),
    )


def temporal_profile(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Change measures of a window over frames where they are valid, flux weighted by the time it stands for (T18; A07, P07)."""
    onset = F.coalesce(F.col("rms_rise_peak_db") >= 3, F.lit(False)) | F.coalesce(F.col("spectral_flux_peak") >= 0.18, F.lit(False))
    seconds = F.greatest(F.lit(0.0), F.coalesce("temporal_window_seconds", F.lit(0.0)))
    valid = lambda c: F.when(F.col("temporal_valid"), F.col(c))
    weight = F.when(F.col("temporal_valid"), F.greatest(F.lit(1e-6), seconds))
    return frames.groupBy(by).agg(
        F.count_if("temporal_valid").alias("valid_frames"),
        F.count_if(onset & F.col("temporal_valid")).alias("onsets"),
        F.round(X.weighted_mean("spectral_flux_mean", weight), 6).alias("flux_mean"),
        F.round(F.max(valid("spectral_flux_peak")), 6).alias("flux_peak"),
        F.round(F.max(valid("rms_rise_peak_db")), 4).alias("rise_peak_db"),
    )


def spectral_shape(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Means of rolloff and flatness over active frames (T07; A03)."""
    return frames.groupBy(by).agg(F.round(F.avg(active("rolloff_hz")), 2).alias("rolloff_hz"), F.round(F.avg(active("flatness")), 6).alias("flatness"))


def project_state(frames: DataFrame, bindings: DataFrame) -> DataFrame:
    """What a snapshot keeps of each track (T14, K03): its whole average of the window, with band levels (32, null where no active frame
    has the band), its place in the mixer, and whether there was anything to analyse."""
    levels = band_means(frames).groupBy("runtime_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "plain_db"))).alias("level"))  # 32 at most
    levels = levels.select("runtime_id", F.transform(F.sequence(F.lit(0), F.lit(len(dims.BAND_CENTERS) - 1)), lambda i: F.try_element_at("level", i)).alias("bands_db"))
    last = frames.groupBy("runtime_id").agg(F.max_by(F.struct("track", "signal_present"), "arrival_seq").alias("l")).select("runtime_id", F.col("l.track").alias("analyzer_name"), "l.signal_present")
    whole = average(frames).join(spectral_shape(frames), "runtime_id").join(last, "runtime_id").join(levels, "runtime_id", "left").join(bindings, "runtime_id", "left")
    return whole.withColumns({"identity": compare.identity(), "analysis_valid": F.col("active_frames") > 0})


def low_band_profile(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Seconds observed, density of onsets, flux weighted by time, and the energy of 40-160 Hz.

    Only frames whose change measures are valid count. Levels at or below -120 dB are left out of the mean; the density is null where no time was observed.
    """
    valid = frames.where("temporal_valid")
    seconds = F.greatest(F.lit(0.0), F.coalesce("temporal_window_seconds", F.lit(0.0)))
    onset = F.coalesce(F.col("rms_rise_peak_db") >= 3, F.lit(False)) | F.coalesce(F.col("spectral_flux_peak") >= 0.18, F.lit(False))
    return valid.groupBy(by).agg(
        F.round(F.sum(seconds), 4).alias("observed_seconds"),
        F.round(F.try_divide(F.count_if(onset).cast("double"), F.sum(seconds)), 4).alias("onset_density_hz"),
        F.round(X.weighted_mean("spectral_flux_mean", F.greatest(F.lit(1e-6), seconds)), 6).alias("flux_mean"),
        F.round(X.power_mean("low_band_energy_db"), 4).alias("low_band_db"),
        F.round(F.min("low_band_energy_db"), 4).alias("low_band_min_db"),
        F.round(F.max("low_band_energy_db"), 4).alias("low_band_max_db"),
    )


def mid_side_profile(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Mid and side levels, decorrelation, negative cross energy and the band of 20-120 Hz (T22; A03, A04, A06)."""
    valid = frames.where("signal_present and stereo_valid")
    return valid.groupBy(by).agg(
        F.round(X.power_mean("mid_rms_db"), 4).alias("mid_rms_db"),
        F.round(X.power_mean("side_rms_db"), 4).alias("side_rms_db"),
        F.round(X.band_power_mean("side_to_mid_db"), 4).alias("side_to_mid_db"),
        F.round(F.avg(1 - F.abs("stereo_correlation")), 6).alias("decorrelation_mean"),
        F.round(F.avg("negative_cross_energy_ratio"), 6).alias("negative_cross_mean"),
        F.round(F.max("negative_cross_energy_ratio"), 6).alias("negative_cross_max"),
        F.round(F.avg("low_band_20_120_correlation"), 6).alias("low_band_correlation"),
        F.round(F.min("low_band_20_120_correlation"), 6).alias("low_band_correlation_min"),
        F.round(X.band_power_mean("low_band_20_120_side_to_mid_db"), 4).alias("low_band_side_to_mid_db"),
        F.round(F.max("low_band_20_120_side_to_mid_db"), 4).alias("low_band_side_to_mid_max_db"),
    )


#: Measures of ``mid_side_profile`` that two tracks are compared by.
MID_SIDE = ["mid_rms_db", "side_rms_db", "side_to_mid_db", "decorrelation_mean", "negative_cross_mean", "low_band_correlation", "low_band_side_to_mid_db"]


def mid_side_compare(profile: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Differences of all pairs of tracks, the second minus the first (T23); one row a track goes in."""
    a, b = (profile.select(F.col(by).alias(n), *[F.col(m).alias(f"{m}_{n}") for m in MID_SIDE]) for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", *[X.delta(f"{m}_a", f"{m}_b").alias(f"{m}_delta") for m in MID_SIDE])


def harmonic_profile(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """How far one harmonic series explains the spectrum, and the candidates for its fundamental (T24; A12)."""
    f0 = F.when(F.col("harmonic_f0_candidate_hz") > 0, F.col("harmonic_f0_candidate_hz"))
    return frames.where("signal_present and semantic_valid").groupBy(by).agg(
        F.round(F.avg("single_f0_harmonic_energy_ratio"), 6).alias("harmonic_mean"),
        F.round(F.max("single_f0_harmonic_energy_ratio"), 6).alias("harmonic_max"),
        F.round(F.percentile(f0, 0.5), 4).alias("f0_median_hz"),
        F.round(F.min(f0), 4).alias("f0_min_hz"),
        F.round(F.max(f0), 4).alias("f0_max_hz"),
    )


def stereo_profile(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Stereo measures of active frames with the family on (T22), with the correlation's label."""
    out = frames.where("signal_present and stereo_valid").groupBy(by).agg(
        F.count("*").alias("frames"),
        F.round(F.avg("stereo_correlation"), 4).alias("correlation_mean"),
        F.round(F.min("stereo_correlation"), 4).alias("correlation_min"),
        F.round(F.max("stereo_correlation"), 4).alias("correlation_max"),
        F.round(F.avg("stereo_width"), 4).alias("width_mean"),
        F.round(F.avg(F.when(F.col("stereo_correlation") < 0, 1.0).otherwise(0.0)), 4).alias("negative_ratio"),
    )
    return out.withColumn("label", X.correlation_label("correlation_mean"))


def performance(frames: DataFrame) -> DataFrame:
    """Frames and load by analysis profile (T27; A13)."""
    name = F.when(F.col("analysis_feature_mask") == 1, "eco").when(F.col("analysis_feature_mask") == 15, "balanced").when(F.col("analysis_feature_mask") == 31, "mix").otherwise("full")
    return frames.groupBy(name.alias("profile")).agg(
        F.count("*").alias("frames"), F.count_distinct("runtime_id").alias("tracks"), F.max("estimated_analysis_lag_ms").alias("max_lag_ms"), F.round(F.avg("estimated_analysis_lag_ms"), 4).alias("mean_lag_ms"), F.sum("dropped_blocks").alias("dropped")
    )


def master_warnings(frames: DataFrame) -> DataFrame:
    """Warnings of single frames (T11, P10) as one text each."""
    rules = X.warnings(
        (F.col("true_peak_dbtp") > 0, "true_peak_over_0"),
        ((F.col("true_peak_dbtp") > -1) & (F.col("true_peak_dbtp") <= 0), "true_peak_over_-1"),
        (F.col("peak_db") > -0.1, "sample_peak_near_0"),
        (F.col("stereo_correlation") < 0, "negative_correlation"),
        (F.col("crest_db") < 4, "low_crest"),
    )
    return frames.select("arrival_seq", F.array_join(rules, ",").alias("warnings")).where("warnings != ''")


def regions(means: DataFrame, value: str = "plain_db", by: str = "runtime_id") -> DataFrame:
    """Region levels from band means (X09): power mean of the bands whose centre lies inside."""
    region = F.get(F.array(*[F.lit(dims.region_of(c)) for c in dims.BAND_CENTERS]), F.col("band"))
    return means.groupBy(by, region.alias("region")).agg(F.round(X.band_power_mean(value), 4).alias("region_db"))


def erb_bands(means: DataFrame, value: str = "plain_db", by: str = "runtime_id") -> DataFrame:
    """16 equal ERB-rate bands from 32 (X07); a band without a centre has no row."""
    erb = F.get(F.array(*[F.lit(dims.erb_of(c)).cast("int") for c in dims.BAND_CENTERS]), F.col("band"))
    return means.groupBy(by, erb.alias("erb")).agg(F.round(X.band_power_mean(value), 4).alias("erb_db")).where("erb is not null")


def chroma(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Weighted mean chroma per track, summing to 1 (A11): (by, pitch, share)."""
    long = frames.where("signal_present and chroma is not null and chroma_energy_ratio is not null").select(
        by, F.greatest(F.lit(1e-6), F.col("chroma_energy_ratio")).alias("w"), F.posexplode("chroma").alias("pitch", "x")
    )
    sums = long.groupBy(by, "pitch").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    return sums.withColumn("share", F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy(by)))).select(by, "pitch", "share")


def keys(shares: DataFrame, profiles: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Correlation of each track's chroma with the 24 key profiles (J08), ranked."""
    scored = shares.join(F.broadcast(profiles), "pitch").groupBy(by, "key").agg(F.corr("share", "weight").alias("raw"))
    scored = scored.withColumn("score", F.round("raw", 4)).drop("raw")
    w = Window.partitionBy(by).orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w).cast("int"))


def chroma_shape(shares: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Shares as an array, with its entropy."""
    arrays = shares.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pitch", "share"))), lambda x: x["share"]).alias("shares"))
    return arrays.withColumn("entropy", F.round(X.entropy("shares", 12), 4))


def tonal_compare(shapes: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Cosine and Jensen-Shannon divergence of all pairs of tracks (T25; X12, X13, J04)."""
    a, b = shapes.select(F.col(by).alias("a"), F.col("shares").alias("sa")), shapes.select(F.col(by).alias("b"), F.col("shares").alias("sb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.cosine("sa", "sb"), 4).alias("cosine"), F.round(X.jensen_shannon("sa", "sb"), 4).alias("divergence"))


def mono_fold(mid: DataFrame, side: DataFrame, by: str = "runtime_id") -> DataFrame:
    """What folding to mono takes from each band (C12); mid and side are band means under the zero rule."""
    p = lambda c: F.when(F.col(c) > X.FLOOR_DB, X.power(c)).otherwise(0.0)
    both = mid.select(by, "band", F.col("zero_db").alias("mid_db")).join(side.select(by, "band", F.col("zero_db").alias("side_db")), [by, "band"])
    both = both.withColumns({"m": p("mid_db"), "s": p("side_db")}).where("m + s > 0")
    total = F.col("m") + F.col("s")
    floored = F.col("m") <= 1e-12
    loss = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("m") / total))
    top = F.max(total).over(Window.partitionBy(by))
    return both.select(
        by,
        "band",
        F.round(10 * F.log10(F.when(floored, F.lit(1e-12)).otherwise(F.col("m")) / total), 4).alias("delta_db"),
        floored.alias("floor_censored"),
        F.round(loss, 4).alias("loss"),
        F.round(total / top * loss, 4).alias("priority"),
    )


def mono_groups(mid: DataFrame, side: DataFrame, by: str = "runtime_id") -> DataFrame:
    """What folding to mono takes from each of the five regions (C12): the powers of a region's bands are summed first."""
    p = lambda c: F.when(F.col(c) > X.FLOOR_DB, X.power(c)).otherwise(0.0)
    region = F.get(F.array(*[F.lit(dims.region_of(c)) for c in dims.BAND_CENTERS]), F.col("band"))
    both = mid.select(by, "band", p("zero_db").alias("m")).join(side.select(by, "band", p("zero_db").alias("s")), [by, "band"])
    sums = both.where("m + s > 1e-12").groupBy(by, region.alias("region")).agg(F.count("*").alias("centers"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    total = F.col("m") + F.col("s")
    loss = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("m") / total))
    share = total / F.max(total).over(Window.partitionBy(by))
    return sums.select(
        by,
        "region",
        "centers",
        F.round(10 * F.log10(F.greatest(F.col("m"), F.lit(1e-12)) / total), 4).alias("delta_db"),
        (F.col("m") <= 1e-12).alias("floor_censored"),
        F.round(loss, 6).alias("loss"),
        F.round(share, 6).alias("share"),
        F.round(share * F.round(loss, 6), 6).alias("priority"),
    )


def stereo_bands(latest: DataFrame) -> DataFrame:
    """The latest frame's correlation by stereo band, with a label (T08, P09); none while the stereo family is off or nothing sounds."""
    b = latest.where("signal_present and stereo_valid and band_stereo_correlation is not null").select("runtime_id", F.posexplode("band_stereo_correlation").alias("stereo_band", "correlation"))
    ranges = F.element_at(F.array(*[F.lit(dims.band_label(lo, hi)) for lo, hi in zip(dims.STEREO_EDGES[:-1], dims.STEREO_EDGES[1:], strict=True)]), F.col("stereo_band") + 1)
    return b.select("runtime_id", "stereo_band", ranges.alias("range"), "correlation", X.correlation_label("correlation").alias("label"))


def stereo_band_means(frames: DataFrame, by: str = "runtime_id") -> DataFrame:
    """Mean correlation and mean side-to-mid ratio of each stereo band (A10); ratios are averaged as powers."""
    ok = frames.where("signal_present and stereo_valid and size(band_stereo_correlation) = size(band_side_to_mid_db)")
    long = ok.select(by, F.posexplode(F.arrays_zip("band_stereo_correlation", "band_side_to_mid_db")).alias("stereo_band", "x"))
    ratio = F.avg(F.pow(F.lit(10.0), F.col("x.band_side_to_mid_db") / 10))
    return long.groupBy(by, "stereo_band").agg(F.round(F.avg("x.band_stereo_correlation"), 6).alias("correlation"), F.round(10 * F.log10(F.greatest(ratio, F.lit(1e-12))), 4).alias("side_to_mid_db"))


def load(frames: DataFrame, seconds: float = 1.0, by: str = "runtime_id") -> DataFrame:
    """Frames, lag and losses of a track in each stretch of ``seconds``."""
    return frames.groupBy(by, F.floor(F.col("received_at") / seconds).alias("stretch")).agg(
        F.count("*").alias("frames"), F.round(F.count("*") / seconds, 4).alias("frames_per_second"), F.round(F.max("estimated_analysis_lag_ms"), 6).alias("max_lag_ms"), F.sum("dropped_blocks").alias("dropped")
    )
