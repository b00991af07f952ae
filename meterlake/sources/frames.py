"""Measurement frames: from wire messages, from the event tables, and back to wire messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X

#: Positions of the wire message's scalar fields, by layer.
BASE = "track sample_rate plugin_timestamp peak_db rms_db crest_db centroid_hz rolloff_hz flatness stereo_correlation stereo_width".split()
LOUDNESS = {43: "lufs_s", 44: "lufs_i", 45: "true_peak_dbtp", 46: "max_true_peak_dbtp"}
VALIDITY = {56: "detector_peak_db", 57: "silence_seconds"}
TEMPORAL = {59: "temporal_window_seconds", 60: "spectral_flux_mean", 61: "spectral_flux_peak", 62: "rms_rise_peak_db", 63: "low_band_energy_db"}
STEREO = {65: "mid_rms_db", 66: "side_rms_db", 67: "side_to_mid_db", 68: "negative_cross_energy_ratio", 69: "low_band_20_120_correlation", 70: "low_band_20_120_side_to_mid_db"}
SEMANTIC = {124: "chroma_energy_ratio", 125: "single_f0_harmonic_energy_ratio", 126: "harmonic_f0_candidate_hz"}
RUNTIME = {130: "worker_load_ratio", 131: "fifo_fill_ratio", 132: "fft_runs_per_second", 133: "semantic_runs_per_second"}
TRANSPORT = {136: "transport_time_seconds", 137: "transport_ppq_position", 138: "transport_bpm", 144: "transport_loop_start_ppq", 145: "transport_loop_end_ppq", 147: "estimated_analysis_lag_ms"}
TRANSPORT_INTS = {139: "transport_time_signature_numerator", 140: "transport_time_signature_denominator", 146: "transport_epoch"}
TRANSPORT_FLAGS = {141: "transport_is_playing", 142: "transport_is_recording", 143: "transport_is_looping"}
ARRAYS = {"bands_db": (11, 32, 43), "band_stereo_correlation": (47, 8, 55), "side_bands_db": (71, 32, 112), "band_side_to_mid_db": (103, 8, 112), "chroma": (112, 12, 128)}
SIGNAL_GATE_DB = -50.0
#: Families of the feature mask, and the columns each governs.
FAMILIES = {
    "loudness": ["lufs_s", "lufs_i", "true_peak_dbtp", "max_true_peak_dbtp"],
    "spectrum": ["centroid_hz", "rolloff_hz", "flatness", "bands_db"],
    "stereo": ["stereo_correlation", "stereo_width", "band_stereo_correlation", "side_bands_db", "band_side_to_mid_db", *STEREO.values()],
    "temporal": list(TEMPORAL.values()),
    "semantic": ["chroma", *SEMANTIC.values()],
}


def parse_wire(raw: DataFrame) -> DataFrame:
    """Rows (args array<string>, received_at double, arrival_seq long) to frames, in one projection.

    Layers count as present by argument count; a message of fewer than 43 arguments is dropped. Values
    that are no finite number are null.
    """
    size = F.size("args")

    def at(i: int, least: int) -> Column:
        return F.when(size >= least, F.get("args", F.lit(i)))

    def number(i: int, least: int) -> Column:
        return X.finite(at(i, least))

    def clamp(c: Column, lo: float, hi: float) -> Column:
        return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))

    columns = {"track": at(0, 43)} | {name: number(i, 43) for i, name in enumerate(BASE) if i}
    for least, fields in ((47, LOUDNESS), (59, VALIDITY), (65, TEMPORAL), (112, STEREO), (128, SEMANTIC), (135, RUNTIME), (150, TRANSPORT)):
        columns |= {name: number(i, least) for i, name in fields.items()}
    columns |= {name: number(i, 150).cast("int") for i, name in TRANSPORT_INTS.items()}
    columns |= {name: number(i, 150) != 0 for i, name in TRANSPORT_FLAGS.items()}
    for name, (i, n, least) in ARRAYS.items():
        columns[name] = F.when(size >= least, F.transform(F.slice("args", i + 1, n), X.finite))
    for name in ("temporal_window_seconds", "spectral_flux_mean", "spectral_flux_peak", "rms_rise_peak_db"):
        columns[name] = F.when(columns[name].isNotNull(), F.greatest(F.lit(0.0), columns[name]))
    columns["negative_cross_energy_ratio"] = clamp(columns["negative_cross_energy_ratio"], 0, 1)
    columns["low_band_20_120_correlation"] = clamp(columns["low_band_20_120_correlation"], -1, 1)
    total = F.aggregate(columns["chroma"], F.lit(0.0), lambda acc, x: acc + x)
    columns["chroma"] = F.when(total > 1e-12, F.transform(columns["chroma"], lambda x: x / total))
    has_id = size >= 59
    columns["runtime_id"] = F.when(has_id, at(58, 59)).otherwise(F.concat(F.lit("legacy:"), F.lower(at(0, 43))))
    columns["signal_present"] = F.when(has_id, number(55, 59) != 0).otherwise(columns["peak_db"] >= SIGNAL_GATE_DB)
    columns["analysis_feature_mask"] = F.coalesce(number(129, 135).cast("int"), F.lit(63))
    columns["analysis_profile_index"] = number(128, 135).cast("int")
    columns["transport_v12_supported"] = F.coalesce(number(135, 150) != 0, F.lit(False))
    columns["dropped_blocks"] = F.coalesce(number(148, 150).cast("long"), F.lit(0))
    columns["schema_version"] = F.coalesce(at(149, 150), at(134, 135), at(127, 128), at(111, 112), at(64, 65))
    parsed = raw.where(size >= 43).select("received_at", "arrival_seq", *[c.alias(n) for n, c in columns.items()])
    return mask_families(parsed)


def mask_families(frames: DataFrame, mask: str = "analysis_feature_mask") -> DataFrame:
    """Columns of disabled families become null, whatever the message held."""
    bits = X.features(mask)
    present = set(frames.columns)
    out = {c: F.when(bits[family], F.col(c)) for family, names in FAMILIES.items() for c in names if c in present}
    return frames.withColumns(out).withColumns({"spectrum_valid": bits["spectrum"], "stereo_valid": bits["stereo"], "temporal_valid": bits["temporal"], "semantic_valid": bits["semantic"]})


def to_wire(frames: DataFrame) -> DataFrame:
    """Frames back to (args, received_at, arrival_seq): the sink's message of 150 arguments."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double").cast("string"), F.lit("nan"))

    fields: dict[int, Column] = {i: text(n) for i, n in enumerate(BASE) if i} | {0: F.col("track")}
    for part in (LOUDNESS, VALIDITY, TEMPORAL, STEREO, SEMANTIC, RUNTIME, TRANSPORT, TRANSPORT_INTS):
        fields |= {i: text(n) for i, n in part.items()}
    fields |= {i: F.when(F.col(n), "1").otherwise("0") for i, n in TRANSPORT_FLAGS.items()}
    fields |= {55: F.when(F.col("signal_present"), "1").otherwise("0"), 58: F.col("runtime_id"), 64: F.lit("0.6"), 111: F.lit("0.8"), 127: F.lit("0.9"), 134: F.lit("1.1"), 149: F.lit("1.2")}
    fields |= {128: text("analysis_profile_index"), 129: text("analysis_feature_mask"), 135: F.when(F.col("transport_v12_supported"), "1").otherwise("0"), 148: text("dropped_blocks")}
    for name, (i, n, _) in ARRAYS.items():
        fields |= {i + j: F.coalesce(F.get(name, F.lit(j)).cast("string"), F.lit("nan")) for j in range(n)}
    return frames.select(F.array(*[fields[i] for i in range(150)]).alias("args"), "received_at", "arrival_seq")


def from_events(events: DataFrame, sectioned: bool = False) -> DataFrame:
    """Event rows as frames of five tracks and two passes (arithmetic only, so SQL can follow it).

    One song second is four hours of events; frames count as received on the song clock. ``sectioned`` lifts every other block of 24 seconds by 9 dB.
    """
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    base = events.select("event_id", "user_id", "event_type", "value", us.alias("us"), k.alias("k"))
    t = (F.col("us") - 1704067200000000) / F.lit(1.44e10)
    lift = F.when(F.floor(t / 24) % 2 == 1, F.lit(9.0)).otherwise(F.lit(0.0)) if sectioned else F.lit(0.0)
    rms = 20 * F.log10(F.greatest(F.col("value") / 500, F.lit(1e-9))) + lift
    base = base.select("event_id", "k", "user_id", "event_type", "us", t.alias("transport_time_seconds"), rms.alias("rms_db"))
    active = F.col("rms_db") > -50
    when_active = lambda c: F.when(active, c).otherwise(F.lit(0.0))
    k = F.col("k")
    frames = base.select(
        F.concat(F.lit("rt-"), F.col("event_type")).alias("runtime_id"),
        F.col("event_type").alias("track"),
        F.col("event_id").alias("arrival_seq"),
        F.col("transport_time_seconds").alias("received_at"),
        (1 + F.col("user_id") % 2).cast("int").alias("transport_epoch"),
        "transport_time_seconds",
        active.alias("signal_present"),
        F.when(k % 10 == 3, k / 10.0).otherwise(0.0).alias("silence_seconds"),
        "rms_db",
        (k / 8.3).alias("crest_db"),
        (F.col("rms_db") + k / 8.3).alias("peak_db"),
        (F.col("rms_db") + k / 8.3 + 0.3).alias("true_peak_dbtp"),
        F.when(k % 10 != 0, F.col("rms_db") - 1).alias("lufs_s"),
        when_active(200.0 + 350.0 * k / 7.1).alias("centroid_hz"),
        when_active(1 - k / 51.7).alias("stereo_correlation"),
        when_active(k / 41.3).alias("stereo_width"),
        when_active(k / 413.0).alias("spectral_flux_mean"),
        when_active(k / 207.0).alias("spectral_flux_peak"),
        when_active(k / 16.3).alias("rms_rise_peak_db"),
        when_active(900.0 + 110.0 * k / 7.1).alias("rolloff_hz"),
        when_active(k / 131.0).alias("flatness"),
        ((1 + k % 5) / 50.0).alias("temporal_window_seconds"),
        (F.col("rms_db") - k / 7.7).alias("low_band_energy_db"),
        (F.col("rms_db") - 0.7).alias("mid_rms_db"),
        (F.col("rms_db") - k / 5.3).alias("side_rms_db"),
        (-k / 6.1).alias("side_to_mid_db"),
        (k / 111.0).alias("negative_cross_energy_ratio"),
        (1 - k / 61.3).alias("low_band_20_120_correlation"),
        (-k / 4.9).alias("low_band_20_120_side_to_mid_db"),
        (k / 121.0).alias("single_f0_harmonic_energy_ratio"),
        F.when(k % 9 == 0, 0.0).otherwise(55.0 + k * 3.3).alias("harmonic_f0_candidate_hz"),
        F.when(k % 8 == 0, 1).when(k % 8 == 1, 15).when(k % 8 == 2, 31).otherwise(63).alias("analysis_feature_mask"),
        (F.col("event_id") % 7 == 0).cast("long").alias("dropped_blocks"),
        (k * 22.0 / 7.0).alias("estimated_analysis_lag_ms"),
        F.lit(True).alias("transport_is_playing"),
        F.lit(True).alias("transport_v12_supported"),
    )
    return mask_families(frames)


def attach_bands(frames: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Spectra and chroma of frames from a table of shapes, numbered from 0; frame i takes shape i mod their number."""
    n = embeddings.count()
    shapes = embeddings.where("vec_id is not null").dropDuplicates(["vec_id"])
    shapes = shapes.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    square = lambda n: F.aggregate(F.slice("e", 1, n), F.lit(0.0), lambda acc, x: acc + x * x)
    shapes = shapes.withColumns({"low": square(12), "all": square(32)})
    # Up to 10,000 shapes (some 10 MB) travel to the frames; more are joined as Spark sees fit.
    joined = frames.withColumn("vec_id", F.col("arrival_seq") % F.lit(max(1, n))).join(F.broadcast(shapes) if n <= 10_000 else shapes, "vec_id", "left")
    out = joined.withColumns(
        {
            "bands_db": F.transform(F.slice("e", 1, 32), lambda x: F.col("rms_db") + 20 * x),
            "side_bands_db": F.transform(F.slice("e", 33, 32), lambda x: F.col("rms_db") - 9 + 20 * x),
            "chroma": F.transform(F.slice("e", 1, 12), lambda x: x * x / F.col("low")),
            "chroma_energy_ratio": F.col("low") / F.col("all"),
            "band_stereo_correlation": F.transform(F.slice("e", 41, 8), lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 4 * x))),
            "band_side_to_mid_db": F.transform(F.slice("e", 49, 8), lambda x: -9 + 20 * x),
        }
    )
    return mask_families(out.drop("e", "low", "all"))


def bindings(spark: SparkSession) -> DataFrame:
    """Mixer bindings of the event tracks; one names a track that never sends."""
    rows = [("rt-error", 0, "Master", 0), ("rt-click", 1, "Drums", 0), ("rt-purchase", 2, "Bass", 0), ("rt-signup", 3, "Keys", 0), ("rt-gone", 9, "Old", 0)]
    return spark.createDataFrame(rows, "runtime_id string, fl_track_index int, fl_track_name string, slot int")


def last_binds(binds: DataFrame) -> DataFrame:
    """Of bind events (runtime_id, fl_track_index, fl_track_name, slot, seq) the last of each id and the last of each slot, with
    live: an event holds if it is both. So a slot keeps the id bound last, and an id that was bound away stays unbound."""
    event = F.struct("seq", "runtime_id", "fl_track_name", "fl_track_index", "slot")
    last = lambda *by: binds.groupBy(*by).agg(F.max(event).alias("e")).select("e.*")
    ids, slots = last("runtime_id").withColumn("of_id", F.lit(1)), last("fl_track_index", "slot").withColumn("of_id", F.lit(0))
    both = ids.unionByName(slots).groupBy("runtime_id", "fl_track_index", "fl_track_name", "slot", "seq")
    return both.agg((F.count_distinct("of_id") == 2).alias("live"))


def latest_binding(binds: DataFrame) -> DataFrame:
    """The bindings that hold."""
    return last_binds(binds).where("live").select("runtime_id", "fl_track_index", "fl_track_name", "slot")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
