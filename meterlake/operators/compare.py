"""Named project states: capture, compare, verify. A state is a small table, one row per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

METRICS = ["rms_db", "crest_db", "centroid_hz", "stereo_correlation", "stereo_width", "active_ratio"]


def compare(before: DataFrame, after: DataFrame, on: str = "runtime_id", metrics: list[str] = METRICS) -> DataFrame:
    """Every track of either state: shared, added or removed, with rounded differences (T16; S01-S04, J06)."""
    a, b = (s.select(on, *[F.col(m).alias(f"{m}_{n}") for m in metrics], F.lit(True).alias(f"in_{n}")) for s, n in ((before, "a"), (after, "b")))
    both = a.join(b, on, "full")
    state = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_b"), "added").otherwise("removed")
    return both.select(on, state.alias("state"), *[X.delta(f"{m}_a", f"{m}_b").alias(f"{m}_delta") for m in metrics])


def missing(requested: DataFrame, state: DataFrame, on: str = "runtime_id") -> DataFrame:
    """Requested targets that a state lacks."""
    return requested.join(state, on, "left_anti")


def compare_reference(reference: DataFrame, target: DataFrame, reference_rms: DataFrame, target_rms: DataFrame, on: str = "band", value: str = "plain_db") -> DataFrame:
    """Target against a frozen reference, band by band (C13): absolute, and after matching overall level.

    The rms inputs are one row each; a null level makes the normalised difference null.
    """
    r = reference.select(on, F.col(value).alias("r")).crossJoin(F.broadcast(reference_rms.select(F.col("rms_db").alias("rr"))))
    t = target.select(on, F.col(value).alias("t")).crossJoin(F.broadcast(target_rms.select(F.col("rms_db").alias("tr"))))
    return r.join(t, on).select(on, F.round(F.col("t") - F.col("r"), 4).alias("absolute_db"), F.round(F.col("t") + F.col("rr") - F.col("tr") - F.col("r"), 4).alias("normalised_db"))


def compare_mono_groups(reference: DataFrame, target: DataFrame, on: str = "region") -> DataFrame:
    """Target's mono fold against a reference's, region by region (C13); regions that either lacks have no row."""
    r = reference.select(on, F.col("delta_db").alias("r"), F.col("floor_censored").alias("reference_floor_censored"))
    t = target.select(on, F.col("delta_db").alias("t"), F.col("floor_censored").alias("target_floor_censored"))
    return r.join(t, on).select(on, X.delta("r", "t").alias("mono_delta_db"), "reference_floor_censored", "target_floor_censored")


#: What a track's place in a project is; its identity is its slot, or its id where it is not bound.
TOPOLOGY = ["analyzer_name", "fl_track_index", "fl_track_name", "identity", "runtime_id", "slot"]


def identity() -> Column:
    bound = F.concat(F.lit("mixer:"), F.col("fl_track_index").cast("string"), F.lit("/slot:"), F.col("slot").cast("string"))
    return F.coalesce(bound, F.col("runtime_id"))


def fingerprint(tracks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fingerprint of a project's topology (X26): the first 16 digits of the SHA-256 of its tracks as canonical JSON, by identity.

    ``tracks`` has runtime_id, and of analyzer_name, fl_track_index, fl_track_name and slot those that are known; others are null. A project has 64 tracks at most.
    """
    known = tracks.withColumns({c: F.lit(None).cast("int" if c in ("fl_track_index", "slot") else "string") for c in TOPOLOGY if c not in tracks.columns and c != "identity"}).withColumn("identity", identity())
    every = F.transform(F.array_sort(F.collect_list(F.struct("identity", F.struct(*TOPOLOGY).alias("track")))), lambda x: x["track"])
    text = F.to_json(every, {"ignoreNullFields": "false"})
    return known.groupBy(*(by or [])).agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def verify(before: DataFrame, after: DataFrame, on: str = "runtime_id") -> DataFrame:
    """Recent verification per track (C10): controlled if both states have it and its activity moved by at most 0.15."""
    rows = compare(before, after, on)
    return rows.withColumn("controlled", (F.col("state") == "shared") & F.coalesce(F.abs("active_ratio_delta") <= 0.15, F.lit(False)))


def verify_range(before: DataFrame, after: DataFrame, minimum: float = 0.8) -> DataFrame:
    """Range verification per track (C11): both ranges adequate, the later pass received after the fence, no new drops."""
    a, b = (s.select("runtime_id", *[F.col(c).alias(f"{c}_{n}") for c in ("transport_epoch", "coverage_ratio", "rms_db", "dropped_blocks", "last_received_at", "first_received_at")]) for s, n in ((before, "a"), (after, "b")))
    j = a.join(b, "runtime_id", "left")
    reason = (
        F.when(F.col("coverage_ratio_b").isNull(), "missing_after")
        .when(F.least("coverage_ratio_a", "coverage_ratio_b") < minimum, "insufficient_coverage")
        .when(F.col("first_received_at_b") <= F.col("last_received_at_a"), "stale_after")
        .when(F.col("dropped_blocks_b") > F.col("dropped_blocks_a"), "dropped_blocks")
    )
    return j.select("runtime_id", F.col("transport_epoch_a").alias("before_epoch"), F.col("transport_epoch_b").alias("after_epoch"), X.delta("rms_db_a", "rms_db_b").alias("rms_delta"), reason.isNull().alias("controlled"), reason.alias("reason"))
