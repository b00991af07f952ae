"""Named captures and verification sessions as tables: one row a session, and frozen states of one row a track.

Requests come as tables too, so many sessions are opened, completed and listed by the same few joins. Nothing
here reads a clock: times are columns or parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import compare, structure

LIMIT = 32
AWAITING, COMPLETED = "awaiting_external_change", "completed"
#: Feature groups of a summary, by the columns any of which tells each.
FEATURES = {
    "core": ["frame_count"], "loudness": ["lufs_s", "true_peak_dbtp"], "spectrum": ["centroid_hz", *structure.REGION_COLUMNS],
    "stereo": ["stereo_correlation", "stereo_width"], "temporal": ["spectral_flux_mean"], "semantic": ["chroma_0"],
}


def _newest(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank: each task sends on as many at most, and only those are numbered."""
    first = rows.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def capture(requests: DataFrame, states: DataFrame, on: str = "name") -> DataFrame:
    """Frozen rows of each named request (T14, T45; K03, K04): ``states`` has one row a (name, track)."""
    named = requests.withColumn(on, F.substring(F.trim(on), 1, 96)).where(F.col(on) != "")
    return named.join(states, on)


def captures(rows: DataFrame, by: list[str], limit: int = 16) -> DataFrame:
    """Captures by name, the newest first, at most ``limit`` (T15, T46): (by, captured_at, tracks, rank)."""
    listed = rows.groupBy(*by).agg(F.max("captured_at").alias("captured_at"), F.count("*").alias("tracks"))
    return _newest(listed, [F.desc("captured_at"), *by], limit)


def features(columns: list[str], suffix: str = "") -> Column:
    """Sorted names of the feature groups that a summary with these columns has (X38); its columns may carry a suffix."""

    def has(c: str) -> Column:
        return F.coalesce(F.col(c + suffix) > 0, F.lit(False)) if c == "frame_count" else F.col(c + suffix).isNotNull()

    found = []
    for name, needs in sorted(FEATURES.items()):
        any_of = F.lit(False)
        for c in needs:
            any_of = any_of | has(c) if c in columns else any_of
        found.append(F.when(any_of, name))
    return F.array_compact(F.array(*found))


def begin(requests: DataFrame, states: DataFrame, valid: Column) -> DataFrame:
    """Sessions with their baselines (T37, T40; K05): requests are (session_id, label, created_at, targets array).

    ``states`` are the baseline rows (session_id, runtime_id, ...), ``valid`` says of a row that it can be compared. Without
    targets all tracks of the baseline are meant. Blockers keep a session from being ready.
    """
    base = states.groupBy("session_id").agg(F.sort_array(F.collect_list("runtime_id")).alias("tracks"), F.sort_array(F.collect_list(F.when(~F.coalesce(valid, F.lit(False)), F.col("runtime_id")))).alias("invalid"))
    out = requests.join(base, "session_id", "left")
    empty = F.array().cast("array<string>")
    targets = F.when(F.size(F.coalesce("targets", empty)) > 0, F.array_sort(F.array_distinct("targets"))).otherwise(F.coalesce("tracks", empty))
    out = out.withColumn("targets", targets)
    missing = F.array_except("targets", F.coalesce("tracks", empty))
    invalid = F.array_intersect("targets", F.coalesce("invalid", empty))
    blockers = F.array_compact(
        F.array(F.when(F.size(F.coalesce("tracks", empty)) == 0, "no_tracks"), F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))), F.when(F.size(invalid) > 0, F.concat(F.lit("invalid:"), F.array_join(invalid, ","))))
    )
    return out.select("session_id", "label", "created_at", "targets", blockers.alias("blockers"), (F.size(blockers) == 0).alias("ready"), F.lit(AWAITING).alias("status"))


def topology(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether a session's two states have the same tracks in the same places: (session_id, same_topology)."""
    a, b = (compare.fingerprint(s, ["session_id"]).withColumnRenamed("fingerprint", n) for s, n in ((before, "a"), (after, "b")))
    return a.join(b, "session_id", "full").select("session_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_topology"))


def compare_targets(sessions: DataFrame, before: DataFrame, after: DataFrame, checks: dict[str, Column], metrics: list[str] = compare.METRICS) -> DataFrame:
    """One row per session and target (T38, T41; C10, C11, C20): deltas, features that both sides have, failed checks.

    States are (session_id, runtime_id, ...); ``checks`` are named conditions over their columns, as <name>_a and <name>_b.
    """
    a, b = (s.select("session_id", "runtime_id", *[F.col(c).alias(f"{c}_{n}") for c in s.columns if c not in ("session_id", "runtime_id")], F.lit(True).alias(f"in_{n}")) for s, n in ((before, "a"), (after, "b")))
    both = a.join(b, ["session_id", "runtime_id"], "full")
    wanted = sessions.select("session_id", "ready", F.explode("targets").alias("runtime_id"))
    rows = wanted.join(both, ["session_id", "runtime_id"], "left").join(topology(before, after), "session_id", "left")
    side = lambda n, of: features(of.columns, f"_{n}")
    every = {"not_ready": F.col("ready"), "topology_changed": F.col("same_topology"), "missing_before": F.col("in_a"), "missing_after": F.col("in_b")} | checks
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in every.items()]))
    return rows.select(
        "session_id", "runtime_id", *[X.delta(f"{m}_a", f"{m}_b").alias(f"{m}_delta") for m in metrics], F.array_intersect(side("a", before), side("b", after)).alias("comparable"), failed.alias("failed"), (F.size(failed) == 0).alias("controlled")
    )


def complete(sessions: DataFrame, targets: DataFrame, readbacks: DataFrame, at: Column) -> DataFrame:
    """Sessions with their results: all targets controlled, and a closed loop where a host readback (session_id, readback) came
    too. A session that is completed already keeps its row, so completing again changes nothing."""
    done = targets.groupBy("session_id").agg(F.count("*").alias("n_targets"), F.count_if("controlled").alias("n_controlled"))
    said = readbacks.groupBy("session_id").agg(F.max(F.trim("readback")).alias("readback"))
    out = sessions.join(done, "session_id", "left").join(said, "session_id", "left")
    open_ = F.col("status") == AWAITING
    controlled = F.coalesce((F.col("n_targets") > 0) & (F.col("n_targets") == F.col("n_controlled")), F.lit(False))
    closed = controlled & (F.length(F.coalesce("readback", F.lit(""))) > 0)
    kept = lambda c, new: (F.when(open_, new).otherwise(F.col(c)) if c in sessions.columns else new).alias(c)
    results = {"controlled": controlled, "closed_loop": closed, "completed_at": at}
    return out.select(*[c for c in sessions.columns if c not in results and c != "status"], F.lit(COMPLETED).alias("status"), *[kept(c, new) for c, new in results.items()])


def status(sessions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest sessions, at most ``limit`` (T39, T42; K05), newest first by rank."""
    return _newest(sessions, [F.desc("created_at"), "session_id"], limit)
