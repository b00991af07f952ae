"""Registry views over frames: latest rows, bounded history, bindings and selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

STALE_SECONDS = 3.0


def latest(frames: DataFrame, key: str = "runtime_id") -> DataFrame:
    """The last row per track by arrival (W01). One aggregation with map-side combine, no sort."""
    rest = [c for c in frames.columns if c != key]
    best = frames.groupBy(key).agg(F.max_by(F.struct(*rest), "arrival_seq").alias("r"))
    return best.select(key, "r.*")


#: Seconds of silence from which short-term loudness says nothing.
SILENT = 3.0


def public_frame(frames: DataFrame) -> DataFrame:
    """Frames as they are shown (P02, T06): measures of a family that is not valid are null, and short-term loudness is after three
    seconds of silence. Columns that the frames lack are not made."""
    rules = [("spectrum_valid", ["centroid_hz", "rolloff_hz", "flatness", "bands_db"]), ("stereo_valid", ["stereo_correlation", "stereo_width", "band_stereo_correlation"])]
    shown = {c: F.when(F.coalesce(flag, "signal_present", F.lit(True)), F.col(c)) for flag, names in rules for c in names if c in frames.columns}
    if "lufs_s" in frames.columns:
        shown["lufs_s"] = F.when(F.coalesce("silence_seconds", F.lit(0.0)) < SILENT, F.col("lufs_s"))
    return frames.withColumns(shown)


def last_event(events: DataFrame, as_of: float, max_age: float, order: str = "arrival_seq") -> DataFrame:
    """The last event overall if it is fresh."""
    return events.orderBy(F.desc(order)).limit(1).where((F.lit(as_of) - F.col("received_at")) <= max_age)


def history(frames: DataFrame, n: int = 3600) -> DataFrame:
    """The last n rows of each track."""
    w = Window.partitionBy("runtime_id").orderBy(F.desc("arrival_seq"))
    return frames.withColumn("history_rank", F.row_number().over(w)).where(F.col("history_rank") <= n)


def bound(frames: DataFrame, bindings: DataFrame) -> DataFrame:
    """Frames with their binding, if any (J01); a binding table has a row per mixer slot, so Spark broadcasts it by size."""
    return frames.join(bindings, "runtime_id", "left")


def stale_bindings(bindings: DataFrame, live: DataFrame) -> DataFrame:
    """Bindings without a live track."""
    return bindings.join(live, "runtime_id", "left_anti")


def live_bindings(bindings: DataFrame, live: DataFrame) -> DataFrame:
    """Bindings of live tracks."""
    return bindings.join(live, "runtime_id", "left_semi")


def duplicate_names(live: DataFrame, name: str = "track") -> DataFrame:
    """Tracks per case-folded name, and whether the name is ambiguous."""
    folded = F.lower(name).alias("name")
    return live.groupBy(folded).agg(F.count("*").alias("n")).withColumn("duplicate", F.col("n") > 1)


def resolve(selectors: DataFrame, live: DataFrame, bindings: DataFrame) -> DataFrame:
    """(selector) to (selector, runtime_id, matches, rung): the first rung with a match decides.

    Rungs: exact id; ``mixer:i`` or ``fl:i`` with optional ``/slot:s``; mixer name; analyzer name; prefix of
    an id. runtime_id is null if the rung matches no or several tracks.
    """
    bound_live = live_bindings(bindings, live)
    ids = live.select("runtime_id", F.lower("track").alias("name"))
    s = selectors.select("selector", F.lower("selector").alias("low"))
    mixer = F.regexp_extract("low", r"^(?:mixer|fl):(\d+)(?:/slot:\d+)?$", 1).try_cast("int")
    wanted_slot = F.regexp_extract("low", r"/slot:(\d+)$", 1).try_cast("int")
    rungs = [
        s.join(ids, s.selector == ids.runtime_id).select("selector", "runtime_id", F.lit(1).alias("rung")),
        s.withColumns({"i": mixer, "s": wanted_slot})
        .join(bound_live, (F.col("i") == F.col("fl_track_index")) & (F.col("s").isNull() | (F.col("s") == F.col("slot"))))
        .select("selector", "runtime_id", F.lit(2).alias("rung")),
        s.join(bound_live, s.low == F.lower("fl_track_name")).select("selector", "runtime_id", F.lit(3).alias("rung")),
        s.join(ids, s.low == ids.name).select("selector", "runtime_id", F.lit(4).alias("rung")),
        # Prefixes are looked up by equality: every prefix of a live id is a row.
        s.join(ids.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("runtime_id")), lambda n: F.substring("runtime_id", F.lit(1), n)))), F.col("low") == F.lower("prefix")).select(
            "selector", "runtime_id", F.lit(5).alias("rung")
        ),
    ]
    all_rungs = rungs[0]
    for r in rungs[1:]:
        all_rungs = all_rungs.unionByName(r)
    per = all_rungs.groupBy("selector", "rung").agg(F.count_distinct("runtime_id").alias("matches"), F.min("runtime_id").alias("runtime_id"))
    best = per.groupBy("selector").agg(F.min_by(F.struct("rung", "matches", "runtime_id"), "rung").alias("b"))
    out = s.select("selector").join(best, "selector", "left")
    return out.select("selector", F.when(F.col("b.matches") == 1, F.col("b.runtime_id")).alias("runtime_id"), F.coalesce("b.matches", F.lit(0)).cast("long").alias("matches"), F.col("b.rung").alias("rung"))


def project_status(live: DataFrame, bindings: DataFrame, as_of: float) -> DataFrame:
    """Conditional counts over live tracks."""
    b = bound(live, bindings.select("runtime_id", "fl_track_index"))
    stale = F.lit(as_of) - F.col("received_at") > STALE_SECONDS
    return b.agg(
        F.count("*").alias("live"),
        F.count_if(F.col("fl_track_index").isNotNull()).alias("bound"),
        F.count_if("signal_present").alias("active"),
        F.count_if(~F.col("signal_present")).alias("silent"),
        F.count_if(stale).alias("stale"),
        F.count_if(F.col("true_peak_dbtp") > 0).alias("over"),
    )


def _warnings(**found: Column) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in found.items()]))


def song_status(live: DataFrame) -> DataFrame:
    """How the live tracks stand to the song (T30): (live, supported, warnings) of one row a track."""
    ok = F.col("transport_v12_supported")
    return live.agg(
        F.count("*").alias("live"),
        F.count_if(ok).alias("supported"),
        _warnings(
            transport_unsupported=F.count_if(ok) < F.count("*"),
            epochs_differ=F.min(F.when(ok, F.col("transport_epoch"))) < F.max(F.when(ok, F.col("transport_epoch"))),
            lag_250_ms=F.max(F.when(ok, F.col("estimated_analysis_lag_ms"))) >= 250,
            dropped_blocks=F.max(F.when(ok, F.col("dropped_blocks"))) > 0,
        ).alias("warnings"),
    )


def song_overview(passes: DataFrame, least: float = 0.9) -> DataFrame:
    """The newest pass of each track and what to mind when they are compared (T32): (tracks, start_seconds, end_seconds, warnings, partial),
    of one row a track and pass; partial lists the tracks covered by less than ``least``."""
    rest = [c for c in passes.columns if c != "runtime_id"]
    newest = passes.groupBy("runtime_id").agg(F.max_by(F.struct(*rest), "transport_epoch").alias("p")).select("runtime_id", "p.*")
    few = F.when(F.coalesce("coverage_ratio", F.lit(0.0)) < least, F.col("runtime_id"))
    return newest.agg(
        F.count("*").alias("tracks"),
        F.min("start_seconds").alias("start_seconds"),
        F.max("end_seconds").alias("end_seconds"),
        _warnings(epochs_differ=F.min("transport_epoch") < F.max("transport_epoch"), lag_250_ms=F.max("max_lag_ms") >= 250, partial_coverage=F.count(few) > 0).alias("warnings"),
        F.array_sort(F.collect_list(few)).alias("partial"),
    ).where("tracks > 0")


def segments(frames: DataFrame, families: list[str], mask: str = "analysis_feature_mask") -> DataFrame:
    """How often each feature family was switched by then, per track and pass (Z08, Z09): state keyed by track, pass and a family's
    segment is reset by a new pass, and by a switch of that family alone."""
    w = Window.partitionBy("runtime_id", "transport_epoch").orderBy("arrival_seq")
    on = X.features(mask)
    switched = frames.select("runtime_id", "transport_epoch", "arrival_seq", *[on[f].alias(f) for f in families])
    marked = switched.select("*", *[F.coalesce((F.col(f) != F.lag(f).over(w)).cast("long"), F.lit(0)).alias(f"{f}_turn") for f in families])
    return marked.select("runtime_id", "transport_epoch", "arrival_seq", *[F.sum(f"{f}_turn").over(w).alias(f"{f}_segment") for f in families])


def _last_identified(requests: DataFrame, identified: DataFrame, max_age: float) -> DataFrame:
    """Each row of ``requests`` (with a time at) as the struct request, with the identification found: the last one at most ``max_age`` older, as (at, runtime_id).

    Both are cut into stretches of ``max_age`` seconds: what a request may see lies in its own stretch or
    the one before, so each stretch is one sort and no time is compared with all others.
    """
    stretch = F.floor(F.col("at") / max_age)
    asking = F.struct(*requests.columns)
    asked = requests.select(stretch.alias("stretch"), "at", F.lit(None).cast("struct<at:double,runtime_id:string>").alias("found"), asking.alias("request"), F.lit(True).alias("asks"))
    seen = identified.select(F.explode(F.array(stretch, stretch + 1)).alias("stretch"), "at", F.struct(F.col("at").cast("double").alias("at"), "runtime_id").alias("found"), F.lit(None).cast(asked.schema["request"].dataType).alias("request"), F.lit(False).alias("asks"))
    w = Window.partitionBy("stretch").orderBy("at", "asks", "found.runtime_id").rowsBetween(Window.unboundedPreceding, 0)
    last = seen.unionByName(asked).withColumn("last", F.last("found", ignorenulls=True).over(w)).where("asks")
    return last.select("request", F.when(F.col("at") - F.col("last.at") <= max_age, F.col("last")).alias("found"))


def handshake(identified: DataFrame, requested: DataFrame, fresh: float = 10.0) -> DataFrame:
    """Bind requests with the id that answered (Z13): of identify events (runtime_id, heard_at) the latest that is at most ``fresh``
    seconds older than the request (slot, at), each event used by its first request only. The last request of a slot keeps it, so another id is evicted."""
    latest = _last_identified(requested.select("slot", "at"), identified.select("runtime_id", F.col("heard_at").alias("at")), fresh).where("found is not null")
    once = latest.withColumn("turn", F.row_number().over(Window.partitionBy("found").orderBy("request.at", "request.slot"))).where("turn = 1")
    return once.groupBy("request.slot").agg(F.max_by("found.runtime_id", "request.at").alias("runtime_id"), F.max("request.at").alias("bound_at"))


def bind_last_identified(requests: DataFrame, identified: DataFrame, max_age: float = 5.0) -> DataFrame:
    """The track that identified itself last before each request, if at most ``max_age`` seconds ago.

    requests (request, at), identified (runtime_id, at); of tracks that identified at one time the greatest name counts.
    """
    return _last_identified(requests.select("request", "at"), identified, max_age).select("request.request", F.col("found.runtime_id").alias("runtime_id"))
