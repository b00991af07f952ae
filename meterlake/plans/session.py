"""Registered queries on captures and verification sessions: one session per track of the events, and one for a track that never sends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import compare, recent, session_store, sessions, timeline
from ..sources import frames as source
from ..sources.versions import VersionedTables
from ..streaming import dimension
from . import oracle as sql
from . import tools
from .lineage import shared_folder
from .song import _HALF
from .tools import P, query

_METRICS = compare.METRICS


def _requests(spark, sf_dir):
    tracks = tools.frames(spark, sf_dir).select("runtime_id").distinct().union(spark.createDataFrame([("rt-gone",)], "runtime_id string"))
    return tracks.select(F.concat(F.lit("verify-"), "runtime_id").alias("session_id"), F.col("runtime_id").alias("label"), F.lit(80.0).alias("created_at"), F.array("runtime_id").alias("targets"))


_REQ = "rq AS (SELECT 'verify-' || runtime_id AS session_id, runtime_id FROM (SELECT DISTINCT runtime_id FROM f UNION ALL SELECT 'rt-gone'))"


def _frozen(requests, state):
    """The state of all tracks, frozen for each session; a project has few tracks."""
    return requests.select("session_id").crossJoin(F.broadcast(state))  # one row a track, 64 at most


def _recent_states(spark, sf_dir):
    f = tools.frames(spark, sf_dir)
    return (recent.average(recent.window(x, t, 60.0)) for x, t in ((f.where("track <> 'view'"), 80.0), (f, 160.0)))


_STATES = f"""{_HALF}, sc AS (SELECT * FROM sa), {_REQ}, sn AS (SELECT rq.*, sa.runtime_id IS NULL AS absent, sa.active_ratio FROM rq LEFT JOIN sa ON sa.runtime_id = rq.runtime_id)"""


def _begun(spark, sf_dir):
    before, _ = _recent_states(spark, sf_dir)
    requests = _requests(spark, sf_dir)
    return sessions.begin(requests, _frozen(requests, before), F.col("active_frames") > 0)


@query(
    "t37_begin_verification",
    f"""{_STATES} SELECT session_id, runtime_id AS label, CASE WHEN absent THEN 'missing:' || runtime_id WHEN NOT coalesce(active_ratio > 0, false) THEN 'invalid:' || runtime_id ELSE '' END AS blockers, NOT absent AND coalesce(active_ratio > 0, false) AS ready, 'awaiting_external_change' AS status FROM sn""",
)
def t37(spark, sf_dir):
    return _begun(spark, sf_dir).select("session_id", "label", F.array_join("blockers", ";").alias("blockers"), "ready", "status")


def _verified(spark, sf_dir):
    before, after = _recent_states(spark, sf_dir)
    requests = _requests(spark, sf_dir)
    a, b = _frozen(requests, before), _frozen(requests, after.where("runtime_id <> 'rt-view'"))
    begun = sessions.begin(requests, a, F.col("active_frames") > 0)
    return begun, sessions.compare_targets(begun, a, b, {"activity_changed": F.abs(F.col("active_ratio_b") - F.col("active_ratio_a")) <= 0.15})


_AFTER = f"""so AS (SELECT runtime_id, round(CAST(count(*) FILTER (WHERE sp) AS DOUBLE) / count(*), 4) AS active_ratio, round(10 * log10(greatest(avg(CASE WHEN sp AND rms_db > -120 THEN pow(10, rms_db / 10) END), 1e-12)), 4) AS rms_db
 FROM f WHERE received_at >= 100 AND received_at <= 160 AND track <> 'view' GROUP BY 1),
tg AS (SELECT sn.session_id, sn.runtime_id, round(so.rms_db - sa.rms_db, 4) AS rms_db_delta, coalesce(sa.active_ratio > 0 AND so.runtime_id IS NOT NULL AND abs(so.active_ratio - sa.active_ratio) <= 0.15, false) AS controlled
 FROM sn LEFT JOIN sa ON sa.runtime_id = sn.runtime_id LEFT JOIN so ON so.runtime_id = sn.runtime_id)"""


@query("c10_session_targets", f"{_STATES}, {_AFTER} SELECT session_id, runtime_id, rms_db_delta, controlled FROM tg")
def c10(spark, sf_dir):
    return _verified(spark, sf_dir)[1].select("session_id", "runtime_id", "rms_db_delta", "controlled")


def _completed(spark, sf_dir):
    begun, targets = _verified(spark, sf_dir)
    said = begun.select("session_id", F.when(F.col("label") != "rt-error", F.lit("volume -2 dB")).alias("readback"))
    done = sessions.complete(begun, targets, said, F.lit(160.0))
    # Completing again, with nothing measured, changes no result.
    return sessions.complete(done, targets.limit(0), said.limit(0), F.lit(170.0))


_DONE = f"{_STATES}, {_AFTER}, dn AS (SELECT session_id, 'completed' AS status, controlled, controlled AND runtime_id <> 'rt-error' AS closed_loop, CAST(160.0 AS DOUBLE) AS completed_at FROM tg)"


@query("t38_complete_verification", f"{_DONE} SELECT * FROM dn")
def t38(spark, sf_dir):
    return _completed(spark, sf_dir).select("session_id", "status", "controlled", "closed_loop", "completed_at")


@query("t39_verification_status", f"{_DONE} SELECT session_id, status, CAST(row_number() OVER (ORDER BY session_id) AS INTEGER) AS rank FROM dn QUALIFY rank <= 4")
def t39(spark, sf_dir):
    return sessions.status(_completed(spark, sf_dir), 4).select("session_id", "status", "rank")


def _ranges(spark, sf_dir):
    p = tools.partials(spark, sf_dir)
    fence = p.where("bin_index < 60").agg(F.max("last_received_at")).first()[0]  # one number
    return timeline.resolve_range(p, 20, 60, 0.3), timeline.resolve_range(p, 100, 140, 0.3, fence)


def _checks():
    return {"insufficient_coverage": F.least("coverage_ratio_a", "coverage_ratio_b") >= 0.3, "dropped_blocks": F.col("dropped_blocks_b") <= F.col("dropped_blocks_a")}


def _ranged(spark, sf_dir):
    """Range sessions through a store of this run: begun, completed twice (the second time changes nothing), one left open."""
    before, after = _ranges(spark, sf_dir)
    requests = _requests(spark, sf_dir)
    store = session_store.SessionStore(VersionedTables(spark, f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"))
    store.begin(requests, _frozen(requests, before), F.col("adequate"))
    said = requests.where("label <> 'rt-view'").select("session_id", F.when(F.col("label") != "rt-error", F.lit("volume -2 dB")).otherwise("").alias("readback"))
    for at in (160.0, 170.0):
        store.complete(said, _frozen(requests, after), _checks(), at)
    return store


def _best(name: str, lo: int, also: str = "") -> str:
    summary = sql.summary("runtime_id, transport_epoch", "40", f"(SELECT * FROM acc WHERE bin >= {lo} AND bin < {lo + 40})")
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY coverage_ratio DESC, last_received_at DESC, transport_epoch DESC) AS r FROM ({summary}) {also}) WHERE r = 1)"


_RANGED = f"""{P}, {_REQ}, {_best('ra', 20)}, fc AS (SELECT max(last_rx) AS fence FROM acc WHERE bin < 60), {_best('rb', 100, ', fc WHERE first_received_at > fence')},
tp AS (SELECT count(*) = count(ra.runtime_id) AND count(*) = count(rb.runtime_id) AS same FROM ra FULL JOIN rb ON ra.runtime_id = rb.runtime_id),
tg AS (SELECT session_id, rq.runtime_id, ra.runtime_id IS NOT NULL AND coalesce(ra.coverage_ratio >= CAST(0.3 AS DOUBLE), false) AS ready, round(rb.rms_db - ra.rms_db, 4) AS rms_db_delta, rb.runtime_id IS NOT NULL AS found, least(ra.coverage_ratio, rb.coverage_ratio) >= CAST(0.3 AS DOUBLE) AND ra.coverage_ratio IS NOT NULL AND rb.coverage_ratio IS NOT NULL AS enough, rb.dropped_blocks <= ra.dropped_blocks AS undropped
 FROM rq LEFT JOIN ra ON ra.runtime_id = rq.runtime_id LEFT JOIN rb ON rb.runtime_id = rq.runtime_id)"""
_IN_ORDER = "SELECT session_id, status, CAST(row_number() OVER (ORDER BY session_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 5"


@query("t40_begin_range_verification", f"{_RANGED} SELECT session_id, ready FROM tg")
def t40(spark, sf_dir):
    before, _ = _ranges(spark, sf_dir)
    requests = _requests(spark, sf_dir)
    return sessions.begin(requests, _frozen(requests, before), F.col("adequate")).select("session_id", "ready")


_COMPLETED = f"{_RANGED}, cm AS (SELECT session_id, runtime_id, rms_db_delta, coalesce(ready AND found AND enough AND undropped AND same, false) AS controlled FROM tg, tp WHERE runtime_id <> 'rt-view')"


@query("t41_complete_range_verification", f"{_COMPLETED} SELECT * FROM cm")
def t41(spark, sf_dir):
    return _ranged(spark, sf_dir).results().select("session_id", "runtime_id", "rms_db_delta", "controlled")


@query(
    "t42_range_verification_status",
    f"""{_COMPLETED}, x AS (SELECT session_id, CASE WHEN cm.session_id IS NULL THEN 'awaiting_external_change' ELSE 'completed' END AS status, controlled, controlled AND tg.runtime_id <> 'rt-error' AS closed_loop, CASE WHEN cm.session_id IS NOT NULL THEN CAST(160 AS DOUBLE) END AS completed_at FROM tg LEFT JOIN cm USING (session_id))
    SELECT *, CAST(row_number() OVER (ORDER BY session_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 5""",
)
def t42(spark, sf_dir):
    return _ranged(spark, sf_dir).status(5).select("session_id", "status", "controlled", "closed_loop", "completed_at", "rank")


@query(
    "k02_live_bindings",
    """WITH b AS (SELECT 'rt-' || user_id % 200 AS runtime_id, CAST(user_id * 7 % 23 AS INTEGER) AS fl_track_index, CAST(event_id % 3 AS INTEGER) AS slot, event_id AS seq FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
    i AS (SELECT runtime_id, max(seq) AS seq FROM b GROUP BY ALL), s AS (SELECT fl_track_index, slot, max(seq) AS seq FROM b GROUP BY ALL)
    SELECT b.runtime_id, b.fl_track_index, b.slot FROM b JOIN i ON i.runtime_id = b.runtime_id AND i.seq = b.seq JOIN s ON s.fl_track_index = b.fl_track_index AND s.slot = b.slot AND s.seq = b.seq""",
)
def k02(spark, sf_dir):
    """Events as bind events, merged into the live dimension in three batches by two streams, one batch twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and event_id is not null")
    binds = e.select(F.concat(F.lit("rt-"), (F.col("user_id") % 200).cast("string")).alias("runtime_id"), (F.col("user_id") * 7 % 23).cast("int").alias("fl_track_index"), F.lit("Mixer").alias("fl_track_name"), (F.col("event_id") % 3).cast("int").alias("slot"), F.col("event_id").cast("long").alias("seq"))
    store = VersionedTables(spark, f"{shared_folder(spark)}/bindings-{uuid.uuid4().hex}")
    for stream, batch in (("one", 0), ("two", 0), ("one", 1), ("one", 0)):
        part = binds.where(F.pmod("seq", F.lit(3)) == {("one", 0): 0, ("two", 0): 1, ("one", 1): 2}[(stream, batch)])
        dimension.upsert(store, stream)(part, batch)
    return dimension.bindings(store).drop("fl_track_name")


def _captured(spark, sf_dir):
    """One snapshot every 40 seconds of the song, of the 20 seconds before it."""
    f = tools.frames(spark, sf_dir)
    at = (F.floor(F.col("received_at") / 40) + 1) * 40.0
    inside = f.withColumn("captured_at", at).where(F.col("received_at") > F.col("captured_at") - 20)
    states = inside.groupBy("captured_at", "runtime_id").agg(F.count("*").alias("frames"), F.round(F.max("peak_db"), 4).alias("peak_db"), F.round(F.avg(recent.active("crest_db")), 4).alias("crest_db"))
    named = states.withColumn("name", F.concat(F.lit("at "), F.col("captured_at").cast("int").cast("string")))
    requests = named.select("name").distinct()
    return sessions.capture(requests, named)


_CAPTURED = f"WITH {sql.frames()}, cp AS (SELECT (floor(received_at / 40) + 1) * 40 AS captured_at, * FROM f), ct AS (SELECT 'at ' || CAST(CAST(captured_at AS INTEGER) AS VARCHAR) AS name, CAST(captured_at AS DOUBLE) AS captured_at, runtime_id, count(*) AS frames, round(max(peak_db), 4) AS peak_db, round(avg(crest_db) FILTER (WHERE sp), 4) AS crest_db FROM cp WHERE received_at > captured_at - 20 GROUP BY ALL)"


@query("t14_capture_snapshot", f"{_CAPTURED} SELECT * FROM ct")
def t14(spark, sf_dir):
    return _captured(spark, sf_dir)


_MEASURES = ["active_ratio", "peak_db", "rms_db", "lufs_s", "crest_db", "centroid_hz", "rolloff_hz", "flatness", "stereo_correlation", "stereo_width", "true_peak_latest"]
_WHOLE = f"""{tools.WB}, {tools.BINDINGS}, av AS ({tools.ORACLE["t07_average"].removeprefix(tools.W)}), ss AS ({tools.ORACLE["t07_spectral_shape"].removeprefix(tools.W)}),
ms AS (SELECT av.runtime_id, unnest([{", ".join(f"{{'measure': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in _MEASURES)}], recursive := true) FROM av JOIN ss ON ss.runtime_id = av.runtime_id UNION ALL SELECT runtime_id, 'band_' || band, CAST(plain_db AS DOUBLE) FROM means)"""


@query("t14_whole_state", f"{_WHOLE} SELECT 'now' AS name, coalesce('mixer:' || fl_track_index || '/slot:' || slot, ms.runtime_id) AS identity, av.active_frames > 0 AS analysis_valid, measure, round(value, 6) AS value FROM ms JOIN av ON av.runtime_id = ms.runtime_id LEFT JOIN bindings b ON b.runtime_id = ms.runtime_id WHERE value IS NOT NULL")
def t14_whole(spark, sf_dir):
    """The whole state of each track, captured in a store and read back, measure by measure."""
    state = recent.project_state(tools.window(spark, sf_dir, True), source.bindings(spark)).withColumn("name", F.lit("now"))
    store = session_store.SnapshotStore(VersionedTables(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"))
    store.capture(spark.createDataFrame([(" now ",)], "name string"), state, tools.AS_OF)
    kept = store.read("now").select("name", "identity", "analysis_valid", *[F.col(m).cast("double").alias(m) for m in _MEASURES], *[F.get("bands_db", F.lit(i)).alias(f"band_{i}") for i in range(len(dims.BAND_CENTERS))])
    long = kept.unpivot(["name", "identity", "analysis_valid"], [c for c in kept.columns if c not in ("name", "identity", "analysis_valid")], "measure", "value")
    return long.where("value is not null").withColumn("value", F.round("value", 6))


@query("t15_list_snapshots", f"{_CAPTURED}, ls AS (SELECT name, captured_at, count(*) AS tracks FROM ct GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY captured_at DESC, name) AS INTEGER) AS rank FROM ls QUALIFY rank <= 3")
def t15(spark, sf_dir):
    return sessions.captures(_captured(spark, sf_dir), ["name"], 3)


def _references(spark, sf_dir):
    """A reference profile of each track: level and band means of the window, frozen under a label."""
    w = tools.window(spark, sf_dir, True)
    means = recent.band_means(w).select("runtime_id", "band", "plain_db")
    level = recent.average(w).select(F.col("runtime_id").alias("id"), "rms_db")
    rows = means.join(level, F.col("runtime_id") == F.col("id")).select(F.concat(F.lit("ref "), "runtime_id").alias("name"), "runtime_id", F.col("band").cast("int").alias("band"), "plain_db", "rms_db", F.lit(tools.AS_OF).alias("captured_at"))
    return sessions.capture(rows.select("name").distinct(), rows)


_REFERENCES = f"{tools.WB}, lv AS (SELECT runtime_id, round(10 * log10(greatest(avg(CASE WHEN sp AND rms_db > -120 THEN pow(10, rms_db / 10) END), 1e-12)), 4) AS rms_db FROM w GROUP BY 1), rf AS (SELECT 'ref ' || means.runtime_id AS name, means.runtime_id, CAST(band AS INTEGER) AS band, plain_db, rms_db, CAST({tools.AS_OF} AS DOUBLE) AS captured_at FROM means JOIN lv ON lv.runtime_id = means.runtime_id)"


@query("t45_capture_reference", f"{_REFERENCES} SELECT * FROM rf")
def t45(spark, sf_dir):
    return _references(spark, sf_dir)


@query("t46_list_references", f"{_REFERENCES}, lf AS (SELECT name, captured_at, count(*) AS tracks FROM rf GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS rank FROM lf")
def t46(spark, sf_dir):
    return sessions.captures(_references(spark, sf_dir), ["name"])


@query(
    "x38_features",
    f"""{P}, r AS (SELECT runtime_id, transport_epoch, bool_or((mask & 32) <> 0) AS semantic, bool_or((mask & 4) <> 0) AS spectrum, count(*) AS n, bool_or(true_peak_dbtp IS NOT NULL OR lufs_s > -120) AS loudness, bool_or((mask & 8) <> 0) AS stereo, bool_or((mask & 16) <> 0) AS temporal FROM f WHERE bin >= 20 AND bin < 60 GROUP BY ALL)
    SELECT runtime_id, transport_epoch, concat_ws(',', CASE WHEN n > 0 THEN 'core' END, CASE WHEN loudness THEN 'loudness' END, CASE WHEN semantic THEN 'semantic' END, CASE WHEN spectrum THEN 'spectrum' END, CASE WHEN stereo THEN 'stereo' END, CASE WHEN temporal THEN 'temporal' END) AS features FROM r""",
)
def x38(spark, sf_dir):
    range_ = timeline.finalize(timeline.overlapping(tools.partials(spark, sf_dir, spectra=True), 20, 60), timeline.KEY)
    return range_.select(*timeline.KEY, F.array_join(sessions.features(range_.columns), ",").alias("features"))
