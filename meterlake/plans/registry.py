"""Registered queries on the registry, single frames and live folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import selection, state, timeline
from ..sources import frames as source
from ..streaming import live
from . import oracle as sql
from .tools import BINDINGS, LATEST, P, W, frames, partials, query, window


@query(
    "t02_list_tracks",
    f"""WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT l.runtime_id, lower(l.track) AS name, fl_track_index, l.sp AS signal_present, count(*) OVER (PARTITION BY lower(l.track)) > 1 AS duplicate FROM latest l LEFT JOIN bindings b ON l.runtime_id = b.runtime_id""",
)
def t02(spark, sf_dir):
    last = state.latest(frames(spark, sf_dir).select("runtime_id", "track", "arrival_seq", "signal_present")).withColumn("name", F.lower("track"))
    names = state.duplicate_names(last).select("name", "duplicate")
    return state.bound(last, source.bindings(spark)).join(names, "name").select("runtime_id", "name", "fl_track_index", "signal_present", "duplicate")


@query("t01_bridge_status", f"WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT count(*) AS live, count(b.runtime_id) AS bound, count(DISTINCT lower(l.track)) AS names, max(l.arrival_seq) AS last_seq FROM latest l LEFT JOIN bindings b ON l.runtime_id = b.runtime_id")
def t01(spark, sf_dir):
    last = state.latest(frames(spark, sf_dir).select("runtime_id", "track", "arrival_seq"))
    return state.bound(last, source.bindings(spark)).agg(F.count("*").alias("live"), F.count("fl_track_index").alias("bound"), F.count_distinct(F.lower("track")).alias("names"), F.max("arrival_seq").alias("last_seq"))


@query("t05_instance_map", f"WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT coalesce(l.runtime_id, b.runtime_id) AS runtime_id, fl_track_index, CASE WHEN l.runtime_id IS NULL THEN 'stale' WHEN b.runtime_id IS NULL THEN 'unbound' ELSE 'bound' END AS state FROM latest l FULL JOIN bindings b ON l.runtime_id = b.runtime_id")
def t05(spark, sf_dir):
    last = state.latest(frames(spark, sf_dir).select("runtime_id", "arrival_seq")).withColumn("live", F.lit(True))
    both = last.join(source.bindings(spark), "runtime_id", "full")
    kind = F.when(F.col("live").isNull(), "stale").when(F.col("fl_track_index").isNull(), "unbound").otherwise("bound")
    return both.select("runtime_id", "fl_track_index", kind.alias("state"))


@query("p02_public_frame", f"WITH {sql.frames()}, {LATEST} SELECT runtime_id, round(rms_db, 4) AS rms_db, CASE WHEN silence < 3 THEN round(lufs_s, 4) END AS lufs_s, round(centroid_hz, 2) AS centroid_hz, round(corr, 4) AS stereo_correlation, (mask & 4) <> 0 AS spectrum_valid, (mask & 8) <> 0 AS stereo_valid FROM latest")
def p02(spark, sf_dir):
    last = state.public_frame(state.latest(frames(spark, sf_dir)))
    return last.select("runtime_id", F.round("rms_db", 4).alias("rms_db"), F.round("lufs_s", 4).alias("lufs_s"), F.round("centroid_hz", 2).alias("centroid_hz"), F.round("stereo_correlation", 4).alias("stereo_correlation"), "spectrum_valid", "stereo_valid")


@query("t26_analysis_status", f"WITH {sql.frames()}, {LATEST} SELECT runtime_id, mask AS analysis_feature_mask, CAST(bit_count(mask) AS INTEGER) AS features, lag >= 250 AS lagging FROM latest")
def t26(spark, sf_dir):
    last = state.latest(frames(spark, sf_dir).select("runtime_id", "arrival_seq", "analysis_feature_mask", "estimated_analysis_lag_ms"))
    return last.select("runtime_id", "analysis_feature_mask", F.bit_count("analysis_feature_mask").alias("features"), (F.col("estimated_analysis_lag_ms") >= 250).alias("lagging"))


@query("a12_median", f"{W} SELECT runtime_id, round(median(k), 4) AS median_k, min(k) AS least, max(k) AS most FROM (SELECT runtime_id, CAST(lag AS DOUBLE) AS k FROM w) GROUP BY 1")
def a12(spark, sf_dir):
    f = window(spark, sf_dir).select("runtime_id", "estimated_analysis_lag_ms")
    ends = f.groupBy("runtime_id").agg(F.min("estimated_analysis_lag_ms").alias("least"), F.max("estimated_analysis_lag_ms").alias("most"))
    return selection.median(f, ["runtime_id"], "estimated_analysis_lag_ms", "median_k").join(ends, "runtime_id").withColumn("median_k", F.round("median_k", 4))


@query("a08_correlation", f"{W} SELECT runtime_id, round(corr(rms_db, crest_db), 4) AS correlation, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3")
def a08(spark, sf_dir):
    return window(spark, sf_dir).groupBy("runtime_id").agg(F.round(X.pearson("rms_db", "crest_db"), 4).alias("correlation"), F.count("*").alias("n"))


@query("a26_epochs", f"WITH {sql.frames()} SELECT DISTINCT runtime_id, transport_epoch FROM f")
def a26(spark, sf_dir):
    return frames(spark, sf_dir).select("runtime_id", "transport_epoch").distinct()


_ORDER = "PARTITION BY runtime_id, transport_epoch ORDER BY arrival_seq"


@query("w13_running_max", f"WITH {sql.frames()} SELECT arrival_seq, round(max(true_peak_dbtp) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING), 4) AS max_true_peak_dbtp FROM f")
def w13(spark, sf_dir):
    out = live.running_max(frames(spark, sf_dir).select("runtime_id", "transport_epoch", "arrival_seq", "true_peak_dbtp"), "true_peak_dbtp", ["runtime_id", "transport_epoch"])
    return out.select("arrival_seq", F.round("true_peak_dbtp", 4).alias("max_true_peak_dbtp"))


@query("w12_rms_rise", f"WITH {sql.frames()} SELECT arrival_seq, round(greatest(0, rms_db - lag(rms_db) OVER ({_ORDER})), 4) AS rise_db FROM f QUALIFY lag(rms_db) OVER ({_ORDER}) IS NOT NULL")
def w12(spark, sf_dir):
    w = Window.partitionBy("runtime_id", "transport_epoch").orderBy("arrival_seq")
    return frames(spark, sf_dir).withColumn("old", F.lag("rms_db").over(w)).where("old is not null").select("arrival_seq", F.round(F.greatest(F.lit(0.0), F.col("rms_db") - F.col("old")), 4).alias("rise_db"))


@query("z12_fence", f"{P}, x AS (SELECT runtime_id, transport_epoch, min(first_rx) AS first_rx, count(*) AS bins FROM acc WHERE bin >= 60 GROUP BY ALL) SELECT runtime_id, transport_epoch, bins FROM x WHERE first_rx > CAST(60.02 AS DOUBLE)")
def z12(spark, sf_dir):
    groups = partials(spark, sf_dir).where("bin_index >= 60").groupBy(*timeline.KEY).agg(F.min("first_received_at").alias("first_received_at"), F.count("*").alias("bins"))
    return live.fence(groups, 60.02).drop("first_received_at")


@query("z14_carry_forward", f"WITH {sql.frames()} SELECT arrival_seq, round(last_value(flux IGNORE NULLS) OVER (PARTITION BY runtime_id ORDER BY received_at, arrival_seq ROWS UNBOUNDED PRECEDING), 6) AS spectral_flux_mean FROM f")
def z14(spark, sf_dir):
    f = frames(spark, sf_dir).select("runtime_id", "received_at", "arrival_seq", "spectral_flux_mean")
    return live.carry_forward(f, "spectral_flux_mean").select("arrival_seq", F.round("spectral_flux_mean", 6).alias("spectral_flux_mean"))


_LISTS = "ls AS MATERIALIZED (SELECT runtime_id, list(arrival_seq ORDER BY received_at, arrival_seq) AS ss, list(received_at ORDER BY received_at, arrival_seq) AS ts, list(rms_db ORDER BY received_at, arrival_seq) AS vs FROM f GROUP BY 1)"


@query(
    "r12_throttle",
    f"""WITH RECURSIVE {sql.frames()}, {_LISTS},
    walk AS (SELECT runtime_id, CAST(0 AS BIGINT) AS i, CAST(-1e300 AS DOUBLE) AS last, false AS kept FROM ls
      UNION ALL SELECT w.runtime_id, i + 1, CASE WHEN ts[i + 1] >= last + CAST(0.1 - 1e-9 AS DOUBLE) THEN ts[i + 1] ELSE last END, ts[i + 1] >= last + CAST(0.1 - 1e-9 AS DOUBLE) FROM walk w JOIN ls ON ls.runtime_id = w.runtime_id WHERE i < len(ts))
    SELECT walk.runtime_id, ts[i] AS received_at, ss[i] AS arrival_seq FROM walk JOIN ls ON ls.runtime_id = walk.runtime_id WHERE kept""",
)
def r12(spark, sf_dir):
    return live.throttle(frames(spark, sf_dir).select("runtime_id", "received_at", "arrival_seq"))


@query(
    "z05_gate",
    f"""WITH RECURSIVE {sql.frames()}, {_LISTS},
    walk AS (SELECT runtime_id, CAST(0 AS BIGINT) AS i, false AS o, CAST(0 AS BIGINT) AS s FROM ls
      UNION ALL SELECT runtime_id, i + 1, CASE WHEN o THEN v >= -12 OR s + 50000000 < 400000000 ELSE v > -10 END, CASE WHEN v > -10 OR (o AND v >= -12) THEN 0 ELSE s + 50000000 END
      FROM (SELECT w.runtime_id, i, o, s, vs[i + 1] AS v FROM walk w JOIN ls ON ls.runtime_id = w.runtime_id WHERE i < len(vs)))
    SELECT walk.runtime_id, ss[i] AS arrival_seq, o AS open, round(CAST(s AS DOUBLE) / 1e9, 6) AS silence FROM walk JOIN ls ON ls.runtime_id = walk.runtime_id WHERE i > 0""",
)
def z05(spark, sf_dir):
    """The gate over the frames' levels, each a hop of 50 ms, with thresholds that these levels cross."""
    at = F.struct("received_at", "arrival_seq")
    hops = frames(spark, sf_dir).select("runtime_id", "arrival_seq", at.alias("seq"), F.col("rms_db").alias("level_db"), F.lit(0.05).alias("seconds"))
    return live.gate(hops, -10.0, -12.0).select("runtime_id", "arrival_seq", "open", F.round("silence", 6).alias("silence"))


@query(
    "w10_passes",
    f"""WITH {sql.frames()}, b AS (SELECT *, lag(t) OVER w AS t0, lag(sp) OVER w AS sp0 FROM f WINDOW w AS (PARTITION BY runtime_id ORDER BY received_at, arrival_seq)),
    s AS (SELECT *, sp AND (NOT coalesce(sp0, false) OR CASE WHEN arrival_seq % 3 = 0 OR lag(arrival_seq) OVER w % 3 = 0 THEN abs(t - (t0 + CAST(2400 AS DOUBLE) / 48000)) > greatest(CAST(0.05 AS DOUBLE), CAST(9600 AS DOUBLE) / 48000)
      ELSE abs(floor(t * 48000) - (floor(t0 * 48000) + 2400)) > 9600 END) AS begins FROM b WINDOW w AS (PARTITION BY runtime_id ORDER BY received_at, arrival_seq))
    SELECT runtime_id, arrival_seq, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY runtime_id ORDER BY received_at, arrival_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM s""",
)
def w10(spark, sf_dir):
    """Passes over the frames as blocks of 50 ms; every third has no sample position."""
    t = F.col("transport_time_seconds")
    audio = frames(spark, sf_dir).select("runtime_id", "arrival_seq", F.struct("received_at", "arrival_seq").alias("seq"), F.col("signal_present").alias("playing"), F.when(F.col("arrival_seq") % 3 != 0, F.floor(t * 48000)).cast("long").alias("position"), t.alias("seconds"), F.lit(2400).alias("size"))
    return live.passes(audio).select("runtime_id", "arrival_seq", "epoch")


@query("x19_similarity", f"{W}, a AS (SELECT runtime_id, avg(rms_db) AS x FROM w GROUP BY 1) SELECT p.runtime_id AS a, q.runtime_id AS b, round(exp(-abs(p.x - q.x) / 6), 4) AS similarity FROM a p JOIN a q ON p.runtime_id < q.runtime_id")
def x19(spark, sf_dir):
    m = window(spark, sf_dir).groupBy("runtime_id").agg(F.avg("rms_db").alias("x"))
    a, b = (m.select(F.col("runtime_id").alias(s), F.col("x").alias(f"x{s}")) for s in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.similarity("xa", "xb", 6.0), 4).alias("similarity"))


@query("p07_onsets", f"{W} SELECT arrival_seq FROM w WHERE (mask & 16) <> 0 AND (rise >= 3 OR flux_peak >= CAST(0.18 AS DOUBLE))")
def p07(spark, sf_dir):
    f = window(spark, sf_dir)
    return f.where("temporal_valid and (rms_rise_peak_db >= 3 or spectral_flux_peak >= 0.18)").select("arrival_seq")


@query("z02_resolutions", " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS resolution, runtime_id, transport_epoch, CAST(floor(CAST(bin AS DOUBLE) / {r}) AS INTEGER) AS group_index, CAST(sum(n) AS BIGINT) AS frame_count, round(sum(bit_count(cover)) / CAST(10 AS DOUBLE), 3) AS covered_seconds FROM acc GROUP BY ALL" for r in (2, 10, 30)).join([f"{P} ", ""]))
def z02(spark, sf_dir):
    """Coarser summaries at several resolutions from one set of partials."""
    p = partials(spark, sf_dir).withColumn("resolution", F.explode(F.array(F.lit(2), F.lit(10), F.lit(30))))
    return p.groupBy("resolution", *timeline.KEY, F.floor(F.col("bin_index") / F.col("resolution")).cast("int").alias("group_index")).agg(F.sum("frame_count").alias("frame_count"), F.round(F.sum(F.bit_count("coverage_mask")) / 10.0, 3).alias("covered_seconds"))


@query(
    "z13_handshake",
    f"""WITH {sql.frames()}, h AS (SELECT runtime_id, t AS heard_at FROM f WHERE arrival_seq % 2 = 0), q AS (SELECT CAST(arrival_seq % 41 AS INTEGER) AS slot, t AS asked_at FROM f WHERE arrival_seq % 2 = 1),
    m AS (SELECT q.slot, q.asked_at, h.heard_at, h.runtime_id FROM q ASOF JOIN (SELECT heard_at, max(runtime_id) AS runtime_id FROM h GROUP BY 1) h ON q.asked_at >= h.heard_at WHERE q.asked_at - h.heard_at <= CAST(0.01 AS DOUBLE)),
    o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY heard_at, runtime_id ORDER BY asked_at, slot) = 1)
    SELECT slot, arg_max(runtime_id, asked_at) AS runtime_id, max(asked_at) AS bound_at FROM o GROUP BY 1""",
)
def z13(spark, sf_dir):
    """Every other event identifies its track, the others ask for a slot; an identification is fresh for a hundredth of a song second."""
    f = frames(spark, sf_dir).select("runtime_id", "arrival_seq", F.col("transport_time_seconds").alias("at"))
    heard = f.where("arrival_seq % 2 = 0").select("runtime_id", F.col("at").alias("heard_at"))
    asked = f.where("arrival_seq % 2 = 1").select((F.col("arrival_seq") % 41).cast("int").alias("slot"), "at")
    return state.handshake(heard, asked, 0.01)


@query("t06_shown_loudness", f"WITH {sql.frames()} SELECT arrival_seq, CASE WHEN silence < 3 THEN round(lufs_s, 4) END AS lufs_s, silence >= 3 AS silent FROM f")
def t06_shown(spark, sf_dir):
    f = frames(spark, sf_dir).select("arrival_seq", "lufs_s", "silence_seconds")
    return state.public_frame(f).select("arrival_seq", F.round("lufs_s", 4).alias("lufs_s"), (F.col("silence_seconds") >= state.SILENT).alias("silent"))


@query(
    "t30_status_warnings",
    f"""WITH {sql.frames()}, {LATEST} SELECT count(*) AS live, count(*) AS supported, concat_ws(',', CASE WHEN min(transport_epoch) < max(transport_epoch) THEN 'epochs_differ' END, CASE WHEN max(lag) >= 250 THEN 'lag_250_ms' END, CASE WHEN max(dropped) > 0 THEN 'dropped_blocks' END) AS warnings FROM latest""",
)
def t30_status(spark, sf_dir):
    last = state.latest(frames(spark, sf_dir).select("runtime_id", "arrival_seq", "transport_v12_supported", "transport_epoch", "estimated_analysis_lag_ms", "dropped_blocks"))
    return state.song_status(last).withColumn("warnings", F.array_join("warnings", ","))


@query(
    "t32_overview_warnings",
    f"""{P}, x AS ({sql.summary('runtime_id, transport_epoch', 'greatest(1, max(bin) + 1 - min(bin))')}), n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY runtime_id ORDER BY transport_epoch DESC) = 1)
    SELECT count(*) AS tracks, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, concat_ws(',', CASE WHEN min(transport_epoch) < max(transport_epoch) THEN 'epochs_differ' END, CASE WHEN max(max_lag_ms) >= 250 THEN 'lag_250_ms' END, CASE WHEN min(coverage_ratio) < CAST(0.9 AS DOUBLE) THEN 'partial_coverage' END) AS warnings,
    coalesce(string_agg(CASE WHEN coverage_ratio < CAST(0.9 AS DOUBLE) THEN runtime_id END, ',' ORDER BY runtime_id), '') AS partial FROM n""",
)
def t32_overview(spark, sf_dir):
    out = state.song_overview(timeline.pass_summary(partials(spark, sf_dir)))
    return out.withColumns({"warnings": F.array_join("warnings", ","), "partial": F.array_join("partial", ",")})
