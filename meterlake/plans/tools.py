"""The registered queries: each reads the given tables through the frames mapping and calls one operator.

``AS_OF`` and ``SECONDS`` are on the song clock: the last minute of the event table's song.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import expr as X
from ..operators import compare, dynamics, pairs, recent, state, timeline
from ..sources import documents
from ..sources import frames as source
from . import oracle as sql
from .lineage import cut

AS_OF, SECONDS = 170.0, 60.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def frames(spark: SparkSession, sf_dir: str, sectioned: bool = False, spectra: bool = False) -> DataFrame:
    f = source.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), sectioned)
    return source.attach_bands(f, spark.read.parquet(f"{sf_dir}/embeddings.parquet")) if spectra else f


def window(spark: SparkSession, sf_dir: str, spectra: bool = False) -> DataFrame:
    return recent.window(frames(spark, sf_dir, spectra=spectra), AS_OF, SECONDS)


def partials(spark: SparkSession, sf_dir: str, sectioned: bool = False, spectra: bool = False) -> DataFrame:
    return timeline.accumulate(frames(spark, sf_dir, sectioned, spectra), spectra)


W = f"WITH {sql.frames()}, {sql.window(SECONDS, AS_OF)}"
WB = f"{W}, {sql.BANDS}"
P = f"WITH {sql.frames()}, {sql.PARTIALS}"
PS = f"WITH {sql.frames(True)}, {sql.PARTIALS}"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY arrival_seq DESC) AS r FROM f) WHERE r = 1)"
BINDINGS = "bindings AS (SELECT * FROM (VALUES ('rt-error', 0, 'Master', 0), ('rt-click', 1, 'Drums', 0), ('rt-purchase', 2, 'Bass', 0), ('rt-signup', 3, 'Keys', 0), ('rt-gone', 9, 'Old', 0)) v(runtime_id, fl_track_index, fl_track_name, slot))"
SUMMARY = "start_seconds, end_seconds, frame_count, active_ratio, covered_seconds, coverage_ratio, rms_db, lufs_s, peak_db, true_peak_dbtp, crest_db, centroid_hz, stereo_correlation, stereo_width, spectral_flux_mean, mean_lag_ms, max_lag_ms, dropped_blocks"
SUMMARY_COLUMNS = SUMMARY.split(", ")


# --- projections and predicates ---


@query("p03_feature_mask", f"WITH {sql.frames()} SELECT mask AS analysis_feature_mask, count(*) AS n, count(lufs_s) AS lufs, count(centroid_hz) AS centroid, count(corr) AS corr, count(flux) AS flux FROM f GROUP BY mask")
def p03(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("analysis_feature_mask").agg(
        F.count("*").alias("n"), F.count("lufs_s").alias("lufs"), F.count("centroid_hz").alias("centroid"), F.count("stereo_correlation").alias("corr"), F.count("spectral_flux_mean").alias("flux")
    )


@query("x15_features", f"WITH {sql.frames()} SELECT arrival_seq, (mask & 1) <> 0 AS core, (mask & 2) <> 0 AS loudness, (mask & 4) <> 0 AS spectrum, (mask & 8) <> 0 AS stereo, (mask & 16) <> 0 AS temporal, (mask & 32) <> 0 AS semantic FROM f")
def x15(spark, sf_dir):
    return frames(spark, sf_dir).select("arrival_seq", *[c.alias(n) for n, c in X.features("analysis_feature_mask").items()])


@query("p09_corr_label", f"WITH {sql.frames()} SELECT CASE WHEN corr < -0.25 THEN 'strong_negative' WHEN corr < 0 THEN 'negative' WHEN corr < 0.25 THEN 'weak' ELSE 'positive' END AS label, count(*) AS n FROM f WHERE corr IS NOT NULL GROUP BY 1")
def p09(spark, sf_dir):
    return frames(spark, sf_dir).where("stereo_correlation is not null").groupBy(X.correlation_label("stereo_correlation").alias("label")).agg(F.count("*").alias("n"))


@query(
    "p10_master_warnings",
    f"""WITH {sql.frames()}, x AS (SELECT arrival_seq, concat_ws(',', CASE WHEN true_peak_dbtp > 0 THEN 'true_peak_over_0' END, CASE WHEN true_peak_dbtp > -1 AND true_peak_dbtp <= 0 THEN 'true_peak_over_-1' END,
    CASE WHEN peak_db > CAST(-0.1 AS DOUBLE) THEN 'sample_peak_near_0' END, CASE WHEN corr < 0 THEN 'negative_correlation' END, CASE WHEN crest_db < 4 THEN 'low_crest' END) AS warnings FROM f) SELECT * FROM x WHERE warnings <> ''""",
)
def p10(spark, sf_dir):
    return recent.master_warnings(frames(spark, sf_dir))


# --- registry ---


@query("w01_latest", f"WITH {sql.frames()}, {LATEST} SELECT runtime_id, arrival_seq, transport_epoch, round(rms_db, 4) AS rms_db, sp AS signal_present FROM latest")
def w01(spark, sf_dir):
    return state.latest(frames(spark, sf_dir)).select("runtime_id", "arrival_seq", "transport_epoch", F.round("rms_db", 4).alias("rms_db"), "signal_present")


@query("w02_last_event", f"WITH {sql.frames()} SELECT arrival_seq, runtime_id FROM f ORDER BY arrival_seq DESC LIMIT 1")
def w02(spark, sf_dir):
    return state.last_event(frames(spark, sf_dir), 1e9, 2e9).select("arrival_seq", "runtime_id")


@query("w03_history", f"WITH {sql.frames()} SELECT runtime_id, arrival_seq, CAST(r AS INTEGER) AS history_rank FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY arrival_seq DESC) AS r FROM f) WHERE r <= 3600")
def w03(spark, sf_dir):
    return state.history(frames(spark, sf_dir)).select("runtime_id", "arrival_seq", "history_rank")


@query("w04_retention", f"{P} SELECT runtime_id, transport_epoch, bin AS bin_index FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY last_seq DESC) AS r FROM acc) WHERE r <= 100")
def w04(spark, sf_dir):
    return timeline.retain(partials(spark, sf_dir), 100).select("runtime_id", "transport_epoch", "bin_index")


def _live(spark, sf_dir):
    return state.latest(frames(spark, sf_dir).select("runtime_id", "track", "arrival_seq", "received_at", "signal_present", "true_peak_dbtp"))


@query("j01_bind_left", f"WITH {sql.frames()}, {BINDINGS} SELECT f.runtime_id, fl_track_index, fl_track_name, count(*) AS n FROM f LEFT JOIN bindings b ON f.runtime_id = b.runtime_id GROUP BY ALL")
def j01(spark, sf_dir):
    return state.bound(frames(spark, sf_dir), source.bindings(spark)).groupBy("runtime_id", "fl_track_index", "fl_track_name").agg(F.count("*").alias("n"))


@query("j02_stale_anti", f"WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT * FROM bindings b WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.runtime_id = b.runtime_id)")
def j02(spark, sf_dir):
    return state.stale_bindings(source.bindings(spark), _live(spark, sf_dir))


@query("j02b_live_semi", f"WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT * FROM bindings b WHERE EXISTS (SELECT 1 FROM latest l WHERE l.runtime_id = b.runtime_id)")
def j02b(spark, sf_dir):
    return state.live_bindings(source.bindings(spark), _live(spark, sf_dir))


@query(
    "j03_resolve",
    f"""WITH {sql.frames()}, {LATEST}, s AS (SELECT event_type AS selector FROM events UNION SELECT 'rt-' || event_type FROM events UNION SELECT 'rt-' || substr(event_type, 1, 1) FROM events)
    SELECT selector, CASE WHEN n = 1 THEN id END AS runtime_id, n AS matches FROM (
      SELECT s.selector, coalesce(e.n, 0) AS en, CASE WHEN e.n > 0 THEN e.n WHEN t.n > 0 THEN t.n ELSE coalesce(p.n, 0) END AS n, CASE WHEN e.n > 0 THEN e.id WHEN t.n > 0 THEN t.id ELSE p.id END AS id FROM s
      LEFT JOIN (SELECT s.selector, count(*) n, min(runtime_id) id FROM s JOIN latest l ON l.runtime_id = s.selector GROUP BY 1) e ON e.selector = s.selector
      LEFT JOIN (SELECT s.selector, count(*) n, min(runtime_id) id FROM s JOIN latest l ON lower(l.track) = lower(s.selector) GROUP BY 1) t ON t.selector = s.selector
      LEFT JOIN (SELECT s.selector, count(*) n, min(runtime_id) id FROM s JOIN latest l ON starts_with(l.runtime_id, s.selector) GROUP BY 1) p ON p.selector = s.selector)""",
)
def j03(spark, sf_dir):
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    parts = F.explode(F.array(F.col("event_type"), F.concat(F.lit("rt-"), "event_type"), F.concat(F.lit("rt-"), F.substring("event_type", 1, 1))))
    return state.resolve(types.select(parts.alias("selector")).distinct(), _live(spark, sf_dir), source.bindings(spark)).select("selector", "runtime_id", "matches")


@query("g01_duplicates", f"WITH {sql.frames()}, {LATEST} SELECT lower(track) AS name, count(*) AS n, count(*) > 1 AS duplicate FROM latest GROUP BY 1")
def g01(spark, sf_dir):
    return state.duplicate_names(_live(spark, sf_dir))


@query(
    "t12_project_status",
    f"""WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT count(*) AS live, count(fl_track_index) AS bound, count(*) FILTER (WHERE sp) AS active, count(*) FILTER (WHERE NOT sp) AS silent,
    count(*) FILTER (WHERE {AS_OF} - received_at > 3) AS stale, count(*) FILTER (WHERE true_peak_dbtp > 0) AS over FROM latest l LEFT JOIN bindings b ON l.runtime_id = b.runtime_id""",
)
def t12(spark, sf_dir):
    return state.project_status(_live(spark, sf_dir), source.bindings(spark), AS_OF)


@query(
    "o01_track_order",
    f"WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT l.runtime_id, CAST(row_number() OVER (ORDER BY fl_track_index IS NULL, coalesce(fl_track_index, 9999), lower(l.track), l.runtime_id) AS INTEGER) AS ord FROM latest l LEFT JOIN bindings b ON l.runtime_id = b.runtime_id",
)
def o01(spark, sf_dir):
    from pyspark.sql import Window

    live = state.bound(_live(spark, sf_dir), source.bindings(spark))
    w = Window.orderBy(F.isnull("fl_track_index"), F.coalesce("fl_track_index", F.lit(9999)), F.lower("track"), "runtime_id")
    return live.select("runtime_id", F.row_number().over(w).alias("ord"))  # one row per track of a project: 64 at most


# --- recent window ---


@query(
    "t07_average",
    f"""{W} SELECT runtime_id, count(*) AS frames, count(*) FILTER (WHERE sp) AS active_frames, round(CAST(count(*) FILTER (WHERE sp) AS DOUBLE) / count(*), 4) AS active_ratio, round(max(peak_db), 4) AS peak_db,
    round(10 * log10(greatest(avg(CASE WHEN sp AND rms_db > -120 THEN pow(10, rms_db / 10) END), 1e-12)), 4) AS rms_db, round(10 * log10(greatest(avg(CASE WHEN sp AND lufs_s > -120 THEN pow(10, lufs_s / 10) END), 1e-12)), 4) AS lufs_s,
    round(avg(crest_db) FILTER (WHERE sp), 4) AS crest_db, round(avg(centroid_hz) FILTER (WHERE sp), 2) AS centroid_hz, round(avg(corr) FILTER (WHERE sp), 4) AS stereo_correlation, round(min(corr) FILTER (WHERE sp), 4) AS stereo_correlation_min,
    round(avg(width) FILTER (WHERE sp), 4) AS stereo_width, round(arg_max(true_peak_dbtp, arrival_seq) FILTER (WHERE true_peak_dbtp IS NOT NULL), 4) AS true_peak_latest FROM w GROUP BY runtime_id""",
)
def t07(spark, sf_dir):
    return recent.average(window(spark, sf_dir))


@query(
    "a05_band_means",
    f"""{WB} SELECT runtime_id, CAST(band AS INTEGER) AS band, round(10 * log10(greatest(avg(pow(10, mid / 10)), 1e-12)), 4) AS plain_db, round(10 * log10(greatest(avg(CASE WHEN mid > -120 THEN pow(10, mid / 10) END), 1e-12)), 4) AS above_db,
    round(10 * log10(greatest(avg(CASE WHEN mid > -120 THEN pow(10, mid / 10) ELSE 0 END), 1e-12)), 4) AS zero_db, round(avg(mid), 4) AS ratio_db FROM bands WHERE mid IS NOT NULL GROUP BY ALL""",
)
def a05(spark, sf_dir):
    return recent.band_means(window(spark, sf_dir, True))


@query(
    "t18_temporal_profile",
    f"""{W} SELECT runtime_id, count(*) FILTER (WHERE (mask & 16) <> 0) AS valid_frames, count(*) FILTER (WHERE (mask & 16) <> 0 AND (rise >= 3 OR flux_peak >= CAST(0.18 AS DOUBLE))) AS onsets,
    round(sum(flux * greatest(CAST(1e-6 AS DOUBLE), coalesce(secs, 0))) FILTER (WHERE (mask & 16) <> 0) / sum(greatest(CAST(1e-6 AS DOUBLE), coalesce(secs, 0))) FILTER (WHERE (mask & 16) <> 0 AND flux IS NOT NULL), 6) AS flux_mean, round(max(flux_peak) FILTER (WHERE (mask & 16) <> 0), 6) AS flux_peak, round(max(rise) FILTER (WHERE (mask & 16) <> 0), 4) AS rise_peak_db FROM w GROUP BY 1""",
)
def t18(spark, sf_dir):
    return recent.temporal_profile(window(spark, sf_dir))


@query("t07_spectral_shape", f"{W} SELECT runtime_id, round(avg(rolloff) FILTER (WHERE sp), 2) AS rolloff_hz, round(avg(flatness) FILTER (WHERE sp), 6) AS flatness FROM w GROUP BY 1")
def t07_shape(spark, sf_dir):
    return recent.spectral_shape(window(spark, sf_dir))


@query(
    "t18_low_band",
    f"""{W} SELECT runtime_id, round(sum(secs), 4) AS observed_seconds, round(count(*) FILTER (WHERE rise >= 3 OR flux_peak >= CAST(0.18 AS DOUBLE)) / sum(secs), 4) AS onset_density_hz, round(sum(flux * greatest(1e-6, secs)) / sum(greatest(1e-6, secs)), 6) AS flux_mean,
    round(10 * log10(greatest(avg(CASE WHEN low_db > -120 THEN pow(10, low_db / 10) END), 1e-12)), 4) AS low_band_db, round(min(low_db), 4) AS low_band_min_db, round(max(low_db), 4) AS low_band_max_db FROM w WHERE (mask & 16) <> 0 GROUP BY 1""",
)
def t18_low(spark, sf_dir):
    return recent.low_band_profile(window(spark, sf_dir))


_LEVEL = "round(10 * log10(greatest(avg({0}), 1e-12)), 4)"
_MID_SIDE = f"""ms AS (SELECT runtime_id, {_LEVEL.format("CASE WHEN mid_db > -120 THEN pow(10, mid_db / 10) END")} AS mid_rms_db, {_LEVEL.format("CASE WHEN side_db > -120 THEN pow(10, side_db / 10) END")} AS side_rms_db, {_LEVEL.format("pow(10, stm_db / 10)")} AS side_to_mid_db,
 round(avg(1 - abs(corr)), 6) AS decorrelation_mean, round(avg(negative), 6) AS negative_cross_mean, round(max(negative), 6) AS negative_cross_max, round(avg(low_corr), 6) AS low_band_correlation, round(min(low_corr), 6) AS low_band_correlation_min,
 {_LEVEL.format("pow(10, low_stm_db / 10)")} AS low_band_side_to_mid_db, round(max(low_stm_db), 4) AS low_band_side_to_mid_max_db FROM w WHERE sp AND (mask & 8) <> 0 GROUP BY 1)"""


@query("t22_mid_side", f"{W}, {_MID_SIDE} SELECT * FROM ms")
def t22_mid_side(spark, sf_dir):
    return recent.mid_side_profile(window(spark, sf_dir))


@query("t23_mid_side_compare", f"{W}, {_MID_SIDE} SELECT p.runtime_id AS a, q.runtime_id AS b, " + ", ".join(f"round(q.{m} - p.{m}, 4) AS {m}_delta" for m in recent.MID_SIDE) + " FROM ms p JOIN ms q ON p.runtime_id < q.runtime_id")
def t23_mid_side(spark, sf_dir):
    return recent.mid_side_compare(recent.mid_side_profile(window(spark, sf_dir)))


@query("t24_harmonic", f"{W} SELECT runtime_id, round(avg(harmonic), 6) AS harmonic_mean, round(max(harmonic), 6) AS harmonic_max, round(median(CASE WHEN f0 > 0 THEN f0 END), 4) AS f0_median_hz, round(min(CASE WHEN f0 > 0 THEN f0 END), 4) AS f0_min_hz, round(max(f0), 4) AS f0_max_hz FROM w WHERE sp AND (mask & 32) <> 0 GROUP BY 1")
def t24_harmonic(spark, sf_dir):
    return recent.harmonic_profile(window(spark, sf_dir))


_STEREO = "SELECT runtime_id, count(*) AS frames, round(avg(corr), 4) AS correlation_mean, round(min(corr), 4) AS correlation_min, round(max(corr), 4) AS correlation_max, round(avg(width), 4) AS width_mean, round(avg(CASE WHEN corr < 0 THEN 1.0 ELSE 0.0 END), 4) AS negative_ratio FROM w WHERE sp AND (mask & 8) <> 0 GROUP BY 1"


@query("t22_stereo_profile", f"{W}, x AS ({_STEREO}) SELECT *, CASE WHEN correlation_mean < -0.25 THEN 'strong_negative' WHEN correlation_mean < 0 THEN 'negative' WHEN correlation_mean < 0.25 THEN 'weak' ELSE 'positive' END AS label FROM x")
def t22(spark, sf_dir):
    return recent.stereo_profile(window(spark, sf_dir))


@query("t23_stereo_compare", f"{W}, x AS ({_STEREO}) SELECT p.runtime_id AS a, q.runtime_id AS b, round(q.correlation_mean - p.correlation_mean, 4) AS correlation_delta, round(q.width_mean - p.width_mean, 4) AS width_delta FROM x p JOIN x q ON p.runtime_id < q.runtime_id")
def t23(spark, sf_dir):
    x = recent.stereo_profile(window(spark, sf_dir))
    a, b = (x.select(F.col("runtime_id").alias(s), F.col("correlation_mean").alias(f"c{s}"), F.col("width_mean").alias(f"w{s}")) for s in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", X.delta("ca", "cb").alias("correlation_delta"), X.delta("wa", "wb").alias("width_delta"))


@query(
    "t27_performance",
    f"""{W} SELECT CASE mask WHEN 1 THEN 'eco' WHEN 15 THEN 'balanced' WHEN 31 THEN 'mix' ELSE 'full' END AS profile, count(*) AS frames, count(DISTINCT runtime_id) AS tracks, max(lag) AS max_lag_ms, round(avg(lag), 4) AS mean_lag_ms, CAST(sum(dropped) AS BIGINT) AS dropped FROM w GROUP BY 1""",
)
def t27(spark, sf_dir):
    return recent.performance(window(spark, sf_dir))


@query("x09_regions", f"{WB} SELECT runtime_id, CAST({sql.region_case()} AS INTEGER) AS region, round(10 * log10(greatest(avg(pow(10, plain_db / 10)), 1e-12)), 4) AS region_db FROM means GROUP BY ALL")
def x09(spark, sf_dir):
    return recent.regions(recent.band_means(window(spark, sf_dir, True)))


_ERB = f"erbs AS (SELECT runtime_id, CAST({sql.erb_case()} AS INTEGER) AS erb, round(10 * log10(greatest(avg(pow(10, plain_db / 10)), 1e-12)), 4) AS erb_db FROM means GROUP BY ALL)"


@query("x07_erb", f"{WB}, {_ERB} SELECT * FROM erbs WHERE erb IS NOT NULL")
def x07(spark, sf_dir):
    return recent.erb_bands(recent.band_means(window(spark, sf_dir, True)))


@query("j04_pairs", f"WITH {sql.frames()}, {LATEST}, {BINDINGS}, n AS (SELECT l.runtime_id, fl_track_index AS i FROM latest l LEFT JOIN bindings b ON l.runtime_id = b.runtime_id WHERE coalesce(fl_track_index, -1) <> 0) SELECT p.runtime_id AS a, q.runtime_id AS b FROM n p JOIN n q ON p.runtime_id < q.runtime_id AND coalesce(p.i <> q.i, true)")
def j04(spark, sf_dir):
    live = state.bound(_live(spark, sf_dir), source.bindings(spark))
    return pairs.tracks_in_pairs(live, master=F.col("fl_track_index") == 0)


_OVER = "rel AS (SELECT runtime_id, band, plain_db, pow(10, (plain_db - max(plain_db) OVER (PARTITION BY runtime_id)) / 10) AS r FROM means), ov AS (SELECT p.runtime_id AS a, q.runtime_id AS b, p.band, least(p.r, q.r) AS o FROM rel p JOIN rel q ON p.band = q.band AND p.runtime_id < q.runtime_id)"
_SCORE = "sc AS (SELECT a, b, round(avg(o), 4) AS score, CAST(min(CASE WHEN r = 1 THEN band END) AS INTEGER) AS strongest_band FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY o DESC, band) AS r FROM ov) WHERE r <= 5 GROUP BY a, b)"


def _means(spark, sf_dir):
    return recent.band_means(window(spark, sf_dir, True))


def _pairs_of(rows):
    return pairs.tracks_in_pairs(rows.select("runtime_id").distinct())


@query("t09_compare", f"{WB}, {_OVER}, {_SCORE} SELECT a, b, score FROM sc")
def t09(spark, sf_dir):
    m = _means(spark, sf_dir)
    return pairs.compare(m, _pairs_of(m)).select("a", "b", "score")


@query("t10_detect", f"{WB}, {_OVER} SELECT a, b, CAST(band AS INTEGER) AS band, round(o, 4) AS overlap FROM ov WHERE round(o, 4) >= CAST(0.15 AS DOUBLE)")
def t10(spark, sf_dir):
    m = _means(spark, sf_dir)
    return pairs.detect(m, _pairs_of(m))


@query("t13_mix_overview", f"{WB}, {_OVER}, {_SCORE} SELECT a, b, score FROM sc ORDER BY score DESC, a, b LIMIT 8")
def t13(spark, sf_dir):
    m = _means(spark, sf_dir)
    return pairs.top_pairs(pairs.compare(m, _pairs_of(m))).select("a", "b", "score")


_CHROMA = """ch AS (SELECT w.runtime_id, CAST(g.i AS INTEGER) AS pitch, pow(CAST(embedding[g.i + 1] AS DOUBLE), 2) / list_sum([pow(CAST(x AS DOUBLE), 2) FOR x IN embedding[1:12]]) AS x,
  greatest(1e-6, list_sum([pow(CAST(x AS DOUBLE), 2) FOR x IN embedding[1:12]]) / list_sum([pow(CAST(x AS DOUBLE), 2) FOR x IN embedding[1:32]])) AS wt
  FROM w JOIN embeddings e ON w.vec_id = e.vec_id, (SELECT unnest(range(12)) AS i) g WHERE sp AND (mask & 32) <> 0),
 cs AS (SELECT runtime_id, pitch, sum(x * wt) AS s FROM ch GROUP BY ALL), share AS (SELECT runtime_id, pitch, s / sum(s) OVER (PARTITION BY runtime_id) AS share FROM cs)"""


@query("a11_chroma", f"{W}, {_CHROMA} SELECT runtime_id, pitch, round(share, 5) AS share FROM share")
def a11(spark, sf_dir):
    return recent.chroma(window(spark, sf_dir, True)).select("runtime_id", "pitch", F.round("share", 5).alias("share"))


_KEYS = "kp AS (SELECT * FROM (VALUES " + ", ".join(f"('{dims.PITCHES[t]} {m}', {p}, CAST({prof[(p - t) % 12]} AS DOUBLE))" for m, prof in (("major", dims.MAJOR), ("minor", dims.MINOR)) for t in range(12) for p in range(12)) + ") v(key, pitch, weight))"


@query("t24_tonal", f"{W}, {_CHROMA}, {_KEYS}, x AS (SELECT runtime_id, key, round(corr(share, weight), 4) AS score FROM share JOIN kp ON share.pitch = kp.pitch GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY runtime_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM x) WHERE rank <= 5")
def t24(spark, sf_dir):
    return recent.keys(recent.chroma(window(spark, sf_dir, True)), dims.key_profile_dim(spark)).where("rank <= 5")


@query("x10_entropy", f"{W}, {_CHROMA} SELECT runtime_id, round(sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) / ln(12), 4) AS entropy FROM share GROUP BY 1")
def x10(spark, sf_dir):
    return recent.chroma_shape(recent.chroma(window(spark, sf_dir, True))).select("runtime_id", "entropy")


@query(
    "t25_tonal_compare",
    f"""{W}, {_CHROMA} SELECT p.runtime_id AS a, q.runtime_id AS b, round(sum(p.share * q.share) / (sqrt(sum(p.share * p.share)) * sqrt(sum(q.share * q.share))), 4) AS cosine,
    round(sum(0.5 * p.share * log2(p.share / ((p.share + q.share) / 2)) + 0.5 * q.share * log2(q.share / ((p.share + q.share) / 2))), 4) AS divergence FROM share p JOIN share q ON p.pitch = q.pitch AND p.runtime_id < q.runtime_id GROUP BY ALL""",
)
def t25(spark, sf_dir):
    return recent.tonal_compare(recent.chroma_shape(recent.chroma(window(spark, sf_dir, True))))


_ZERO = "round(10 * log10(greatest(avg(CASE WHEN {0} > -120 THEN pow(10, {0} / 10) ELSE 0 END), 1e-12)), 4)"


@query(
    "t44_mono",
    f"""{WB}, z AS (SELECT runtime_id, band, pow(10, {_ZERO.format('mid')} / 10) AS m FROM bands WHERE mid IS NOT NULL GROUP BY ALL), y AS (SELECT runtime_id, band, pow(10, {_ZERO.format('side')} / 10) AS s FROM bands WHERE side IS NOT NULL GROUP BY ALL)
    SELECT z.runtime_id, CAST(z.band AS INTEGER) AS band, round(10 * log10(m / (m + s)), 4) AS delta_db, m <= 1e-12 AS floor_censored, round(1 - m / (m + s), 4) AS loss, round((m + s) / max(m + s) OVER (PARTITION BY z.runtime_id) * (1 - m / (m + s)), 4) AS priority FROM z JOIN y ON z.runtime_id = y.runtime_id AND z.band = y.band""",
)
def t44(spark, sf_dir):
    w = window(spark, sf_dir, True)
    return recent.mono_fold(recent.band_means(w), recent.band_means(w, "side_bands_db"))


_FOLD = f"""z AS (SELECT runtime_id, band, {_ZERO.format('mid')} AS m FROM bands WHERE mid IS NOT NULL GROUP BY ALL), y AS (SELECT runtime_id, band, {_ZERO.format('side')} AS s FROM bands WHERE side IS NOT NULL GROUP BY ALL),
fold AS (SELECT z.runtime_id, z.band, CASE WHEN m > -120 THEN pow(10, m / 10) ELSE 0 END AS m, CASE WHEN s > -120 THEN pow(10, s / 10) ELSE 0 END AS s FROM z JOIN y ON z.runtime_id = y.runtime_id AND z.band = y.band),
fg AS (SELECT runtime_id, CAST({sql.region_case()} AS INTEGER) AS region, count(*) AS centers, sum(m) AS m, sum(s) AS s FROM fold WHERE m + s > 1e-12 GROUP BY ALL),
fd AS (SELECT runtime_id, region, centers, round(10 * log10(greatest(m, 1e-12) / (m + s)), 4) AS delta_db, m <= 1e-12 AS floor_censored, 1 - m / (m + s) AS l, (m + s) / max(m + s) OVER (PARTITION BY runtime_id) AS p FROM fg)"""


def _mono_groups(spark, sf_dir):
    w = window(spark, sf_dir, True)
    return recent.mono_groups(recent.band_means(w), recent.band_means(w, "side_bands_db"))


@query("c12_mono_groups", f"{WB}, {_FOLD} SELECT runtime_id, region, centers, delta_db, floor_censored, round(l, 6) AS loss, round(p, 6) AS share, round(p * round(l, 6), 6) AS priority FROM fd")
def c12(spark, sf_dir):
    return _mono_groups(spark, sf_dir)


@query(
    "c13_reference_mono",
    f"{WB}, {_FOLD} SELECT r.region, round(t.delta_db - r.delta_db, 4) AS mono_delta_db, r.floor_censored AS reference_floor_censored, t.floor_censored AS target_floor_censored FROM fd r JOIN fd t ON r.region = t.region AND r.runtime_id = 'rt-click' AND t.runtime_id = 'rt-view'",
)
def c13_mono(spark, sf_dir):
    g = _mono_groups(spark, sf_dir)
    return compare.compare_mono_groups(g.where("runtime_id = 'rt-click'"), g.where("runtime_id = 'rt-view'"))


@query(
    "t04_bind_last_identified",
    f"""WITH {sql.frames()}, ids AS (SELECT received_at AS at, max(runtime_id) AS found FROM f WHERE arrival_seq % 11 = 0 GROUP BY 1), rq AS (SELECT arrival_seq AS request, received_at AS at FROM f WHERE arrival_seq % 7 = 0)
    SELECT request, CASE WHEN rq.at - ids.at <= CAST(0.1 AS DOUBLE) THEN found END AS runtime_id FROM rq ASOF LEFT JOIN ids ON rq.at >= ids.at""",
)
def t04(spark, sf_dir):
    """Every eleventh event identifies its track and every seventh asks; the age is short, so that some find none."""
    f = frames(spark, sf_dir)
    asks = f.where("arrival_seq % 7 = 0").select(F.col("arrival_seq").alias("request"), F.col("received_at").alias("at"))
    return state.bind_last_identified(asks, f.where("arrival_seq % 11 = 0").select("runtime_id", F.col("received_at").alias("at")), 0.1)


@query(
    "r15_documents",
    f"""{P}, g AS (SELECT runtime_id, transport_epoch, CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER) AS group_index, CAST(sum(n) AS BIGINT) AS frame_count FROM acc GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY runtime_id, transport_epoch) > 24 AS truncated FROM g QUALIFY row_number() OVER (PARTITION BY runtime_id, transport_epoch ORDER BY group_index) <= 24)
    SELECT runtime_id, transport_epoch, CAST(to_json(struct_pack(runtime_id := runtime_id, transport_epoch := transport_epoch, bins := list(struct_pack(group_index := group_index, frame_count := frame_count, truncated := truncated) ORDER BY group_index))) AS VARCHAR) AS document FROM c GROUP BY runtime_id, transport_epoch""",
)
def r15(spark, sf_dir):
    rows = timeline.first_groups(timeline.song_timeline(partials(spark, sf_dir)), 24)
    return documents.documents(rows.select(*timeline.KEY, "group_index", "frame_count", "truncated"), timeline.KEY, "group_index", "bins")


# --- alignment ---


WR, WBR = W.replace("WITH", "WITH RECURSIVE", 1), WB.replace("WITH", "WITH RECURSIVE", 1)
ERBS = list(zip(dims.erb_edges()[:-1], dims.erb_edges()[1:], strict=True))


@query("j07_align", f"{WR}, {sql.aligned()} SELECT a, b, a_seq, b_seq, round(dt, 6) AS dt FROM al")
def j07(spark, sf_dir):
    w = window(spark, sf_dir)
    return pairs.align(w, _pairs_of(w)).select("a", "b", "a_seq", "b_seq", F.round("dt", 6).alias("dt"))


_LOW = "CASE WHEN band IN (" + ", ".join(str(i) for i, c in enumerate(dims.BAND_CENTERS) if 40 <= c < 160) + ") THEN 0 END"


@query(
    "t19_temporal_compare",
    f"""{WBR}, {sql.aligned()}, {sql.region_levels(_LOW)}, {sql.REGION_TEMPORAL}, o AS (SELECT arrival_seq, flux, (mask & 16) <> 0 AND (coalesce(rise, 0) >= 3 OR coalesce(flux_peak, 0) >= CAST(0.18 AS DOUBLE)) AS onset FROM w),
    b AS (SELECT al.a, al.b, count(*) AS aligned, count(*) FILTER (WHERE x.onset AND y.onset) AS onsets_together, round(corr(x.flux, y.flux), 4) AS correlation, round(avg(abs(dt)), 6) AS mean_abs_dt FROM al JOIN o x ON x.arrival_seq = al.a_seq JOIN o y ON y.arrival_seq = al.b_seq GROUP BY ALL)
    SELECT b.*, usable_pairs, coactive_ratio, band_correlation, round(temporal, 6) AS band_overlap FROM b LEFT JOIN (rt JOIN ca USING (a, b)) ON rt.a = b.a AND rt.b = b.b""",
)
def t19(spark, sf_dir):
    w = window(spark, sf_dir, True)
    return pairs.temporal_compare(pairs.align(w, _pairs_of(w)), w)


def _evidence(names: str = "p.runtime_id < q.runtime_id") -> str:
    return f"""{_ERB}, {sql.region_levels(sql.erb_case())}, {sql.REGION_TEMPORAL}, er AS (SELECT *, pow(10, (erb_db - max(erb_db) OVER (PARTITION BY runtime_id)) / 10) AS r FROM erbs WHERE erb IS NOT NULL),
    eo AS (SELECT p.runtime_id AS a, q.runtime_id AS b, p.erb, least(p.r, q.r) AS overlap, 1 / (1 + exp(-(p.erb_db - q.erb_db) / 6)) AS wt FROM er p JOIN er q ON p.erb = q.erb AND {names}),
    es AS (SELECT eo.*, overlap * wt AS sab, overlap * (1 - wt) AS sba, overlap * wt * (0.25 + 0.75 * temporal) AS cab, overlap * (1 - wt) * (0.25 + 0.75 * temporal) AS cba, usable_pairs, coactive_ratio, band_correlation, temporal
      FROM eo LEFT JOIN (rt JOIN ca USING (a, b)) ON rt.a = eo.a AND rt.b = eo.b AND rt.region = eo.erb),
    ev AS (SELECT a, b, erb, round(overlap, 6) AS overlap, round(sab, 6) AS spectral_ab, round(sba, 6) AS spectral_ba, round(cab, 6) AS combined_ab, round(cba, 6) AS combined_ba, usable_pairs, coactive_ratio, band_correlation, round(temporal, 6) AS temporal, round(greatest(coalesce(cab, sab), coalesce(cba, sba)), 6) AS strength FROM es),
    ek AS (SELECT *, CAST(row_number() OVER (PARTITION BY a, b ORDER BY strength DESC, erb) AS INTEGER) AS rank FROM ev)"""


def evidence_of(frames, chosen=None, k: int = 8):
    """The ``k`` strongest regions of each pair of tracks, or of the pairs that ``chosen`` takes from the band means.

    Spectra are attached once: the frames' levels, and the few means and pairs, are what the steps reread.
    """
    f = cut(frames.select("runtime_id", "received_at", "arrival_seq", "signal_present", F.when(F.col("signal_present"), F.col("bands_db")).alias("bands_db")))
    m = cut(recent.band_means(f))
    p = cut(_pairs_of(m) if chosen is None else chosen(m))
    return pairs.evidence(recent.erb_bands(m), p, pairs.region_temporal(pairs.align(f, p), f, ERBS), k)


@query("t20_masking", f"{WBR}, {sql.aligned()}, {_evidence()} SELECT * FROM ek WHERE rank <= 8")
def t20(spark, sf_dir):
    return evidence_of(window(spark, sf_dir, True))


@query("t21_masking_scan", f"{WBR}, {sql.aligned()}, {_OVER}, {_SCORE}, tp AS (SELECT a, b FROM sc ORDER BY score DESC, a, b LIMIT 8), {_evidence()}, sm AS (SELECT ek.a, ek.b, round(avg(strength), 5) AS score FROM ek JOIN tp ON tp.a = ek.a AND tp.b = ek.b WHERE rank <= 4 GROUP BY ALL) SELECT * FROM sm ORDER BY score DESC, a, b LIMIT 4")
def t21(spark, sf_dir):
    """Evidence only for the strongest pairs by overlap: twice as many as are reported."""
    strongest = lambda m: pairs.top_pairs(pairs.compare(m, _pairs_of(m)), 8).select("a", "b")
    return pairs.top_pairs(pairs.evidence_score(evidence_of(window(spark, sf_dir, True), strongest)), 4)


@query(
    "x43_directional_deltas",
    f"""{WB}, rg AS (SELECT runtime_id, CAST({sql.region_case()} AS INTEGER) AS region, round(10 * log10(greatest(avg(pow(10, plain_db / 10)), 1e-12)), 4) AS db FROM means GROUP BY ALL),
    dd AS (SELECT p.runtime_id AS a, q.runtime_id AS b, p.region, round(q.db - p.db, 5) AS delta_db FROM rg p JOIN rg q ON p.region = q.region AND p.runtime_id < q.runtime_id)
    SELECT *, CASE WHEN delta_db > 0 THEN b WHEN delta_db < 0 THEN a END AS stronger, CAST(row_number() OVER (PARTITION BY a, b ORDER BY abs(delta_db) DESC, region) AS INTEGER) AS rank FROM dd QUALIFY rank <= 3""",
)
def x43(spark, sf_dir):
    r = recent.regions(recent.band_means(window(spark, sf_dir, True)))
    return pairs.directional_deltas(r, _pairs_of(r))


# --- timeline ---


@query("a14_timeline_partial", f"{P} SELECT runtime_id, transport_epoch, bin AS bin_index, n AS frame_count, active AS active_count, CAST(cover AS INTEGER) AS coverage_mask, round(rms_p, 6) AS rms_power_sum, rms_n AS rms_count, round(peak, 4) AS peak_db_max, dropped AS dropped_blocks_max FROM acc")
def a14(spark, sf_dir):
    return partials(spark, sf_dir).select(
        "runtime_id", "transport_epoch", "bin_index", "frame_count", "active_count", "coverage_mask", F.round("rms_db_power_sum", 6).alias("rms_power_sum"), F.col("rms_db_count").alias("rms_count"), F.round("peak_db_max", 4).alias("peak_db_max"), "dropped_blocks_max"
    )


@query("t31_song_timeline", f"{P}, x AS ({sql.summary('runtime_id, transport_epoch, CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER)', '5').replace('CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER),', 'CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER) AS group_index,', 1)}) SELECT runtime_id, transport_epoch, group_index, {SUMMARY} FROM x")
def t31(spark, sf_dir):
    return timeline.song_timeline(partials(spark, sf_dir)).select("runtime_id", "transport_epoch", "group_index", *SUMMARY_COLUMNS)


@query(
    "o04_first_groups",
    f"{P}, x AS ({sql.summary('runtime_id, transport_epoch, CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER)', '5').replace('CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER),', 'CAST(floor(CAST(bin AS DOUBLE) / 5) AS INTEGER) AS group_index,', 1)}), "
    "y AS (SELECT *, count(*) OVER (PARTITION BY runtime_id, transport_epoch) AS group_count FROM x) SELECT runtime_id, transport_epoch, group_index, frame_count, coverage_ratio, group_count, group_count > 24 AS truncated FROM y QUALIFY row_number() OVER (PARTITION BY runtime_id, transport_epoch ORDER BY group_index) <= 24",
)
def o04(spark, sf_dir):
    """The first 24 groups of each pass; the limit is the feature."""
    return timeline.first_groups(timeline.song_timeline(partials(spark, sf_dir)), 24).select("runtime_id", "transport_epoch", "group_index", "frame_count", "coverage_ratio", "group_count", "truncated")


_PASS = sql.summary("runtime_id, transport_epoch", "greatest(1, max(bin) + 1 - min(bin))")


@query("a15_pass_summary", f"{P}, x AS ({_PASS}), b AS (SELECT runtime_id, transport_epoch, count(*) AS bin_count FROM acc GROUP BY ALL) SELECT x.runtime_id, x.transport_epoch, bin_count, {SUMMARY} FROM x JOIN b ON x.runtime_id = b.runtime_id AND x.transport_epoch = b.transport_epoch")
def a15(spark, sf_dir):
    return timeline.pass_summary(partials(spark, sf_dir)).select("runtime_id", "transport_epoch", "bin_count", *SUMMARY_COLUMNS)


@query("t30_song_status", f"{P}, x AS ({_PASS}) SELECT runtime_id, transport_epoch, coverage_ratio, CASE WHEN coverage_ratio < 0.75 THEN 'coverage_below_0.75' WHEN coverage_ratio < 0.9 THEN 'coverage_below_0.9' END AS coverage_warning, max_lag_ms >= 250 AS lag_warning FROM x")
def t30(spark, sf_dir):
    x = timeline.pass_summary(partials(spark, sf_dir))
    warning = F.when(F.col("coverage_ratio") < 0.75, "coverage_below_0.75").when(F.col("coverage_ratio") < 0.9, "coverage_below_0.9")
    return x.select("runtime_id", "transport_epoch", "coverage_ratio", warning.alias("coverage_warning"), (F.col("max_lag_ms") >= 250).alias("lag_warning"))


@query("t32_song_overview", f"{P}, x AS ({_PASS}) SELECT runtime_id, {SUMMARY} FROM x WHERE transport_epoch = 1")
def t32(spark, sf_dir):
    return timeline.finalize(partials(spark, sf_dir).where("transport_epoch = 1"), timeline.KEY).select("runtime_id", *SUMMARY_COLUMNS)


_RANGE = f"x AS ({sql.summary('runtime_id, transport_epoch', '41', '(SELECT * FROM acc WHERE bin + 1 > 20 AND bin < 61)')}), c02 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY coverage_ratio DESC, last_received_at DESC, transport_epoch DESC) AS r FROM x) WHERE r = 1)"


@query("c02_range", f"{P}, {_RANGE} SELECT runtime_id, transport_epoch, coverage_ratio >= CAST(0.3 AS DOUBLE) AS adequate, {SUMMARY} FROM c02")
def c02(spark, sf_dir):
    return timeline.resolve_range(partials(spark, sf_dir), 20.25, 60.5, 0.3).select("runtime_id", "transport_epoch", "adequate", *SUMMARY_COLUMNS)


_ASKED = "rq AS (SELECT CAST(arrival_seq % 60 AS INTEGER) AS request, CAST(min(bin) FILTER (WHERE bin >= 2 * (arrival_seq % 60)) AS INTEGER) AS s FROM f GROUP BY 1), ra AS (SELECT request, s, s + 3 + (request * 7) % 70 AS e, CASE WHEN request % 2 = 1 THEN CAST(60 AS DOUBLE) - request / CAST(4 AS DOUBLE) END AS fence FROM rq WHERE s IS NOT NULL)"


@query(
    "c02_ranges",
    f"""{P}, {_ASKED}, x AS ({sql.summary('request, s, e, fence, runtime_id, transport_epoch', 'max(e - s)', '(SELECT ra.*, acc.* FROM ra JOIN acc ON bin >= s AND bin < e)')}),
    y AS (SELECT *, row_number() OVER (PARTITION BY request, runtime_id ORDER BY coverage_ratio DESC, last_received_at DESC, transport_epoch DESC) AS r FROM x WHERE fence IS NULL OR first_received_at > fence)
    SELECT request, runtime_id, transport_epoch, coverage_ratio >= CAST(0.8 AS DOUBLE) AS adequate, {SUMMARY} FROM y WHERE r = 1""",
)
def c02_ranges(spark, sf_dir):
    """Sixty ranges at once over a tree of partials, some behind a fence."""
    request = (F.col("arrival_seq") % 60).cast("int")
    starts = frames(spark, sf_dir).select(request.alias("request"), timeline.bin_index(F.col("transport_time_seconds")).alias("bin")).where("bin >= 2 * request").groupBy("request").agg(F.min("bin").alias("start"))
    asked = starts.select("request", "start", (F.col("start") + 3 + F.col("request") * 7 % 70).alias("end"), F.when(F.col("request") % 2 == 1, 60 - F.col("request") / 4.0).alias("fence"))
    return timeline.resolve_ranges(timeline.tree(partials(spark, sf_dir)), asked).select("request", "runtime_id", "transport_epoch", "adequate", *SUMMARY_COLUMNS)


@query("w09_gaps", f"{P} SELECT runtime_id, transport_epoch, CAST(p + 1 AS INTEGER) AS gap_start, bin AS gap_end FROM (SELECT *, lag(bin) OVER (PARTITION BY runtime_id, transport_epoch ORDER BY bin) AS p FROM acc) WHERE bin - p > 1")
def w09(spark, sf_dir):
    return timeline.gaps(partials(spark, sf_dir))


@query("a24_coverage", f"{P} SELECT runtime_id, transport_epoch, CAST(sum(bit_count(cover)) AS BIGINT) AS slots, count(*) AS bins FROM acc GROUP BY ALL")
def a24(spark, sf_dir):
    return partials(spark, sf_dir).groupBy(*timeline.KEY).agg(F.sum(F.bit_count("coverage_mask")).cast("long").alias("slots"), F.count("*").alias("bins"))


# --- distributions ---

_QS = ", ".join(f"({q})" for q in dynamics.QUANTILES)


def _percentiles(by: str, rows: str) -> str:
    return f"""o AS ({rows}), p AS (SELECT *, (sum(w) OVER (PARTITION BY {by} ORDER BY v, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY {by}) AS pos FROM o WHERE v IS NOT NULL AND w > 0),
    pq AS (SELECT *, lead(v) OVER (PARTITION BY {by} ORDER BY v, w) AS v2, lead(pos) OVER (PARTITION BY {by} ORDER BY pos) AS p2, min(pos) OVER (PARTITION BY {by}) AS p0 FROM p),
    pc AS (SELECT {by}, CAST(q AS DOUBLE) AS q, max(CASE WHEN q < p0 AND pos = p0 THEN v WHEN pos <= q AND v2 IS NULL THEN v WHEN pos <= q AND p2 > q THEN v + (v2 - v) * (q - pos) / (p2 - pos) END) AS x FROM pq, (VALUES {_QS}) t(q) GROUP BY {by}, q)"""


@query("a18_weighted_percentile", f"WITH {_percentiles('l_shipmode_', 'SELECT l_returnflag || l_linestatus AS l_shipmode_, l_extendedprice AS v, CAST(l_quantity AS DOUBLE) AS w FROM lineitem')} SELECT l_shipmode_ AS flag, q, round(x, 4) AS x FROM pc")
def a18(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("flag"), "l_extendedprice", "l_quantity")
    return dynamics.weighted_percentiles(rows, ["flag"], "l_extendedprice", "l_quantity").select("flag", "q", F.round("x", 4).alias("x"))


_BINS = f"bn AS ({sql.summary('runtime_id, transport_epoch, bin', '1')})"
_PCS = _percentiles("runtime_id, transport_epoch", "SELECT runtime_id, transport_epoch, rms_db AS v, covered_seconds AS w FROM bn WHERE coverage_ratio >= 0.5")


@query(
    "t43_dynamics",
    f"""{P}, {_BINS}, {_PCS}, a AS (SELECT runtime_id, transport_epoch, count(*) AS n, round(sum(w), 3) AS weight, round(min(v), 4) AS min, round(max(v), 4) AS max, round(sum(v * w) / sum(w), 4) AS mean, round(10 * log10(greatest(sum(pow(10, v / 10) * w) / sum(w), 1e-12)), 4) AS power_mean FROM p GROUP BY ALL),
    wd AS (SELECT runtime_id, transport_epoch, max(CASE WHEN q = 0.1 THEN x END) AS a1, max(CASE WHEN q = 0.25 THEN x END) AS a2, max(CASE WHEN q = 0.5 THEN x END) AS a3, max(CASE WHEN q = 0.75 THEN x END) AS a4, max(CASE WHEN q = 0.9 THEN x END) AS a5 FROM pc GROUP BY ALL)
    SELECT a.*, round(a1, 8) AS p10, round(a2, 8) AS p25, round(a3, 8) AS p50, round(a4, 8) AS p75, round(a5, 8) AS p90, round(a4 - a2, 8) AS iqr, round(a5 - a1, 8) AS spread FROM a JOIN wd ON a.runtime_id = wd.runtime_id AND a.transport_epoch = wd.transport_epoch""",
)
def t43(spark, sf_dir):
    bins = timeline.finalize(partials(spark, sf_dir), [*timeline.KEY, "bin_index"], F.lit(1.0))
    return dynamics.distribution(bins.where("coverage_ratio >= 0.5"), timeline.KEY, "rms_db", "covered_seconds", digits=8)


@query(
    "a17_bin_accounting",
    f"{P} SELECT runtime_id, transport_epoch, count(*) FILTER (WHERE bit_count(cover) >= 5) AS accepted, count(*) FILTER (WHERE bit_count(cover) < 5) AS rejected, 40 - count(*) AS missing, round(sum(bit_count(cover)) / CAST(10 AS DOUBLE), 3) AS covered_seconds, round(coalesce(sum(bit_count(cover)) FILTER (WHERE bit_count(cover) >= 5), 0) / CAST(10 AS DOUBLE), 3) AS accepted_seconds FROM acc WHERE bin >= 20 AND bin < 60 GROUP BY ALL",
)
def a17(spark, sf_dir):
    return dynamics.accepted(partials(spark, sf_dir), timeline.KEY, 20, 60)


_SHIFTS = ", ".join(f"('{m}', '{stat}', '{name}')" for m, stat, name in dynamics.SHIFTS)
_SIDES = "sd AS (SELECT runtime_id, transport_epoch, CASE WHEN bin >= 20 AND bin < 60 THEN 'primary' ELSE 'other' END AS side, * EXCLUDE (runtime_id, transport_epoch) FROM bn WHERE coverage_ratio >= 0.5 AND ((bin >= 20 AND bin < 60) OR (bin >= 100 AND bin < 140)))"
_MEASURED = " UNION ALL ".join(f"SELECT runtime_id, transport_epoch, side, '{m}' AS measure, CAST({m} AS DOUBLE) AS v, covered_seconds AS w FROM sd" for m in ("rms_db", "lufs_s", "crest_db", "peak_db"))


@query(
    "c17_section_comparison",
    f"""{P}, {_BINS}, {_SIDES}, {_percentiles('runtime_id, transport_epoch, side, measure', _MEASURED)},
    wd AS (SELECT runtime_id, transport_epoch, measure, {', '.join(f"max(CASE WHEN side = '{x}' AND q = {q} THEN x END) AS {x}_{round(q * 100)}" for x in ('primary', 'other') for q in (0.1, 0.5, 0.9))} FROM pc GROUP BY ALL)
    SELECT runtime_id, transport_epoch, name AS shift, round(CASE stat WHEN 'p50' THEN other_50 - primary_50 WHEN 'p90' THEN other_90 - primary_90 ELSE (other_90 - other_10) - (primary_90 - primary_10) END, 4) AS delta FROM wd JOIN (VALUES {_SHIFTS}) s(m, stat, name) ON m = measure""",
)
def c17(spark, sf_dir):
    bins = timeline.finalize(partials(spark, sf_dir), [*timeline.KEY, "bin_index"], F.lit(1.0))
    return dynamics.section_comparison(bins, (20, 60), (100, 140), timeline.KEY)


@query(
    "c16_exact_pass",
    f"{P}, {_BINS} SELECT runtime_id, transport_epoch, CAST(bin AS INTEGER) AS bin_index, rms_db, coverage_ratio FROM bn WHERE transport_epoch = 2 AND bin + 1 > 20 AND bin < 60",
)
def c16(spark, sf_dir):
    bins = timeline.finalize(partials(spark, sf_dir), [*timeline.KEY, "bin_index"], F.lit(1.0))
    return dynamics.exact_pass(bins, *dynamics.scope(20, 60), 2).select(*timeline.KEY, "bin_index", "rms_db", "coverage_ratio")


# --- stereo by band, load, resets ---

_SB = "sb AS (SELECT vec_id, g.i AS stereo_band, greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), 4 * CAST(embedding[g.i + 41] AS DOUBLE))) AS c, -9 + 20 * CAST(embedding[g.i + 49] AS DOUBLE) AS r FROM embeddings, (SELECT unnest(range(8)) AS i) g)"
_RANGES = ", ".join(f"({i}, '{dims.band_label(lo, hi)}')" for i, (lo, hi) in enumerate(zip(dims.STEREO_EDGES[:-1], dims.STEREO_EDGES[1:], strict=True)))


@query(
    "t08_stereo_bands",
    f"""WITH {sql.frames()}, {LATEST}, {_SB} SELECT runtime_id, CAST(stereo_band AS INTEGER) AS stereo_band, label AS range, c AS correlation, CASE WHEN c < -0.25 THEN 'strong_negative' WHEN c < 0 THEN 'negative' WHEN c < 0.25 THEN 'weak' ELSE 'positive' END AS label
    FROM latest JOIN sb ON sb.vec_id = latest.vec_id JOIN (VALUES {_RANGES}) n(i, label) ON n.i = stereo_band WHERE sp AND (mask & 8) <> 0""",
)
def t08(spark, sf_dir):
    return recent.stereo_bands(state.latest(frames(spark, sf_dir, spectra=True)))


@query("a10_stereo_band_means", f"{W}, {_SB} SELECT runtime_id, CAST(stereo_band AS INTEGER) AS stereo_band, round(avg(c), 6) AS correlation, round(10 * log10(greatest(avg(pow(10, r / 10)), 1e-12)), 4) AS side_to_mid_db FROM w JOIN sb ON sb.vec_id = w.vec_id WHERE sp AND (mask & 8) <> 0 GROUP BY ALL")
def a10(spark, sf_dir):
    return recent.stereo_band_means(window(spark, sf_dir, True))


@query("z15_load", f"WITH {sql.frames()} SELECT runtime_id, CAST(floor(received_at) AS BIGINT) AS stretch, count(*) AS frames, CAST(count(*) AS DOUBLE) AS frames_per_second, round(max(lag), 6) AS max_lag_ms, CAST(sum(dropped) AS BIGINT) AS dropped FROM f GROUP BY ALL")
def z15(spark, sf_dir):
    return recent.load(frames(spark, sf_dir))


_TURNS = ", ".join(f"CAST(coalesce((mask & {bit}) <> lag(mask & {bit}) OVER k, false) AS INTEGER) AS {n}_turn" for n, bit in (("loudness", 2), ("semantic", 32)))


@query(
    "z09_segments",
    f"WITH {sql.frames()}, tn AS (SELECT runtime_id, transport_epoch, arrival_seq, {_TURNS} FROM f WINDOW k AS (PARTITION BY runtime_id, transport_epoch ORDER BY arrival_seq)) SELECT runtime_id, transport_epoch, arrival_seq, CAST(sum(loudness_turn) OVER k AS BIGINT) AS loudness_segment, CAST(sum(semantic_turn) OVER k AS BIGINT) AS semantic_segment FROM tn WINDOW k AS (PARTITION BY runtime_id, transport_epoch ORDER BY arrival_seq)",
)
def z09(spark, sf_dir):
    return state.segments(frames(spark, sf_dir), ["loudness", "semantic"])


@query("x40_names", f"WITH {sql.frames()}, {LATEST}, {BINDINGS} SELECT l.runtime_id, CASE WHEN fl_track_index IS NULL THEN l.runtime_id ELSE 'mixer:' || fl_track_index || '/slot:' || slot END AS selector, coalesce(fl_track_name, track) AS name FROM latest l LEFT JOIN bindings b ON b.runtime_id = l.runtime_id")
def x40(spark, sf_dir):
    live = _live(spark, sf_dir).join(source.bindings(spark), "runtime_id", "left")
    return live.select("runtime_id", X.binding_selector("fl_track_index", "slot", "runtime_id").alias("selector"), X.display_name("fl_track_name", "track", "runtime_id").alias("name"))
