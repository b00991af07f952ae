"""SQL of the frames mapping, as common table expressions that the oracle queries build on."""

from __future__ import annotations

from ..functions import dims


def frames(sectioned: bool = False) -> str:
    lift = "CASE WHEN CAST(floor(t / 24) AS BIGINT) % 2 = 1 THEN 9.0 ELSE 0.0 END" if sectioned else "0.0"
    return f"""
f0 AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
f1 AS (SELECT *, (us - 1704067200000000) / CAST(1.44e10 AS DOUBLE) AS t FROM f0),
f2 AS (SELECT *, 20 * log10(greatest(value / 500, CAST(1e-9 AS DOUBLE))) + CAST({lift} AS DOUBLE) AS rms_db,
  CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 15 WHEN 2 THEN 31 ELSE 63 END AS mask FROM f1),
f AS (SELECT event_id AS arrival_seq, event_id % (SELECT greatest(count(*), 1) FROM embeddings) AS vec_id, 'rt-' || event_type AS runtime_id, event_type AS track, CAST(1 + user_id % 2 AS INTEGER) AS transport_epoch,
  t, CAST(floor(t) AS INTEGER) AS bin, t AS received_at, k, mask, rms_db, rms_db > -50 AS sp, CASE WHEN k % 10 = 3 THEN CAST(k AS DOUBLE) / 10 ELSE 0 END AS silence, CAST(k AS DOUBLE) / CAST(8.3 AS DOUBLE) AS crest_db, rms_db + CAST(k AS DOUBLE) / CAST(8.3 AS DOUBLE) AS peak_db,
  CASE WHEN (mask & 2) <> 0 THEN rms_db + CAST(k AS DOUBLE) / CAST(8.3 AS DOUBLE) + CAST(0.3 AS DOUBLE) END AS true_peak_dbtp,
  CASE WHEN (mask & 2) <> 0 AND k % 10 <> 0 THEN rms_db - 1 END AS lufs_s,
  CASE WHEN (mask & 4) <> 0 THEN CASE WHEN rms_db > -50 THEN 200 + 350 * CAST(k AS DOUBLE) / CAST(7.1 AS DOUBLE) ELSE 0 END END AS centroid_hz,
  CASE WHEN (mask & 8) <> 0 THEN CASE WHEN rms_db > -50 THEN 1 - CAST(k AS DOUBLE) / CAST(51.7 AS DOUBLE) ELSE 0 END END AS corr,
  CASE WHEN (mask & 8) <> 0 THEN CASE WHEN rms_db > -50 THEN CAST(k AS DOUBLE) / CAST(41.3 AS DOUBLE) ELSE 0 END END AS width,
  CASE WHEN (mask & 16) <> 0 THEN CASE WHEN rms_db > -50 THEN CAST(k AS DOUBLE) / 413 ELSE 0 END END AS flux,
  CASE WHEN (mask & 16) <> 0 THEN CASE WHEN rms_db > -50 THEN CAST(k AS DOUBLE) / 207 ELSE 0 END END AS flux_peak,
  CASE WHEN (mask & 16) <> 0 THEN CASE WHEN rms_db > -50 THEN CAST(k AS DOUBLE) / CAST(16.3 AS DOUBLE) ELSE 0 END END AS rise,
  CASE WHEN (mask & 4) <> 0 THEN CASE WHEN rms_db > -50 THEN 900 + 110 * CAST(k AS DOUBLE) / CAST(7.1 AS DOUBLE) ELSE 0 END END AS rolloff, CASE WHEN (mask & 4) <> 0 THEN CASE WHEN rms_db > -50 THEN CAST(k AS DOUBLE) / 131 ELSE 0 END END AS flatness,
  CASE WHEN (mask & 16) <> 0 THEN CAST(1 + k % 5 AS DOUBLE) / 50 END AS secs, CASE WHEN (mask & 16) <> 0 THEN rms_db - CAST(k AS DOUBLE) / CAST(7.7 AS DOUBLE) END AS low_db,
  CASE WHEN (mask & 8) <> 0 THEN rms_db - CAST(0.7 AS DOUBLE) END AS mid_db, CASE WHEN (mask & 8) <> 0 THEN rms_db - CAST(k AS DOUBLE) / CAST(5.3 AS DOUBLE) END AS side_db, CASE WHEN (mask & 8) <> 0 THEN -CAST(k AS DOUBLE) / CAST(6.1 AS DOUBLE) END AS stm_db,
  CASE WHEN (mask & 8) <> 0 THEN CAST(k AS DOUBLE) / 111 END AS negative, CASE WHEN (mask & 8) <> 0 THEN 1 - CAST(k AS DOUBLE) / CAST(61.3 AS DOUBLE) END AS low_corr, CASE WHEN (mask & 8) <> 0 THEN -CAST(k AS DOUBLE) / CAST(4.9 AS DOUBLE) END AS low_stm_db,
  CASE WHEN (mask & 32) <> 0 THEN CAST(k AS DOUBLE) / 121 END AS harmonic, CASE WHEN (mask & 32) <> 0 THEN CASE WHEN k % 9 = 0 THEN 0 ELSE 55 + k * CAST(3.3 AS DOUBLE) END END AS f0,
  CAST(event_id % 7 = 0 AS BIGINT) AS dropped, CAST(k AS DOUBLE) * 22 / 7 AS lag FROM f2)"""


def region_case(column: str = "band") -> str:
    return "CASE " + " ".join(f"WHEN {column} = {i} THEN {dims.region_of(c)}" for i, c in enumerate(dims.BAND_CENTERS) if dims.region_of(c) is not None) + " END"


def erb_case(column: str = "band") -> str:
    return "CASE " + " ".join(f"WHEN {column} = {i} THEN {dims.erb_of(c)}" for i, c in enumerate(dims.BAND_CENTERS) if dims.erb_of(c) is not None) + " END"


#: Band levels of active frames in the window; mid and side where their family is on.
BANDS = """
sh AS (SELECT vec_id, g.i AS band, CAST(embedding[g.i + 1] AS DOUBLE) AS m, CAST(embedding[g.i + 33] AS DOUBLE) AS s FROM embeddings, (SELECT unnest(range(32)) AS i) g),
bands AS (SELECT w.runtime_id, w.arrival_seq, sh.band, CASE WHEN (mask & 4) <> 0 THEN rms_db + 20 * m END AS mid, CASE WHEN (mask & 8) <> 0 THEN rms_db - 9 + 20 * s END AS side FROM w JOIN sh ON w.vec_id = sh.vec_id WHERE sp),
means AS (SELECT runtime_id, band, round(10 * log10(greatest(avg(pow(10, mid / 10)), 1e-12)), 4) AS plain_db FROM bands WHERE mid IS NOT NULL GROUP BY ALL)"""


def window(seconds: float, as_of: float) -> str:
    return f"w AS (SELECT * FROM f WHERE received_at >= CAST({as_of - seconds} AS DOUBLE) AND received_at <= CAST({as_of} AS DOUBLE))"


PARTIALS = """
acc AS (SELECT runtime_id, transport_epoch, bin, count(*) AS n, count(*) FILTER (WHERE sp) AS active,
  bit_or(1 << CAST(least(9, greatest(0, floor((t - floor(t)) / CAST(0.1 AS DOUBLE)))) AS INTEGER)) AS cover, min(received_at) AS first_rx, max(received_at) AS last_rx, max(arrival_seq) AS last_seq,
  sum(CASE WHEN rms_db > -120 THEN pow(10, rms_db / 10) END) AS rms_p, count(CASE WHEN rms_db > -120 THEN 1 END) AS rms_n,
  sum(CASE WHEN lufs_s > -120 THEN pow(10, lufs_s / 10) END) AS lufs_p, count(CASE WHEN lufs_s > -120 THEN 1 END) AS lufs_n,
  max(peak_db) AS peak, max(true_peak_dbtp) AS tp, sum(crest_db) AS crest_s, count(crest_db) AS crest_n, sum(centroid_hz) AS cen_s, count(centroid_hz) AS cen_n,
  sum(corr) AS corr_s, count(corr) AS corr_n, sum(width) AS width_s, count(width) AS width_n, sum(flux) AS flux_s, count(flux) AS flux_n,
  CAST(sum(CAST(round(greatest(0, lag) * 1000) AS BIGINT)) AS BIGINT) AS lag_s, count(lag) AS lag_n, max(greatest(0, lag)) AS lag_m, max(dropped) AS dropped FROM f GROUP BY ALL)"""


def summary(by: str, expected: str, source: str = "acc") -> str:
    """Finalised summaries of partials, grouped by the columns ``by``."""
    return f"""SELECT {by}, CAST(min(bin) AS INTEGER) AS start_seconds, CAST(max(bin) + 1 AS INTEGER) AS end_seconds, CAST(sum(n) AS BIGINT) AS frame_count,
  round(CAST(sum(active) AS DOUBLE) / greatest(1, sum(n)), 4) AS active_ratio, round(sum(bit_count(cover)) / CAST(10 AS DOUBLE), 3) AS covered_seconds,
  round(least(1.0, sum(bit_count(cover)) / CAST(10 AS DOUBLE) / {expected}), 4) AS coverage_ratio,
  CASE WHEN sum(rms_n) > 0 THEN round(10 * log10(greatest(sum(rms_p) / sum(rms_n), 1e-12)), 4) END AS rms_db,
  CASE WHEN sum(lufs_n) > 0 THEN round(10 * log10(greatest(sum(lufs_p) / sum(lufs_n), 1e-12)), 4) END AS lufs_s,
  round(max(peak), 4) AS peak_db, round(max(tp), 4) AS true_peak_dbtp,
  CASE WHEN sum(crest_n) > 0 THEN round(sum(crest_s) / sum(crest_n), 4) END AS crest_db, CASE WHEN sum(cen_n) > 0 THEN round(sum(cen_s) / sum(cen_n), 2) END AS centroid_hz,
  CASE WHEN sum(corr_n) > 0 THEN round(sum(corr_s) / sum(corr_n), 5) END AS stereo_correlation, CASE WHEN sum(width_n) > 0 THEN round(sum(width_s) / sum(width_n), 5) END AS stereo_width,
  CASE WHEN sum(flux_n) > 0 THEN round(sum(flux_s) / sum(flux_n), 6) END AS spectral_flux_mean, CASE WHEN sum(lag_n) > 0 THEN CAST((2 * sum(lag_s) + sum(lag_n)) // (2 * sum(lag_n)) AS DOUBLE) / 1000 END AS mean_lag_ms,
  max(lag_m) AS max_lag_ms, max(dropped) AS dropped_blocks, max(last_rx) AS last_received_at, min(first_rx) AS first_received_at FROM {source} GROUP BY {by}"""


def aligned(tolerance: float = 0.08) -> str:
    """Two pointers over the window's frames of each pair of tracks, as CTEs that end in al (a, b, a_seq, b_seq, dt); needs WITH RECURSIVE."""
    t = f"CAST({tolerance} AS DOUBLE)"
    return f"""ls AS MATERIALIZED (SELECT runtime_id, list(received_at ORDER BY received_at, arrival_seq) AS ts, list(arrival_seq ORDER BY received_at, arrival_seq) AS ss FROM w GROUP BY 1),
walk AS (SELECT x.runtime_id AS a, y.runtime_id AS b, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS a_seq, CAST(NULL AS BIGINT) AS b_seq, CAST(NULL AS DOUBLE) AS dt FROM ls x JOIN ls y ON x.runtime_id < y.runtime_id
 UNION ALL SELECT a, b, i + CASE WHEN d <= {t} THEN 1 ELSE 0 END, j + CASE WHEN d >= -{t} THEN 1 ELSE 0 END, CASE WHEN abs(d) <= {t} THEN sa END, CASE WHEN abs(d) <= {t} THEN sb END, d
 FROM (SELECT k.a, k.b, i, j, x.ts[i] - y.ts[j] AS d, x.ss[i] AS sa, y.ss[j] AS sb FROM walk k JOIN ls x ON x.runtime_id = k.a JOIN ls y ON y.runtime_id = k.b WHERE i <= len(x.ts) AND j <= len(y.ts))),
al AS MATERIALIZED (SELECT a, b, a_seq, b_seq, dt FROM walk WHERE a_seq IS NOT NULL)"""


def region_levels(case: str, frames: str = "bands") -> str:
    """fl: levels of active frames by the region that ``case`` gives each band."""
    return f"fl AS (SELECT arrival_seq, region, 10 * log10(greatest(avg(pow(10, mid / 10)), 1e-12)) AS level FROM (SELECT arrival_seq, mid, {case} AS region FROM {frames} WHERE mid > -120) WHERE region IS NOT NULL GROUP BY ALL)"


#: Evidence in time of aligned frames by region: rt and ca.
REGION_TEMPORAL = """lv AS (SELECT al.a, al.b, x.region, x.level AS la, y.level AS lb FROM al JOIN fl x ON x.arrival_seq = al.a_seq JOIN fl y ON y.arrival_seq = al.b_seq AND y.region = x.region),
lw AS (SELECT *, least(pow(10, (la - max(la) OVER (PARTITION BY a, b, region)) / 10), pow(10, (lb - max(lb) OVER (PARTITION BY a, b, region)) / 10)) AS m FROM lv),
rt AS (SELECT a, b, region, count(*) AS usable_pairs, CASE WHEN count(*) >= 3 AND sqrt(var_pop(la) * var_pop(lb)) * count(*) > 1e-12 THEN round(corr(la, lb), 6) END AS band_correlation, avg(m) AS temporal FROM lw GROUP BY ALL),
ca AS (SELECT al.a, al.b, round(CAST(count(*) FILTER (WHERE x.sp AND y.sp) AS DOUBLE) / count(*), 6) AS coactive_ratio FROM al JOIN w x ON x.arrival_seq = al.a_seq JOIN w y ON y.arrival_seq = al.b_seq GROUP BY ALL)"""
