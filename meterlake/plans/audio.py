"""Registered queries on audio: hops and windows of samples, and their measures, against sums and Fourier sums in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import dsp
from ..sources import audio as source
from .tools import query

#: s: samples; h: whole hops; wn: windows with their samples, numbered from 0.
_HOPS = """v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
h AS (SELECT vec_id // 16 AS hop FROM v GROUP BY 1 HAVING count(*) = 16),
s AS (SELECT hop, 'au-' || hop // 16 AS runtime_id, (vec_id % 16) * 64 + g.i AS pos, CAST(e[g.i + 1] AS DOUBLE) AS l, CAST(e[64 - g.i] AS DOUBLE) AS r FROM v JOIN h ON h.hop = vec_id // 16, (SELECT unnest(range(64)) AS i) g)"""
_WINDOWS = f"""{_HOPS}, th AS (SELECT DISTINCT runtime_id, hop, row_number() OVER (PARTITION BY runtime_id ORDER BY hop) AS k FROM (SELECT DISTINCT runtime_id, hop FROM s)),
wn AS (SELECT w.runtime_id, w.hop AS hop_index, (x.k - w.k + 3) * 1024 + pos AS t, l, r FROM th w JOIN th x ON x.runtime_id = w.runtime_id AND x.k BETWEEN w.k - 3 AND w.k AND w.k >= 4 JOIN s ON s.hop = x.hop)"""
_DB = "greatest(-120, 20 * log10(greatest({0}, CAST(1e-9 AS DOUBLE))))"
_LEVEL = f"lv AS (SELECT runtime_id, hop_index, {_DB.format('max(greatest(abs(l), abs(r)))')} AS peak_db, {_DB.format('sqrt(sum(l * l + r * r) / 8192)')} AS rms_db FROM wn GROUP BY ALL)"


def _windows(spark, sf_dir):
    return dsp.windows(source.hops(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _measured(spark, sf_dir, *only):
    return dsp.analyse(_windows(spark, sf_dir), only)


@query("w18_windows", f"WITH {_WINDOWS} SELECT runtime_id, hop_index, count(*) AS samples, round(sum(l * (t + 1)), 5) AS left_moment, round(sum(r * (t + 1)), 5) AS right_moment FROM wn GROUP BY ALL")
def w18(spark, sf_dir):
    """Windows of four hops; the moments tell whether each sample is at its place."""
    moment = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x), 5)
    return _windows(spark, sf_dir).select("runtime_id", "hop_index", F.size("left").cast("long").alias("samples"), moment("left").alias("left_moment"), moment("right").alias("right_moment"))


@query("d15_detector_peak", f"WITH {_HOPS} SELECT runtime_id, hop AS hop_index, round({_DB.format('max(greatest(abs(l), abs(r)))')}, 6) AS detector_peak_db FROM s GROUP BY ALL")
def d15(spark, sf_dir):
    return dsp.detector_peak(source.hops(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumn("detector_peak_db", F.round("detector_peak_db", 6))


@query("d03_levels", f"WITH {_WINDOWS}, {_LEVEL} SELECT runtime_id, hop_index, round(peak_db, 6) AS peak_db, round(rms_db, 6) AS rms_db, round(peak_db - rms_db, 6) AS crest_db FROM lv")
def d03(spark, sf_dir):
    return _measured(spark, sf_dir, *dsp.LEVELS).select("runtime_id", "hop_index", *[F.round(c, 6).alias(c) for c in dsp.LEVELS])


@query(
    "d04_stereo",
    f"""WITH {_WINDOWS} SELECT runtime_id, hop_index, round(CASE WHEN sqrt(sum(l * l) * sum(r * r)) > 1e-12 THEN sum(l * r) / sqrt(sum(l * l) * sum(r * r)) ELSE 0 END, 6) AS stereo_correlation,
    round(least(4, greatest(0, sqrt(sum((l - r) * (l - r) / 4)) / greatest(sqrt(sum((l + r) * (l + r) / 4)), CAST(1e-9 AS DOUBLE)))), 6) AS stereo_width,
    round({_DB.format('sqrt(avg((l + r) * (l + r) / 4))')}, 6) AS mid_rms_db, round({_DB.format('sqrt(avg((l - r) * (l - r) / 4))')}, 6) AS side_rms_db FROM wn GROUP BY ALL""",
)
def d04(spark, sf_dir):
    return _measured(spark, sf_dir, *dsp.STEREO).select("runtime_id", "hop_index", *[F.round(c, 6).alias(c) for c in dsp.STEREO])


def _spectrum(first: int, last: int) -> str:
    """m: magnitudes of the middle signal's bins, by Fourier sums under a Hann window."""
    turn = "2 * pi() * b * t / 4096"
    return f"""md AS (SELECT runtime_id, hop_index, t, (l + r) / 2 * (0.5 - 0.5 * cos(2 * pi() * t / 4096)) AS x FROM wn), bn AS (SELECT unnest(range({first}, {last} + 1)) AS b),
    m AS (SELECT runtime_id, hop_index, b, sqrt(pow(sum(x * cos({turn})), 2) + pow(sum(x * sin({turn})), 2)) / 2048 AS m FROM md, bn GROUP BY ALL)"""


@query(
    "d05_spectrum",
    f"""WITH {_WINDOWS}, {_spectrum(2, 1706)}, t AS (SELECT *, b * CAST(48000 AS DOUBLE) / 4096 AS hz, sum(m * m) OVER (PARTITION BY runtime_id, hop_index) AS whole, sum(m * m) OVER (PARTITION BY runtime_id, hop_index ORDER BY b) AS upto FROM m)
    SELECT runtime_id, hop_index, round(sum(m * hz) / sum(m), 3) AS centroid_hz, round(min(CASE WHEN upto >= CAST(0.85 AS DOUBLE) * whole THEN hz END), 3) AS rolloff_hz, round(exp(avg(ln(greatest(m, CAST(1e-12 AS DOUBLE))))) / avg(m), 6) AS flatness FROM t GROUP BY ALL""",
)
def d05(spark, sf_dir):
    """Centroid, rolloff and flatness from 20 Hz to 20 kHz: bins 2 to 1706."""
    return _measured(spark, sf_dir, "centroid_hz", "rolloff_hz", "flatness").select("runtime_id", "hop_index", F.round("centroid_hz", 3).alias("centroid_hz"), F.round("rolloff_hz", 3).alias("rolloff_hz"), F.round("flatness", 6).alias("flatness"))


_CENTERS = ", ".join(f"({i}, {int(c * 4096 / source.RATE)}, {c * 4096 / source.RATE - int(c * 4096 / source.RATE)!r})" for i, c in enumerate(dims.BAND_CENTERS))


@query(
    "d07_bands",
    f"""WITH {_WINDOWS}, {_spectrum(1, 1706)}, ct(band, lo, part) AS (VALUES {_CENTERS})
    SELECT x.runtime_id, x.hop_index, band, round({_DB.format('x.m * (1 - CAST(part AS DOUBLE)) + y.m * CAST(part AS DOUBLE)')}, 5) AS level_db FROM ct JOIN m x ON x.b = lo JOIN m y ON y.b = lo + 1 AND y.hop_index = x.hop_index AND y.runtime_id = x.runtime_id""",
)
def d07(spark, sf_dir):
    """Levels of the 32 bands: the magnitude between the two bins beside each centre."""
    return _measured(spark, sf_dir, "bands_db").select("runtime_id", "hop_index", F.posexplode("bands_db").alias("band", "level_db")).withColumn("level_db", F.round("level_db", 5))


@query("d11_low_band", f"WITH {_WINDOWS}, {_spectrum(4, 13)} SELECT runtime_id, hop_index, round({_DB.format('sqrt(avg(m * m))')}, 5) AS low_band_energy_db FROM m GROUP BY ALL")
def d11(spark, sf_dir):
    """The energy of 40 to 160 Hz: bins 4 to 13."""
    return _measured(spark, sf_dir, "low_band_energy_db").select("runtime_id", "hop_index", F.round("low_band_energy_db", 5).alias("low_band_energy_db"))


@query(
    "d12_chroma",
    f"""WITH {_WINDOWS}, {_spectrum(7, 426)}, c AS (SELECT runtime_id, hop_index, CAST(round(69 + 12 * log2(b * CAST(48000 AS DOUBLE) / 4096 / 440)) AS INTEGER) % 12 AS pitch, sum(m * m) AS e FROM m GROUP BY ALL)
    SELECT runtime_id, hop_index, pitch, round(e / greatest(sum(e) OVER (PARTITION BY runtime_id, hop_index), CAST(1e-18 AS DOUBLE)), 6) AS share FROM c""",
)
def d12(spark, sf_dir):
    """The shares of the twelve pitch classes from 80 Hz to 5 kHz: bins 7 to 426."""
    return _measured(spark, sf_dir, "chroma").select("runtime_id", "hop_index", F.posexplode("chroma").alias("pitch", "share")).withColumn("share", F.round("share", 6))


@query(
    "z07_emissions",
    f"""WITH {_WINDOWS}, {_LEVEL}, d AS (SELECT runtime_id, hop_index, greatest(0, rms_db - lag(rms_db) OVER (PARTITION BY runtime_id ORDER BY hop_index)) AS rise, lag(hop_index) OVER (PARTITION BY runtime_id ORDER BY hop_index) IS NOT NULL AS second FROM lv)
    SELECT runtime_id, hop_index // 5 AS emission, round(max(CASE WHEN second THEN rise ELSE 0 END), 5) AS rms_rise_peak_db, count(*) * 1024 AS samples FROM d GROUP BY ALL""",
)
def z07(spark, sf_dir):
    """Level rises gathered from one emission to the next, every five hops."""
    out = dsp.emissions(dsp.changes(_measured(spark, sf_dir, "rms_db", "shape")), 5)
    return out.select("runtime_id", "emission", F.round("rms_rise_peak_db", 5).alias("rms_rise_peak_db"), "samples")
