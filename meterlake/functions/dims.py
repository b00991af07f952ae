"""Constant dimension tables; all have a fixed number of rows, so joins with them broadcast: none has more than 288."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

BANDS = 32
BAND_EDGES = [20.0 * 1000.0 ** (i / BANDS) for i in range(BANDS + 1)]
BAND_CENTERS = [math.sqrt(a * b) for a, b in zip(BAND_EDGES[:-1], BAND_EDGES[1:], strict=True)]
STEREO_EDGES = [20.0, 60.0, 120.0, 250.0, 500.0, 1000.0, 2000.0, 5000.0, 20000.0]
REGIONS = [("sub", 20.0, 120.0), ("low_mid", 120.0, 500.0), ("mid", 500.0, 2000.0), ("presence", 2000.0, 5000.0), ("high", 5000.0, 20000.0)]
ERB = 16
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
#: Krumhansl-Kessler major and minor key profiles.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
PROFILES = [("eco", 1), ("balanced", 15), ("mix", 31), ("full", 63)]
RESOLUTIONS = [1, 2, 5, 10, 15, 30]
SCALES = [2, 4, 8]


def erb_rate(hz: float) -> float:
    return 21.4 * math.log10(1 + 0.00437 * hz)


def erb_edges() -> list[float]:
    lo, hi = erb_rate(20.0), erb_rate(20000.0)
    return [(10 ** ((lo + (hi - lo) * i / ERB) / 21.4) - 1) / 0.00437 for i in range(ERB + 1)]


def region_of(hz: float) -> int | None:
    return next((i for i, (_, lo, hi) in enumerate(REGIONS) if lo <= hz < hi), None)


def erb_of(hz: float) -> int | None:
    edges = erb_edges()
    return next((i for i in range(ERB) if edges[i] <= hz < edges[i + 1]), None)


def band_label(lo: float, hi: float) -> str:
    """``20-60 Hz`` or ``1.0-2.0 kHz``."""
    return f"{lo / 1000:.1f}-{hi / 1000:.1f} kHz" if lo >= 1000 else f"{lo:.0f}-{hi:.0f} Hz"


def band_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, BAND_EDGES[i], BAND_EDGES[i + 1], c, region_of(c), erb_of(c)) for i, c in enumerate(BAND_CENTERS)]
    return spark.createDataFrame(rows, "band int, lo_hz double, hi_hz double, center_hz double, region int, erb int")


def stereo_band_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, lo, hi, band_label(lo, hi)) for i, (lo, hi) in enumerate(zip(STEREO_EDGES[:-1], STEREO_EDGES[1:], strict=True))]
    return spark.createDataFrame(rows, "stereo_band int, lo_hz double, hi_hz double, label string")


def region_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REGIONS)], "region int, region_name string, lo_hz double, hi_hz double")


def key_profile_dim(spark: SparkSession) -> DataFrame:
    rows = [(t, mode, f"{PITCHES[t]} {mode}", p, float(profile[(p - t) % 12])) for mode, profile in (("major", MAJOR), ("minor", MINOR)) for t in range(12) for p in range(12)]
    return spark.createDataFrame(rows, "tonic int, mode string, key string, pitch int, weight double")


def profile_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(PROFILES)], "profile_index int, profile string, mask int")


def nearest_resolution(seconds: float) -> int:
    """Nearest of the resolution ladder, the smaller on ties."""
    return min(RESOLUTIONS, key=lambda r: (abs(r - seconds), r))
