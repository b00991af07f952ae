"""Measurements of audio windows (D01-D13): rows of samples in, one row of measures out.

Rows are (runtime_id, hop_index, sample_rate, left array<float>, right array<float>) of 4096 samples. Windows are
independent, so this is a map without a shuffle; the FFT of a batch is one numpy call. Sliding windows from
hops come from ``windows`` (D: W18), flux and rise from a lag over the result.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims

SIZE, HOP = 4096, 1024
MEASURES = (
    "runtime_id string, hop_index long, peak_db double, rms_db double, crest_db double, stereo_correlation double, stereo_width double, mid_rms_db double, side_rms_db double, "
    "centroid_hz double, rolloff_hz double, flatness double, bands_db array<double>, side_bands_db array<double>, chroma array<double>, chroma_energy_ratio double, band_stereo_correlation array<double>, band_side_to_mid_db array<double>, "
    "negative_cross_energy_ratio double, low_band_20_120_correlation double, low_band_20_120_side_to_mid_db double, low_band_energy_db double, "
    "true_peak_dbtp double, harmonic_f0_candidate_hz double, single_f0_harmonic_energy_ratio double, shape array<float>"
)


#: Hops of a block: what one task filters and looks back over at once, with the hops before it that it needs.
BLOCK_HOPS = 2048


def with_halo(rows: DataFrame, halo: int, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """``rows`` with the block of their hop, and again, as halo, with the next one's where they are among the ``halo`` hops before it.

    Windows by (runtime_id, block) then see all that they look back to, and one long track is many tasks. ``halo`` is shorter than a block.
    """
    own = F.floor(F.col("hop_index") / block_hops)
    spots = F.when(F.col("hop_index") >= (own + 1) * block_hops - halo, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")), F.struct((own + 1).alias("block"), F.lit(True).alias("halo"))))
    spots = F.coalesce(spots, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return rows.withColumn("spot", F.explode(spots)).select("*", "spot.block", "spot.halo").drop("spot")


def _before(n: int) -> Window:
    """The row and the n before it, in its block."""
    return Window.partitionBy("runtime_id", "block").orderBy("hop_index").rowsBetween(-n, 0)


def windows(hops: DataFrame, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """Four consecutive hops make a window of 4096 samples."""
    n = SIZE // HOP
    w = _before(n - 1)
    parts = with_halo(hops, n - 1, block_hops).withColumns({"first": F.min("hop_index").over(w), **{c: F.flatten(F.collect_list(c).over(w)) for c in ("left", "right")}})
    return parts.where((F.size("left") == SIZE) & (F.col("hop_index") - F.col("first") == n - 1) & ~F.col("halo")).select(*hops.columns)


def _db(x: np.ndarray) -> np.ndarray:
    return np.maximum(20 * np.log10(np.maximum(x, 1e-9)), -120.0)


def stereo_spectrum(left: np.ndarray, right: np.ndarray, hz: np.ndarray) -> dict[str, np.ndarray]:
    """Stereo measures of spectra (D08-D10): correlation and side-to-mid ratio of eight bands and of 20 to 120 Hz, and the
    share of bins, weighted by both sides' magnitudes, whose sides point apart."""
    cross = (left * right.conj()).real
    powers = {"l": np.abs(left) ** 2, "r": np.abs(right) ** 2, "m": np.abs(left + right) ** 2 / 4, "s": np.abs(left - right) ** 2 / 4}

    def of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = {k: p[:, inside].sum(axis=1) for k, p in powers.items()}
        size = np.sqrt(total["l"] * total["r"])
        correlation = np.where(size > 1e-18, np.clip(cross[:, inside].sum(axis=1) / np.maximum(size, 1e-18), -1, 1), 0.0)
        return correlation, 10 * np.log10(np.maximum(total["s"], 1e-12) / np.maximum(total["m"], 1e-12))

    last = len(dims.STEREO_EDGES) - 2
    bands = [of((hz >= lo) & ((hz < hi) | ((i == last) & (hz <= hi)))) for i, (lo, hi) in enumerate(zip(dims.STEREO_EDGES[:-1], dims.STEREO_EDGES[1:], strict=True))]
    inside = (hz >= 20) & (hz <= 20000)
    weight = np.sqrt(powers["l"] * powers["r"])[:, inside]
    whole = weight.sum(axis=1)
    low = of((hz >= 20) & (hz < 120))
    return {
        "band_stereo_correlation": np.stack([c for c, _ in bands], axis=1),
        "band_side_to_mid_db": np.stack([r for _, r in bands], axis=1),
        "negative_cross_energy_ratio": np.where(whole > 1e-18, (weight * (cross[:, inside] < 0)).sum(axis=1) / np.maximum(whole, 1e-18), 0.0),
        "low_band_20_120_correlation": low[0],
        "low_band_20_120_side_to_mid_db": low[1],
    }


def detector_peak(hops: DataFrame) -> DataFrame:
    """Peak of both channels of every hop, in dB."""
    peak = F.greatest(*[F.array_max(F.transform(c, lambda x: F.abs(x))) for c in ("left", "right")]).cast("double")
    return hops.select("runtime_id", "hop_index", F.greatest(F.lit(-120.0), 20 * F.log10(F.greatest(peak, F.lit(1e-9)))).alias("detector_peak_db"))


def emissions(changes: DataFrame, every: int) -> DataFrame:
    """Changes accumulated from one emission to the next, every ``every`` hops (Z07): means, peaks and seconds; nothing carries over."""
    return changes.withColumn("emission", F.floor(F.col("hop_index") / every)).groupBy("runtime_id", "emission").agg(
        F.avg("flux").alias("spectral_flux_mean"), F.max("flux").alias("spectral_flux_peak"), F.max("rise_db").alias("rms_rise_peak_db"), (F.count("*") * HOP).alias("samples")
    )


def measure(left: np.ndarray, right: np.ndarray, rate: float, only: Collection[str] | None = None) -> dict[str, np.ndarray]:
    """Measures of windows (rows) at one sample rate; all, or at least those of ``only`` with what they share work with."""
    needs = lambda *names: only is None or not set(only).isdisjoint(names)
    n = left.shape[1]
    out = {}
    if needs(*LEVELS):
        out |= levels(left, right)
    if needs(*STEREO):
        out |= stereo(left, right)
    if needs(*SPECTRAL):
        out |= spectral(left, right, rate)
    if needs(*STEREO_SPECTRUM):
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        out |= stereo_spectrum(*(np.fft.rfft(x * hann, axis=1) / (n / 2) for x in (left, right)), np.fft.rfftfreq(n, 1 / rate))
    if needs("true_peak_dbtp"):
        out["true_peak_dbtp"] = true_peak_db(left, right)
    if needs(*FUNDAMENTAL):
        out |= dict(zip(FUNDAMENTAL, fundamental(left, right, rate), strict=True))
    return out


LEVELS = ("peak_db", "rms_db", "crest_db")
STEREO = ("stereo_correlation", "stereo_width", "mid_rms_db", "side_rms_db")
SPECTRAL = ("centroid_hz", "rolloff_hz", "flatness", "bands_db", "side_bands_db", "chroma", "chroma_energy_ratio", "low_band_energy_db", "shape")
STEREO_SPECTRUM = ("band_stereo_correlation", "band_side_to_mid_db", "negative_cross_energy_ratio", "low_band_20_120_correlation", "low_band_20_120_side_to_mid_db")
FUNDAMENTAL = ("harmonic_f0_candidate_hz", "single_f0_harmonic_energy_ratio")


def levels(left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    out = {"peak_db": _db(np.maximum(np.abs(left), np.abs(right)).max(axis=1)), "rms_db": _db(np.sqrt((left**2 + right**2).sum(axis=1) / (2 * left.shape[1])))}
    return out | {"crest_db": out["peak_db"] - out["rms_db"]}


def stereo(left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    mid, side = (left + right) / 2, (left - right) / 2
    square = np.sqrt((left**2).sum(axis=1) * (right**2).sum(axis=1))
    return {
        "mid_rms_db": _db(np.sqrt((mid**2).mean(axis=1))),
        "side_rms_db": _db(np.sqrt((side**2).mean(axis=1))),
        "stereo_correlation": np.where(square > 1e-12, (left * right).sum(axis=1) / np.maximum(square, 1e-12), 0.0),
        "stereo_width": np.clip(np.sqrt((side**2).sum(axis=1)) / np.maximum(np.sqrt((mid**2).sum(axis=1)), 1e-9), 0, 4),
    }


def spectral(left: np.ndarray, right: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Measures of the spectra of the middle and side signals."""
    n = left.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    mid, side = (left + right) / 2, (left - right) / 2
    m, s = (np.abs(np.fft.rfft(x * hann, axis=1)) / (n / 2) for x in (mid, side))
    hz = np.fft.rfftfreq(n, 1 / rate)
    inside = (hz >= 20) & (hz <= min(20000.0, rate / 2))
    p, f = m[:, inside], hz[inside]
    total = np.maximum(p.sum(axis=1), 1e-18)
    power = np.cumsum(p * p, axis=1)
    out = {
        "centroid_hz": (p * f).sum(axis=1) / total,
        "rolloff_hz": f[np.minimum((power < 0.85 * power[:, -1:]).sum(axis=1), len(f) - 1)],
        "flatness": np.exp(np.log(np.maximum(p, 1e-12)).mean(axis=1)) / np.maximum(p.mean(axis=1), 1e-12),
    }
    at = np.array(dims.BAND_CENTERS) * n / rate
    lo = np.minimum(at.astype(int), m.shape[1] - 2)
    part = np.clip(at - lo, 0, 1)
    for name, x in (("bands_db", m), ("side_bands_db", s)):
        out[name] = _db(x[:, lo] * (1 - part) + x[:, lo + 1] * part)
    tonal = (hz >= 80) & (hz <= 5000)
    pitch = np.mod(np.round(69 + 12 * np.log2(hz[tonal] / 440)), 12).astype(int)
    energy = np.stack([(m[:, tonal][:, pitch == k] ** 2).sum(axis=1) for k in range(12)], axis=1)
    whole = energy.sum(axis=1, keepdims=True)
    out["chroma"] = energy / np.maximum(whole, 1e-18)
    out["chroma_energy_ratio"] = whole[:, 0] / np.maximum(power[:, -1], 1e-18)
    low = m[:, (hz >= 40) & (hz < 160)]
    out["low_band_energy_db"] = _db(np.sqrt((low * low).mean(axis=1)))
    out["shape"] = (m / np.maximum(m.sum(axis=1, keepdims=True), 1e-18)).astype(np.float32)
    return out


#: Windows measured at once, some MB an array.
ROWS_AT_ONCE = 32
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def analyse(audio: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Measures of each window, all or those named in ``only``.

    A window is 64 KB, so batches are kept to 4 MB in the session: a task's memory does not grow with its rows.
    """
    conf = audio.sparkSession.conf
    at = str(conf.get(BATCH_BYTES)).lower().rstrip("b")
    if not at.isdigit() or int(at) > 4 << 20:
        conf.set(BATCH_BYTES, str(4 << 20))
    kinds = dict(c.split() for c in MEASURES.split(", ") if only is None or c.split()[0] in {*only, "runtime_id", "hop_index"})

    def column(v: np.ndarray) -> pa.Array:
        if v.ndim == 1:
            return pa.array(v, from_pandas=True)
        return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel(), from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = batch.column("sample_rate").to_numpy(zero_copy_only=False)
            for rate in np.unique(rates):
                rows = np.flatnonzero(rates == rate)
                for lo in range(0, len(rows), ROWS_AT_ONCE):
                    part = batch.take(pa.array(rows[lo : lo + ROWS_AT_ONCE]))
                    left, right = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1) for c in ("left", "right"))
                    got = measure(left, right, float(rate), only)
                    yield pa.RecordBatch.from_arrays([part.column(c) if c in ("runtime_id", "hop_index") else column(got[c]) for c in kinds], names=list(kinds))

    return audio.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def changes(measures: DataFrame, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """Spectral flux and level rise against the window before (D11, W11, W12); null flux where the hop before has none."""
    w = Window.partitionBy("runtime_id", "block").orderBy("hop_index")
    up = F.aggregate(F.zip_with("shape", F.lag("shape").over(w), lambda now, old: F.greatest(F.lit(0.0), (now - old).cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
    rise = F.greatest(F.lit(0.0), F.col("rms_db") - F.lag("rms_db").over(w))
    return with_halo(measures.select("runtime_id", "hop_index", "rms_db", "shape"), 1, block_hops).select("runtime_id", "hop_index", "rms_db", up.alias("flux"), rise.alias("rise_db"), "halo").where("not halo").drop("halo")


def true_peak_db(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Peak of the fourfold oversampled windows (D14), by padding their spectra."""
    n = left.shape[1]
    both = [np.abs(np.fft.irfft(np.fft.rfft(x, axis=1), 4 * n, axis=1) * 4).max(axis=1) for x in (left, right)]
    return _db(np.maximum(*both))


def fundamental(left: np.ndarray, right: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, share of tonal power) of the best single pitch of each window (D13); nan if none has two harmonics.

    Candidates are bins from 55 to 1000 Hz; each gathers the strongest of three bins around its first eight harmonics,
    weighted by 1/h.
    """
    n = left.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    m = np.abs(np.fft.rfft((left + right) / 2 * hann, axis=1)) / (n / 2)
    p = m * m
    near = np.maximum(p, np.maximum(np.pad(p[:, 1:], ((0, 0), (0, 1))), np.pad(p[:, :-1], ((0, 0), (1, 0)))))
    candidates = np.arange(max(1, math.ceil(55 * n / rate)), int(1000 * n / rate) + 1)
    floor = near.max(axis=1, keepdims=True) * 1e-4
    score, found, power = (np.zeros((len(p), len(candidates))) for _ in range(3))
    for h in range(1, 9):
        at = candidates * h
        ok = at < min(p.shape[1], 5000 * n / rate)
        part = np.where(ok, near[:, np.minimum(at, p.shape[1] - 1)], 0.0)
        score += np.sqrt(part) / h
        found += part > floor
        power += part
    score = np.where(found >= 2, score, 0.0)
    best = score.argmax(axis=1)
    hz = np.fft.rfftfreq(n, 1 / rate)
    tonal = p[:, (hz >= 80) & (hz <= 5000)].sum(axis=1)
    rows = np.arange(len(p))
    none = score[rows, best] <= 0
    return np.where(none, np.nan, candidates[best] * rate / n), np.where(none, np.nan, np.clip(power[rows, best] / np.maximum(tonal, 1e-18), 0, 1))


CONTEXT = 15  # hops before the one measured; the filters have died away after fewer


def weighting(n: int, rate: float) -> np.ndarray:
    """Frequency response of the K weighting of ITU-R BS.1770 on an n-point transform."""
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    # The standard's shelf and high pass as analogue prototypes.
    k, q, high = math.tan(math.pi * 1681.974450955533 / rate), 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    band = high**0.4996667741545416
    shelf = (high + band * k / q + k * k + 2 * (k * k - high) * z + (high - band * k / q + k * k) * z**2) / (1 + k / q + k * k + 2 * (k * k - 1) * z + (1 - k / q + k * k) * z**2)
    k, q = math.tan(math.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    return shelf * (1 - 2 * z + z**2) / (1 + 2 * (k * k - 1) / a0 * z + (1 - k / q + k * k) / a0 * z**2)


def hop_energy(hops: DataFrame, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """K-weighted mean square of every hop, channels added (D14): (runtime_id, hop_index, sample_rate, energy).

    A block is filtered at once, after the ``CONTEXT`` hops before it, in which the filter settles; missing hops are silence.
    """
    schema = "runtime_id string, hop_index long, sample_rate double, energy double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("hop_index")
        index, rate = table["hop_index"].to_numpy(), table["sample_rate"][0].as_py()
        place = index - index[0]
        length = (int(place[-1]) + 1) * HOP
        size = 1 << (length + CONTEXT * HOP - 1).bit_length()  # padded, so that the end does not reach the beginning
        energy = np.zeros(int(place[-1]) + 1)
        for c in ("left", "right"):
            x = np.zeros((int(place[-1]) + 1, HOP))
            x[place] = table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, HOP)
            y = np.fft.irfft(np.fft.rfft(x.ravel(), size) * weighting(size, float(rate)), size)[:length]
            energy += (y.reshape(-1, HOP) ** 2).mean(axis=1)
        own = ~table["halo"].to_numpy(zero_copy_only=False)
        return pa.table({"runtime_id": table["runtime_id"].filter(pa.array(own)), "hop_index": index[own], "sample_rate": table["sample_rate"].filter(pa.array(own)), "energy": energy[place[own]]})

    return with_halo(hops.select("runtime_id", "hop_index", "sample_rate", "left", "right"), CONTEXT, block_hops).groupBy("runtime_id", "block", "sample_rate").applyInArrow(run, schema)


def _lufs(energy):
    return -0.691 + 10 * F.log10(F.greatest(energy, F.lit(1e-12)))


def short_term(energies: DataFrame, rate: float = 48000.0, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """Loudness of the last three seconds at each hop."""
    n = round(3 * rate / HOP)
    rows = with_halo(energies.select("runtime_id", "hop_index", "energy"), n - 1, block_hops)
    return rows.withColumn("lufs_s", _lufs(F.avg("energy").over(_before(n - 1)))).where("not halo").select("runtime_id", "hop_index", "lufs_s")


def gating_blocks(energies: DataFrame, rate: float = 48000.0, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """Energies of 0.4 s every 0.1 s, to the nearest hop (D14): (runtime_id, hop_index, e)."""
    block, step = round(0.4 * rate / HOP), round(0.1 * rate / HOP)
    w = _before(block - 1)
    rows = with_halo(energies.select("runtime_id", "hop_index", "energy"), block - 1, block_hops).withColumns({"e": F.avg("energy").over(w), "n": F.count("*").over(w)})
    return rows.where((F.col("n") == block) & (F.col("hop_index") % step == 0) & ~F.col("halo")).select("runtime_id", "hop_index", "e")


def integrated(energies: DataFrame, rate: float = 48000.0, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """Gated loudness per track (D14): blocks above -70 LUFS, then those above 10 LU under their mean."""
    loud = gating_blocks(energies, rate, block_hops).where(_lufs(F.col("e")) > -70)
    mean = loud.groupBy("runtime_id").agg(F.avg("e").alias("mean"))
    return loud.join(mean, "runtime_id").where(_lufs(F.col("e")) > _lufs(F.col("mean")) - 10).groupBy("runtime_id").agg(_lufs(F.avg("e")).alias("lufs_i"))


def loudness_histogram(energies: DataFrame, rate: float = 48000.0, block_hops: int = BLOCK_HOPS) -> DataFrame:
    """Blocks by loudness in tenths of an LU from -70 on: (runtime_id, tenth, n). Histograms of parts of a track add up, so this is the rollup to keep."""
    tenth = F.floor((_lufs(F.col("e")) + 70) * 10).cast("int")
    return gating_blocks(energies, rate, block_hops).where(_lufs(F.col("e")) > -70).groupBy("runtime_id", tenth.alias("tenth")).agg(F.count("*").alias("n"))


def integrated_of(histogram: DataFrame) -> DataFrame:
    """Gated loudness from histograms, to within a tenth of an LU of ``integrated``: each block counts as the middle of its tenth."""
    level = F.col("tenth") / 10.0 - 69.95
    rows = histogram.groupBy("runtime_id", "tenth").agg(F.sum("n").alias("n")).withColumns({"level": level, "e": F.pow(F.lit(10.0), (level + 0.691) / 10)})
    mean = rows.groupBy("runtime_id").agg(_lufs(F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("mean"))
    kept = rows.join(mean, "runtime_id").where(F.col("level") > F.col("mean") - 10)
    return kept.groupBy("runtime_id").agg(_lufs(F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("lufs_i"))
