"""Column expressions of the telemetry measures. Null means unavailable and stays null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

FLOOR_DB = -120.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value as double, null if it is no finite number."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def amplitude_db(c: Column | str) -> Column:
    """Amplitude to dB, floored at -120."""
    return F.greatest(20 * F.log10(F.greatest(col(c), F.lit(1e-9))), F.lit(FLOOR_DB))


def ratio_db(a: Column | str, b: Column | str, power: bool = True) -> Column:
    """Ratio in dB within +-120; 0 if both sides are about zero."""
    a, b, tiny = col(a), col(b), 1e-18 if power else 1e-9
    raw = (10 if power else 20) * F.log10(F.greatest(a, F.lit(tiny)) / F.greatest(b, F.lit(tiny)))
    return F.when((a <= tiny) & (b <= tiny), F.lit(0.0)).otherwise(F.greatest(F.lit(-120.0), F.least(F.lit(120.0), raw)))


def power(db: Column | str) -> Column:
    """dB to power."""
    return F.pow(F.lit(10.0), col(db) / 10)


def db(p: Column | str, floor: float = 1e-12) -> Column:
    """Power to dB with a floor."""
    return 10 * F.log10(F.greatest(col(p), F.lit(floor)))


def power_mean(c: Column | str) -> Column:
    """Power-domain mean of dB values above -120."""
    return db(F.avg(F.when(col(c) > FLOOR_DB, power(c))))


def band_power_mean(c: Column | str) -> Column:
    """Power-domain mean of all dB values of a band."""
    return db(F.avg(power(c)))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean with positive weights, over rows that have a value."""
    v, w = col(value), col(weight)
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def pearson(a: Column | str, b: Column | str, least: int = 3) -> Column:
    """Correlation of at least ``least`` pairs with variance on both sides, within +-1."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    n = F.count(x)
    enough = (n >= least) & (F.sqrt(F.var_pop(x) * F.var_pop(y)) * n > 1e-12)
    return F.when(enough, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(x, y))))


def correlation_label(c: Column | str) -> Column:
    """Bucket of a stereo correlation."""
    x = col(c)
    return F.when(x < -0.25, "strong_negative").when(x < 0, "negative").when(x < 0.25, "weak").when(x.isNotNull(), "positive")


def features(mask: Column | str) -> dict[str, Column]:
    """The six feature bits of a mask."""
    m = col(mask)
    return {name: m.bitwiseAND(1 << i) != 0 for i, name in enumerate(("core", "loudness", "spectrum", "stereo", "temporal", "semantic"))}


def slot(t: Column | str, width: float = 0.1) -> Column:
    """Index of the 100 ms slot inside a one-second bin, 0 to 9."""
    x = col(t)
    return F.least(F.lit(9), F.greatest(F.lit(0), F.floor((x - F.floor(x)) / width).cast("int")))


def erb_rate(hz: Column | str) -> Column:
    """ERB-rate of a frequency."""
    return 21.4 * F.log10(1 + 0.00437 * col(hz))


def erb_frequency(rate: Column | str) -> Column:
    return (F.pow(F.lit(10.0), col(rate) / 21.4) - 1) / 0.00437


def direction_weight(delta_db: Column | str, scale: float = 6.0) -> Column:
    """Logistic weight of a level difference."""
    return 1 / (1 + F.exp(-col(delta_db) / scale))


def similarity(a: Column | str, b: Column | str, scale: float) -> Column:
    """Exponential similarity of two values."""
    return F.exp(-F.abs(col(a) - col(b)) / scale)


def change_score(d: Column | str, scale: float = 1.5) -> Column:
    """How strongly a normalised difference speaks for a change."""
    return 1 - F.exp(-col(d) / scale)


def proximity(d: Column | str, scale: float) -> Column:
    """1 at no difference, 0 from ``scale`` on."""
    return 1 - F.least(F.lit(1.0), F.abs(col(d)) / scale)


def entropy(values: Column | str, n: int) -> Column:
    """Entropy of a distribution in an array, 1 if even."""
    return F.aggregate(col(values), F.lit(0.0), lambda acc, p: acc + F.when(p > 0, -p * F.ln(p)).otherwise(0.0)) / F.ln(F.lit(float(n)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str, tiny: float = 1e-12) -> Column:
    """Cosine similarity within 0..1, null for zero vectors."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > tiny) & (nb > tiny), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), na * nb))))


def jensen_shannon(a: Column | str, b: Column | str) -> Column:
    """Jensen-Shannon divergence, base 2, within 0..1."""

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / F.greatest(m, F.lit(1e-300)))).otherwise(0.0)

    terms = F.zip_with(col(a), col(b), lambda p, q: 0.5 * part(p, (p + q) / 2) + 0.5 * part(q, (p + q) / 2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)))


def rotate(values: Column | str, by: Column | int, n: int = 12) -> Column:
    """Element i of the result is element (i - by) mod n (X11)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(col(values), F.pmod(i - by, F.lit(n)).cast("int")))


def pitch_class(hz: Column | str) -> Column:
    """Pitch class 0 (C) to 11 of a frequency."""
    return F.pmod(F.round(69 + 12 * F.log2(col(hz) / 440)).cast("int"), F.lit(12))


def family_label(i: Column) -> Column:
    """A..Z, AA.. of a family's ordinal from 0."""
    one = F.chr(65 + i % 26)
    return F.when(i < 26, one).otherwise(F.concat(F.chr(65 + F.floor(i / 26) - 1), one))


def pair_id(a: Column | str, b: Column | str) -> Column:
    """Ids of a pair in order."""
    return F.concat_ws("::", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of a text's characters up to U+00FF."""
    codes = F.transform(F.split(col(text), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def stereo_band(hz: Column | str) -> Column:
    """Stereo band of a frequency, null outside; the last band holds its upper edge."""
    edges = dims.STEREO_EDGES
    return reduce(lambda acc, i: acc.when((col(hz) >= edges[i]) & ((col(hz) < edges[i + 1]) | F.lit(i == len(edges) - 2) & (col(hz) <= edges[i + 1])), i), range(len(edges) - 1), F.when(F.lit(False), 0))


def transport_estimate(latest: Column | str, ppq: Column | str, bpm: Column | str, block_samples: Column | str, queued_samples: Column | str, rate: Column | str, playing: Column | str, window: int = 4096) -> Column:
    """Time and beat position that a window's middle stands for, and the lag in ms."""
    behind = (col(queued_samples) + window / 2) / col(rate)
    time = F.when(col(playing), F.greatest(F.lit(0.0), col(latest) + col(block_samples) / col(rate) - behind)).otherwise(col(latest))
    beats = F.when(col(playing) & (col(bpm) > 0), col(ppq) + (time - col(latest)) * col(bpm) / 60).otherwise(col(ppq))
    return F.struct(time.alias("transport_time_seconds"), beats.alias("transport_ppq_position"), (behind * 1000).alias("estimated_analysis_lag_ms"))


def idle_wait_ms(available: Column | str, hop: Column | str, rate: Column | str, most: int = 20) -> Column:
    """Milliseconds until a hop should be there (X35): none if it is, else 1 to ``most``."""
    missing = F.ceil((col(hop) - col(available)) * 1000.0 / F.greatest(col(rate), F.lit(1.0)))
    return F.when((col(hop) == 0) | (col(available) >= col(hop)), 0).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), missing))).cast("int")


def loudness_due(samples: Column | str, rate: Column | str, elapsed_ms: Column | str, seconds: float = 0.1) -> Column:
    """Whether loudness is to be measured again (X35): a tenth of a second of audio or of time has passed."""
    interval = F.greatest(F.lit(1), F.ceil(F.greatest(col(rate), F.lit(1.0)) * seconds))
    return (col(samples) >= interval) | (col(elapsed_ms) >= 1000 * seconds)


def binding_selector(index: Column | str, slot: Column | str, runtime_id: Column | str) -> Column:
    """mixer:<index>/slot:<slot> of a bound track, else its runtime id."""
    return F.when(col(index).isNotNull() & col(slot).isNotNull(), F.format_string("mixer:%d/slot:%d", col(index), col(slot))).otherwise(col(runtime_id))


def display_name(bound: Column | str, track: Column | str, runtime_id: Column | str) -> Column:
    """The name of a track's binding, else its own, else its id (X40); blank names don't count."""
    return F.coalesce(*[F.when(F.length(F.trim(col(c))) > 0, col(c)) for c in (bound, track)], col(runtime_id))


def delta(before: Column | str, after: Column | str, digits: int = 4) -> Column:
    """after - before, rounded; null if either is."""
    return F.round(col(after) - col(before), digits)


def warnings(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that hold, in order (P10)."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())
