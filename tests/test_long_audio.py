"""Loudness, windows and changes of long tracks in blocks; bounded late data."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import dsp, timeline
from meterlake.sources import frames as source
from meterlake.streaming import live

HOPS = "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>"


@pytest.fixture(scope="module")
def sound():
    """Nine seconds: loud, 20 dB lower, all but silent; a tone and noise."""
    rng = np.random.default_rng(8)
    n = 420 * dsp.HOP
    t = np.arange(n) / 48000
    level = np.repeat([0.5, 0.05, 0.00001], n // 3)
    return level * np.sin(2 * np.pi * 997 * t), level * rng.normal(size=n) * 0.3


@pytest.fixture(scope="module")
def hops(spark, sound):
    left, right = (x.reshape(-1, dsp.HOP) for x in sound)
    return spark.createDataFrame([("a", i, 48000.0, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(left, right, strict=True))], HOPS).cache()


def test_energy_in_blocks_is_that_of_the_whole(hops, sound):
    size = 1 << (len(sound[0]) + 65_536).bit_length()
    whole = sum((np.fft.irfft(np.fft.rfft(x, size) * dsp.weighting(size, 48000.0), size)[: len(x)].reshape(-1, dsp.HOP) ** 2).mean(axis=1) for x in sound)
    for block in (32, 2048):
        got = {r.hop_index: r.energy for r in dsp.hop_energy(hops, block).collect()}
        assert set(got) == set(range(420))
        assert all(abs(10 * np.log10(got[i] / whole[i])) < 0.05 for i in range(280)) and all(got[i] < 1e-8 for i in range(300, 420))


def test_loudness_in_blocks(hops):
    energy = dsp.hop_energy(hops).cache()
    one = lambda df: df.first().lufs_i
    want = one(dsp.integrated(energy))
    for block in (150, 2048):
        assert one(dsp.integrated(energy, block_hops=block)) == pytest.approx(want, abs=1e-9)
        hist = dsp.loudness_histogram(energy, block_hops=block)
        assert one(dsp.integrated_of(hist)) == pytest.approx(want, abs=0.1)
        # Histograms of parts add up.
        parts = [hist.where(F.col("tenth") % 2 == k) for k in (0, 1)]
        assert one(dsp.integrated_of(parts[0].union(parts[1]).union(parts[1].limit(0)))) == pytest.approx(one(dsp.integrated_of(hist)), abs=1e-12)
    e = np.array([r.energy for r in energy.orderBy("hop_index").collect()])
    lufs = lambda x: -0.691 + 10 * np.log10(max(x, 1e-12))
    got = {r.hop_index: r.lufs_s for r in dsp.short_term(energy, block_hops=150).collect()}
    assert got == {i: pytest.approx(lufs(e[max(0, i - 140) : i + 1].mean()), abs=1e-9) for i in range(420)}
    # By plain numpy: blocks of 19 hops every 5, the absolute and then the relative gate.
    blocks = np.array([e[i - 18 : i + 1].mean() for i in range(18, 420) if i % 5 == 0])
    loud = blocks[[lufs(b) > -70 for b in blocks]]
    assert want == pytest.approx(lufs(loud[[lufs(b) > lufs(loud.mean()) - 10 for b in loud]].mean()), abs=1e-9)


def test_windows_and_changes_in_blocks(hops):
    some = hops.where("hop_index < 40 and hop_index <> 21")
    for block in (7, 2048):
        w = dsp.windows(some, block)
        assert sorted(r.hop_index for r in w.select("hop_index").collect()) == [i for i in range(3, 40) if not 21 <= i <= 24]
    m = dsp.analyse(dsp.windows(some)).cache()
    row = lambda df: sorted((r.hop_index, r.rms_db, r.flux, r.rise_db) for r in df.where("hop_index > 25 or hop_index < 21").collect() if r.flux is not None)
    assert row(dsp.changes(m, 5)) == row(dsp.changes(m, 2048)) and len(row(dsp.changes(m, 5))) == 31


def test_bounded_late_data(spark):
    """A frame of a closed span of receive time is left out; one of an open span counts, however late in the song it is."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # Received on the song clock: 100 s and later, then one far behind and one a little behind.
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1.44e10
    first = events.where((at >= 100) & (at < 130))
    late = events.where((at >= 10) & (at < 12)).unionByName(events.where((at >= 95) & (at < 100)))
    folder = tempfile.mkdtemp(prefix="spark-")
    dropped = 0
    for part in (first, late, events.where((at >= 130) & (at < 131))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = live.timeline_stream(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), bound_ms=30_000, span_seconds=10)
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        assert q.awaitTermination(60)
        dropped += sum(int(s.numRowsDroppedByWatermark) for p in q.recentProgress for s in p.stateOperators)
    out = timeline.merge(spark.read.parquet(f"{folder}/out")).collect()
    closed = timeline.accumulate(source.from_events(events.where((at >= 95) & (at < 100)))).collect()  # the only span closed with rows
    key = lambda r: (r.runtime_id, r.transport_epoch, r.bin_index, r.frame_count, r.coverage_mask)
    assert sorted(map(key, out)) == sorted(map(key, closed)) and dropped > 0
