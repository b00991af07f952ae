"""Streams with state equal their batch forms, across a restart from the checkpoint."""

import random
import tempfile
import time
from collections import OrderedDict

import pytest

from meterlake.operators import dsp
from meterlake.streaming import stateful

RNG = random.Random(41)


def run(spark, parts, schema, make):
    """Feed parts one by one, each to a query started anew from the same checkpoint; return what it wrote."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").start(f"{folder}/out")
        until = time.time() + 60
        # A query with a time to live goes on without data, so its rows are waited for.
        while sum(p.numInputRows for p in q.recentProgress) < len(rows) and q.isActive and time.time() < until:
            time.sleep(0.2)
        q.stop()
    return spark.read.parquet(f"{folder}/out")


def split(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_windows(spark):
    schema = "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>"
    sound = lambda: [round(RNG.uniform(-1, 1), 3) for _ in range(dsp.HOP)]
    rows = [(t, i, 48000.0, sound(), sound()) for i in range(9) for t in "ab"]
    got = run(spark, split(rows, 3), schema, stateful.windows)
    want = dsp.windows(spark.createDataFrame(rows, schema))
    key = lambda df: sorted((r.runtime_id, r.hop_index, tuple(r.left), tuple(r.right)) for r in df.collect())
    assert key(got) == key(want) and got.count() == 12


def test_emissions(spark):
    schema = "runtime_id string, hop_index long, flux double, rise_db double"
    rows = [(t, i, None if i == 0 or RNG.random() < 0.1 else RNG.random(), None if i == 0 else RNG.random() * 9) for i in range(100) if i not in range(40, 52) for t in "ab"]
    got = run(spark, split(rows, 3), schema, lambda s: stateful.emissions(s, 5))
    want = {(r.runtime_id, r.emission): r for r in dsp.emissions(spark.createDataFrame(rows, schema), 5).collect()}
    seen = {(r.runtime_id, r.emission): r for r in got.collect()}
    assert set(seen) == {k for k in want if k[1] != 19}  # the last is not over
    for k, r in seen.items():
        assert r.spectral_flux_mean == pytest.approx(want[k].spectral_flux_mean) and r.spectral_flux_peak == want[k].spectral_flux_peak
        assert r.rms_rise_peak_db == want[k].rms_rise_peak_db and r.samples == want[k].samples


def test_retained(spark):
    schema = "runtime_id string, arrival_seq long, received_at double, transport_epoch int, transport_time_seconds double, signal_present boolean, rms_db double"
    rows = [(t, i, float(i), 1 + i // 300, RNG.choice([i / 7, RNG.uniform(0, 40)]), RNG.random() < 0.5, RNG.choice([-130.0, RNG.uniform(-60, 0)])) for i in range(400) for t in "ab"]
    got = run(spark, split(rows, 4), schema, lambda s: stateful.retained(s, bins=20, last=50)).collect()
    for t in "ab":
        held, evicted = OrderedDict(), []
        for n, (_, _, _, epoch, at, active, level) in enumerate((r for r in rows if r[0] == t), 1):
            k = (epoch, int(at))
            v = held.pop(k, [0, 0, 0, 0, 0.0, 0])
            usable = level > -120
            held[k] = [n, v[1] + 1, v[2] + active, v[3] | 1 << min(9, int((at - int(at)) / 0.1)), v[4] + (10 ** (level / 10) if usable else 0), v[5] + usable]
            if len(held) > 20:
                k, v = held.popitem(last=False)
                evicted.append((*k, *v[:4], v[5]))
        mine = [r for r in got if r.runtime_id == t]
        row = lambda r: (r.transport_epoch, r.bin_index, r.touched, r.frame_count, r.active_count, r.coverage_mask, r.rms_db_count)
        assert sorted(row(r) for r in mine if r.evicted) == sorted(evicted)
        latest = {}
        for r in sorted(mine, key=lambda r: (r.touched, r.evicted)):
            latest[(r.transport_epoch, r.bin_index)] = r
        alive = {k: r for k, r in latest.items() if not r.evicted}
        assert {k: row(r)[2:] for k, r in alive.items()} == {k: (*v[:4], v[5]) for k, v in held.items()}
        assert all(r.rms_db_power_sum == pytest.approx(held[k][4]) for k, r in alive.items())
        assert max(r.frames_held for r in mine) == 50 and max(r.oldest_seq for r in mine) == 350


def test_time_to_live(spark):
    """State with a time to live of a millisecond is gone in the next batch: the track starts anew."""
    schema = "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>"
    rows = [("a", i, 48000.0, [0.0] * dsp.HOP, [0.0] * dsp.HOP) for i in range(10)]
    got = run(spark, split(rows, 2), schema, lambda s: stateful.windows(s, ttl_ms=1))
    assert sorted(r.hop_index for r in got.collect()) == [3, 4, 8, 9]
