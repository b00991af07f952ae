"""Streams with state of their own per track, by transformWithState: the stream forms of operators that look back.

``windows`` keeps the last three hops and joins them with each new one (Z03). ``emissions`` adds up change measures, sends
them when their time is over, and starts anew (Z07). ``retained`` keeps the one-second bins touched last and the
last frames, and drops what is older (Z11). Rows of one micro-batch are put in order first; what arrives in a later batch
counts as later, and is never taken back. State is written to the checkpoint with each batch, so a restart goes on from there.

With ``ttl_ms`` state that was not touched for so long goes, in processing time; a track then starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dsp

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Named states need the RocksDB store; queries started from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _transform(rows: DataFrame, processor: StatefulProcessor, schema: str, ttl_ms: int | None) -> DataFrame:
    use_state_store(rows.sparkSession)
    return rows.groupBy("runtime_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


WINDOW = "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>"


class Windows(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hops = handle.getListState("hops", "left array<double>, right array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(list(a), list(b)) for a, b in self.hops.get()]
        out = []
        for r in _ordered(rows, "hop_index").itertuples(index=False):
            held = [*held[-3:], (list(r.left), list(r.right))]
            if len(held) == dsp.SIZE // dsp.HOP:
                out.append((key[0], r.hop_index, r.sample_rate, *(sum((h[side] for h in held), []) for side in (0, 1))))
        self.hops.put(held[-3:])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")])

    def close(self) -> None:
        pass


def windows(hops: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The windows of ``dsp.windows``, of a stream of hops (runtime_id, hop_index, sample_rate, left, right)."""
    return _transform(hops, Windows(ttl_ms), WINDOW, ttl_ms)


EMISSION = "runtime_id string, emission long, spectral_flux_mean double, spectral_flux_peak double, rms_rise_peak_db double, samples long"


class Emissions(StatefulProcessor):
    def __init__(self, every: int, ttl_ms: int | None):
        self.every, self.ttl_ms = every, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "emission long, flux double, n long, peak double, rise double, hops long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.sums.get()) if self.sums.exists() else None
        out = []
        for r in _ordered(rows, "hop_index").itertuples(index=False):
            emission = r.hop_index // self.every
            if s is not None and emission > s[0]:
                out.append((key[0], s[0], s[1] / s[2] if s[2] else None, s[3] if s[2] else None, None if s[4] < 0 else s[4], s[5] * dsp.HOP))
                s = None
            _, flux, n, peak, rise, hops = s or (emission, 0.0, 0, -1.0, -1.0, 0)
            if r.flux == r.flux and r.flux is not None:
                flux, n, peak = flux + r.flux, n + 1, max(peak, r.flux)
            if r.rise_db == r.rise_db and r.rise_db is not None:
                rise = max(rise, r.rise_db)
            s = ((s or (emission,))[0], flux, n, peak, rise, hops + 1)
        self.sums.update(s)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EMISSION.split(", ")])

    def close(self) -> None:
        pass


def emissions(changes: DataFrame, every: int, ttl_ms: int | None = None) -> DataFrame:
    """The rows of ``dsp.emissions`` as they are over, of a stream of changes (runtime_id, hop_index, flux, rise_db)."""
    return _transform(changes, Emissions(every, ttl_ms), EMISSION, ttl_ms)


BIN = "transport_epoch int, bin_index int"
SUMS = "touched long, frame_count long, active_count long, coverage_mask int, rms_db_power_sum double, rms_db_count long"
RETAINED = f"runtime_id string, {BIN}, {SUMS}, evicted boolean, frames_held int, oldest_seq long"


class Retained(StatefulProcessor):
    def __init__(self, bins: int, frames: int, ttl_ms: int | None):
        self.bins, self.frames, self.ttl_ms = bins, frames, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("bins", BIN, SUMS, self.ttl_ms)
        self.ring = handle.getMapState("frames", "slot int", "arrival_seq long, received_at double, rms_db double", self.ttl_ms)
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        held = {tuple(k): tuple(v) for k, v in self.held.iterator()}
        changed, gone = set(), []
        for r in _ordered(rows, "arrival_seq").itertuples(index=False):
            self.ring.updateValue((int(n % self.frames),), (int(r.arrival_seq), float(r.received_at), float(r.rms_db)))
            n += 1
            k = (int(r.transport_epoch), int(r.transport_time_seconds // 1))
            _, frames, active, mask, power, counted = held.get(k, (0, 0, 0, 0, 0.0, 0))
            usable = r.rms_db == r.rms_db and r.rms_db > -120
            slot = min(9, max(0, int((r.transport_time_seconds - k[1]) / 0.1)))
            held[k] = (n, frames + 1, active + bool(r.signal_present), mask | 1 << slot, power + (10 ** (r.rms_db / 10) if usable else 0.0), counted + usable)
            changed.add(k)
            if len(held) > self.bins:
                old = min(held, key=lambda x: held[x][0])
                gone.append((old, held.pop(old)))
                changed.discard(old)
                if self.held.containsKey(old):
                    self.held.removeKey(old)
        for k in changed:
            self.held.updateValue(k, held[k])
        self.count.update((int(n),))
        oldest = self.ring.getValue((int(n % self.frames),) if n > self.frames else (0,))[0]
        out = [(key[0], *k, *v, True, int(min(n, self.frames)), oldest) for k, v in gone] + [(key[0], *k, *held[k], False, int(min(n, self.frames)), oldest) for k in sorted(changed)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RETAINED.split(", ")])

    def close(self) -> None:
        pass


def retained(frames: DataFrame, bins: int = 1200, last: int = 3600, ttl_ms: int | None = None) -> DataFrame:
    """Per track the ``bins`` one-second bins touched last, and its ``last`` frames, of a stream of frames.

    Each batch sends the bins it touched, and those that it evicted with what they held; a bin that is touched again after
    that starts anew. touched counts the track's frames, so the latest row of a bin is the one that counts.
    """
    return _transform(frames, Retained(bins, last, ttl_ms), RETAINED, ttl_ms)
