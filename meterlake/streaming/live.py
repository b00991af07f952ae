"""Live views: the batch expressions over streams, and folds that need order within a key.

The timeline is keyed by song second, not by arrival, and late frames still update their bin, so its stream has
no watermark and runs in update mode; ``timeline_stream`` takes a bound on receive time where state must be bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, timeline
from ..sources import frames as source


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Event files as a stream, a few files per trigger (R13: back-pressure instead of drops)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timeline_stream(events: DataFrame, bound_ms: int | None = None, span_seconds: int = 60) -> DataFrame:
    """Timeline partials of an event stream (Z01): the same aggregation as in batch.

    With ``bound_ms`` state is bounded (Z10): partials are kept by spans of receive time too (received_window), and a span is closed when
    frames received ``bound_ms`` later than its end have been seen. A frame of a closed span is late: it is left out, and counted in the
    query's numRowsDroppedByWatermark. A bin's partials of several spans are one by ``timeline.merge``.
    """
    frames = source.from_events(events)
    if bound_ms is None:
        return timeline.accumulate(frames)
    timed = frames.withColumn("received", F.timestamp_seconds("received_at")).withWatermark("received", f"{bound_ms} milliseconds")
    return timeline.accumulate(timed, also=[F.window("received", f"{span_seconds} seconds").alias("received_window")])


def start_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "update"):
    """Run a stream into a table in memory (tests and small boards)."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def latest_stream(frames: DataFrame) -> DataFrame:
    """The last row per track, updated."""
    rest = [c for c in frames.columns if c != "runtime_id"]
    return frames.groupBy("runtime_id").agg(F.max_by(F.struct(*rest), "arrival_seq").alias("r")).select("runtime_id", "r.*")


def passes(blocks: DataFrame, rate: float = 48000.0, block_rows: int = folds.BLOCK_ROWS) -> DataFrame:
    """Continuous passes (W10, Z04) as the column epoch, of blocks of audio (runtime_id, seq, playing, position, seconds, size)."""
    return folds.fold(blocks, ["seq"], folds.passes(rate), block_rows=block_rows)


OPEN_DB, CLOSE_DB, HOLD = -48.0, -50.0, 0.4
GATE = "runtime_id string, seq long, open boolean, silence double"


def gate_step(level: float | None, step: int, is_open: bool, silence: int) -> tuple[bool, int]:
    """One hop of ``step`` nanoseconds through the signal gate (Z05); a missing level is silence."""
    level = float("-inf") if level is None or level != level else level
    if level > OPEN_DB or (is_open and level >= CLOSE_DB):
        return True, 0
    silence += step
    return is_open and silence < round(HOLD * folds.NANO), silence


def gate(hops: DataFrame, open_db: float = OPEN_DB, close_db: float = CLOSE_DB, hold: float = HOLD, block_rows: int = folds.BLOCK_ROWS) -> DataFrame:
    """``hops`` (runtime_id, seq, level_db, seconds) with open and silence; one long track is many tasks."""
    return folds.fold(hops, ["seq"], folds.gate(open_db, close_db, hold), block_rows=block_rows)


def gate_stream(hops: DataFrame) -> DataFrame:
    """The same gate over a stream, its state kept per track."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else (False, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            s = gate_step(r.level_db, round(r.seconds * folds.NANO), *s)
            out.append((key[0], r.seq, s[0], s[1] / folds.NANO))
        state.update(tuple(s))
        yield pd.DataFrame(out, columns=["runtime_id", "seq", "open", "silence"])

    return hops.groupBy("runtime_id").applyInPandasWithState(update, GATE, "open boolean, silence long", "append", "NoTimeout")


def throttle(frames: DataFrame, seconds: float = 0.1, clock: str = "received_at", block_rows: int = folds.BLOCK_ROWS) -> DataFrame:
    """The first frame at least ``seconds`` after the one kept before, per track (R12, Z06); of frames of one time the first to arrive."""
    order = [clock, *(c for c in ("arrival_seq",) if c in frames.columns)]
    return folds.fold(frames, order, folds.throttle(seconds, clock), block_rows=block_rows).where("kept").drop("kept")


def fence(groups: DataFrame, at: float) -> DataFrame:
    """Groups first received strictly after the fence."""
    return groups.where(F.col("first_received_at") > at)


def carry_forward(frames: DataFrame, column: str, clock: str = "received_at", block_rows: int = folds.BLOCK_ROWS) -> DataFrame:
    """The last value known at each frame."""
    order = [clock, *(c for c in ("arrival_seq",) if c in frames.columns)]
    return folds.running(frames, ["runtime_id"], order, column, folds.last_known, folds.later, block_rows)


def running_max(frames: DataFrame, column: str, by: list[str], order: str = "arrival_seq", block_rows: int = folds.BLOCK_ROWS) -> DataFrame:
    """The highest value so far at each frame."""
    return folds.running(frames, by, [order], column, F.max, F.greatest, block_rows)
