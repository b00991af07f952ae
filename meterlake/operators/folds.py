"""Ordered folds of tracks in parallel: a prefix over state machines.

A fold goes through a track's rows in order and carries a state. Here the rows are cut into blocks of about
``BLOCK_ROWS`` by range of (track, order), so one long track lies in many blocks and tasks. The first pass turns each
part of a track in a block into a small map from the state before it to the state after it; the second composes
the maps of a track, a few numbers a block, which gives each block its entry state; the third emits the
block's rows from there. The blocks are checkpointed in between, so both passes see the same ones, and no
pass moves rows once they are cut.

Machines say what a map is, how it acts on a state and how rows follow from a state. Their states are whole numbers and
comparisons of given values only, so results don't depend on where the cuts are. ``running`` does the same for what
Spark's own window functions express.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows of a block: what a task holds at once, as Arrow.
BLOCK_ROWS = 200_000
BATCH_ROWS = 10_000
KEY = "runtime_id"


class Machine(NamedTuple):
    """``summarise`` makes the map of a part of a track, ``act`` applies a map to a state, ``emit`` adds columns to rows from the state before them; both are given the columns of ``reads``."""

    reads: list[str]
    state: str
    initial: tuple
    map: str
    summarise: Callable[[pd.DataFrame], tuple]
    act: Callable[[tuple, tuple], tuple]
    emit: Callable[[pd.DataFrame, tuple], pd.DataFrame]
    added: str


ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def blocks(rows: DataFrame, order: list[str], key: str = KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` in ranges of (key, order), with their range's number as block; ``order`` must tell a track's rows apart."""
    n = max(1, -(-rows.count() // block_rows))
    ranged = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    return cut(ranged.withColumn("block", F.spark_partition_id()))


def _parts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each (track, block), in order, from batches of sorted rows."""
    held: list[pa.RecordBatch] = []
    of: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        name = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices.to_numpy()
        block = batch.column("block").to_numpy()
        new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (block[1:] != block[:-1])))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
            now = batch.column(key)[lo].as_py(), int(block[lo])
            if held and now != of:
                yield pa.Table.from_batches(held)
                held = []
            of = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def fold(rows: DataFrame, order: list[str], machine: Machine, key: str = KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with the columns that ``machine`` adds (in place of any of their names), each track folded in ``order``."""
    added = [c.split()[0] for c in machine.added.split(", ")]
    states = [c.split()[0] for c in machine.state.split(", ")]
    maps = [c.split()[0] for c in machine.map.split(", ")]
    map_types, added_types = ([ARROW[c.split()[1]] for c in columns.split(", ")] for columns in (machine.map, machine.added))
    rows = rows.drop(*added)
    kind = rows.schema[key].dataType.simpleString()
    dealt = blocks(rows, order, key, block_rows)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, key):
            values = machine.summarise(part.select(machine.reads).to_pandas())
            yield pa.RecordBatch.from_arrays([part[key].slice(0, 1).combine_chunks(), part["block"].slice(0, 1).combine_chunks(), *(pa.array([v], t) for v, t in zip(values, map_types, strict=True))], names=[key, "block", *maps])

    def compose(found: pd.DataFrame) -> pd.DataFrame:
        state, out = machine.initial, []
        for row in found.sort_values("block").itertuples(index=False):
            out.append((row[0], row[1], *state))
            state = machine.act(tuple(row[2:]), state)
        return pd.DataFrame(out, columns=[key, "block", *(f"entry_{s}" for s in states)])

    entry = ", ".join(f"entry_{c}" for c in machine.state.split(", "))
    entries = dealt.select(key, "block", *(c for c in machine.reads if c != key)).mapInArrow(summaries, f"{key} {kind}, block int, {machine.map}").groupBy(key).applyInPandas(compose, f"{key} {kind}, block int, {entry}")
    # One row a track and block: Spark joins them without moving the rows where they are few, and what it moves is sorted again.
    entries = cut(entries.withColumnsRenamed({key: "fold_key", "block": "fold_block"}))
    met = dealt.join(entries, F.col(key).eqNullSafe(F.col("fold_key")) & (F.col("block") == F.col("fold_block"))).sortWithinPartitions(key, *order)
    names = rows.columns
    met = met.select(*names, "block", *(f"entry_{c}" for c in states))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, key):
            found = (part[f"entry_{s}"][0].as_py() for s in states)
            got = machine.emit(part.select(machine.reads).to_pandas(), tuple(float("nan") if v is None else v for v in found))
            out = part.select(names)
            for c, t in zip(added, added_types, strict=True):
                out = out.append_column(c, pa.array(got[c].to_numpy(), t))
            yield from out.to_batches(max_chunksize=BATCH_ROWS)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), machine.added])
    return met.mapInArrow(emit, schema)


NANO = 1_000_000_000


def gate(open_db: float = -48.0, close_db: float = -50.0, hold: float = 0.4) -> Machine:
    """The signal gate (Z05) of rows with level_db and seconds: opens above ``open_db``; closes when silence, the time below
    ``close_db`` since the last level that was not, reaches ``hold``. While closed, silence runs on until it opens.
    A null level is below."""
    most = round(hold * NANO)

    def levels(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        level = part["level_db"].to_numpy(np.float64, na_value=-np.inf)
        level = np.where(np.isnan(level), -np.inf, level)
        return level > open_db, level < close_db, np.rint(part["seconds"].to_numpy(np.float64) * NANO).astype(np.int64)

    def run(loud: np.ndarray, low: np.ndarray, step: np.ndarray, is_open: bool, silence: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(len(step))
        passed = np.cumsum(step)
        last = lambda on: np.maximum.accumulate(np.where(on, n, -1))
        begin = last(~low)  # silence counts from the row after this one
        quiet = passed - np.where(begin >= 0, passed[begin], -silence)
        closing = low & (quiet >= most)
        opened = last(loud)
        shut = np.append(np.minimum.accumulate(np.where(closing, n, len(n))[::-1])[::-1], len(n))[opened + 1]
        known = (opened >= 0) | is_open
        shown = known & (shut > n)
        # Closed rows count on from where the silence that closed the gate began.
        start = begin[np.minimum(shut, len(n) - 1)]
        since = passed - np.where(known & (start >= 0), passed[start], -silence)
        return shown, np.where(shown, np.where(low, quiet, 0), since)

    def summarise(part: pd.DataFrame) -> tuple:
        loud, low, step = levels(part)
        if loud.any():
            shown, silence = run(loud, low, step, True, 0)
            return True, 0, 0, False, bool(shown[-1]), int(silence[-1])
        lead = int(np.argmin(low)) if not low.all() else len(low)
        if lead == len(low):
            return False, int(step.sum()), int(step.sum()), True, False, 0
        shown, silence = run(loud[lead:], low[lead:], step[lead:], True, 0)
        return False, int(step.sum()), int(step[:lead].sum()) if lead else -1, False, bool(shown[-1]), int(silence[-1])

    def act(found: tuple, state: tuple) -> tuple:
        loud, total, lead, all_low, shown, silence = found
        if loud:
            return shown, silence
        if not state[0] or (lead >= 0 and state[1] + lead >= most):
            return False, state[1] + total
        return (True, state[1] + total) if all_low else (shown, silence)

    def emit(part: pd.DataFrame, state: tuple) -> pd.DataFrame:
        shown, silence = run(*levels(part), bool(state[0]), int(state[1]))
        return part.assign(open=shown, silence=silence / NANO)

    return Machine(["level_db", "seconds"], "open boolean, silence long", (False, 0), "loud boolean, total long, lead long, all_low boolean, exit_open boolean, exit_silence long", summarise, act, emit, "open boolean, silence double")


def throttle(seconds: float = 0.1, clock: str = "received_at") -> Machine:
    """Whether a row is the first at least ``seconds`` after the one kept before (R12, Z06), as the column kept.

    A map lists, for the rows that the row kept before the block can make the first kept one here, what is kept last; rows with one end are one entry.
    """

    def due(t):
        return t + (seconds - 1e-9)

    def following(t: np.ndarray) -> np.ndarray:
        return np.searchsorted(t, due(t))

    def summarise(part: pd.DataFrame) -> tuple:
        t = part[clock].to_numpy(np.float64)
        to = following(t)
        to = np.where(to < len(t), to, np.arange(len(t)))
        while (to[to] != to).any():
            to = to[to]
        first = min(int(np.searchsorted(t, due(t[0]))), len(t) - 1)
        upto = np.flatnonzero(np.append(to[: first + 1][1:] != to[:first], True))
        return t[upto].tolist(), t[to[upto]].tolist()

    def act(found: tuple, state: tuple) -> tuple:
        at = int(np.searchsorted(np.asarray(found[0]), due(state[0])))
        return (float(found[1][at]),) if at < len(found[0]) else state

    def emit(part: pd.DataFrame, state: tuple) -> pd.DataFrame:
        t = part[clock].to_numpy(np.float64)
        kept, to = np.zeros(len(t), bool), following(t)
        at = int(np.searchsorted(t, due(state[0])))
        while at < len(t):
            kept[at] = True
            at = int(to[at])
        return part.assign(kept=kept)

    return Machine([clock], "last double", (float("-inf"),), "upto array<double>, ends array<double>", summarise, act, emit, "kept boolean")


def passes(rate: float = 48_000.0) -> Machine:
    """The number of the pass each block of audio belongs to (W10, Z04), as the column epoch, of rows with playing, position, seconds and size.

    A pass starts when play starts, or where the position is off by more than max(2048, 4 blocks) samples; without
    positions on both sides, where the seconds are off by more than max(0.05 s, 4 blocks).
    """

    def starts(now: tuple, before: tuple) -> np.ndarray:
        playing, position, seconds, size = now
        was, at, then, length = before
        moved = np.abs(position - (at + length)) > np.maximum(2048, 4 * size)
        slipped = np.abs(seconds - (then + length / rate)) > np.maximum(0.05, 4 * size / rate)
        return playing & (~was | np.where(np.isnan(position) | np.isnan(at), slipped, moved))

    def columns(part: pd.DataFrame) -> tuple:
        number = lambda c: part[c].to_numpy(np.float64, na_value=np.nan)
        return part["playing"].fillna(False).to_numpy(bool), number("position"), number("seconds"), number("size")

    def row(c: tuple, i: int) -> tuple:
        return tuple(x[i : i + 1] for x in c)

    def counted(c: tuple, state: tuple) -> np.ndarray:
        inner = starts(tuple(x[1:] for x in c), tuple(x[:-1] for x in c))
        first = starts(row(c, 0), tuple(np.array([x]) for x in (bool(state[1]), *state[2:])))
        return np.concatenate([first, inner])

    def summarise(part: pd.DataFrame) -> tuple:
        c = columns(part)
        inner = int(counted(c, (0, False, np.nan, 0.0, 0.0))[1:].sum())
        return inner, *(v for i in (0, -1) for v in (bool(c[0][i]), *(float(x[i]) for x in c[1:])))

    def act(found: tuple, state: tuple) -> tuple:
        first = tuple(np.array([v]) for v in found[1:5])
        begun = starts(first, tuple(np.array([x]) for x in (bool(state[1]), *state[2:])))
        return (int(state[0]) + int(begun[0]) + int(found[0]), *found[5:9])

    def emit(part: pd.DataFrame, state: tuple) -> pd.DataFrame:
        return part.assign(epoch=int(state[0]) + np.cumsum(counted(columns(part), state)))

    side = "{0}_playing boolean, {0}_position double, {0}_seconds double, {0}_size double"
    return Machine(["playing", "position", "seconds", "size"], "epoch long, playing boolean, position double, seconds double, size double", (0, False, float("nan"), 0.0, 0.0), f"inner long, {side.format('first')}, {side.format('last')}", summarise, act, emit, "epoch long")


def running(rows: DataFrame, by: list[str], order: list[str], column: str, how: Callable[[Column], Column], merge: Callable[[Column, Column], Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``column`` as its running aggregate, without a window over a whole track: ``how`` aggregates over ordered
    rows or parts, ``merge`` joins what came before a part with what is inside it. W13: F.max, F.greatest; Z14: ``last_known``."""
    dealt = blocks(rows.withColumn("fold_key", F.struct(*by)), order, "fold_key", block_rows)
    part = Window.partitionBy("fold_key", "block").orderBy(*order)
    inside = dealt.withColumn(column, how(F.col(column)).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    # What a part comes to is the value at its last row.
    whole = inside.groupBy("fold_key", "block").agg(F.max_by(F.struct(F.col(column).alias("x")), F.struct(*order)).alias("w"))
    parts = Window.partitionBy("fold_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(whole.select("fold_key", "block", how(F.col("w.x")).over(parts).alias("fold_before")))
    met = inside.join(before, ["fold_key", "block"])
    return met.withColumn(column, merge(F.col("fold_before"), F.col(column))).select(*rows.columns)


def last_known(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def later(before: Column, inside: Column) -> Column:
    return F.coalesce(inside, before)
