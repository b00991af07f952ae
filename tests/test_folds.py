"""Folds cut into blocks equal the same fold row by row, wherever the cuts are."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import folds
from meterlake.streaming import live

RNG = random.Random(21)
BLOCKS = [7, 40, 10_000]


def tracks(value, sizes=(("a", 300), ("b", 1), ("c", 45), (None, 60))):
    return [(name, i, *value(i)) for name, n in sizes for i in range(n)]


def by_track(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("levels", [[-60.0, -60.0, -60.0, -49.0, -30.0], [-60.0, -49.0], [-60.0], [-49.0, -40.0], [-60.0, None, -40.0, float("nan")]])
def test_gate(spark, block_rows, levels):
    rows = tracks(lambda i: (RNG.choice(levels), RNG.choice([0.0, 0.021, 0.1, 0.13])))
    df = spark.createDataFrame(rows, "runtime_id string, seq long, level_db double, seconds double")
    got = {(r.runtime_id, r.seq): (r.open, r.silence) for r in live.gate(df, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for name, track in by_track(rows).items():
        s = (False, 0)
        for _, i, level, seconds in track:
            s = live.gate_step(level, round(seconds * 1e9), *s)
            assert got[(name, i)] == (s[0], s[1] / 1e9)


def test_gate_state_as_defined():
    """Closing needs 0.4 s below -50 dB; the silence that closed it runs on; -49 dB neither opens nor stays silent."""
    s, seen = (False, 0), []
    for level in (-49, -47, -51, -51, -49, -51, -51, -51, -51, -49, -48, -47):
        s = live.gate_step(level, 100_000_000, *s)
        seen.append((s[0], s[1] // 100_000_000))
    assert seen == [(False, 1), (True, 0), (True, 1), (True, 2), (True, 0), (True, 1), (True, 2), (True, 3), (False, 4), (False, 5), (False, 6), (True, 0)]


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("steps", [[0.0, 0.01, 0.03], [0.0], [0.2], [0.1], [0.04, 3.0]])
def test_throttle(spark, block_rows, steps):
    at = {}

    def value(i):
        at["t"] = 0.0 if i == 0 else at["t"] + RNG.choice(steps)
        return (at["t"], i)

    rows = tracks(value)
    df = spark.createDataFrame(rows, "runtime_id string, seq long, received_at double, arrival_seq long")
    got = {(r.runtime_id, r.seq) for r in live.throttle(df, block_rows=block_rows).collect()}
    want = set()
    for name, track in by_track(rows).items():
        last = float("-inf")
        for _, i, t, _ in track:
            if t >= last + (0.1 - 1e-9):
                want.add((name, i))
                last = t
    assert got == want


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_passes(spark, block_rows):
    at = {}

    def value(i):
        at["p"] = 0 if i == 0 else at["p"] + 512 + RNG.choice([0, 0, 0, 0, 3000, -9000, 1500])
        return RNG.random() < 0.8, None if RNG.random() < 0.3 else at["p"], at["p"] / 48000, 512

    rows = tracks(value)
    df = spark.createDataFrame(rows, "runtime_id string, seq long, playing boolean, position long, seconds double, size long")
    got = {(r.runtime_id, r.seq): r.epoch for r in live.passes(df, block_rows=block_rows).collect()}
    for name, track in by_track(rows).items():
        epoch, before = 0, None
        for _, i, playing, position, seconds, size in track:
            if playing and (before is None or not before[0]):
                epoch += 1
            elif playing:
                if position is not None and before[1] is not None:
                    off = abs(position - (before[1] + before[3])) > max(2048, 4 * size)
                else:
                    off = abs(seconds - (before[2] + before[3] / 48000)) > max(0.05, 4 * size / 48000)
                epoch += off
            before = (playing, position, seconds, size)
            assert got[(name, i)] == epoch


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_running(spark, block_rows):
    rows = tracks(lambda i: (None if RNG.random() < 0.6 else RNG.random(), float(i), i))
    df = spark.createDataFrame(rows, "runtime_id string, seq long, x double, received_at double, arrival_seq long")
    last = {(r.runtime_id, r.seq): r.x for r in live.carry_forward(df, "x", block_rows=block_rows).collect()}
    top = {(r.runtime_id, r.seq): r.x for r in live.running_max(df, "x", ["runtime_id"], block_rows=block_rows).collect()}
    for name, track in by_track(rows).items():
        known = most = None
        for _, i, x, *_ in track:
            known = known if x is None else x
            most = most if x is None else x if most is None else max(most, x)
            assert last[(name, i)] == known and top[(name, i)] == most


def test_one_track_is_many_tasks(spark):
    df = spark.range(4000).select(F.lit("a").alias("runtime_id"), F.col("id").alias("seq"), F.lit(-40.0).alias("level_db"), F.lit(0.1).alias("seconds"))
    dealt = folds.blocks(df, ["seq"], block_rows=500)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    empty = live.gate(df.where("seq < 0"))
    assert empty.count() == 0 and set(empty.columns) == {"runtime_id", "seq", "level_db", "seconds", "open", "silence"}
