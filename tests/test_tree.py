"""Ranges over a tree of partials, topology, feature groups and handshakes against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from meterlake.operators import compare, sessions, state, timeline
from meterlake.sources import frames as source

RNG = random.Random(61)


def test_range_nodes_cover_each_second_once(spark):
    asked = [(i, a, a + RNG.randrange(1, 300)) for i in range(60) for a in [RNG.randrange(-40, 400)]]
    rows = timeline.range_nodes(spark.createDataFrame(asked, "request int, start int, end int"), 5).collect()
    held = {}
    for r in rows:
        held.setdefault(r.request, []).extend(range(r.node << r.level, (r.node + 1) << r.level))
    for i, a, b in asked:
        assert sorted(held[i]) == list(range(a, b))
    assert max(sum(1 for r in rows if r.request == i and r.level < 5) for i, *_ in asked) <= 10


def test_ranges_of_the_tree_equal_those_of_bins(spark):
    p = timeline.accumulate(source.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))
    p = p.cache()
    nodes = timeline.tree(p, 6)
    asked = [(i, a, a + RNG.choice([0.5, 3, 17.25, 64, 150]), RNG.choice([None, 30.0])) for i in range(8) for a in [round(RNG.uniform(-5, 120), 2)]]
    got = timeline.resolve_ranges(nodes, spark.createDataFrame(asked, "request int, start double, end double, fence double"), levels=6).collect()
    names = [c for c in timeline.resolve_range(p, 0, 1).columns if c != "frame_count"]
    for i, a, b, fence in asked:
        want = {r.runtime_id: r for r in timeline.resolve_range(p, a, b, fence=fence).collect()}
        mine = {r.runtime_id: r for r in got if r.request == i}
        assert set(mine) == set(want)
        for t, r in mine.items():
            assert all(r[c] == want[t][c] or abs(r[c] - want[t][c]) < 1e-3 for c in names)
    p.unpersist()


def test_topology(spark):
    tracks = [("id-1", "Kick \"1\"", 3, "Drüms", 0), ("id-2", "Bass", None, None, None), ("id-3", "Pad", 1, "Pads\\x", 2)]
    schema = "runtime_id string, analyzer_name string, fl_track_index int, fl_track_name string, slot int"

    def plain(rows):
        named = [{"identity": f"mixer:{i}/slot:{s}" if i is not None else r, "runtime_id": r, "analyzer_name": a, "fl_track_index": i, "fl_track_name": n, "slot": s} for r, a, i, n, s in rows]
        text = json.dumps(sorted(named, key=lambda t: t["identity"]), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    assert compare.fingerprint(spark.createDataFrame(tracks, schema)).first()[0] == plain(tracks)
    moved = [*tracks[:2], ("id-3", "Pad", 1, "Pads\\x", 1)]
    states = lambda *sets: spark.createDataFrame([(f"s{k}", *t) for k, rows in enumerate(sets) for t in rows], f"session_id string, {schema}")
    got = {r.session_id: r.same_topology for r in sessions.topology(states(tracks, tracks, tracks, tracks), states(tracks[::-1], moved, tracks[:2])).collect()}
    assert got == {"s0": True, "s1": False, "s2": False, "s3": False}


def test_feature_groups(spark):
    rows = [(1, None, -3.0, None, None, 0.4, None, None), (0, None, None, None, -20.0, None, 0.1, None), (0, None, None, None, None, None, None, 0.5)]
    df = spark.createDataFrame(rows, "frame_count long, lufs_s double, true_peak_dbtp double, centroid_hz double, region_sub double, stereo_width double, spectral_flux_mean double, chroma_0 double")
    assert [r[0] for r in df.select(sessions.features(df.columns)).collect()] == [["core", "loudness", "stereo"], ["spectrum", "temporal"] if "region_sub" in sessions.FEATURES["spectrum"] else ["temporal"], ["semantic"]]


def test_handshake_by_plain_python(spark):
    heard = [(RNG.choice("abc"), round(RNG.uniform(0, 300), 1)) for _ in range(150)]
    asked = [(RNG.randrange(12), round(RNG.uniform(0, 300), 1)) for _ in range(150)]
    used, slots = set(), {}
    for at, slot in sorted((at, slot) for slot, at in asked):
        seen = [(t, n) for n, t in heard if t <= at and at - t <= 5]
        if seen and max(seen) not in used:
            used.add(max(seen))
            slots[slot] = (max(seen)[1], at)
    got = state.handshake(spark.createDataFrame(heard, "runtime_id string, heard_at double"), spark.createDataFrame(asked, "slot int, at double"), 5.0)
    assert {r.slot: (r.runtime_id, r.bound_at) for r in got.collect()} == slots
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and got.select(F.count("*")).first()[0] == len(slots)
