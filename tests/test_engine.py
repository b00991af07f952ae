"""Golden numbers and properties of the telemetry operators."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.functions import dims
from meterlake.functions import expr as X
from meterlake.operators import compare, dsp, dynamics, pairs, recent, relations, sessions, state, structure, timeline
from meterlake.sources import frames as source
from meterlake.streaming import live

PARTIAL = "runtime_id string, transport_epoch int, bin_index int, frame_count long, active_count long, coverage_mask int, first_received_at double, last_received_at double, rms_db_power_sum double, rms_db_count long, lufs_s_power_sum double, lufs_s_count long, peak_db_max double, true_peak_dbtp_max double, crest_sum double, crest_count long, centroid_sum double, centroid_count long, stereo_corr_sum double, stereo_corr_count long, stereo_width_sum double, stereo_width_count long, flux_sum double, flux_count long, lag_sum double, lag_count long, lag_max double, dropped_blocks_max long, last_arrival_seq long"


def bins(spark, rows):
    """(track, epoch, bin, slots, rms, received) rows as timeline partials."""
    out = [(t, e, b, s, s, (1 << s) - 1, r, r, 10 ** (rms / 10) * s, s, 0.0, 0, rms, rms, 4.0 * s, s, 0.0, 0, 0.0, 0, 0.0, 0, 0.0, 0, 0.0, 0, None, 0, 1) for t, e, b, s, rms, r in rows]
    return spark.createDataFrame(out, PARTIAL)


def test_weighted_percentiles_golden(spark):
    rows = spark.createDataFrame([(-30.0, 1.0), (-20.0, 1.0), (-10.0, 0.5)], "v double, w double").withColumn("g", F.lit(1))
    got = {r.q: r.x for r in dynamics.weighted_percentiles(rows, ["g"], "v", "w").collect()}
    assert got[0.5] == pytest.approx(-22.5) and got[0.9] == pytest.approx(-10.0)
    xs = [got[q] for q in sorted(got)]
    assert xs == sorted(xs)


def test_range_prefers_coverage_and_respects_the_fence(spark):
    p = bins(spark, [("a", 3, b, 10, -18.0, 5.0) for b in (2, 3, 4)] + [("a", 4, b, 2, -17.0, 9.0) for b in (2, 3, 4)])
    row = timeline.resolve_range(p, 2.25, 4.2).first()
    assert (row.transport_epoch, row.coverage_ratio, row.adequate) == (3, 1.0, True)
    assert timeline.resolve_range(p, 2.25, 4.2, fence=5.0).first().transport_epoch == 4
    assert timeline.resolve_range(p, 2.25, 4.2, fence=9.0).count() == 0


def test_range_verification(spark):
    before = timeline.resolve_range(bins(spark, [("a", 3, b, 10, -18.0, 5.0) for b in (2, 3, 4)]), 2, 5)
    after = timeline.resolve_range(bins(spark, [("a", 11, b, 10, -16.0, 20.0) for b in (2, 3, 4)]), 2, 5)
    row = compare.verify_range(before, after).first()
    assert row.controlled and row.rms_delta == pytest.approx(2.0)
    assert not compare.verify_range(before, before).first().controlled


def test_sparse_coverage(spark):
    p = bins(spark, [("a", 1, 0, 2, -20.0, 1.0), ("a", 1, 4, 2, -20.0, 1.0)])
    row = timeline.finalize(p, timeline.KEY, F.lit(5.0)).first()
    assert (row.covered_seconds, row.coverage_ratio) == (0.4, 0.08)


def test_mono_fold(spark):
    def fold(mid, side):
        m, s = (spark.createDataFrame([("a", 0, x)], "runtime_id string, band int, zero_db double") for x in (mid, side))
        return recent.mono_fold(m, s).first()

    assert fold(-18.0, -120.0).delta_db == 0
    assert fold(-6.0206, -6.0206).delta_db == pytest.approx(-3.0103, abs=1e-4)
    anti = fold(-120.0, -9.0)
    assert anti.floor_censored and anti.delta_db == pytest.approx(-111.0, abs=1e-3)


def test_reference_gain_cancels(spark):
    def side(bands, rms):
        return spark.createDataFrame([(i, x) for i, x in enumerate(bands)], "band int, plain_db double"), spark.createDataFrame([(rms,)], "rms_db double")

    (r, rr), (t, tr) = side([-30.0, -24.0, -28.0], -20.0), side([-24.0, -18.0, -22.0], -14.0)
    rows = compare.compare_reference(r, t, rr, tr).orderBy("band").collect()
    assert [x.absolute_db for x in rows] == [6.0] * 3 and [x.normalised_db for x in rows] == [0.0] * 3
    shaped, level = side([-24.0, -16.0, -24.0], -14.0)
    assert [x.normalised_db for x in compare.compare_reference(r, shaped, rr, level).orderBy("band").collect()] == [0.0, 2.0, -2.0]
    unknown = spark.createDataFrame([(None,)], "rms_db double")
    assert compare.compare_reference(r, t, unknown, tr).first().normalised_db is None


def two_pointer(a, b, tol):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        d = a[i][0] - b[j][0]
        if abs(d) <= tol:
            out.append((a[i][1], b[j][1]))
            i, j = i + 1, j + 1
        elif d < 0:
            i += 1
        else:
            j += 1
    return out


def test_alignment_equals_two_pointers(spark):
    rng = random.Random(3)
    for n in (5, 60):
        sides = [sorted((round(rng.uniform(0, n / 8), 2), 1000 * k + i) for i in range(n)) for k in (1, 2)]
        rows = [(name, t, s) for name, side in zip("ab", sides, strict=True) for t, s in side]
        f = spark.createDataFrame(rows, "runtime_id string, received_at double, arrival_seq long")
        got = pairs.align(f, spark.createDataFrame([("a", "b")], "a string, b string"), 0.0801).select("a_seq", "b_seq").collect()
        want = two_pointer(*[sorted(s) for s in sides], 0.0801)
        assert sorted(map(tuple, got)) == sorted(want)


def test_partials_merge_in_any_split(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    f = source.from_events(events)
    whole = timeline.finalize(timeline.accumulate(f), timeline.KEY)
    parts = timeline.accumulate(f.where("arrival_seq % 2 = 0")).unionByName(timeline.accumulate(f.where("arrival_seq % 2 = 1")))
    cols = ["runtime_id", "transport_epoch", "frame_count", "rms_db", "crest_db", "peak_db"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, timeline.finalize(parts, timeline.KEY).select(cols).collect()))


def test_wire_layers_and_masks(spark):
    args = ["Drums", "48000", "1.5", "-14", "-24", "10", "700", "6000", "0.15", "0.75", "0.25", *["-30"] * 32]
    full = [*args, "-18", "-14", "-1", "-0.5", *["0.85"] * 8, "1", "-14", "0", "id-1", "0.1", "0.12", "0.08", "1", "-28", "0.6"]
    full += ["-25", "-34", "-9", "2.0", "0.92", "-15", *["-42"] * 32, *["-10"] * 8, "0.8", *["1"] * 12, "0.72", "0.58", "130.81", "0.9", "0", "1", "0.2", "0.01", "46.8", "5", "1.1"]
    full += ["1", "2.5", "5", "120", "4", "4", "1", "0", "0", "0", "0", "7", "42", "0", "1.2"]
    raw = spark.createDataFrame([(args[:20], 1.0, 1), (args, 1.0, 2), (full, 1.0, 3)], "args array<string>, received_at double, arrival_seq long")
    rows = {r.arrival_seq: r for r in source.parse_wire(raw).collect()}
    assert set(rows) == {2, 3}
    assert rows[2].runtime_id == "legacy:drums" and rows[2].signal_present and rows[2].lufs_s is None
    eco = rows[3]
    assert (eco.transport_epoch, eco.transport_time_seconds, eco.rms_db) == (7, 2.5, -24.0)
    assert eco.chroma is None and eco.centroid_hz is None and eco.stereo_width is None and not eco.spectrum_valid


def test_recent_band_rules_and_nulls(spark):
    f = spark.createDataFrame([("a", True, [-120.0, -20.0]), ("a", True, [-20.0, -20.0]), ("a", False, [0.0, 0.0])], "runtime_id string, signal_present boolean, bands_db array<double>")
    rows = {r.band: r for r in recent.band_means(f).collect()}
    assert rows[0].above_db == -20.0 and rows[0].zero_db == pytest.approx(-23.0103, abs=1e-3) and rows[1].plain_db == -20.0


def test_scalar_goldens(spark):
    one = spark.range(1)
    got = one.select(X.pitch_class(F.lit(440.0)).alias("a"), X.family_label(F.lit(27)).alias("b"), X.fnv1a(F.lit("a")).alias("c"), X.correlation_label(F.lit(-0.3)).alias("d"), X.slot(F.lit(3.97)).alias("s")).first()
    assert (got.a, got.b, got.c, got.d, got.s) == (9, "AB", 0xE40C292C, "strong_negative", 9)
    assert [dims.nearest_resolution(x) for x in (3, 20, 100)] == [2, 15, 30]
    assert dims.band_label(1000, 2000) == "1.0-2.0 kHz" and dims.band_label(20, 60) == "20-60 Hz"


def test_structure_finds_the_changes(spark):
    rows = [("a", 1, b, 10, -10.0 if (b // 24) % 2 else -28.0, 1.0) for b in range(72)]
    pts = structure.points(bins(spark, rows))
    found = structure.boundaries(structure.peaks(structure.smooth(structure.novelty(pts))), pts)
    at = sorted(r.bin_index for r in found.collect())
    assert len(at) == 2 and abs(at[0] - 24) <= 2 and abs(at[1] - 48) <= 2
    secs = structure.sections(found, pts)
    fam = {r.ord: r.family for r in structure.families(secs, structure.section_similarity(structure.summaries(secs, bins(spark, rows)))).collect()}
    assert fam[1] == fam[3] != fam[2]


def test_bindings_keep_the_last_per_slot(spark):
    rows = [("x", 1, "Kick", 0, 1), ("y", 1, "Kick", 0, 2), ("x", 2, "Bass", 0, 3), ("z", 2, "Bass", 0, 4)]
    got = source.latest_binding(spark.createDataFrame(rows, "runtime_id string, fl_track_index int, fl_track_name string, slot int, seq long"))
    assert {(r.runtime_id, r.fl_track_index) for r in got.collect()} == {("y", 1), ("z", 2)}
    live_rows = spark.createDataFrame([("id-1", "Kick"), ("id-2", "kick")], "runtime_id string, track string")
    sel = spark.createDataFrame([("id-1",), ("KICK",), ("id-",)], "selector string")
    got = {r.selector: (r.runtime_id, r.matches) for r in state.resolve(sel, live_rows, source.bindings(spark)).collect()}
    assert got == {"id-1": ("id-1", 1), "KICK": (None, 2), "id-": (None, 2)}


def test_timeline_stream_equals_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tempfile.mkdtemp(prefix="spark-")
    events.repartition(3).write.parquet(f"{folder}/in")
    stream = live.timeline_stream(live.read_events(spark, f"{folder}/in", events._jdf.schema().toDDL()))
    q = live.start_memory(stream, "timeline_live", f"{folder}/state", "complete")
    q.processAllAvailable()
    q.stop()
    cols = ["runtime_id", "transport_epoch", "bin_index", "frame_count", "coverage_mask"]
    batch = timeline.accumulate(source.from_events(events)).select(cols)
    assert sorted(map(tuple, spark.table("timeline_live").select(cols).collect())) == sorted(map(tuple, batch.collect()))


def test_gate_stream_equals_batch_and_throttle(spark):
    rng = random.Random(5)
    rows = [(t, i, rng.choice([-60.0, -49.0, -30.0]), 0.1) for t in "ab" for i in range(200)]
    hops = spark.createDataFrame(rows, "runtime_id string, seq long, level_db double, seconds double")
    batch = {(r.runtime_id, r.seq): r.open for r in live.gate(hops).collect()}
    for t in "ab":
        s = (False, 0)
        for name, i, level, sec in rows:
            if name == t:
                s = live.gate_step(level, round(sec * 1e9), *s)
                assert batch[(t, i)] == s[0]
    folder = tempfile.mkdtemp(prefix="spark-")
    for part in range(2):
        hops.where(f"seq >= {part * 100} and seq < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(hops.schema).parquet(f"{folder}/in")
    q = live.start_memory(live.gate_stream(stream), "gate_live", f"{folder}/state", "append")
    q.processAllAvailable()
    q.stop()
    assert {(r.runtime_id, r.seq): r.open for r in spark.table("gate_live").collect()} == batch
    f = spark.createDataFrame([("a", x / 100) for x in range(0, 100, 3)], "runtime_id string, received_at double")
    kept = sorted(r.received_at for r in live.throttle(f).collect())
    assert kept[0] == 0 and all(b - a >= 0.1 - 1e-9 for a, b in zip(kept[:-1], kept[1:], strict=True)) and len(kept) == 9


def test_passes(spark):
    rows = [("a", i, p, pos, pos / 48000, 512) for i, (p, pos) in enumerate([(False, 0), (True, 0), (True, 512), (True, 1024), (True, 90000), (False, 90512), (True, 90512)])]
    got = live.passes(spark.createDataFrame(rows, "runtime_id string, seq long, playing boolean, position long, seconds double, size long")).orderBy("seq").collect()
    assert [r.epoch for r in got] == [0, 1, 1, 1, 2, 2, 3]


def test_audio_measures(spark):
    t = np.arange(dsp.SIZE) / 48000
    sine = 0.5 * np.sin(2 * np.pi * 440 * t)
    rows = [("same", 0, 48000.0, sine.tolist(), sine.tolist()), ("anti", 0, 48000.0, sine.tolist(), (-sine).tolist()), ("left", 0, 48000.0, sine.tolist(), (0 * sine).tolist())]
    got = {r.runtime_id: r for r in dsp.analyse(spark.createDataFrame(rows, "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>")).collect()}
    assert got["same"].rms_db == pytest.approx(20 * math.log10(0.5 / math.sqrt(2)), abs=0.05)
    assert got["same"].stereo_correlation == pytest.approx(1) and got["anti"].stereo_correlation == pytest.approx(-1)
    assert max(range(12), key=lambda i: got["same"].chroma[i]) == 9 and abs(got["same"].centroid_hz - 440) < 40
    assert got["anti"].mid_rms_db == -120 and got["left"].mid_rms_db == pytest.approx(got["left"].side_rms_db)
    hops = spark.createDataFrame([("a", i, [0.0] * 1024, [0.0] * 1024) for i in range(6)], "runtime_id string, hop_index long, left array<double>, right array<double>")
    assert sorted(r.hop_index for r in dsp.windows(hops).collect()) == [3, 4, 5]


def test_every_query_runs_and_matches_names():
    import __spark_entry__ as entry

    names, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(names) and len(names) > 60


def test_loudness_pitch_and_true_peak(spark):
    # A full-scale 997 Hz sine in one channel reads -3.01 LUFS.
    t = np.arange(48000 * 4) / 48000
    x = np.sin(2 * np.pi * 997 * t)
    hops = [("a", i, 48000.0, x[i * 1024 : (i + 1) * 1024].tolist(), [0.0] * 1024) for i in range(len(x) // 1024)]
    energy = dsp.hop_energy(spark.createDataFrame(hops, "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>"))
    assert dsp.integrated(energy).first().lufs_i == pytest.approx(-3.01, abs=0.05)
    assert dsp.short_term(energy).orderBy(F.desc("hop_index")).first().lufs_s == pytest.approx(-3.01, abs=0.05)
    w = np.arange(dsp.SIZE) / 48000
    tone = sum(np.sin(2 * np.pi * 220 * h * w) / h for h in range(1, 6))[None] * 0.3
    hz, share = dsp.fundamental(tone, tone, 48000.0)
    assert abs(hz[0] - 220) <= 12 and share[0] > 0.3
    quarter = np.sin(2 * np.pi * 12000 * w + np.pi / 4)[None]
    assert np.abs(quarter).max() < 0.71 and dsp.true_peak_db(quarter, quarter)[0] == pytest.approx(0, abs=0.1)
    assert np.isnan(dsp.fundamental(tone * 0, tone * 0, 48000.0)[0][0])


def test_udp_messages():
    import socket

    from meterlake.sources import udp

    reader = udp.UdpReader({"port": "19855"})
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for data in (udp.encode_osc("/frame", ["Drums", 1.5, 7]), b"junk\0\0\0\0", udp.encode_osc("/identify", ["x"])):
        out.sendto(data, ("127.0.0.1", 19855))
    rows, end = reader.read({"seq": 0})
    rows = list(rows)
    assert [r[:2] for r in rows] == [("/frame", ["Drums", "1.5", "7"]), ("/identify", ["x"])] and end == {"seq": 2}
    assert list(reader.readBetweenOffsets({"seq": 0}, {"seq": 1})) == rows[:1]
    reader.commit(end)
    assert not reader.kept
    with pytest.raises(ValueError):
        udp.port_of({"port": "70000"})


def test_guides(spark, tmp_path):
    from meterlake.sources import guides

    (tmp_path / "index.md").write_text("# Index\ntext")
    row = guides.guides(spark, str(tmp_path)).first()
    assert (row.uri, row.text) == ("guide://index", "# Index\ntext")
    with pytest.raises(ValueError):
        guides.guide_path("/g", "../secret.md")


def test_scalar_goldens(spark):
    waits = [(1024, 48000.0, 0), (1023, 48000.0, 1), (512, 48000.0, 11), (0, 48000.0, 20), (0, 192000.0, 6), (0, 0.0, 20)]
    df = spark.createDataFrame([(a, 1024, r, w) for a, r, w in waits], "available int, hop int, rate double, want int")
    assert all(r.got == r.want for r in df.select("want", X.idle_wait_ms("available", "hop", "rate").alias("got")).collect())
    due = [(4799, 48000.0, 99.9, False), (4800, 48000.0, 5.0, True), (1024, 48000.0, 100.0, True), (4410, 44100.0, 0.0, True), (1, 0.0, 0.0, True)]
    df = spark.createDataFrame(due, "n long, rate double, ms double, want boolean")
    assert all(r.got == r.want for r in df.select("want", X.loudness_due("n", "rate", "ms").alias("got")).collect())
    df = spark.createDataFrame([(19.9, None), (20.0, 0), (119.9, 1), (120.0, 2), (20000.0, 7), (20000.1, None)], "hz double, want int")
    assert all(r.got == r.want for r in df.select("want", X.stereo_band("hz").alias("got")).collect())
    df = spark.createDataFrame([(10.0, 20.0, 120.0, 480, 0, 48000.0, True), (10.0, 20.0, 120.0, 480, 0, 48000.0, False)], "t double, ppq double, bpm double, block long, queued long, rate double, playing boolean")
    on, off = (r.e for r in df.select(X.transport_estimate("t", "ppq", "bpm", "block", "queued", "rate", "playing").alias("e")).collect())
    assert on.transport_time_seconds == pytest.approx(10 + (480 - 2048) / 48000) and on.transport_ppq_position == pytest.approx(20 + 2 * (480 - 2048) / 48000) and off.transport_time_seconds == 10.0


def test_stereo_spectra_and_hops(spark):
    import numpy as np

    t = np.arange(4096) / 48000
    tone = np.sin(2 * np.pi * 100 * t)[None]
    same, apart = dsp.measure(tone, tone, 48000.0), dsp.measure(tone, -tone, 48000.0)
    assert same["low_band_20_120_correlation"][0] == pytest.approx(1) and apart["low_band_20_120_correlation"][0] == pytest.approx(-1)
    assert same["negative_cross_energy_ratio"][0] == 0 and apart["negative_cross_energy_ratio"][0] == pytest.approx(1)
    assert same["band_stereo_correlation"][0][1] == pytest.approx(1) and same["band_side_to_mid_db"][0][1] < -60 and apart["band_side_to_mid_db"][0][1] > 60
    assert same["low_band_energy_db"][0] > -20 > same["bands_db"][0][-1]
    assert same["harmonic_f0_candidate_hz"].shape == (1,) and abs(same["true_peak_dbtp"][0]) < 0.3
    hops = spark.createDataFrame([("a", 0, [0.5, -1.0], [0.1, 0.2]), ("a", 1, [0.0, 0.0], [0.0, 0.0])], "runtime_id string, hop_index long, left array<double>, right array<double>")
    assert [r.detector_peak_db for r in dsp.detector_peak(hops).sort("hop_index").collect()] == [0.0, -120.0]
    changes = spark.createDataFrame([("a", i, float(i), 1.0) for i in range(8)], "runtime_id string, hop_index long, flux double, rise_db double")
    assert [(r.spectral_flux_peak, r.samples) for r in dsp.emissions(changes, 4).sort("emission").collect()] == [(3.0, 4096), (7.0, 4096)]


def test_sessions_block_and_complete_once(spark):
    state = spark.createDataFrame([("a", -10.0, 0.5), ("b", -12.0, 0.0)], "runtime_id string, rms_db double, active_ratio double")
    requests = spark.createDataFrame([("s1", "one", 1.0, ["a"]), ("s2", "two", 2.0, ["b"]), ("s3", "three", 3.0, ["gone"]), ("s4", "all", 4.0, [])], "session_id string, label string, created_at double, targets array<string>")
    before = requests.select("session_id").crossJoin(state)
    begun = sessions.begin(requests, before, F.col("active_ratio") > 0)
    got = {r.session_id: r for r in begun.collect()}
    assert [got[k].ready for k in ("s1", "s2", "s3", "s4")] == [True, False, False, False]
    assert got["s2"].blockers == ["invalid:b"] and got["s3"].blockers == ["missing:gone"] and got["s4"].targets == ["a", "b"]
    after = before.withColumn("rms_db", F.col("rms_db") + 2)
    columns = ["crest_db", "centroid_hz", "stereo_correlation", "lufs_s"]
    wide = lambda df: df.withColumns({c: F.lit(None).cast("double") for c in columns} | {"frame_count": F.lit(3), "true_peak_dbtp": F.lit(-1.0)})
    targets = sessions.compare_targets(begun, wide(before), wide(after), {}, ["rms_db"])
    rows = {(r.session_id, r.runtime_id): r for r in targets.collect()}
    assert rows["s1", "a"].controlled and rows["s1", "a"].rms_db_delta == 2.0 and rows["s1", "a"].comparable == ["core", "loudness"]
    assert rows["s3", "gone"].failed == ["not_ready", "missing_before", "missing_after"] or "missing_before" in rows["s3", "gone"].failed
    said = spark.createDataFrame([("s1", "-2 dB"), ("s2", " ")], "session_id string, readback string")
    done = sessions.complete(begun, targets, said, F.lit(9.0))
    again = {r.session_id: r for r in sessions.complete(done, targets.limit(0), said.limit(0), F.lit(10.0)).collect()}
    assert again["s1"].closed_loop and not again["s2"].controlled and {r.completed_at for r in again.values()} == {9.0}
    assert [r.session_id for r in sessions.status(done, 2).sort("rank").collect()] == ["s4", "s3"]


def test_scopes_and_handshake(spark):
    assert dynamics.scope(2.25, 4.2) == (2, 5) and dynamics.scope(section=(3, 9)) == (3, 9) and dynamics.scope(span=(0, 7)) == (0, 7)
    for bad in ({"start": 1.0}, {"start": 1.0, "end": 2.0, "section": (0, 1)}, {"start": 2.0, "end": 1.0}, {}):
        with pytest.raises(ValueError):
            dynamics.scope(**bad)
    heard = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("b", 6.0)], "runtime_id string, heard_at double")
    asked = spark.createDataFrame([(1, 2.0), (1, 5.5), (2, 5.7), (3, 40.0)], "slot int, at double")
    assert {r.slot: r.runtime_id for r in state.handshake(heard, asked).collect()} == {1: "b"}


def test_similar_sections_from_either_side(spark):
    df = spark.createDataFrame([("a", 1, 1, 2, 0.9), ("a", 1, 1, 3, 0.5), ("a", 1, 2, 3, None)], "runtime_id string, transport_epoch int, ord_a int, ord_b int, score double")
    got = {(r.ord, r.rank): r.other for r in relations.similar_sections(df, ["runtime_id", "transport_epoch"]).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (3, 1): 1}


def test_last_identified_binding_looks_back_no_further_than_its_age(spark):
    seen = spark.createDataFrame([("rt-a", 1.0), ("rt-b", 1.0), ("rt-c", 4.9), ("rt-d", 20.0)], "runtime_id string, at double")
    asks = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 5.2), (4, 9.9), (5, 9.91), (6, 20.0)], "request long, at double")
    got = {r["request"]: r["runtime_id"] for r in state.bind_last_identified(asks, seen, 5.0).collect()}
    assert got == {1: None, 2: "rt-b", 3: "rt-c", 4: "rt-c", 5: None, 6: "rt-d"}
    assert state.bind_last_identified(asks.limit(0), seen).count() == 0
    assert state.bind_last_identified(asks, seen.limit(0)).where("runtime_id is not null").count() == 0


def test_section_range_names_what_is_missing(spark):
    maps = spark.createDataFrame([("old", 1, "S01", 0, 24, "A"), ("new", 2, "S01", 0, 30, "B")], "map_id string, made int, section string, start int, end int, family string")
    asks = spark.createDataFrame([(1, None, " s01 "), (2, "old", "S01"), (3, "old", "S09"), (4, "none", "S01")], "request int, map_id string, section string")
    got = {r["request"]: (r["end"], r["family"], r["reason"]) for r in structure.section_range(asks, maps).collect()}
    assert got == {1: (30, "B", None), 2: (24, "A", None), 3: (None, None, "no_section"), 4: (None, None, "no_map")}
