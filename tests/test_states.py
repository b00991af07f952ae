"""What frames show, warnings of the song, and whole states of tracks."""

from pyspark.sql import functions as F

from meterlake.operators import recent, state
from meterlake.sources import frames as source


def test_public_frames(spark):
    rows = [(1.0, 2.0, [3.0], 4.0, -20.0, 0.0, True, True, True), (1.0, 2.0, [3.0], 4.0, -20.0, 2.99, False, True, True), (1.0, 2.0, [3.0], 4.0, -20.0, 3.0, True, False, True), (1.0, 2.0, [3.0], 4.0, -20.0, None, None, None, False), (1.0, 2.0, [3.0], 4.0, None, 9.0, None, None, None)]
    df = spark.createDataFrame(rows, "centroid_hz double, rolloff_hz double, bands_db array<double>, stereo_width double, lufs_s double, silence_seconds double, spectrum_valid boolean, stereo_valid boolean, signal_present boolean")
    got = [(r.centroid_hz is None, r.bands_db is None, r.stereo_width is None, r.lufs_s) for r in state.public_frame(df).collect()]
    assert got == [(False, False, False, -20.0), (True, True, False, -20.0), (False, False, True, None), (True, True, True, -20.0), (False, False, False, None)]


def test_song_warnings(spark):
    schema = "runtime_id string, transport_v12_supported boolean, transport_epoch int, estimated_analysis_lag_ms double, dropped_blocks long"
    status = lambda *rows: state.song_status(spark.createDataFrame(list(rows), schema)).first()
    assert status(("a", True, 1, 10.0, 0), ("b", True, 1, 249.9, 0)).warnings == []
    assert status(("a", True, 1, 10.0, 0), ("b", False, 2, 900.0, 7)).warnings == ["transport_unsupported"]
    assert status(("a", True, 1, 250.0, 1), ("b", True, 2, None, None), ("c", None, None, None, None)).warnings == ["transport_unsupported", "epochs_differ", "lag_250_ms", "dropped_blocks"]
    assert status()[:] == (0, 0, [])


def test_song_overview(spark):
    schema = "runtime_id string, transport_epoch int, start_seconds int, end_seconds int, coverage_ratio double, max_lag_ms double"
    overview = lambda *rows: state.song_overview(spark.createDataFrame(list(rows), schema)).collect()
    got = overview(("a", 1, 0, 50, 0.1, 900.0), ("a", 2, 5, 60, 0.95, 1.0), ("b", 2, 7, 61, 0.9, None))
    assert [tuple(r) for r in got] == [(2, 5, 61, [], [])]
    got = overview(("a", 1, 0, 50, 0.89, 1.0), ("b", 2, 7, 61, None, 251.0))
    assert [tuple(r) for r in got] == [(2, 0, 61, ["epochs_differ", "lag_250_ms", "partial_coverage"], ["a", "b"])]
    assert overview() == []


def test_project_state(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    f = source.attach_bands(source.from_events(events), spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    got = {r.runtime_id: r for r in recent.project_state(f, source.bindings(spark)).collect()}
    means = {(r.runtime_id, r.band): r.plain_db for r in recent.band_means(f).collect()}
    shape = {r.runtime_id: r.rolloff_hz for r in recent.spectral_shape(f).collect()}
    for t, r in got.items():
        assert r.bands_db == [means.get((t, i)) for i in range(32)] and r.rolloff_hz == shape[t]
        assert r.identity == (t if r.slot is None else f"mixer:{r.fl_track_index}/slot:{r.slot}") and r.analysis_valid == (r.active_frames > 0)
    silent = recent.project_state(f.withColumn("signal_present", F.lit(False)), source.bindings(spark)).collect()
    assert len(silent) == len(got) and all(not r.analysis_valid and r.bands_db is None for r in silent)
