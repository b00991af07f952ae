"""What grows with the input stays in Spark's partitions: nothing of frames' size through the driver, windows over levels, or Python at once."""

from pyspark.sql import functions as F

from meterlake.operators import dsp, folds, pairs
from meterlake.plans import tools

EDGES = [(20.0, 200.0), (200.0, 20000.0)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_aligned_pairs_meet_frames_without_broadcast(spark):
    """Spark estimates frames' arrays and compressed files too low and would broadcast them, however many they are."""
    aligned = spark.createDataFrame([("a", "b", 1, 2, 0.0)], pairs.ALIGNED)
    side = spark.createDataFrame([(1, [1.0] * 32), (2, [2.0] * 32)], "arrival_seq long, levels array<double>")
    met = pairs._joined(aligned, side)
    assert "Broadcast" not in plan(met)
    assert [(r.a_seq, r.levels_a[0], r.levels_b[0]) for r in met.collect()] == [(1, 1.0, 2.0)]


def test_fold_reads_its_columns_only(spark):
    """Other columns, also structs, pass through as Arrow; a machine gets what it reads, and a block's result comes in small batches."""
    rows = spark.range(3000).select(F.lit("a").alias("runtime_id"), F.struct(F.col("id").cast("double").alias("t"), "id").alias("seq"), F.lit(-40.0).alias("level_db"), F.lit(0.1).alias("seconds"), F.lit("x").alias("other"))
    gate = folds.gate()

    def only(part, state):
        assert list(part.columns) == ["level_db", "seconds"]
        return gate.emit(part, state)

    out = folds.fold(rows, ["seq"], gate._replace(emit=only), block_rows=1000)
    assert "MapInPandas" not in plan(out) and out.columns == [*rows.columns, "open", "silence"]
    got = out.collect()
    assert len(got) == 3000 and all(r.open and r.other == "x" and r.seq.t == r.seq.id for r in got)


def test_passes_read_their_columns_only(spark):
    """Positions may be missing; the order's struct and other columns stay in Arrow."""
    rows = spark.range(3000).select(F.lit("a").alias("runtime_id"), F.struct("id").alias("seq"), F.lit(True).alias("playing"), F.when(F.col("id") % 3 > 0, F.col("id") * 512).alias("position"), (F.col("id") * 512 / 48000).alias("seconds"), F.lit(512).alias("size"))
    passes = folds.passes()

    def only(part, state):
        assert list(part.columns) == ["playing", "position", "seconds", "size"]
        return passes.emit(part, state)

    got = folds.fold(rows, ["seq"], passes._replace(emit=only), block_rows=700).collect()
    assert len(got) == 3000 and {r.epoch for r in got} == {1}


def hops_of(spark, n):
    import numpy as np

    rng = np.random.default_rng(5)
    return spark.createDataFrame([("a", i, 48000.0, *rng.normal(size=(2, dsp.SIZE)).tolist()) for i in range(n)], "runtime_id string, hop_index long, sample_rate double, left array<double>, right array<double>").coalesce(1)


def test_audio_measures_what_is_asked_in_small_batches(spark):
    """As when all is measured; 65 windows are 4 MB, and no call gets more than ``ROWS_AT_ONCE``."""
    audio = hops_of(spark, 70)
    low = dsp.analyse(audio, ("low_band_energy_db",))
    assert low.columns == ["runtime_id", "hop_index", "low_band_energy_db"] and int(spark.conf.get(dsp.BATCH_BYTES).rstrip("bB")) <= 4 << 20
    assert {r.hop_index: r[2] for r in low.collect()} == {r.hop_index: r[2] for r in dsp.analyse(audio).select(*low.columns).collect()}


def test_chroma_alone_is_that_of_all(spark):
    audio = hops_of(spark, 5)
    got = dsp.analyse(audio, ("chroma",))
    assert got.columns == ["runtime_id", "hop_index", "chroma"]
    assert [r.chroma for r in got.collect()] == [r.chroma for r in dsp.analyse(audio).collect()]


def test_spectrum_alone_is_that_of_all(spark):
    names = ["centroid_hz", "rolloff_hz", "flatness"]
    audio = hops_of(spark, 5)
    got = dsp.analyse(audio, names)
    assert got.columns == ["runtime_id", "hop_index", *names] and got.collect() == dsp.analyse(audio).select(*got.columns).collect()


def test_evidence_attaches_spectra_once(spark):
    """What is planned on rereads what was cut; no step scans the events or their spectra again."""
    scan = tools.QUERIES["t21_masking_scan"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in plan(scan).lower()


def test_regions_move_no_levels(spark):
    """Sides are set against their maxima by a join with these few, not by a window that shuffles and sorts every level."""
    met = spark.createDataFrame([("a", "b", True, True, [0.0, None], [-10.0, 1.0]), ("a", "b", True, False, [-10.0, 2.0], [0.0, 3.0])], "a string, b string, on_a boolean, on_b boolean, levels_a array<double>, levels_b array<double>")
    got = pairs._of_regions(met)
    assert "Window" not in plan(got)
    assert {(r.region, r.usable_pairs, round(r.temporal, 9), r.coactive_ratio) for r in got.collect()} == {(0, 2, 0.1, 0.5), (1, 1, 1.0, 0.5)}
