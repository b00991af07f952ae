"""Cached maps: built once, found by inputs and parameters, and read without the events."""

import tempfile
import threading

import pytest

from meterlake.operators import relations, structure
from meterlake.plans import song, tools
from meterlake.sources.cache import TableCache


def test_entries(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.range(5).write.parquet(f"{folder}/in")
    cache = TableCache(spark, f"{folder}/cache", keep=2)
    made = []

    def make(n):
        def run():
            made.append(n)
            return {"t": spark.range(n).toDF("x")}

        return run

    assert cache.find() is None and cache.find("nothing") is None
    one, t = cache.build([f"{folder}/in"], {"n": 1}, make(1))
    assert cache.build([f"{folder}/in"], {"n": 1}, make(1))[0] == one and made == [1] and t.read("t").count() == 1
    two, _ = cache.build([f"{folder}/in"], {"n": 2}, make(2))
    assert cache.find().read("t").count() == 2 and cache.find(one).read("t").count() == 1 and one != two
    spark.range(1).write.mode("append").parquet(f"{folder}/in")
    three, _ = cache.build([f"{folder}/in"], {"n": 1}, make(3))
    assert three != one and cache.keys() == [two, three] and cache.find(one) is None and cache.find().read("t").count() == 3
    # Built at once: one entry, whose tables count for all.
    threads = [threading.Thread(target=cache.build, args=([f"{folder}/in"], {"n": 9}, make(9))) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(cache.keys()) == 2 and cache.find().version() == 1 and cache.find().read("t").count() == 9


def test_map_is_built_once(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    key, tables = song.section_map(spark, sf)
    row = lambda df: sorted(map(str, df.collect()))
    # What the map holds is what its parts come to one by one.
    p = tools.partials(spark, sf, True, True)
    secs = tables.read("sections")
    assert row(structure.sections(tables.read("boundaries"), structure.points(p)).select(secs.columns)) == row(secs)
    assert row(relations.select_passes(p, 0, 180).select(*tables.read("passes").columns)) == row(tables.read("passes"))
    assert {r.section for r in tables.read("tracks").select("section").collect()} <= {r.section for r in tables.read("song").collect()}

    def closed(*_, **__):
        raise AssertionError("the events were read")

    monkeypatch.setattr(song, "partials", closed)
    monkeypatch.setattr(tools, "frames", closed)
    assert song.section_map(spark, sf)[0] == key
    for name in ("c07_boundaries", "c08_families", "j12_similar_sections", "t33_section_map", "k08_map_profile", "k08_map_story", "k08_map_relationships"):
        tools.QUERIES[name](spark, sf).collect()
    assert tools.QUERIES["k08_map_profile"](spark, sf).count() > 0
    with pytest.raises(AssertionError):
        song.section_map(spark, sf, sensitivity=0.9)
