"""Bindings as a live dimension: a stream of bind events kept as a versioned table.

Each micro-batch is merged into the table and committed with its number, so a batch that is replayed after a
failure changes nothing. Streams that write at once retry on each other's versions. The table holds the last event of each
track and of each mixer slot, so it is as large as those are many, and it knows of tracks that lost their slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import frames as source
from ..sources.versions import VersionedTables

EVENT = ["runtime_id", "fl_track_index", "fl_track_name", "slot", "seq"]


def upsert(store: VersionedTables, stream: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge bind events (runtime_id, fl_track_index, fl_track_name, slot, seq) of the named stream."""

    def merge(events: DataFrame, batch: int) -> None:
        def change(version: int):
            done = store.notes(version).get("batches", {})
            if done.get(stream, -1) >= batch:
                return None
            held = store.read("bindings", version)
            every = events.select(*EVENT) if held is None else held.select(*EVENT).unionByName(events.select(*EVENT))
            return {"bindings": source.last_binds(every)}, {"batches": done | {stream: batch}}

        store.update(change)

    return merge


def bindings(store: VersionedTables, version: int | None = None) -> DataFrame:
    """The bindings that hold: one a slot, and one a track."""
    held = store.read("bindings", version)
    if held is None:
        return store.spark.createDataFrame([], "runtime_id string, fl_track_index int, fl_track_name string, slot int")
    return held.where("live").select(*EVENT[:-1])


def start(events: DataFrame, store: VersionedTables, stream: str, checkpoint: str):
    """Keep the table by a stream; its checkpoint and the table's batch numbers together make each event count once."""
    return events.writeStream.foreachBatch(upsert(store, stream)).option("checkpointLocation", checkpoint).start()


def follow(frames: DataFrame, store: VersionedTables) -> DataFrame:
    """Frames with the binding that holds now (J01); one row a track of a project, so Spark broadcasts it by size."""
    return frames.join(bindings(store).withColumn("bound", F.lit(True)), "runtime_id", "left")
