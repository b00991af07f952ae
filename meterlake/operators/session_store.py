"""Verification sessions and snapshots that outlive a process: versions of their tables, committed by compare-and-set.

Every operation reads the latest version, makes the next one from it and commits that; where another process was first it starts
again from there. So a session is begun once, completed once whoever asks how often, and the oldest beyond the limit go
in the version that adds new ones (K03-K05, T14, T37-T42).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import VersionedTables
from . import sessions


def newest(rows: DataFrame, limit: int, at: str, *ties: str) -> DataFrame:
    """The ``limit`` rows latest by ``at``: each task sends on as many at most."""
    return rows.orderBy(F.desc(at), *ties).limit(limit)


class SessionStore:
    def __init__(self, tables: VersionedTables, limit: int = sessions.LIMIT):
        self.tables, self.limit = tables, limit

    def begin(self, requests: DataFrame, states: DataFrame, valid: Column) -> int:
        """Open sessions on their baselines; one that is known already stays as it is."""

        def change(version: int):
            held, frozen = self.tables.read("sessions", version), self.tables.read("before", version)
            new = requests if held is None else requests.join(held.select("session_id"), "session_id", "left_anti")
            begun = sessions.begin(new, states.join(new.select("session_id"), "session_id", "left_semi"), valid)
            begun = begun.withColumns({"controlled": F.lit(None).cast("boolean"), "closed_loop": F.lit(None).cast("boolean"), "completed_at": F.lit(None).cast("double"), "readback": F.lit(None).cast("string")})
            every = newest(begun if held is None else held.unionByName(begun), self.limit, "created_at", "session_id")
            kept = every.select("session_id")
            base = states if frozen is None else frozen.unionByName(states.join(frozen.select("session_id").distinct(), "session_id", "left_anti"))
            return {"sessions": every, "before": base.join(kept, "session_id", "left_semi")}, {}

        return self.tables.update(change)

    def complete(self, readbacks: DataFrame, after: DataFrame, checks: dict[str, Column], at: float) -> int:
        """Complete the sessions that ``readbacks`` (session_id, readback) names, with the states after the change. Those that are
        completed, unknown or gone stay as they are; if nothing is left to do, no version is made."""

        def change(version: int):
            held, before = self.tables.read("sessions", version), self.tables.read("before", version)
            if held is None:
                return None
            asked = held.where(F.col("status") == sessions.AWAITING).join(readbacks.select("session_id").distinct(), "session_id", "left_semi")
            if asked.isEmpty():
                return None
            ids = asked.select("session_id")
            measured = after.join(ids, "session_id", "left_semi")
            results = sessions.compare_targets(asked, before.join(ids, "session_id", "left_semi"), measured, checks)
            done = sessions.complete(asked.drop("controlled", "closed_loop", "completed_at", "readback"), results, readbacks, F.lit(float(at)))
            done = done.join(readbacks.groupBy("session_id").agg(F.max(F.trim("readback")).alias("readback")), "session_id", "left")
            every = held.join(ids, "session_id", "left_anti").unionByName(done)
            old, old_after = self.tables.read("results", version), self.tables.read("after", version)
            keep = every.select("session_id")
            results = (results if old is None else old.unionByName(results)).join(keep, "session_id", "left_semi")
            measured = (measured if old_after is None else old_after.unionByName(measured)).join(keep, "session_id", "left_semi")
            return {"sessions": every, "results": results, "after": measured}, {}

        return self.tables.update(change)

    def status(self, limit: int | None = None) -> DataFrame:
        """The newest sessions, newest first by rank."""
        return sessions.status(self.tables.read("sessions"), limit or self.limit)

    def results(self) -> DataFrame | None:
        """One row a completed session and target; None before the first completion."""
        return self.tables.read("results")


class SnapshotStore:
    """Named states of tracks (T14, T15); capturing a name again replaces it, and the oldest beyond ``keep`` names go."""

    def __init__(self, tables: VersionedTables, keep: int = 16):
        self.tables, self.keep = tables, keep

    def capture(self, requests: DataFrame, states: DataFrame, at: float) -> int:
        """Freeze the states (name, runtime_id, ...) of the requested names."""

        def change(version: int):
            held = self.tables.read("snapshots", version)
            new = sessions.capture(requests, states).withColumn("captured_at", F.lit(float(at)))
            every = new if held is None else held.join(new.select("name").distinct(), "name", "left_anti").unionByName(new)
            names = newest(every.groupBy("name").agg(F.max("captured_at").alias("captured_at")), self.keep, "captured_at", "name")
            return {"snapshots": every.join(names.select("name"), "name", "left_semi")}, {}

        return self.tables.update(change)

    def read(self, name: str) -> DataFrame:
        held = self.tables.read("snapshots")
        found = None if held is None else held.where(F.col("name") == name.strip()[:96])
        if found is None or found.isEmpty():
            raise KeyError(name)
        return found
