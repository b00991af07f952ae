"""Tables that are derived once: a cache addressed by what they are derived from.

An entry's key is a hash of its input files (names, sizes and times of change; no data is read) and of the
parameters. Who asks for an entry that is there reads its tables and nothing else; who finds none builds it, and of several that
build at once the first one's tables count for all. An index, itself versioned, lists the entries by the order they were made in,
and the oldest beyond ``keep`` go.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .versions import Conflict, VersionedTables


class TableCache:
    def __init__(self, spark: SparkSession, path: str, keep: int = 16):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.index = VersionedTables(spark, f"{self.path}/index")

    def state_of(self, path: str) -> list[tuple[str, int, int]]:
        """Name, size and time of change of each file of an input."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
        out = []
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
        return sorted(out)

    def key(self, inputs: list[str], params: dict) -> str:
        text = json.dumps([[self.state_of(p) for p in inputs], params], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:32]

    def keys(self) -> list[str]:
        """The entries, in the order they were made in."""
        return self.index.notes().get("keys", [])

    def _entry(self, key: str) -> VersionedTables:
        return VersionedTables(self.spark, f"{self.path}/{key}")

    def find(self, key: str | None = None) -> VersionedTables | None:
        """The entry of a key, or the latest; None if there is none."""
        keys = self.keys()
        key = keys[-1] if key is None and keys else key
        return self._entry(key) if key in keys and self._entry(key).version() else None

    def build(self, inputs: list[str], params: dict, make: Callable[[], dict[str, DataFrame]]) -> tuple[str, VersionedTables]:
        """The entry of these inputs and parameters, made by ``make`` if it is not there."""
        key = self.key(inputs, params)
        found = self.find(key)
        if found:
            return key, found
        entry = self._entry(key)
        if not entry.version():
            try:
                entry.commit(make(), 0, {"params": params})
            except Conflict:
                pass  # another was first: its tables are the same
        self._list(key)
        return key, entry

    def _list(self, key: str) -> None:
        def add(version: int):
            keys = self.index.notes(version).get("keys", [])
            return None if key in keys else ({}, {"keys": [*keys, key][-self.keep :]})

        before = self.keys()
        self.index.update(add)
        for old in set(before) - set(self.keys()):
            fs, at = self._entry(old)._at("")
            fs.delete(at, True)
        self.index.vacuum(4)
