"""Vectorised word boundaries and hashes over Arrow string batches.

Small helpers for tasks: a batch of texts is cut into runs of at most
``RUN_BYTES`` (one text at least), each run is one flat byte array, and words,
shingles and their 64-bit hashes come from whole-array numpy operations.
Memory is bounded by the longest single text, never by the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 256_000

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every bit depends on all others."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def release() -> None:
    """Give freed memory back to the system: idle workers stay alive beside tasks that need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _U(_RADIX))
        down = np.full(size, _U(pow(_RADIX, -1, 2**64)))
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


@dataclass
class Run:
    """Some texts as one byte array. ``bounds`` has one entry more than there are texts."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words of a run: byte range and 64-bit hash; ``of[i]:of[i + 1]`` are text i's words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray


def runs(texts: pa.Array | pa.ChunkedArray, size: int = RUN_BYTES) -> Iterator[Run]:
    """Cut a string column into runs; null counts as empty."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if chunk.null_count:
            chunk = pc.fill_null(chunk, "")
        chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            lo, hi = int(offsets[at]), int(offsets[to])
            yield Run(at, data[lo:hi], offsets[at : to + 1] - lo)
            at = to
    release()


def spans(run: Run, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges where ``inside`` holds; none crosses a text's end."""
    n = len(run.data)
    edge = np.zeros(n + 1, bool)
    edge[run.bounds] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    return start, np.flatnonzero(inside & (~after | edge[1:])) + 1


def in_word(data: np.ndarray) -> np.ndarray:
    return ~_SPACE[data]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges, mixed."""
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(run: Run, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, after lower-casing A-Z when asked."""
    data = _LOWER[run.data] if lower else run.data
    start, end = spans(run, ~_SPACE[data])
    return Words(start, end, span_hashes(data, start, end), np.searchsorted(start, run.bounds))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word windows, and the text of each window's first word.

    A text of fewer words than ``width`` has its whole word sequence as one window.
    """
    counts = np.diff(w.of)
    n = len(w.hash)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        part = w.hash[j:] * _U((2 * j + 3) * 0xD6E8FEB86659FD93 & (2**64 - 1) | 1)
        out[: n - j] += part
    text = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(n) + width <= w.of[1:][text]
    out = mix(out, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = w.of[short]
        keep[first] = True
        for i, at in zip(short, first, strict=True):
            own = w.hash[at : w.of[i + 1]]
            out[at] = mix((own * (np.arange(len(own), dtype=np.uint64) * _U(2) + _U(3)) * _U(0xA24BAED4963EE407)).sum(keepdims=True), 1000 + len(own))[0]
    return out[keep], text[keep]


def sort_within(bounds: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A copy of ``value``, sorted inside each range ``bounds[i]:bounds[i + 1]``."""
    out = value.copy()
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    return out


def distinct(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sorted distinct values: (values, bounds); ``text`` must ascend."""
    ordered = sort_within(np.searchsorted(text, np.arange(n + 1)), value)
    keep = np.ones(len(ordered), bool)
    keep[1:] = (ordered[1:] != ordered[:-1]) | (text[1:] != text[:-1])
    return ordered[keep], np.searchsorted(text[keep], np.arange(n + 1))


def per_text(run: Run, of: np.ndarray) -> np.ndarray:
    """The text of each item when ``of`` bounds items per text."""
    return np.repeat(np.arange(len(run)), np.diff(of))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
