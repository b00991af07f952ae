"""Line deduplication by an exact set-similarity join.

A line's set holds its distinct lower-cased words. A line is removed when an earlier line, by
(document id, line number), has Jaccard similarity of ``percent`` or more with it; lines of fewer than
``min_words`` words stay. Whether the earlier line is itself removed plays
no part, so each line is judged alone.

1. One pass writes each line's 128-bit set hash and counts words in a table of fixed size (collisions
   only raise a count, so a word counted once is in one line; the counts only order words and choose keys,
   so a crowded table costs rows, never results). Equal sets are grouped; all but the first
   are removed. The sets held most often (at most ``HEAVY``) go on as their first line alone. Sets of fewer
   than ``least_words`` words match equal ones only (at 80 %, up to three words), so this step is all of theirs.
2. A second pass orders each line's words by rarity and emits its prefix with size, position and a
   96-bit parity sketch of the set. Words counted once are left out: no other line has them. Matching lines
   share the rarest word they have in common in both prefixes; where that word is frequent, the key is that
   word with the next one they share, and so on up to ``DEPTH`` words, while more than ``LIGHT`` lines are
   expected to hold the key. A match shares as many words in prefixes that are longer by as many. A key also has a mark of the
   word before it, so that two lines meet by the key of their first common words and are passed over at later ones, where the
   same word comes before in both. (Marks of two different words are equal once in 2^32; a match would be lost only where they
   stand before the first common words of a line and all the earlier lines that match it.)
3. Lines meet by key. Length, positional and sketch bounds (sketches differ in no more bits than sets
   do in words), all exact, leave few candidates; each later line sends on its nearest, ``SENT`` at most.
   Keys that more than ``OVER`` different sets hold all the same are written out, counted, and met in
   blocks of pairs.
4. Candidates are verified on full sets. Lines that had more candidates and none confirmed are
   joined again without that limit, over the keys they have, so no match is lost.

Defined results: null, empty and blank texts stay as they are; rows with a null id are neither
compared nor changed; equal rows count as one document and are treated alike; rows that share an id and differ in text are documents
of their own, the one of the smaller text hash first; empty tables give empty results;
other columns are kept (n_lines and n_removed are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import BROADCAST_KEYS, Scratch, emit_table, merge_tables, restrict
from .text_arrays import Run, mix, release, runs, sort_within, spans, words

SLOTS = 1 << 24
HEAVY = 1_000_000
LIGHT, DEPTH = 512, 3
#: Words from which lines have keys of two words at most, and of one: no line has more keys than 18 times its prefix's words.
SIZES = (40, 160)
OVER, BLOCK_LINES = 16_384, 4096
#: Candidates sent on at most, by whether the nearest is within a quarter of the bound, half of it, or not (bounds below 4 tell nothing).
SENT = (2, 4, 4)
#: Words from which a line has a second sketch: 96 bits no longer tell such lines apart.
LONG = 128
PAIRS_AT_ONCE = 200_000
#: Bits of a broadcast filter: eight for each key, and no more than these (16 MB); longer lists are joined by a shuffle.
MOST_BITS = 1 << 27
POSTING = "unit long, d long, t long, line long, b1 long, b2 long, b3 long, b4 long"
PAIR = "d long, t long, l int, d0 long, t0 long, l0 int, more boolean"
ROW = ["d", "t"]
LINE = ["d", "t", "l"]


def line_spans(run: Run):
    """(text, line number, start, end) of the run's lines that aren't empty."""
    start, end = spans(run, run.data != 10)
    text = np.searchsorted(run.bounds, start, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(run.data == 10)])
    return text, (breaks[start] - breaks[run.bounds[text]]).astype(np.int32), start, end


def line_words(run: Run, min_words: int):
    """(text, line number, bounds, word hashes) of the run's lines with enough words."""
    text, number, start, end = line_spans(run)
    w = words(run)
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    keep = hi - lo >= min_words
    lo, size = lo[keep], (hi - lo)[keep]
    return text[keep], number[keep], np.concatenate([[0], np.cumsum(size)]), w.hash[_spread(lo, size)[1]]


def distinct_sorted(bounds: np.ndarray, key: np.ndarray):
    """Keys sorted and distinct within each range: (keys, bounds, range of each)."""
    key = sort_within(bounds, key)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[keep], of[keep]
    return key, np.searchsorted(of, np.arange(len(bounds))), of


_HASH = np.uint64(2**56 - 1)


def set_hash(bounds: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """One hash of each range's words, from the low 56 bits of their keys."""
    return np.add.reduceat(mix(key & _HASH, salt), bounds[:-1]) if len(bounds) > 1 else key[:0]


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts as ordered codes of one byte: below 64 as they are, then eight steps a doubling."""
    out = np.minimum(counts, 64).astype(np.uint8)
    large = counts > 64
    out[large] = np.minimum(64 + np.floor(8 * np.log2(counts[large] / 64)), 255)
    return out


def expected() -> np.ndarray:
    """The most lines that each code stands for."""
    code = np.arange(256)
    return np.where(code < 64, code, 64 * 2.0 ** ((code - 63) / 8))


def _ids(batch: pa.RecordBatch, run: Run, column: str) -> np.ndarray:
    return batch[column].slice(run.first, len(run)).to_numpy(zero_copy_only=False)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each i and each j of first[i] .. first[i] + size[i] - 1."""
    i = np.repeat(np.arange(len(size)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + first[i]


def least_words(percent: int) -> int:
    """The smallest set that an unequal one can match: of n words, a set of n + 1 is the nearest."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**31


def scan_lines(min_words: int, percent: int):
    """Rows (d, t, l, h1, h2) of lines, and the task's word counts, in lines that unequal ones can match, as rows (block, data)."""
    least = least_words(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint16)
        names = ["d", "t", "l", "h1", "h2", "block", "data"]
        for batch in batches:
            for r in runs(batch["text"]):
                text, number, bounds, hashes = line_words(r, min_words)
                counted = hashes[np.repeat(np.diff(bounds) >= least, np.diff(bounds))]
                for at in range(0, len(counted), 32767):  # so that no sum passes 16 bits
                    slot = (counted[at : at + 32767] & np.uint64(SLOTS - 1)).astype(np.int64)
                    np.add.at(counts, slot, np.uint16(1))
                    counts[slot] = np.minimum(counts[slot], 32767)
                key, bounds, _ = distinct_sorted(bounds, hashes >> np.uint64(8))
                h1, h2 = set_hash(bounds, key, 1), set_hash(bounds, key, 3)
                n = len(number)
                yield _batch(names, _ids(batch, r, "d")[text], _ids(batch, r, "t")[text], number, h1.view(np.int64), h2.view(np.int64), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        if counts.any():
            table = emit_table(counts)
            none = [pa.nulls(len(table), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            yield _batch(names, *none, table["block"], table["data"])

    return run


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def depths(n: np.ndarray, percent: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """The most words of a key, by a line's size, and by that of the largest line it can match.

    Lines that match use the depth of the larger one. So a line whose two depths differ has keys of both.
    """
    most = lambda size: np.minimum(deepest, 1 + (size < SIZES[0]) + (size < SIZES[1]))
    return most(n), most(100 * n // percent)


def prefix_keys(key: np.ndarray, line: np.ndarray, position: np.ndarray, prefix: np.ndarray, lines: int, own: np.ndarray, larger: np.ndarray):
    """(key, line, position, mark) of each prefix entry's keys; ``own`` and ``larger`` are the lines' ``depths``.

    The position is such that n less it bounds the overlap of lines whose first common words are the key's. The mark is 32 bits of the
    last word before the key's last one that is not of the key: lines that both have it share a word that comes first, so they meet by another key.
    It is 0 without such a word.
    """
    count = expected()[(key >> np.uint64(56)).astype(np.int64)]
    shared = count > 1
    at = np.flatnonzero(shared & (position < prefix[line]))
    unit, held = mix(key[at], 34), count[at]
    words_at = at[:, None]  # of each key, its words' places
    named = np.where(shared, np.maximum(mix(key, 37) >> np.uint64(32), np.uint64(1)), np.uint64(0))
    begin = np.arange(len(key)) - position

    def mark() -> np.ndarray:
        before = words_at[:, -1] - 1
        for k in range(words_at.shape[1] - 2, -1, -1):
            before = before - (before == words_at[:, k])
        return np.where(before >= begin[words_at[:, -1]], named[before], np.uint64(0))
    for depth in range(1, DEPTH + 1):
        # A frequent key that is cut short by a line's size is another than the one that goes on from it.
        done, cut = held <= LIGHT, (held > LIGHT) & ((depth == own[line[at]]) | (depth == larger[line[at]]))
        marks = mark()
        yield unit[done], line[at[done]], position[at[done]] - (depth - 1), marks[done]
        yield mix(unit[cut], 36), line[at[cut]], position[at[cut]] - (depth - 1), marks[cut]
        on = ~done & (depth < own[line[at]])
        at, unit, held, words_at = at[on], unit[on], held[on], words_at[on]
        if not len(at):
            return
        # Words after each in the line, in the prefix that is longer by the depth.
        i, j = _spread(at + 1, prefix[line[at]] + depth - position[at] - 1)
        i, j = i[shared[j]], j[shared[j]]
        at, unit, held, words_at = j, mix(unit[i] ^ mix(key[j], 35), depth), held[i] * count[j] / max(1, lines), np.column_stack([words_at[i], j])


def sketch(place: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each range's places below 96: 64 bits, and 32 in the high half of another number."""
    bit = np.uint64(1) << (place & np.uint64(63))
    parts = np.where(place < 64, bit, np.uint64(0)), np.where((place > 63) & (place < 96), bit << np.uint64(32), np.uint64(0))
    return tuple(np.bitwise_xor.reduceat(x, bounds[:-1]) for x in parts)


def scan_postings(min_words: int, percent: int, lines: int, table, heavy, probes=None, only=None):
    """Keys of lines, with what the filters need, packed: unit holds 48 bits of the key, then the position
    (at most 65535: a smaller one only loosens a bound); line is number * 2^32 + n; b1 and the high half of b2
    are the sketch, the low half of b2 is from the set's hash; b3 and b4 are half of a sketch of twice as many bits
    whose halves, added, are the first one (0 in lines of fewer than ``LONG`` words), the low half of b4 is the key's mark.

    ``table`` and ``heavy`` are Spark broadcasts. With ``probes``, a broadcast of bits by line, the lines whose bit is set are
    marked in a last column; with ``only``, one of bits by unit, just units whose bit is set are returned, else just marked lines.
    """
    least = least_words(percent)
    # Any two unequal sets that match share as many words.
    deepest = max(1, min(DEPTH, -(-percent * (2 * least + 1) // (100 + percent))))
    names = [c.split()[0] for c in POSTING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (heavy_hash, *first) = table.value, heavy.value
        for batch in batches:
            for r in runs(batch["text"]):
                text, number, bounds, hashes = line_words(r, max(min_words, least))
                if not len(number):
                    continue
                d, t = _ids(batch, r, "d")[text], _ids(batch, r, "t")[text]
                key = codes[hashes & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
                key, bounds, line = distinct_sorted(bounds, key)
                h = set_hash(bounds, key, 1)
                n = np.diff(bounds)
                skip = n < least
                if len(heavy_hash):
                    at = np.minimum(np.searchsorted(heavy_hash, h), len(heavy_hash) - 1)
                    other = np.any([a[at] != b for a, b in zip(first, (d, t, number), strict=True)], axis=0)
                    skip |= (heavy_hash[at] == h) & other
                place = (key & np.uint64(0xFFFF)) % np.uint64(192)
                b1, high = sketch(place % np.uint64(96), bounds)
                b2 = (high | h >> np.uint64(32)).view(np.int64)
                b3, b4 = (np.where(n < LONG, np.uint64(0), x).view(np.int64) for x in sketch(place - np.uint64(96), bounds))
                b1 = b1.view(np.int64)
                prefix = np.where(skip, -DEPTH, prefix_length(n, percent))
                own, larger = depths(n, percent, deepest)
                position = np.arange(len(key)) - bounds[:-1][line]
                unit, line, position, marks = (np.concatenate(x) for x in zip(*prefix_keys(key, line, position, prefix, lines, own, larger), strict=True))
                probe = []
                if probes is not None:
                    marked = has_bit(probes.value, line_key(d, t, number))[line]
                    keep = marked if only is None else has_bit(only.value, unit >> np.uint64(16))
                    unit, line, position, marks, probe = unit[keep], line[keep], position[keep], marks[keep], [marked[keep]]
                unit = unit >> np.uint64(16) << np.uint64(16) | np.minimum(position, 65535).astype(np.uint64)
                yield _batch([*names, "probe"][: len(names) + len(probe)], unit.view(np.int64), d[line], t[line], number[line].astype(np.int64) << 32 | n[line], b1[line], b2[line], b3[line], b4[line] | marks.view(np.int64), *probe)

    return run


def line_key(d: np.ndarray, t: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(mix(mix(d.view(np.uint64), 41) ^ t.view(np.uint64), 42) ^ number.astype(np.uint64), 43)


def has_bit(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(8 * len(table) - 1)
    return table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def bit_table(keys, bits: int):
    """A task's keys as a table of bits, for merge_tables; ``keys`` makes arrays of keys from a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for key in keys(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                at = key & np.uint64(bits - 1)
                np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if table.any():
            yield emit_table(table)

    return run


def bits_for(n: int) -> int:
    return 1 << min(MOST_BITS.bit_length() - 1, max(20, (8 * n).bit_length()))


def first_of_equal(t: dict[str, np.ndarray], sized: int = 16) -> dict[str, np.ndarray]:
    """Rows of sorted postings without the later of equal sets in a unit: step 1 removes those lines, and the first stands for them."""
    unit = t["unit"] >> 16
    new = np.ones(len(unit), bool)
    new[1:] = unit[1:] != unit[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(unit)))
    at = np.flatnonzero(np.repeat(size >= sized, size))
    if not len(at):
        return t
    order = at[np.lexsort((at, t["b2"][at], t["b1"][at], t["line"][at] & 2**32 - 1, unit[at]))]
    same = np.ones(len(order) - 1, bool)
    for c in (unit, t["b1"], t["b2"], t["line"] & 2**32 - 1):
        same &= c[order[1:]] == c[order[:-1]]
    keep = np.ones(len(unit), bool)
    keep[order[1:][same]] = False
    return {n: c[keep] for n, c in t.items()}


def candidates(percent: int, sent: tuple[int, ...] | None, over: int | None):
    """Earlier lines that may match each later one, from postings sorted by (unit, d, t, line).

    A later line sends on its nearest candidates by sketch, as many as ``sent`` says; more says that it had others. With ``sent`` None only lines whose column ``probe`` holds are looked up, without a limit.
    Units of more than ``over`` different sets leave as they came, in the columns of postings.
    """
    names = [c.split()[0] for c in PAIR.split(", ")]

    def pairs(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        unit, n, position, mark = t["unit"] >> 16, t["line"] & 2**32 - 1, t["unit"] & 65535, t["b4"] & 2**32 - 1
        first = np.ones(len(unit), bool)
        first[1:] = unit[1:] != unit[:-1]
        begin = np.flatnonzero(first)[np.cumsum(first) - 1]
        earlier = np.arange(len(unit)) - begin
        if sent is None:
            earlier = np.where(t["probe"], earlier, 0)
        total = np.cumsum(earlier)
        at = 0
        while at < len(unit):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
            x, y = _spread(begin[at:to], earlier[at:to])
            x += at
            nx, ny = n[x], n[y]
            need = -(-percent * (nx + ny) // (100 + percent))
            ok = (np.minimum(nx - position[x], ny - position[y]) >= need) & ((mark[x] != mark[y]) | (mark[x] == 0))
            x, y, both, need = x[ok], y[ok], (nx + ny)[ok], need[ok]
            b1, b2, b3, b4 = ((t[b][x] ^ t[b][y]).view(np.uint64) for b in ("b1", "b2", "b3", "b4"))  # signed values would be counted without their sign
            high, long = b2 >> np.uint64(32), np.minimum(nx[ok], ny[ok]) >= LONG
            b3, b4 = np.where(long, b3, np.uint64(0)), np.where(long, b4 >> np.uint64(32), np.uint64(0))
            apart = sum(np.bitwise_count(c).astype(np.int64) for c in (b1 ^ b3, high ^ b4, b3, b4))
            # Equal sets are step 1's.
            ok = (apart <= both - 2 * need) & ((apart > 0) | (b2 > 0) | (n[x] != n[y]))
            x, y, apart, bound = x[ok], y[ok], apart[ok], (both - 2 * need)[ok]
            more = np.zeros(len(x), bool)
            if sent is not None and len(x):
                order = np.lexsort((y, apart, x))
                x, y, apart, bound = x[order], y[order], apart[order], bound[order]
                new = np.ones(len(x), bool)
                new[1:] = x[1:] != x[:-1]
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                rank, most = np.arange(len(x)) - head, np.array(sent)[np.where(bound < 4, 2, (4 * apart > bound).astype(int) + (2 * apart > bound))][head]
                more = np.bincount(x, minlength=to)[x] > most
                keep = rank < most
                x, y, more = x[keep], y[keep], more[keep]
            if len(x):
                yield _batch(names, *(c for i in (x, y) for c in (t["d"][i], t["t"][i], (t["line"][i] >> 32).astype(np.int32))), more)
            at = to

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def both(found, t: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Pairs, or rows of postings where ``found`` is None, with nulls in the columns of the other."""
        n = len(t["d"]) if found is None else len(found)
        left = [pa.nulls(n, k) for k in kinds] if found is None else found.columns
        right = t.values() if found is None else [pa.nulls(n, pa.bool_() if c == "probe" else pa.int64()) for c in t]
        return _batch([*names, *("p_" + c for c in t)], *left, *right)

    def units(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        t = first_of_equal(t)
        if over is not None:
            unit = t["unit"] >> 16
            new = np.ones(len(unit), bool)
            new[1:] = unit[1:] != unit[:-1]
            size = np.diff(np.append(np.flatnonzero(new), len(unit)))
            large = np.repeat(size > over, size)
            if large.any():
                yield both(None, {n: c[large] for n, c in t.items()})
                t = {n: c[~large] for n, c in t.items()}
        for found in pairs(t):
            yield both(found, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        leaving = None  # the unit whose rows go out as they come
        for batch in batches:
            if not len(batch):
                continue
            t = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            if leaving is not None:
                to = int(np.searchsorted(t["unit"] >> 16, leaving, "right"))
                if to:
                    yield both(None, {n: c[:to] for n, c in t.items()})
                    t = {n: c[to:] for n, c in t.items()}
                if not len(t["unit"]):
                    continue
                leaving = None
            if held:
                t = {n: np.concatenate([held[n], c]) for n, c in t.items()}
            cut = int(np.searchsorted(t["unit"] >> 16, t["unit"][-1] >> 16))
            if cut:
                yield from units({n: c[:cut] for n, c in t.items()})
            held = {n: c[cut:].copy() for n, c in t.items()}
            if over is not None and len(held["unit"]) > over:
                held = first_of_equal(held)
                if len(held["unit"]) > over:
                    leaving = held["unit"][-1] >> 16
                    yield both(None, held)
                    held = {}
        if held:
            yield from units(held)
        release()

    return run


def scan_sets(wanted):
    """The sorted word hashes, of six bytes, of the lines whose bit is set in ``wanted``, a Spark broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = (batch[c].to_numpy(zero_copy_only=False) for c in ROW)
            batch = batch.filter(pa.array(has_bit(wanted.value, line_key(d, t, np.full(len(d), 2**32)))))
            for r in runs(batch["text"]):
                text, number, start, end = line_spans(r)
                d, t = _ids(batch, r, "d")[text], _ids(batch, r, "t")[text]
                keep = np.flatnonzero(has_bit(wanted.value, line_key(d, t, number)))
                size = end[keep] - start[keep]
                own = Run(0, r.data[_spread(start[keep], size)[1]], np.concatenate([[0], np.cumsum(size)]))
                w = words(own)
                key, bounds, _ = distinct_sorted(w.of, w.hash >> np.uint64(16))
                data, bounds = np.ascontiguousarray(key[:, None].view(np.uint8)[:, :6]).tobytes(), 6 * bounds
                yield _batch([*LINE, "items"], d[keep], t[keep], number[keep], pa.array([data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))

    return run


def wanted_keys(d: np.ndarray, t: np.ndarray, number: np.ndarray) -> Iterator[np.ndarray]:
    yield line_key(d, t, number)
    yield line_key(d, t, np.full(len(d), 2**32))


def verify(percent: int):
    def parts(batch: pa.RecordBatch, column: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        items = batch[column].slice(lo, hi - lo).to_pylist()
        size = np.array([len(x) // 6 for x in items])
        data = np.zeros((size.sum(), 8), np.uint8)
        data[:, :6] = np.frombuffer(b"".join(items), np.uint8).reshape(-1, 6)
        return data.view(np.uint64)[:, 0] | np.repeat(np.arange(hi - lo, dtype=np.uint64) << np.uint64(48), size), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                hi = min(lo + 4096, len(batch))
                (x, nx), (y, ny) = parts(batch, "items", lo, hi), parts(batch, "items0", lo, hi)
                every = np.sort(np.concatenate([x, y]))
                same = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(48)).astype(np.int64), minlength=hi - lo)
                keep = 100 * same >= percent * (nx + ny - same)
                yield batch.select(LINE).slice(lo, hi - lo).filter(pa.array(keep))

    return run


def _meet(docs: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """Documents with their listed lines, ascending; the list is broadcast only where it has at most BROADCAST_KEYS lines."""
    small = lines.count() <= BROADCAST_KEYS
    by = lines.groupBy(*ROW).agg(F.sort_array(F.collect_set("l")).alias("lines"))
    return docs.join(F.broadcast(by) if small else by, ROW, how)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Rows with their keys, and whether rows share ids: d is the id, t (where ids are shared, else 0) a hash of the text, row the columns of ``docs``."""
    d = F.col(id_col).cast("long")
    shared = not docs.select(d.alias("d")).where("d is not null").groupBy("d").count().where("count > 1").isEmpty()
    t = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)) if shared else F.lit(0)
    return docs.select(d.alias("d"), t.cast("long").alias("t"), F.struct(*docs.columns).alias("row")), shared


def removed_lines(keyed: DataFrame, repeated: bool, text_col: str, percent: int, min_words: int) -> DataFrame:
    """Distinct (d, t, l): the lines to remove, of rows from ``keyed_rows``; ``repeated`` says that rows share ids."""
    spark = keyed.sparkSession
    scratch = Scratch(spark, "lines")
    rows = keyed.select(*ROW, F.col("row")[text_col].alias("text")).where("d is not null and text is not null")
    scanned = scratch.table(rows.mapInArrow(scan_lines(min_words, percent), "d long, t long, l int, h1 long, h2 long, block int, data binary"))
    lines = scanned.where("block is null").select(*LINE, "h1", "h2")
    counts = merge_tables(scanned.where("block is not null").select("block", "data"), "<u2", np.add, "<u4")
    sets = scratch.table(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*LINE)).alias("first")).where("n > 1"))
    copies = scratch.table(lines.join(sets, ["h1", "h2"]).where(" or ".join(f"{c} != first.{c}" for c in LINE)).select(*LINE).distinct())
    if not len(counts):
        return copies
    # The most often held sets: the lowest power of two of holders that at most HEAVY sets exceed.
    tall = sorted(sets.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect(), reverse=True)
    most, many = 0, 2**62
    for k, n in tall:
        most += n
        if most > HEAVY:
            break
        many = 2**k
    heavy = sets.where(F.col("n") >= many).select("h1", "first.d", "first.t", "first.l").toArrow()
    # A 64-bit hash stands for the set here; of sets that share one, none is taken for heavy.
    found, at, n = np.unique(heavy["h1"].to_numpy().view(np.uint64), return_index=True, return_counts=True)
    shared_heavy = spark.sparkContext.broadcast((found[n == 1], *(heavy[c].to_numpy()[at[n == 1]] for c in LINE)))
    shared_codes = spark.sparkContext.broadcast(rarity(counts))
    total = lines.count()

    def postings_of(rows: DataFrame, *bits) -> DataFrame:
        return rows.mapInArrow(scan_postings(min_words, percent, total, shared_codes, shared_heavy, *bits), POSTING + ", probe boolean" * bool(bits))

    def shared_bits(of: DataFrame, keys, bits: int):
        table = merge_tables(of.mapInArrow(bit_table(keys, bits), "block int, data binary"), "u1", np.bitwise_or)
        return spark.sparkContext.broadcast(table if len(table) else np.zeros(1, np.uint8))

    def meet_by_key(postings: DataFrame, sent: tuple[int, ...] | None, over: int | None) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = F.shiftright("unit", 16)
        dealt = postings.repartition(n, key).sortWithinPartitions(key, "d", "t", "line")
        held = ", ".join(f"p_{f.name} {f.dataType.simpleString()}" for f in postings.schema)
        return scratch.table(dealt.mapInArrow(candidates(percent, sent, over), f"{PAIR}, {held}"))

    def candidate_pairs(postings: DataFrame, sent: tuple[int, ...] | None) -> DataFrame:
        met = meet_by_key(postings, sent, OVER)
        found = met.where("d is not null").select(*(c.split()[0] for c in PAIR.split(", ")))
        large = met.where("d is null").select(*(F.col("p_" + c).alias(c) for c in postings.columns))
        if not large.isEmpty():
            key = F.shiftright("unit", 16)
            sizes = scratch.table(large.groupBy(key.alias("key")).agg(F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("blocks")))
            by_size = F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes
            dealt = (
                large.withColumn("key", key).join(by_size, "key")
                .withColumn("own", F.pmod(F.xxhash64("b1", "b2"), "blocks").cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("unit", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(~0xFFFF).bitwiseOR(F.col("unit").bitwiseAND(0xFFFF)))
            )
            found = found.union(meet_by_key(dealt.select(*postings.columns), sent, None).select(*found.columns))
        return scratch.table(found.groupBy(*found.columns[:-1]).agg(F.max("more").alias("more")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        earlier = [c + "0" for c in LINE]
        wanted = scratch.table(pairs.select(*LINE).union(pairs.select(*earlier)).distinct())
        n = 2 * wanted.count()
        if 8 * n <= MOST_BITS:
            bits, near = shared_bits(wanted, wanted_keys, bits_for(n)), rows
        else:
            bits, near = spark.sparkContext.broadcast(np.full(1, 255, np.uint8)), rows.join(wanted.select(*ROW).distinct(), ROW, "left_semi")
        held = near.mapInArrow(scan_sets(bits), "d long, t long, l int, items binary")
        held = scratch.table(held.dropDuplicates(LINE) if repeated else held)
        both = pairs.join(held, LINE).join(held.select(*(F.col(c).alias(c + "0") for c in [*LINE, "items"])), earlier)
        found = scratch.table(both.select(*LINE, "items", "items0").mapInArrow(verify(percent), "d long, t long, l int").distinct())
        scratch.drop(wanted, held)
        return found

    pairs = candidate_pairs(postings_of(rows), SENT)
    near = confirmed(pairs)
    left = scratch.table(pairs.where("more").select(*LINE).distinct().join(near, LINE, "left_anti").join(copies, LINE, "left_anti"))
    out = copies.union(near)
    if not left.isEmpty():
        probes = shared_bits(left, lambda *line: [line_key(*line)], bits_for(left.count()))
        own = restrict(rows, scratch.table(left.select(*ROW).distinct()), ROW)
        units = shared_bits(postings_of(own, probes).select("unit"), lambda unit: [unit.view(np.uint64) >> np.uint64(16)], MOST_BITS >> 2)
        out = out.union(confirmed(candidate_pairs(postings_of(rows, probes, units), None)))
    gone = scratch.table(out.distinct())
    scratch.drop_all(gone)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_words: int = 1) -> DataFrame:
    """``docs`` with the later of matching lines taken out, and n_lines, n_removed (longs)."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    # The row travels as one struct, so its column names meet no others.
    keyed, repeated = keyed_rows(docs.select(*names), id_col, text_col)
    gone = removed_lines(keyed, repeated, text_col, percent, min_words)
    met = _meet(keyed, gone, "left").withColumn("parts", F.split(F.col("row")[text_col], "\n", -1))
    text, size = F.col("row")[text_col], F.size("parts")
    # The parts between removed lines, so that the work is in proportion to the lines.
    runs_kept = F.zip_with(F.concat(F.array(F.lit(-1)), "lines"), F.concat("lines", F.array(size)), lambda a, b: F.slice("parts", a + 2, b - a - 1))
    kept = F.array_join(F.flatten(runs_kept), "\n")
    return met.select(
        *[F.when(F.col("lines").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        F.when(text.isNull(), F.lit(0)).otherwise(size).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_removed"),
    )
