"""Fill-in-the-middle transformation, cut through a piecewise-linear learned index of token ranks.

A text is n tokens, each a word with the white space before it, or the white space at the end; rank k's boundary
is where its first k tokens end. A task indexes the boundaries of a run of texts: line segments, none across
two texts, predict a boundary's byte from its rank to within ``ERROR`` bytes, and what is left to the true byte
is stored as one signed byte a boundary. A segment starts as a whole text and is halved while its error is
larger. A cut is predicted from its rank and put right by its stored residual, so it is exact.

Ranks come from the hex sha256 of ``seed:id``, so they depend on no order, partition or machine. Rebuilding
is done with Spark's string functions, from the output and its form alone.

Defined results: null texts are the empty text; empty texts and texts that hold a sentinel stay plain; a null id is
drawn like the empty string; rows that share an id are each cut at ranks of the same draw; white space alone is one
token; very long texts go alone in a run; empty tables give empty results; other columns are kept, those named like
the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _kept, _with
from .spark_tools import bound_batches
from .text_arrays import Run, in_word, runs, spans

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that a prediction may be off by, so that a residual takes one signed byte.
ERROR = 127


class RankIndex:
    """Boundaries ``x`` of several texts, text i's at ``first[i]:first[i + 1]``, as segments and residuals."""

    def __init__(self, x: np.ndarray, first: np.ndarray):
        done: list[np.ndarray] = []
        self.residual = np.zeros(len(x), np.int8)
        begin, end = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0]
        while len(begin):
            size = end - begin
            slope = (x[end - 1] - x[begin]) / np.maximum(1, size - 1)
            of = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            left = x[begin[of] + step] - self.line(x[begin][of], slope[of], step)
            fits = np.maximum.reduceat(np.abs(left), np.cumsum(size) - size) <= ERROR
            held = fits[of]
            self.residual[(begin[of] + step)[held]] = left[held]
            done.append(np.stack([begin[fits], x[begin[fits]], slope[fits]]))
            begin, end = begin[~fits], end[~fits]
            half = (begin + end) // 2
            begin, end = np.concatenate([begin, half]), np.concatenate([half, end])
        self.start, self.base, self.slope = np.concatenate(done, axis=1) if done else np.zeros((3, 0))
        order = np.argsort(self.start)
        self.start, self.base, self.slope = self.start[order].astype(np.int64), self.base[order].astype(np.int64), self.slope[order]

    @staticmethod
    def line(base: np.ndarray, slope: np.ndarray, step: np.ndarray) -> np.ndarray:
        return base + np.rint(slope * step).astype(np.int64)

    def predict(self, at: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.start, at, "right") - 1
        return self.line(self.base[s], self.slope[s], at - self.start[s])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The exact boundaries of entries ``at``."""
        return self.predict(at) + self.residual[at]


def boundaries(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, first): for each text its begin and the end of each of its tokens, text i's at first[i]:first[i + 1]."""
    inside = in_word(run.data)
    _, ends = spans(run, inside)
    last = run.bounds[1:][np.diff(run.bounds) > 0]
    ends = np.sort(np.concatenate([ends, last[~inside[last - 1]]]))
    first = np.searchsorted(ends, run.bounds, "right")
    return np.insert(ends, first[:-1], run.bounds[:-1]), first + np.arange(len(first))


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join([p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output in place of the text.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of them with the suffix first.
    """
    bound_batches(docs.sparkSession)
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    drop = {text_col.lower(), *(n for n, _ in fields)}
    schema = _with(docs.drop(text_col), *fields)
    draw = "draw"
    while draw in {c.lower() for c in docs.columns}:
        draw += "_"
    drawn = docs.withColumn(draw, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    sentinels = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch[text_col]):
                rows = slice(r.first, r.first + len(r))
                h = np.array([[int(x[i : i + 8], 16) for i in (0, 8, 16, 24)] for x in batch[draw].slice(r.first, len(r)).to_pylist()], np.int64)
                x, first = boundaries(r)
                n = np.diff(first) - 1
                index = RankIndex(x, first)
                ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                cut = index[first[:-1, None] + ranks]
                characters = np.concatenate([[0], np.cumsum((r.data & 0xC0) != 0x80)])
                chars = np.diff(characters[np.column_stack([r.bounds[:-1], cut])], axis=1)
                form, out = [], []
                for i, (a, b) in enumerate(cut.tolist()):
                    lo, hi = int(r.bounds[i]), int(r.bounds[i + 1])
                    text = r.data[lo:hi].tobytes()
                    plain = not text or h[i, 2] % 100 >= rate or any(s in text for s in sentinels)
                    form.append("plain" if plain else "spm" if h[i, 3] % 100 < spm else "psm")
                    out.append(text if plain else arrange(text[: a - lo], text[a - lo : b - lo], text[b - lo :], form[-1]))
                none = np.array([f == "plain" for f in form], bool)
                kept = [(name, c.slice(rows.start, len(r))) for name, c in _kept(batch, drop | {draw})]
                new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), *(pa.array(chars[:, k], pa.int64(), mask=none) for k in (0, 1)), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + new, names=[name for name, _ in kept] + [name for name, _ in fields])

    return drawn.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text in another form holds a sentinel, so the first of each is the one put in."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        second = F.call_function("locate", F.lit(two), output)
        third = F.call_function("locate", F.lit(MIDDLE), output, second + len(two))
        a = F.substring(output, F.lit(len(one) + 1), second - (len(one) + 1))
        b = F.substring(output, second + len(two), third - second - len(two))
        return a, b, F.substring(output, third + len(MIDDLE), F.length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
