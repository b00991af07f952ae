"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of ``DIMS`` signs. A letter trigram is bound as the product of
its letters' vectors, rotated by their position; a text bundles (sums) its trigrams; a language's
prototype bundles its learning texts. The language of largest cosine wins. Words are lower-cased and
padded with a boundary symbol, so one letter already has a trigram.

Defined results: null texts and texts without a letter get ``und`` and score 0; null or unlearned
languages are never predicted; without any learning text all get ``und``; equal cosines fall to the
alphabetically first language; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import bound_batches
from .text_arrays import runs

DIMS = 1024
_SYMBOLS = 1024
RUN_BYTES = 800_000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbol of every code point (0: no letter), and the letter vectors rotated for each position."""
    symbol = np.zeros(0x110000, np.int64)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    symbol[letters] = np.where(letters < 0x300, letters, 0x300 + (letters * 2654435761 >> 7) % (_SYMBOLS - 0x300))
    vectors = (np.random.default_rng(20240517).integers(0, 2, (_SYMBOLS, DIMS), np.int8) * 2 - 1).astype(np.int8)
    return symbol, [np.roll(vectors, 2 - k, axis=1) for k in range(3)]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram code, count) of all texts, each once."""
    symbol, _ = _tables()
    # A break separates texts; lower-casing can change a text's length, so lengths are taken after it.
    low = [(t or "").lower() for t in texts]
    flat = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low) + 1), [1, *(len(t) + 1 for t in low)])
    s = symbol[flat]
    keep = (s > 0) | np.concatenate([[True], s[:-1] > 0]) | (flat == 0)
    s, text = s[keep], text[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = s[1:-1] > 0
    code = (s[:-2] << 20 | s[1:-1] << 10 | s[2:])[middle]
    key = np.sort((text[1:-1][middle] - 1) << 30 | code)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return key[at] >> 30, key[at] & (1 << 30) - 1, np.diff(np.append(at, len(key)))


def bundles(group: np.ndarray, code: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The sum of count * trigram vector for each of n groups."""
    _, rotated = _tables()
    out = np.zeros((n, DIMS), np.float32)
    found, column = np.unique(code, return_inverse=True)
    for lo in range(0, len(found), 4096):
        c = found[lo : lo + 4096]
        bound = (rotated[0][c >> 20] * rotated[1][c >> 10 & 1023] * rotated[2][c & 1023]).astype(np.float32)
        own = (column >= lo) & (column < lo + 4096)
        weight = np.bincount(group[own] * len(c) + column[own] - lo, count[own], n * len(c)).astype(np.float32)
        out += weight.reshape(n, len(c)) @ bound
    return out


def prototypes(learn: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language: tasks bundle what they read, Spark adds the bundles by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for r in runs(batch["text"], RUN_BYTES):
                text, code, count = trigrams(batch["text"].slice(r.first, len(r)).to_pylist())
                langs, index = np.unique(np.array(batch["lang"].slice(r.first, len(r)).to_pylist(), object).astype(str), return_inverse=True)
                for lang, vector in zip(langs.tolist(), bundles(index[text], code, count, len(langs)).astype(np.float64), strict=True):
                    total[lang] = total.get(lang, 0) + vector
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    bound_batches(learn.sparkSession)
    rows = learn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(run, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, dim, x in sums.collect():
        out.setdefault(lang, np.zeros(DIMS))[dim] = x
    return {k: out[k] for k in sorted(out) if out[k].any()}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; score is the winning cosine, cut to 0..1."""
    bound_batches(docs.sparkSession)
    names = list(learned)
    matrix = np.stack([v / np.linalg.norm(v) for v in learned.values()]).astype(np.float32) if names else np.zeros((0, DIMS), np.float32)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch["text"], RUN_BYTES):
                text, code, count = trigrams(batch["text"].slice(r.first, len(r)).to_pylist())
                vector = bundles(text, code, count, len(r))
                size = np.linalg.norm(vector, axis=1)
                some = np.isin(np.arange(len(r)), text) & (len(names) > 0)
                pred, score = ["und"] * len(r), np.zeros(len(r))
                if some.any():
                    cosine = vector @ matrix.T / np.maximum(size, 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    pred = [names[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
                    score = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(r.first, len(r)), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
