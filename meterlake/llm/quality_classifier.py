"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are indicators, hashed into ``WIDTH`` slots: lower-cased words, and 1- to 3-grams of
word shapes (case, digits, punctuation, length, whether the word repeats the one before, whether it
begins a line). Each indicator is scaled by its smoothed class log-count ratio, and a linear model with
squared hinge loss is fitted by dual coordinate descent. The score is the logistic of the margin.

The fit takes a bounded sample: of n labelled rows, those whose id hashes below ``fit_rows / n``
(all if n <= fit_rows). Scoring reads every whole text.

Defined results: null and empty texts have no indicator and get the score of the intercept alone; a null
or other label than 0 and 1 is not learned from; if a class is missing, every score is the share of
label 1 (0.5 without labels); repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import bound_batches
from .text_arrays import distinct, mix, runs, words

WIDTH = 1 << 18
FIT_ROWS = 10_000
COST, EPOCHS = 1.0, 12

_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 punctuation, 4 other
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3


def indicators(run) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a run's indicators: (sorted distinct slots per text, bounds)."""
    w = words(run)
    n = len(w.hash)
    text = np.repeat(np.arange(len(run)), np.diff(w.of))
    data = run.data
    kind = _KIND[data]
    if len(data):
        after = np.concatenate([[0], data[:-1]])
        kind = np.where((after == 0xC3) & (data >= 0x80) & (data <= 0x9E), 1, kind)
    count = []
    for k in range(4):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        count.append(total[w.end] - total[w.start])
    lower, upper, digit, punct = count
    size = w.end - w.start
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(lower == 0, 2, 3)))
    marks = np.where(punct == 0, 0, np.where(punct == size, 3, np.minimum(punct, 2)))
    length = np.searchsorted([2, 4, 8, 16, 32], size, "right")
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    same = np.zeros(n, bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & ~first[1:]
    lines = np.concatenate([[0], np.cumsum(data == 10)])[w.start]
    begins = first.copy()
    begins[1:] |= lines[1:] != lines[:-1]
    shape = (case + 4 * marks + 16 * (digit > 0) + 32 * length + 256 * same + 512 * begins).astype(np.uint64)
    parts, owner, gram = [mix(w.hash, 21)], [text], mix(shape, 22)
    parts.append(gram)
    owner.append(text)
    for k in (1, 2):
        gram = mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[k:], 22 + k) if n > k else gram[:0]
        ok = text[: len(gram)] == text[k : k + len(gram)]
        parts.append(gram[ok])
        owner.append(text[: len(gram)][ok])
    slot, of = np.concatenate(parts) >> np.uint64(46), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return distinct(of[order], slot[order].astype(np.int64), len(run))


@dataclass
class Model:
    weight: np.ndarray | None
    bias: float
    share: float
    ratio: np.ndarray | None = None


def fit_arrays(rows: list[np.ndarray], good: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """Log-count ratios, then dual coordinate descent for the squared hinge loss."""
    share = float(good.mean()) if len(good) else 0.5
    if not len(good) or good.all() or not good.any():
        return Model(None, 0.0, share)
    y = np.where(good, 1.0, -1.0)
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g == c]), minlength=WIDTH) + 1.0 for c in (True, False)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    # Classes weigh alike, whatever their sizes.
    c = np.where(good, cost * 0.5 / share, cost * 0.5 / (1 - share))
    scale = [ratio[r] for r in rows]
    norm = np.array([max(np.sqrt(s @ s), 1e-9) for s in scale])
    scale = [s / n for s, n in zip(scale, norm, strict=True)]
    diagonal = 0.5 / c
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r, x = rows[i], scale[i]
            gradient = y[i] * (w[r] @ x + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (2.0 + diagonal[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * x
                bias += step
    return Model(w * ratio, bias, share, ratio)


def sample_of(labelled: DataFrame, id_col: str, fit_rows: int) -> Column:
    """Condition that holds for about fit_rows rows at most, chosen by a hash of the id."""
    n = labelled.count()
    return F.lit(True) if n <= fit_rows else F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows; ``labels`` has one row per id (of several, the smallest label counts)."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    known = known.where(sample_of(known, id_col, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch["text"]):
                slot, bounds = indicators(r)
                parts = [slot[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(r.first, len(r)), batch["label"].slice(r.first, len(r)), pa.array(parts, pa.binary())], names=["id", "label", "slots"])

    joined = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(known), id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    table = joined.select(F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(run, f"id {kind}, label int, slots binary").toArrow().sort_by("id")
    rows = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in table["slots"]]
    return fit_arrays(rows, np.array(table["label"].to_pylist(), int) == 1)


def scorer(model: Model):
    """A function from a run of texts to their scores."""
    bias, share = model.bias, model.share
    weight, ratio = (None, None) if model.weight is None else (model.weight.astype(np.float32), model.ratio.astype(np.float32))

    def scores(r) -> np.ndarray:
        if weight is None:
            return np.full(len(r), share)
        slot, bounds = indicators(r)
        text = np.repeat(np.arange(len(r)), np.diff(bounds))
        margin = np.bincount(text, weight[slot], len(r))
        size = np.sqrt(np.bincount(text, ratio[slot] ** 2, len(r)))
        return 1 / (1 + np.exp(-np.clip(2 * (margin / np.maximum(size, 1e-9) + bias), -500, 500)))

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: 0 to 1, higher where label 1 is likelier."""
    bound_batches(docs.sparkSession)
    kind, scores = docs.schema[id_col].dataType.simpleString(), scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(r.first, len(r)), pa.array(scores(r), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    scores = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch[text_col]):
                yield batch.slice(r.first, len(r)).filter(pa.array(scores(r) >= least))

    return docs.mapInArrow(run, docs.schema)
