"""Benchmark decontamination by template canonicalisation.

Texts become templates: lower-cased words (A-Z), with numbers, units after a number, and names
(capitalised words inside a sentence) replaced by typed placeholders; neighbours of one type are one
placeholder. Windows of ``WINDOW`` template tokens of the documents are joined by hash with those of
the benchmark; an item with fewer tokens is one window of its own length (``LEAST`` tokens at least). An
item's first word also counts as the name that it may be inside a sentence. Items with fewer than two windows
are looked for exactly as well: by windows of up to ``WINDOW`` plain tokens, which are lower-cased words, and each
arithmetic sign and each character of three bytes or more by itself; those of up to ``ALONE`` tokens must fill
whole lines. Plain windows have no slots and are counted apart. A table of ``BITS`` bits, of fixed size, drops most windows that no item
has before the join; the join decides.

A pair (document, item) is reported when one occurrence is: its windows met cover ``coverage`` of the item's
windows and its slots are consistent: in ``consistency`` of the item's slot values that recur or not, one document
value stands for each. A window's offset is its place in the document less that in the item. Occurrences are the
windows of one offset; those of offsets within an item's length of each other (in two staggered grids, so an
insertion of up to half that length splits none); those whose slots are equal; and all together. The row tells
the best that passes: verbatim first, then by coverage. Copies have equal slots (verbatim); re-parameterised questions have other, consistent ones.

Defined results: null and empty texts have no window and match nothing; null ids are left out; a window
that occurs several times counts once per item position; repeated rows count once; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import Scratch, emit_table, merge_tables, without
from .text_arrays import Run, mix, runs, span_hashes, spans

WINDOW, LEAST, ALONE = 8, 4, 2
BITS = 1 << 25
#: Units that follow a number.
UNITS = (
    "m km cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kph percent dollar dollars euro euros cent cents usd eur degree degrees"
).split()

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in '.!?:\n"']] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "+-*/=<>^%"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _plain(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end = spans(Run(0, data, np.array([0, len(data)])), _TOKEN[data])
    return np.sort(span_hashes(data, start, end))


_UNIT = _plain(UNITS)
_PLACE = mix(np.arange(4, dtype=np.uint64), 77)


def plain_tokens(run: Run):
    """(hash, bounds per text, opens a line, ends a line) of the tokens of the exact search."""
    data = run.data
    n = len(data)
    lead = data >= 0xE0
    inside, edge, solo = _TOKEN[data] | _SIGN[data], np.zeros(n + 1, bool), lead.copy()
    edge[run.bounds] = True
    for back, least in ((1, 0xE0), (2, 0xE0), (3, 0xF0)):
        solo[back:] |= data[: max(n - back, 0)] >= least
    word = _TOKEN[data] & ~solo
    after_word = np.zeros(n, bool)
    after_word[1:] = word[:-1]
    first = inside & (lead | _SIGN[data] | word & ~after_word | edge[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    line = np.searchsorted(np.flatnonzero(data == 10), start) + np.searchsorted(run.bounds, start, "right")
    new = np.ones(len(start) + 1, bool)
    new[1:-1] = line[1:] != line[:-1]
    return span_hashes(_LOWER[data], start, end), np.searchsorted(start, run.bounds), new[:-1], new[1:]


def plain_windows(run: Run, width: int | None):
    """(text, place, hash, width) of windows of plain tokens; with ``width`` None each text's own."""
    token, of, opens, ends = plain_tokens(run)
    size, kind = np.diff(of), np.zeros(len(token), np.int8)
    out = []
    for w in [width] if width else range(1, WINDOW + 1):
        start, hashes = windows(token, kind, of, w)
        text = np.searchsorted(of, start, "right") - 1
        keep = np.ones(len(start), bool) if w == WINDOW else size[text] == w if width is None else opens[start] & ends[start + w - 1] if w <= ALONE else np.ones(len(start), bool)
        out.append((text[keep], (start - of[text])[keep], hashes[keep], np.full(int(keep.sum()), w)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def template(run: Run, opening: bool = True):
    """(template token, kind, own hash, bounds per text); kind 0 word, 1 number, 2 unit, 3 name. Without
    ``opening`` the first token of a text is taken as inside a sentence."""
    data = run.data
    start, end = spans(run, _TOKEN[data])
    own = span_hashes(_LOWER[data], start, end)
    n = len(start)
    text = np.searchsorted(run.bounds, start, "right") - 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] > digits[start]
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = first & opening
    opens[1:] |= stops[start[1:]] > stops[end[:-1]]
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~number[1:] & ~first[1:]
    unit &= np.isin(own, _UNIT)
    letter = data[start] if n else np.zeros(0, np.uint8)
    second = data[np.minimum(start + 1, len(data) - 1)] if n else letter
    capital = (letter >= 65) & (letter <= 90) | (letter == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    inner = (second >= 97) & (second <= 122) | (second >= 128)
    name = capital & inner & ~opens & ~number & ~unit
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] > 0) & ~first[1:]
    head = np.flatnonzero(~same)
    # A placeholder's own value covers all the tokens it stands for.
    place = (np.arange(n) - np.repeat(head, np.diff(np.append(head, n))) + 1).astype(np.uint64)
    value = np.add.reduceat(own * place, head) if n else own
    kind, text = kind[head], text[head]
    token = np.where(kind > 0, _PLACE[kind], own[head])
    return token, kind, np.where(kind > 0, value, own[head]), np.searchsorted(text, np.arange(len(run) + 1))


def windows(token: np.ndarray, kind: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of windows of ``width`` tokens inside a text, half of them words at least."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += token[j : j + n] * np.uint64((2 * j + 3) * 0xD6E8FEB86659FD93 & (2**64 - 1) | 1)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    plain = np.concatenate([[0], np.cumsum(kind == 0)])
    start = np.arange(n)
    keep = (start + width <= of[1:][text[:n]]) & (2 * (plain[width:] - plain[:n]) >= width)
    return start[keep], mix(total[keep], 500 + width)


def _rows(ids: pa.Array, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, kind: np.ndarray, value: np.ndarray, start: np.ndarray, width: np.ndarray) -> pa.RecordBatch:
    """Template windows with the values of their slots."""
    span = np.repeat(start, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    slot = kind[span] > 0
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(slot, np.cumsum(width) - width))]) if len(start) else np.zeros(1, int)
    slots = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value[span][slot].view(np.int64)))
    return _batch(ids, text, at, hashes, slots, np.zeros(len(text)))


def _plain_rows(ids: pa.Array, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, width: np.ndarray) -> pa.RecordBatch:
    return _batch(ids, text, at, hashes, pa.array([[]] * len(text), pa.list_(pa.int64())), width)


def _batch(ids: pa.Array, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, slots: pa.Array, plain: np.ndarray) -> pa.RecordBatch:
    columns = [ids.take(pa.array(text)), pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)), slots, pa.array(plain, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "at", "hash", "slots", "plain"])


#: plain is the width of a window of plain tokens, 0 for a template window.
WINDOWS = "id long, at int, hash long, slots array<long>, plain int"


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in runs(batch["text"]):
            ids = batch["id"].slice(r.first, len(r))
            seen = np.zeros(len(r), np.int64)
            for opening in (True, False):
                token, kind, value, of = template(r, opening)
                size = np.diff(of)
                found = [windows(token, kind, of, WINDOW)]
                widths = [np.full(len(found[0][0]), WINDOW)]
                for w in range(LEAST, WINDOW):
                    start, hashes = windows(token, kind, of, w)
                    text = np.searchsorted(of, start, "right") - 1
                    keep = size[text] == w
                    found.append((start[keep], hashes[keep]))
                    widths.append(np.full(int(keep.sum()), w))
                start, hashes = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                width = np.concatenate(widths)
                text = np.searchsorted(of, start, "right") - 1
                if opening:
                    seen += np.bincount(text, minlength=len(r))
                else:  # only the windows that hold the first token as a name
                    keep = (start == of[text]) & (kind[start] == 3)
                    start, hashes, width, text = start[keep], hashes[keep], width[keep], text[keep]
                yield _rows(ids, text, start - of[text], hashes, kind, value, start, width)
            text, at, hashes, width = plain_windows(r, None)
            keep = seen[text] < 2
            yield _plain_rows(ids, text[keep], at[keep], hashes[keep], width[keep])


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BITS - 1)).astype(np.int64)


def bit_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BITS >> 3, np.uint8)
    for batch in batches:
        at = _bit(batch["hash"].to_numpy().view(np.uint64))
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
    if table.any():
        yield emit_table(table)


def document_windows(table, short: list[int], plain: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for r in runs(batch["text"]):
                token, kind, value, of = template(r)
                for width in [WINDOW, *short]:
                    start, hashes = windows(token, kind, of, width)
                    at = _bit(hashes)
                    keep = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
                    start, hashes = start[keep], hashes[keep]
                    if len(start):
                        text = np.searchsorted(of, start, "right") - 1
                        yield _rows(batch["id"].slice(r.first, len(r)), text, start - of[text], hashes, kind, value, start, np.full(len(start), width))
                for width in plain:
                    text, place, hashes, widths = plain_windows(r, width)
                    at = _bit(hashes)
                    keep = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
                    if keep.any():
                        yield _plain_rows(batch["id"].slice(r.first, len(r)), text[keep], place[keep], hashes[keep], widths[keep])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = 0.5, consistency: float = 0.8
) -> DataFrame:
    """(id, item, n_windows, coverage, slot_consistency, verbatim) of each document and item that meet."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").dropDuplicates()
    own = scratch.table(items.mapInArrow(item_windows, WINDOWS))
    bits = merge_tables(own.mapInArrow(bit_table, "block int, data binary"), "u1", np.bitwise_or)
    schema = "id long, item long, n_windows long, coverage double, slot_consistency double, verbatim boolean"
    if not len(bits):
        return spark.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "item": item_col})
    exact = (F.col("plain") > 0).alias("exact")
    counted = own.groupBy("id", exact).agg(F.countDistinct("at").alias("n_item"), (F.max("at") - F.min("at") + WINDOW).alias("length"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # Widths below WINDOW cost a pass over the words each; all are looked for only if items that short exist.
    short = list(range(LEAST, WINDOW)) if not counted.where("n_item = 1 and not exact").isEmpty() else []
    plain = sorted(r.plain for r in own.where("plain > 0").select("plain").distinct().collect())  # WINDOW values at most
    seen = rows.mapInArrow(document_windows(spark.sparkContext.broadcast(bits), short, plain), WINDOWS)
    met = scratch.table(
        seen.withColumnRenamed("slots", "found")
        .join(own.select(F.col("id").alias("item"), F.col("at").alias("item_at"), "hash", "slots", "plain"), ["hash", "plain"])
        .select("id", "item", exact, "item_at", (F.col("at") - F.col("item_at")).alias("offset"), "found", "slots")
    )
    sized = met.join(counted.withColumnRenamed("id", "item"), ["item", "exact"])
    half = F.floor(F.col("length") / 2)
    places = [(0, F.lit(0)), (1, F.col("offset")), (2, F.floor(F.col("offset") / F.col("length"))), (3, F.floor((F.col("offset") + half) / F.col("length")))]
    place = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("nth"))
    every = F.array(*[place(k, x) for k, x in places])
    equal = F.concat(every, F.array(place(4, F.lit(0))))
    placed = sized.withColumn("p", F.explode(F.when(F.col("slots") == F.col("found"), equal).otherwise(every))).select("*", "p.kind", "p.nth")
    key = ["id", "item", "exact", "kind", "nth"]
    cover = placed.groupBy(*key).agg(F.countDistinct("item_at").alias("n_windows"), F.first("n_item").alias("n_item")).where(F.col("n_windows") >= coverage * F.col("n_item"))
    pairs = placed.select(*key, F.explode(F.arrays_zip("slots", "found")).alias("s")).select(*key, F.col("s.slots").alias("x"), F.col("s.found").alias("y"))
    # Of the values that stand for one slot value, the one seen most often: its share is the consistency.
    seen_as = pairs.groupBy(*key, "x", "y").agg(F.count("*").alias("n"))
    by_value = seen_as.groupBy(*key, "x").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.max(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("equal"))
    slots = by_value.groupBy(*key).agg(F.sum("top").alias("top"), F.sum("n").alias("n"), F.sum("equal").alias("equal"))
    found = cover.join(slots, key, "left").withColumn("share", F.coalesce(F.col("top") / F.col("n"), F.lit(1.0))).where(F.col("share") >= consistency)
    verbatim = F.coalesce(F.col("equal") >= consistency * F.col("n"), F.lit(True))
    best = found.groupBy("id", "item").agg(F.max(F.struct(verbatim.alias("verbatim"), (F.col("n_windows") / F.col("n_item")).alias("coverage"), "share", "n_windows")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.n_windows", "b.coverage", F.col("b.share").alias("slot_consistency"), "b.verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = contaminated(docs, benchmark, id_col, **options).select(id_col).distinct()
    return without(docs, Scratch(docs.sparkSession, "leaks").table(found), id_col)
