"""Fill-in-the-middle, SentencePiece and hard negatives against plain Python, and on odd inputs."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterlake.llm import fill_middle, hard_negatives, sentencepiece_bpe
from meterlake.llm.text_arrays import Run

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
RNG = random.Random(11)
DOCS = "doc_id long, text string, n int, form string, output string, ids string, decoded int, draw string"
LONG = "".join(RNG.choice("abcdé \n\t") for _ in range(200_000))
TEXTS = [None, "", " ", " \n\t ", "one", " one ", "a b  c\td\ne ", "中文 ｘ é́ \U0001f600", "holds <P> itself", "holds <M>", "<S>", "x<P y>S>", "\x00 nul \x1c", "▁ mark▁s  ▁", "same twice", "same twice", LONG, "z" * 30_000, " " * 3000]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([*((i, t, 1, "f", "o", "i", 2, "d") for i, t in enumerate(texts)), (None, "no id here", 1, "f", "o", "i", 2, "d"), (4, "other text of id four", 1, "f", "o", "i", 2, "d")], DOCS)


def filled(doc_id, text, rate=50, spm=80):
    text = text or ""
    t = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(t), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100)])
def test_fill_middle_by_plain_python(spark, rate, spm):
    docs = rows(spark)
    made = fill_middle.transform(docs, rate=rate, spm=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert set(made.columns) == {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "ids", "decoded", "draw", "back"}
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"], r["draw"]) for r in made.collect()), key=str)
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *filled(r["doc_id"], r["text"], rate, spm), r["text"] or "", "d") for r in docs.collect()), key=str)
    assert got == want


def test_fill_middle_of_parts_like_sentinels(spark):
    texts = ["".join(p) for p in itertools.product(("<", "P", ">", "S ", "<S", " M>"), repeat=4)]
    made = fill_middle.transform(rows(spark, texts), rate=100).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert {(r["doc_id"], r["back"]) for r in made.collect() if r["doc_id"] not in (None, 4)} == {(i, t) for i, t in enumerate(texts) if i != 4}


def test_rank_index_is_exact_and_short():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 4000, 0, 20_000, 2]
    x = np.cumsum(np.concatenate([rng.integers(1, 12, n) if n != 4000 else rng.integers(1, 2000, n) for n in sizes]))
    first = np.concatenate([[0], np.cumsum(sizes)])
    index = fill_middle.RankIndex(x, first)
    at = np.arange(len(x))
    assert (index[at] == x).all() and (np.abs(x - index.predict(at)) <= fill_middle.ERROR).all()
    assert (index.start == first[:-1][np.array(sizes) > 0][:, None]).any(axis=1).sum() == 5 and len(index.start) < 3000
    assert np.searchsorted(index.start, first[5]) and ((index.start >= first[5]) & (index.start < first[6])).sum() < 100


def test_boundaries_of_runs():
    texts = ["", "a b", "", "  ", "x ", " y"]
    data = "".join(texts).encode()
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, first = fill_middle.boundaries(Run(0, np.frombuffer(data, np.uint8), bounds))
    for i, t in enumerate(texts):
        assert (x[first[i] : first[i + 1]] - bounds[i]).tolist() == [0, *itertools.accumulate(len(w) for w in TOKEN.findall(t))]


def test_sentencepiece_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    letters = [*"ab \n\tthe   ▁éЖ中文ｘ한\x00<>s/0x", "\U0010ffff", "\U0001f600", "́", "ing", "▁▁"]
    texts = [*TEXTS, *("".join(RNG.choice(letters) for _ in range(RNG.randint(0, 60))) for _ in range(1500)), *(" " * k + "▁" * (k % 7) + "a" * k for k in range(60)), "<s></s><unk><0x0A>"]
    docs = rows(spark, texts)
    both = sentencepiece_bpe.encode(docs, MODEL, decoded=True)
    assert set(both.columns) == {"doc_id", "n", "form", "output", "draw", "n_tokens", "ids", "decoded"}
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["ids"], r["decoded"]) for r in both.collect()), key=str)
    want = sorted(((str(r["doc_id"]), len(ids := sp.encode(r["text"] or "")), ids, sp.decode(ids)) for r in docs.collect()), key=str)
    assert got == want
    again = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, MODEL), MODEL)
    assert sorted(r["decoded"] for r in again.collect()) == sorted(w[3] for w in want)
    assert sentencepiece_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).first()["decoded"] == ""


def test_prefix_table_holds_each_prefix():
    """The table's last token of every prefix is the library's."""
    from sentencepiece import SentencePieceProcessor

    sp, table = SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.PrefixTable(MODEL)
    for word in ("▁internationalization", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁a", "▁中中文aé\U0001f600b", "▁aaaaaaaaaaaaaaaaaaaaaaa"):
        last = table.last_tokens(word)
        for end in range(2, len(word) + 1):
            text = word[:end]
            pieces = sp.encode(text[1:].replace("▁", " "), out_type=str)
            assert last[end] == (pieces[-1] if not pieces[-1].startswith("<0x") else text[-1])
    for a, b in itertools.product(("▁the", "re", "s", "▁▁", "▁", "in", "ing", "g"), repeat=2):
        assert table.compatible(a, b) == (table.merged(a + b) == [a, b])


VECTORS = "vec_id long, embedding array<double>, label int, extra string, v int, cluster string, rank long"


def mined(data, positives=5, negatives=3, low=50, high=95, is_anchor=lambda i: i % 5 == 0):
    good = {}
    for i, v, label, *_ in data:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = max(good.get(i, (str(label), v)), (str(label), v))
    score = lambda a, b: min(max(sum(int(x) * int(y) for x, y in zip(good[a][1], good[b][1], strict=True)), -(2**63) + 1), 2**63 - 1)
    out = set()
    for a in filter(is_anchor, good):
        others = [(-score(a, b), b, good[b][0] == good[a][0]) for b in good if b != a and len(good[b][1]) == len(good[a][1])]
        others.sort()
        for s, p, _ in [o for o in others if o[2]][:positives]:
            hard = [(n, b) for n, b, same in others if not same and -low * s <= -100 * n <= -high * s][:negatives]
            out |= {(a, p, k + 1, b, -s, -n) for k, (n, b) in enumerate(hard)}
    return out


def check(spark, data, **limits):
    df = spark.createDataFrame([(*r, "x", 1, "c", 2) for r in data], VECTORS)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 5 == 0, **limits).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(data, **limits)
    return got


@pytest.mark.parametrize("cells, step, members, cluster", [(1 << 22, 1024, 512, 128), (2048, 16, 8, 4)])
def test_hard_negatives_brute_force(spark, monkeypatch, cells, step, members, cluster):
    """With ties, a hot vector, clusters of anchors split over groups, and negative scores."""
    for name, value in {"CELLS": cells, "STEP": step, "MEMBERS": members, "CLUSTER": cluster}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    centre = rng.integers(-9, 9, (6, 8))
    x = centre[rng.integers(0, 6, 700)] + rng.integers(-3, 4, (700, 8))
    x[100:300] = x[100]
    x[300:330] = 0
    data = [(i, [float(c) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    assert len(check(spark, data)) > 500
    check(spark, data, positives=2, negatives=1, low=0, high=100)


def test_hard_negatives_of_odd_rows(spark):
    data = [(0, [1.0, 2.0], 1), (5, [1.0, 2.0], None), (10, None, 1), (15, [None, 1.0], 1), (20, [float("nan"), 1.0], 1), (25, [float("inf"), 1.0], 1), (30, [], 1), (None, [1.0, 2.0], 1)]
    data += [(i, [float(i), 3.0], i % 3) for i in range(31, 60)] + [(i, [float(i), 3.0, 1.0], i % 2) for i in range(60, 90)]
    data += [(40, [9.0, 9.0], 2), (40, [9.0, 9.0], 2), (100, [2.0**40, 1.0], 1), (101, [2.0**40, 3.0], 1), (102, [2.0**39 + 1, 5.0], 2), (105, [1.0, 1.0], 77)]
    assert check(spark, data)
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("id") % 5 == 0).count() == 0
    assert check(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_walks_stop_early():
    """Tight clusters certify the end of the walk before the list ends."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(8, 16)) * 100
    y = np.rint(np.repeat(centre, 4000, axis=0) + rng.normal(size=(32_000, 16)))
    x, ids = y[:50], np.arange(len(y))
    best = hard_negatives.Best(len(x), 3)
    seen = []

    def take(m, score, places):
        seen.append(len(m) * len(places))
        i, j = np.nonzero(best.beaten(m, score, ids[places]))
        best.offer(m[i], score[i, j], ids[places[j]])

    mean = hard_negatives.directions(hard_negatives.directions(x).sum(axis=0, keepdims=True))[0]
    hard_negatives.walk(x, mean, y, ids, lambda m: best.score[m, -1], take)
    full = x @ y.T
    want = [sorted(range(len(y)), key=lambda c: (-row[c], c))[:3] for row in full]
    assert best.id.tolist() == want and sum(seen) < full.size / 4
