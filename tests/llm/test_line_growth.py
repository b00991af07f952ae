"""Candidates of line deduplication grow with the lines, not with the keys that lines share."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from meterlake.llm import line_dedup


def candidates_of(texts, counts, sent):
    ids = pa.array(np.arange(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(len(texts), np.int64)), pa.array(texts)], names=["d", "t", "text"])
    codes, none = SimpleNamespace(value=line_dedup.rarity(counts)), SimpleNamespace(value=(np.zeros(0, np.uint64),) * 4)
    postings = pa.Table.from_batches(line_dedup.scan_postings(1, 80, 100_000, codes, none)(iter([batch])))
    postings = postings.append_column("key", pa.array(postings["unit"].to_numpy() >> 16)).sort_by([(c, "ascending") for c in ("key", "d", "t", "line")]).drop_columns("key")
    return [(r["d"], r["d0"]) for b in line_dedup.candidates(80, sent, None)(iter(postings.combine_chunks().to_batches())) for r in b.to_pylist()]


def test_a_pair_of_lines_meets_once():
    """Near copies share each of their words, and all keys of two and three; only that of their first common words sends them on."""
    stem = [f"stem{i}" for i in range(30)]
    texts = []
    for i in range(40):
        words = list(stem)
        words[11 * i % 30] = f"own{i % 7}"
        texts.append(" ".join(words))
    for often in (40, 2000):  # keys of one word, and of up to three
        found = candidates_of(texts, np.full(line_dedup.SLOTS, often, np.uint32), (1000, 1000, 1000))
        sets = [set(t.split()) for t in texts]
        want = {(i, j) for i in range(40) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
        assert want <= set(found) and len(found) <= 2 * len(want)
