"""Each operator against brute force, and its defined results on odd inputs."""

import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterlake.llm import byte_bpe, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, quality_classifier, shards, url_filter
from meterlake.llm.text_arrays import runs, shingles, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, band int, h1 long, component_id long, lines string"


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Null, empty and blank texts, null ids and columns, repeated rows, one long text, clashing column names."""
    long = sentence(40_000)
    texts = [None, "", "   \n\t\n", "one", "one", "a b c d", "é ü ß", "\x00\x1c odd", "x" * 70_000, long, long + " tail", "same line of five words\nsame line of five words"]
    rows = [(i, t, None if i % 3 else "en", None, None, 1, 2, 3, "z") for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, "no id at all here now", "en", "s", 1, 1, 2, 3, "z")]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "z") for i, t in enumerate(texts)], DOCS)


def near_texts(n=60):
    out = []
    for _ in range(n):
        base = sentence(RNG.randint(3, 80)).split(" ")
        for _ in range(RNG.randint(1, 4)):
            copy = list(base)
            for _ in range(RNG.randint(0, 3)):
                copy[RNG.randrange(len(copy))] = RNG.choice(VOCABULARY)
            out.append(" ".join(copy))
    return out


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_words_and_shingles_by_regex():
    import pyarrow as pa

    texts = [*near_texts(10), "", "one", "A\u00a0b c\x0bd", "Ünï Ö b"]
    for run in runs(pa.array(texts), 300):
        w = words(run)
        value, of = shingles(w, 5)
        for k in range(len(run)):
            text = texts[run.first + k]
            assert w.of[k + 1] - w.of[k] == len(WORD.findall(text))
            assert len(set(value[of == k].tolist())) == len(shingle_set(text))


def test_minhash_brute_force(spark):
    texts = [*near_texts(), *["copy of one text with several words in it"] * 5, None, "", "two words"]
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), links)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_minhash_chain_and_large_group(spark):
    """Neighbours of a chain link, its ends do not: open buckets must be resolved exactly."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for step in range(40):
        texts.append(" ".join([*base[step:], *[f"n{i}" for i in range(step)]]))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == closure(range(40), links)


def test_minhash_of_shared_ids(spark):
    """Rows of one id are one document with several sets: what is near any of them is one component."""
    base = [sentence(40) for _ in range(4)]
    near = [t + " one" for t in base]
    rows = [(1, base[0]), (2, base[1]), (2, base[0]), (3, base[1]), (7, base[2]), (8, near[2]), (8, base[3]), (9, near[3]), (9, near[3]), (5, near[1]), (11, ""), (11, base[2]), (12, None), (12, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, 3, "z") for i, t in rows], DOCS)
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(i, j) for i, x in sets for j, y in sets if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = closure({i for i, _ in rows}, links)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and want[3] == want[5] == 1 and want[9] == want[11] == 7
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: max(len(x) for j, x in sets if j == i) for i in got}
    assert {i for i, r in got.items() if r["kept"]} == {1, 7, 12}


def test_overlaps_are_exact():
    sets = [np.unique(np.array([RNG.randrange(200) for _ in range(50)], np.uint64)) for _ in range(20)]
    got = minhash_dedup.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def lines_to_remove(texts, percent=80, least=5):
    seen, out = [], set()
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line.translate(LOWER))
            if len(w) >= least:
                s = frozenset(w)
                if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                    out.add((d, n))
                seen.append(s)
    return out


def line_texts():
    texts = []
    for _ in range(60):
        texts.append("\n".join(RNG.choice([sentence(RNG.randint(1, 30)), "", "the same common line in many texts", RNG.choice(near_texts(2))]) for _ in range(RNG.randint(1, 6))))
    for i in range(0, 60, 4):
        texts[i] += "\n" + texts[i // 2].split("\n")[0] + " extra"
    return texts


@pytest.mark.parametrize("sent, light, over, heavy, sizes", [((2, 16, 1024), 512, 16_384, 1_000_000, (40, 160)), ((1, 1, 1), 4, 6, 4, (10, 18)), ((1, 1, 2), 0, 3, 0, (7, 12))])
def test_line_dedup_brute_force(spark, monkeypatch, sent, light, over, heavy, sizes):
    """Also with few candidates sent on, keys of several words, keys over the bound, equal sets in the join, and matches across sizes."""
    texts = line_texts()
    for name, value in (("SENT", sent), ("LIGHT", light), ("OVER", over), ("HEAVY", heavy), ("BLOCK_LINES", over), ("SIZES", sizes)):
        monkeypatch.setattr(line_dedup, name, value)
    for least in (1, 5):
        want = lines_to_remove(texts, least=least)
        rows = line_dedup.dedup_lines(documents(spark, texts), min_words=least).collect()
        for r in rows:
            kept = [x for n, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, n) not in want]
            assert r.text == "\n".join(kept) and r.n_lines == len(texts[r.doc_id].split("\n")) and r.n_removed == r.n_lines - len(kept)


def test_line_dedup_of_one_hot_word(spark, monkeypatch):
    """One word pair in every line, and no rarer word in most: the keys that all hold are met in blocks."""
    monkeypatch.setattr(line_dedup, "LIGHT", 8)
    monkeypatch.setattr(line_dedup, "OVER", 40)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 16)
    few = [f"t{i}" for i in range(14)]
    texts = ["\n".join(" ".join(["hot", "pair", *RNG.sample(few, 6)]) for _ in range(8)) for _ in range(100)]
    want = lines_to_remove(texts, least=1)
    for r in line_dedup.dedup_lines(documents(spark, texts)).collect():
        assert r.text == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, n) not in want)


@pytest.mark.parametrize("n", [5, 31, 32, 39, 40, 127, 128, 159, 160, 880, 9727])
def test_line_keys_are_bounded(n):
    """However frequent its words, a line has few keys for each word of its prefix."""
    key = line_dedup.rarity(np.full(1, 750))[0].astype(np.uint64) << np.uint64(56) | np.arange(n, dtype=np.uint64)
    size = np.array([n])
    prefix = line_dedup.prefix_length(size, 80)
    keys = line_dedup.prefix_keys(key, np.zeros(n, np.int64), np.arange(n), prefix, 1000, *line_dedup.depths(size, 80, 3))
    assert prefix[0] <= sum(len(k[0]) for k in keys) <= 18 * prefix[0] + 40


def test_line_dedup_of_frequent_words_in_long_lines(spark, monkeypatch):
    """Lines of thousands of words that most lines hold, near copies of some, and lines of sizes about those where keys change."""
    monkeypatch.setattr(line_dedup, "LIGHT", 8)
    common = [f"w{i}" for i in range(5000)]
    lines = [RNG.sample(common, 3750) for _ in range(24)]
    for i in (3, 9, 15):
        lines.append([*lines[i][: 3750 - 40 * i], *RNG.sample(common, 40)])
        lines.append(lines[i] * 5)
    few = common[:200]
    for n in (30, 34, 38, 39, 40, 41, 46, 120, 130, 150, 158, 160, 161, 170):
        lines.append(RNG.sample(few, n))
        lines += [RNG.sample(lines[-1], n * 9 // 10), [*lines[-1], *RNG.sample(common[200:], n // 12)], RNG.sample(lines[-1], n * 7 // 10)]
    RNG.shuffle(lines)
    texts = [" ".join(x) for x in lines]
    want = lines_to_remove(texts, least=1)
    assert len(want) > 20
    for r in line_dedup.dedup_lines(documents(spark, texts)).collect():
        assert r.n_removed == ((r.doc_id, 0) in want)


def test_line_dedup_of_shared_ids(spark):
    """Rows of one id are documents of their own, the smaller text hash first; equal rows are treated alike."""
    texts = ["one two three four five six seven", "completely other words in this row here\nand more of them", "one two three four five six seven\nown line of it", "and more of them"]
    ids = [0, 1, 1, 1]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)] * 2, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    order = sorted(range(4), key=lambda k: (ids[k], 0 if ids[k] == 0 else {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}[texts[k]]))
    want = lines_to_remove([texts[k] for k in order], least=1)
    kept = [(ids[k], "\n".join(x for n, x in enumerate(texts[k].split("\n")) if (at, n) not in want)) for at, k in enumerate(order)]
    assert got == sorted(kept * 2)


def test_line_dedup_of_a_long_text(spark):
    lines = [f"w{i} x{i} y{i} z{i}" for i in range(60_000)]
    text = "\n".join(x for line in lines for x in (line, line))
    (row,) = line_dedup.dedup_lines(documents(spark, [text])).collect()
    assert row.text == "\n".join(lines) and row.n_removed == 60_000


def test_queries_compare_short_lines(spark, tmp_path):
    import corpus_pipeline
    from meterlake.llm import queries

    few = ["ab", "ba", "ab ab ba", "x y z", "x y", "p q r s", "p q r s t", "p q r t s u", "", " ", "les.", "Les.", "a a a a a", "a", "k l m n o", "k l m n"]
    texts = ["\n".join(RNG.choice([*few, sentence(RNG.randint(1, 6))]) for _ in range(RNG.randint(1, 8))) for _ in range(60)]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = lines_to_remove(texts, least=1)
    kept = ["\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want) for d, t in enumerate(texts)]
    got = {r.doc_id: r for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[d].text_sha256 for d in range(60)] == [hashlib.sha256(t.encode()).hexdigest() for t in kept]
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == dict(enumerate(kept))


def test_embeddings_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 8))
    rows = []
    for i in range(300):
        v = centers[i % 30] + rng.normal(size=8) * 0.15
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0, None, *[1.0] * 6], 0), (403, [float("nan")] * 8, 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [], 0), rows[5]]
    good = {i: np.array(v, float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = [(i, j) for i in good for j in good if j < i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j])) >= 0.93]
    want = closure(label, links)
    count = {i: sum(i in x for x in links) for i in label}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("group", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (count[i], want[i], want[i] == i) for i in label}


def test_quality_held_out(spark):
    good = [sentence(RNG.randint(20, 60)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(RNG.randint(20, 60)).split()) for _ in range(50)]
    texts = good + bad
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(200) if i % 3] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i < 150) for i in range(0, 200, 3))
    assert quality_classifier.keep(docs, model).count() == 150
    # The dual optimum: the squared hinge loss of the fitted weights can't be lowered by a step along any gradient.
    rng = np.random.default_rng(1)
    rows, good = [np.unique(rng.integers(0, 40, 8)) + (0 if k % 2 else 10) for k in range(80)], np.arange(80) % 2 == 1
    fitted = quality_classifier.fit_arrays(rows, good, epochs=300)
    ratio = fitted.ratio
    x = np.zeros((80, len(ratio)))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt(ratio[r] @ ratio[r])
    w = np.divide(fitted.weight, ratio, out=np.zeros(len(ratio)), where=ratio != 0)
    y, c = np.where(good, 1.0, -1.0), quality_classifier.COST
    loss = lambda w, b: (w @ w + b * b) / 2 + c * (np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    slack = np.maximum(0, 1 - y * (x @ w + fitted.bias))
    step, step_b = w - 2 * c * x.T @ (slack * y), fitted.bias - 2 * c * (slack * y).sum()
    assert loss(w, fitted.bias) <= loss(w - 1e-3 * step, fitted.bias - 1e-3 * step_b) + 1e-3 and np.abs(step).max() < 0.05 * c
    none = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {1.0}


def test_language_held_out(spark):
    alphabets = {"aa": "abcde", "bb": "efghi", "cc": "äöüßa", "dd": "абвгд"}
    rows = []
    for i in range(200):
        lang = list(alphabets)[i % 4]
        rows.append((i, " ".join("".join(RNG.choice(alphabets[lang]) for _ in range(5)) for _ in range(20)), lang if i % 5 else None))
    rows += [(200, None, "aa"), (201, "12 34 !!", "bb"), (202, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.prototypes(docs)).collect()}
    assert all(got[i].lang_pred == list(alphabets)[i % 4] for i in range(200))
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[202].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "<|endoftext|>", "日本語🙂 naïve café\r\n\t  x", "'s 're don't", "  \n\n  a", "\u00a0\u2003z\x1c\x85", "a" * 3000, "1234567 12.5%", *near_texts(5)]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, TOKENIZER, PATTERN, offsets=True), TOKENIZER).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == reference.encode_ordinary(t) and rows[i].n_tokens * 4 == len(rows[i].ids)
        assert bytes(rows[i].decoded).decode() == t
        if t:
            assert rows[i].starts[0] == 0 and rows[i].ends[-1] == len(t) and all(a < b for a, b in zip(rows[i].starts, rows[i].ends, strict=True))


def test_decontamination(spark):
    item = "Last week Anna bought 12 apples and 30 pears in Paris for 5 kg of soup and gave 12 apples to her older brother today"
    changed = item.replace("12", "40").replace("Anna", "Peter").replace("30", "7")
    broken = item.replace("bought 12", "bought 40").replace("Anna", "Bob")
    texts = [sentence(50), f"{sentence(20)}. {item} {sentence(10)}", f"{sentence(5)}\n{changed}\n{sentence(5)}", " ".join(item.split()[:6]), None, "", broken, "tiny five word item here now"]
    bench = spark.createDataFrame([(1, item), (2, sentence(30)), (3, None), (4, ""), (5, "tiny five word item here")], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert {(1, 1), (2, 1), (7, 5)} <= set(rows) and not {d for d, _ in rows} & {0, 3, 4, 5}
    assert rows[(1, 1)].verbatim and not rows[(2, 1)].verbatim and rows[(2, 1)].slot_consistency == 1.0
    kept = {r.doc_id for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    assert {0, 3, 4, 5} <= kept and not kept & {1, 2, 7}


def test_decontamination_by_occurrence(spark):
    item = "Last week Anna bought 12 apples and 30 pears in Paris for 5 kg of soup and gave 12 apples to her older brother today"
    other = [item.replace("12", str(40 + k)).replace("Anna", n).replace("30", str(70 + k)).replace("Paris", p).replace("5 kg", f"{k + 6} kg") for k, (n, p) in enumerate([("Peter", "Rome"), ("Eva", "Oslo"), ("Tom", "Bern"), ("Ida", "Kiel")])]
    late = other[0].replace(" of soup", " of very good and hot soup")
    torn = item.replace("bought 12", "bought 40")
    texts = [f"{item}. {other[0]}", ". ".join(other), ". ".join([*other, item]), ".\n".join([late, *other[1:3]]), f"{sentence(30)}. {late}", sentence(60), " ".join(item.split()[:6]), torn]
    rows = {r.doc_id: r for r in decontaminate.contaminated(documents(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(range(5)) <= set(rows) and not {5, 6} & set(rows)
    assert [rows[i].verbatim for i in range(4)] == [True, False, True, False] and rows[1].slot_consistency == 1.0 and rows[0].coverage == 1.0


def test_decontamination_of_items_without_windows(spark):
    items = ["12 + 34 = 46", "Anna Smith, Peter Jones, Eva Brown, Tom White, Ida Green, Max Black", "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u826f\u3044\u3067\u3059\u306d", "Yes", "Solve the riddle of seven locked doors tonight", "46 / 2"]
    hold = [f"{sentence(9)} (12 + 34 = 46) {sentence(9)}", f"{sentence(9)}: with {items[1]} and {sentence(9)}", f"\u6700\u521d\u306b{items[2]}\u3068\u8a00\u3046", f"{sentence(4)}\nyes.\n{sentence(3)}", f"Question 5) {items[4]} {sentence(9)}", f"so 46 / 2 {sentence(3)} and 46/2"]
    clean = ["yes it is", "12 34 46", "12 - 34 = 46", "Anna Jones, Peter Smith and Eva Black", "\u5929\u6c17\u4eca\u65e5", "Solve the riddle"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, [*hold, *clean]), bench).collect()}
    assert got == {(i, i) for i in range(6)}


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_url_rules_and_templates(spark):
    urls = ["http://A.Example.com/en/71", "http://x.example.com/en/8?q", "https://example.net/de/8/a", "http://b.net/de/1", "http://org/es/", "notaurl", None, "x://h", "ftp://c.org/fr/1#en", "http://acom/en/1"]
    want = ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None]
    spam = [f"http://spam.io/buy/{i}" for i in range(60)] + [f"http://spam.io/about/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + spam)], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([("spam.io", f"/buy/{i}", 1) for i in range(40)] + [("spam.io", f"/about/{i}", 0) for i in range(40)], "host string, path string, bad int").withColumn("template", F.lit("clash"))
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES), labels).collect()}
    assert [rows[i].rule for i in range(10)] == want
    assert [rows[i].verdict for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (rows[0].host, rows[0].path, rows[5].host, rows[6].path) == ("a.example.com", "/en/71", "", "")
    assert {rows[i].verdict for i in range(10, 70)} == {"block"} and {rows[i].verdict for i in range(70, 130)} == {"allow"}
    assert rows[10].template == "/buy/*"


def test_url_branches_merge_upwards(spark):
    """Inner branches of equal purity merge; one that differs below stays split, and its sibling with it."""
    leaf = [("h", f"/{a}/{b}/*", 30, bad) for a, b, bad in [("x", "p", 3), ("x", "q", 3), ("y", "p", 4), ("y", "q", 3), ("z", "p", 28), ("z", "q", 27)]]
    leaf += [("g", "/x/p/*", 30, 3), ("g", "/x/q/*", 30, 28), ("g", "/y/p/*", 30, 3), ("g", "/y/q/*", 30, 4), ("g", "/w/*", 0, 0), ("k", "/a", 5, 1), ("k", "/a/*", 6, 1)]
    df = spark.createDataFrame(leaf, "host string, template string, n long, bad long")
    got = {(r.host, r.template): r.branch for r in url_filter.branches(df, url_filter.Scratch(spark, "t")).collect()}
    of = lambda h, *t: {got[h, x] for x in t}
    assert len(of("h", "/x/p/*", "/x/q/*", "/y/p/*", "/y/q/*")) == 1 and len(of("h", "/z/p/*", "/z/q/*")) == 1 and len({b for (h, _), b in got.items() if h == "h"}) == 2
    assert len(of("g", "/x/p/*", "/x/q/*")) == 2 and len(of("g", "/y/p/*", "/y/q/*")) == 1 and len({b for (h, _), b in got.items() if h == "g"}) == 4
    assert len({b for (h, _), b in got.items() if h == "k"}) == 1 and len(got) == len(leaf)


def test_url_rules_by_plain_python(spark):
    from meterlake.llm import queries

    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = queries.op4_url_filter(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(pages)
    for r in rows:
        url = pages[r.page_id]
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url, re.S) if url else None
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(x), x, v) for v, x in RULES for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.purity >= url_filter.REJECT else "allow")


def test_url_sections_of_large_and_deep_hosts(spark):
    urls = [("big.io", f"/s{k}/{i}") for k in range(60) for i in range(70)]
    urls += [("deep.io", f"/a/b/c/d/e/f/g/h/{s}/{i}") for s in ("bad", "good") for i in range(40)]
    urls += [("ids.io", f"/u{k}/{25 * k + i}") for k in range(100) for i in range(25)]
    pages = spark.createDataFrame([(n, f"http://{h}{p}") for n, (h, p) in enumerate(urls)], "page_id long, url string")
    bad = lambda h, p: int("/bad/" in p or h == "big.io" and p.startswith("/s7/") or h == "ids.io" and p.startswith("/u7/"))
    labels = spark.createDataFrame([(h, p, bad(h, p)) for h, p in urls if int(p.rsplit("/", 1)[1]) % 2], "host string, path string, bad int")
    rows = url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES), labels).collect()
    assert len(rows) == len(urls) and all((r.verdict == "block") == bool(bad(r.host, r.path)) for r in rows)
    found = {r.path: r.template for r in rows}
    assert found["/s1/1"] == "/s1/*" and found["/u7/181"] == "/u7/*" and found["/u8/201"] == "/*/*"


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", base=1000, ratio=4, fan_in=3, target=1 << 20)
    assert store.read() is None and store.compact() == 0
    for k in range(5):
        store.append(documents(spark, [f"{k} {i}" for i in range(10)]).coalesce(1))
    before = store.read().count()
    version = store.compact()
    assert version > 5 and store.read().count() == before == 50 and len(store.runs()) < 5
    assert store.read(5).count() == 50  # an older version still reads until vacuum
    with pytest.raises(shards.Conflict):
        store.commit([], version)
    store.vacuum()  # all is too young to go
    assert store.read(5) is not None
    store.vacuum(0)
    rows = shards.placements(store, "doc_id").collect()
    assert len(rows) == 50 and {r.version for r in rows} == {version}
    assert json.dumps([r.name for r in store.runs()])


def test_shards_keep_odd_rows(spark, tmp_path):
    """Rows of each version against a list, with nulls, repeated rows, an empty arrival and clashing names."""
    from meterlake.llm import queries

    rows = [(1, None, 1, 2), (1, None, 1, 2), (None, "x", 3, 4), (2, "y" * 50_000, None, None)]
    schema = "doc_id long, text string, arrival int, run int"
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    want = []
    for part in (rows, [], rows[:2], rows[2:]):
        store.append(spark.createDataFrame(part, schema).coalesce(1))
        want += part
    assert store.version() == 3
    store.compact()
    assert sorted(map(repr, map(tuple, store.read().collect()))) == sorted(map(repr, want))
    assert {r.doc_id for r in shards.placements(store, "doc_id").collect()} == {1, 2, None}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_sharding(spark, str(tmp_path)).count() == 0


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [(0, f"{sentence(50)}\n{apache}.\n{sentence(20)}", "p/a/x.txt"), (1, "Released under the MIT License.", "p/LICENSE"), (2, sentence(30), "p/b/y.txt"), (3, sentence(30), "q/z.txt"), (4, None, "p/c.txt"), (5, "", None), (6, "the license of truth is never quite granted to readers of tales", "q/l.txt"), (None, apache, "q/LICENSE")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert (got[0].license, got[0].origin) == ("Apache-2.0", "header")
    assert (got[1].license, got[2].license, got[2].origin, got[2].directory, got[4].license) == ("MIT", "MIT", "directory", "p/", "MIT")
    assert got[3].license is None and got[5].license is None and got[6].license is None and set(got) == set(range(7))


def test_license_texts(spark):
    whole = {name: text for name, text in license_scan.WHOLE}
    wrap = lambda text, n=11: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + sentence(300)
    texts = [gpl, *(f"Copyright (c) 2020 A. Person\n\n{wrap(whole[k])}" for k in sorted(whole)), wrap(whole["MIT"][-480:]), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", sentence(400)]
    want = ["GPL-3.0", *sorted(whole), "MIT", "ISC", None]
    rows = [(i, t, f"p{i}/{i}.txt") for i, t in enumerate(texts)]
    rows += [(100 + i, sentence(9), f"p{i}/a/b.txt") for i in range(len(texts))]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows + rows[:3], "doc_id long, text string, path string")).collect()}
    assert [got[i].license for i in range(len(texts))] == want
    assert [got[100 + i].license for i in range(6)] == want[:6] and all(got[i].origin == "file" for i in range(6)) and got[100 + len(texts) - 1].license is None


def test_long_licences_and_their_parts(spark):
    """Whole texts of long licences, and their first and last two thirds, are that licence and no relative of it."""
    whole = {name: text for name, text in license_scan.WHOLE if len(text) > 5000}
    assert set(whole) == {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    cut = lambda text: (text, text[len(text) // 3 :], text[: 2 * len(text) // 3], "Copyright 2021 A. Person\n\n" + text)
    rows = [(name, part) for name, text in sorted(whole.items()) for part in cut(text)]
    filler = [(None, sentence(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, f"p{i}/x.txt") for i, (_, t) in enumerate(rows + filler)], "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.origin) for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [(name, "file") for name, _ in rows]
    assert all(got[i] == (None, None) for i in range(len(rows), len(rows) + 40))


def test_license_cosines_by_plain_python(spark):
    import math

    term = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
    texts = [f"{sentence(6)} released under the MIT license {sentence(2)}", "licensed under the apache license version 2.0 and more of it", "MIT License", sentence(5)]
    sorts = {whole: sort.of for whole, sort in zip((False, True), license_scan.SORTS, strict=True)}
    known = {whole: {t for *_, x in of for t in term.findall(x.lower())} for whole, of in sorts.items()}
    docs = [term.findall(t.lower()) for t in texts]
    weigh = lambda t, whole: math.log((1 + len(docs)) / (1 + max(1, sum(t in d for d in docs)) if t in known[whole] else 2)) + 1
    vector = lambda words, whole: {t: words.count(t) * weigh(t, whole) for t in words}
    cosine = lambda a, b: sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    of = lambda d, whole: min((-round(cosine(vector(d, whole), vector(term.findall(x.lower()), whole)), 6), n) for n, _, x in sorts[whole])
    best = [next((b for b in (of(d, True), of(d, False)) if -b[0] >= 0.3), (0, None)) for d in docs]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, path string"), least=0.3).collect()}
    for i, (minus, name) in enumerate(best):
        assert (got[i].license, got[i].score) == ((name, pytest.approx(-minus, abs=2e-6)) if -minus >= 0.3 else (None, None))


def test_odd_inputs_and_empty_tables(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS)
    empty = docs.limit(0)
    near = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert set(near) == set(range(12)) and near[0].n_shingles == near[1].n_shingles == near[2].n_shingles == 0 and near[4].component_id == 3 and near[10].component_id == 9
    assert minhash_dedup.drop_near_duplicates(docs).where("doc_id is null").count() == 1
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[11].text == "same line of five words" and lines[0].text is None and lines[0].n_lines == 0 and lines[2].n_removed == 0
    assert language_id.identify(docs, language_id.prototypes(docs)).count() == docs.count()
    model = quality_classifier.fit(docs, spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, quality int"))
    assert quality_classifier.score(docs, model).count() == docs.count()
    encoded = byte_bpe.decode(byte_bpe.encode(docs, TOKENIZER, PATTERN), TOKENIZER).collect()
    want = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert sorted(hashlib.sha256(bytes(r.decoded)).hexdigest() for r in encoded) == want
    bench = spark.createDataFrame([(1, sentence(20))], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert language_id.identify(empty, language_id.prototypes(empty)).count() == 0
    assert quality_classifier.score(empty, quality_classifier.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "host string, path string, bad int")
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES), labels).count() == 0
    assert license_scan.scan_licenses(empty.withColumn("path", F.lit("a/b"))).count() == 0
    assert byte_bpe.encode(empty, TOKENIZER, PATTERN).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(rows) <= docs.count() and all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, extra and clashing columns, and an empty table pass every stage."""
    import corpus_pipeline

    docs = spark.createDataFrame(odd_rows(), DOCS).withColumnsRenamed({"band": "text_sha256", "component_id": "n_removed"})
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0), docs.drop("n_chars", "lang")):
            out = stage(spark, rows, str(tmp_path))
            found = out.collect()
            assert (len(found) == 0) if rows.isEmpty() else 0 < len(found) <= docs.count()
            assert name == "bpe" or [c for c in rows.columns if c not in ("n_removed",)] == [c for c in out.columns if c not in ("n_removed",)]
