"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Encoding cuts whole texts into the pieces that the vocabulary's pattern matches. The tokenizers
library merges each distinct piece once, in batches (``Tokenizer.encode`` of pieces, no special
tokens: their strings are ordinary text); a worker keeps the ids of up to ``KEPT_PIECES`` short pieces.
Ids travel as little-endian unsigned 32-bit integers. Decoding reverses the byte-to-character table of byte-level vocabularies: each id
has its bytes, and a document's bytes are their concatenation, so characters split between tokens
come back whole. ``offsets=True`` adds each token's character range; a token that holds only part
of a character gets the range of that character.

Defined results: null encodes like the empty text, to no ids; repeated ids and rows are kept as
they are; very long texts go alone in a run; other columns are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .spark_tools import bound_batches
from .text_arrays import runs

RUN_BYTES = 256_000
KEPT_PIECES, KEPT_LENGTH = 200_000, 40


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones
    for themselves, the other bytes in order from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # pieces come cut
    return t


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """A function from texts to their ids as bytes."""
    tokenizer, cut, known = _tokenizer(path), regex.compile(pattern).findall, {}

    def merged(new: list[str]) -> list[bytes]:
        e = tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        end = 4 * np.searchsorted(np.array(e.word_ids), np.arange(len(new) + 1))
        return [ids[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]

    def encode_texts(texts: list[str | None]) -> list[bytes]:
        pieces = [cut(t) if t else [] for t in texts]
        new = list(set().union(*pieces).difference(known))
        if new:
            known.update(zip(new, merged(new), strict=True))
        out = [b"".join(map(known.__getitem__, p)) for p in pieces]
        if len(known) > KEPT_PIECES:
            known.clear()
        else:
            for piece in new:
                if len(piece) > KEPT_LENGTH:
                    del known[piece]
        return out

    return encode_texts


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids' bytes in one array, and where each id's bytes begin (one entry more than ids)."""
    back = byte_characters()
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in table])])


def bytes_of(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The concatenated bytes of ids."""
    data, start = table
    size = (start[1:] - start[:-1])[ids]
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint8)
    return data[np.arange(total) + np.repeat(start[:-1][ids] - np.cumsum(size) + size, size)]


def character_offsets(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, of each token."""
    size = np.diff(table[1])[ids]
    end = np.cumsum(size)
    if not len(ids):
        return end, end
    character = np.cumsum((bytes_of(ids, table) & 0xC0) != 0x80)
    return character[end - size] - 1, character[end - 1]


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    names = {f[0].lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + [T.StructField(n, k) for n, k in fields])


def _kept(batch: pa.RecordBatch, drop: set[str]) -> list[tuple[str, pa.Array]]:
    return [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in drop]


def encode(docs: DataFrame, tokenizer: str, pattern: str, text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids in place of the text; with starts and ends, the character offsets; with
    decoded, the bytes that the ids stand for, so that a round trip needs one pass through Python."""
    bound_batches(docs.sparkSession)
    drop = {text_col.lower(), "n_tokens", "ids"} | ({"starts", "ends"} if offsets else set()) | ({"decoded"} if decoded else set())
    fields = [("n_tokens", T.LongType()), ("ids", T.BinaryType())]
    if offsets:
        fields += [("starts", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType()))]
    if decoded:
        fields.append(("decoded", T.BinaryType()))
    schema = _with(docs.drop(text_col), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, table = _encoder(tokenizer, pattern), byte_table(tokenizer)
        for batch in batches:
            text = batch[text_col]
            for r in runs(text, RUN_BYTES):
                ids = encoded(text.slice(r.first, len(r)).to_pylist())
                out = [(n, c.slice(r.first, len(r))) for n, c in _kept(batch, drop)]
                out += [("n_tokens", pa.array([len(x) // 4 for x in ids], pa.int64())), ("ids", pa.array(ids, pa.binary()))]
                if offsets:
                    both = [character_offsets(np.frombuffer(x, "<u4"), table) for x in ids]
                    out += [(n, pa.array([b[k] for b in both], pa.list_(pa.int64()))) for k, n in enumerate(("starts", "ends"))]
                if decoded:
                    out.append(("decoded", pa.array([bytes_of(np.frombuffer(x, "<u4"), table).tobytes() for x in ids], pa.binary())))
                yield pa.RecordBatch.from_arrays([c for _, c in out], names=[n for n, _ in out])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded: the bytes that the ids stand for (null ids: none)."""
    schema = _with(encoded, ("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(tokenizer)
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, 256)
                at += 256
                back = [bytes_of(np.frombuffer(x.as_buffer(), "<u4"), table).tobytes() if x.is_valid else b"" for x in part[ids_col]]
                out = [*_kept(part, {"decoded"}), ("decoded", pa.array(back, pa.binary()))]
                yield pa.RecordBatch.from_arrays([c for _, c in out], names=[n for n, _ in out])

    return encoded.mapInArrow(run, schema)
