"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

Merging always joins the neighbours whose joined piece scores highest, the leftmost of equals. Cut the result
of a text anywhere between two tokens, and each side is the result of that side alone: no merge crossed the cut.
So each prefix of a text has one last token, and two tokens may stand side by side exactly if merging the two
alone leaves them apart. The table is filled from left to right: an automaton over the pieces finds those that end at
a character, and the one that may follow the last token before it is entered. Ids are recovered from the
end backwards. A character is always a token: where it is no piece, it is written as its bytes' ids.

No piece has a word mark after another character in the usual models, and some characters (line ends) are in no
longer piece, so texts are cut there, each distinct part is encoded once, and a worker keeps the ids of up to
``KEPT_PARTS`` short parts. A mark that some piece has after a character is no cut behind it. Normalising is the library's, and so is decoding.

Defined results: null encodes like the empty text, to no ids; repeated ids and rows are kept as they are; very
long texts go alone in a run; null ids decode to the empty text; empty tables give empty results; other columns are
kept, those named like the new ones are replaced. Only BPE models with byte fallback and without pieces of the
user's or unused ones are taken.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import _kept, _with
from .spark_tools import bound_batches
from .text_arrays import list_array, runs

MARK = "▁"
KEPT_PARTS, KEPT_LENGTH, KEPT_PAIRS = 200_000, 40, 2_000_000


@lru_cache(maxsize=2)
def _processor(model: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


class PrefixTable:
    """The pieces of a model, and what encodes one part of a text with them."""

    def __init__(self, model: str):
        sp = _processor(model)
        every = range(sp.get_piece_size())
        self.ids = {sp.id_to_piece(i): i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.score = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.byte = {int(sp.id_to_piece(i)[3:-1], 16): i for i in every if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError(f"{model} has no byte fallback")
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # A piece that merging does not make of its own characters is never a token.
            if len(piece) > 1 and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        joined = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        before = "".join(re.escape(c) for c in sorted({c for piece in self.ids for c, mark in zip(piece, piece[1:], strict=False) if mark == MARK != c}))
        inner = f"[^{MARK}{alone}]" + (f"|(?<=[{before}]){MARK}" if before else "")
        self.cut = re.compile(f"{MARK}*(?:{inner})+|{MARK}+" + (f"|[{alone}]" if alone else "")).findall

    def merged(self, text: str) -> list[str]:
        """Merging as defined, for texts as short as two pieces."""
        out, score = list(text), self.score
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = score.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves the two tokens apart."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        fits = self.fits[a, b] = a + b not in self.score and self.merged(a + b) == [a, b]
        return fits

    def last_tokens(self, part: str) -> list[str]:
        """The last token of each prefix, by the prefix's length; that of the empty one is empty."""
        last, known = [""], self.fits.get
        for at, piece in self.automaton.iter(part):
            while len(last) <= at:
                last.append(part[len(last) - 1])  # no longer piece may end there
            start = at + 1 - len(piece)
            if len(last) == at + 1 and start:
                pair = last[start], piece
                fits = known(pair)
                if self.compatible(*pair) if fits is None else fits:
                    last.append(piece)
            elif not start:
                last.append(piece)
        while len(last) <= len(part):
            last.append(part[len(last) - 1])
        return last

    def encode(self, part: str) -> bytes:
        last, end, out = self.last_tokens(part), len(part), []
        while end:
            token = last[end]
            if token in self.ids:
                out.append(self.ids[token])
            else:
                out += [self.byte[b] for b in reversed(token.encode())]
            end -= len(token)
        return array("i", out[::-1]).tobytes()


@lru_cache(maxsize=2)
def _encoder(model: str):
    """A function from texts to their ids."""
    table, normalize, known = PrefixTable(model), _processor(model).normalize, {}

    def encode_texts(texts: list[str | None]) -> list[np.ndarray]:
        parts = [table.cut(normalize(t)) if t else [] for t in texts]
        new = set().union(*parts).difference(known)
        known.update((p, table.encode(p)) for p in new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), "<i4") for p in parts]
        if len(known) > KEPT_PARTS:
            known.clear()
        else:
            for p in new:
                if len(p) > KEPT_LENGTH:
                    del known[p]
        return out

    return encode_texts


def encode(docs: DataFrame, model: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids (an array of ints) in place of the text; with decoded, also the text that they stand for."""
    bound_batches(docs.sparkSession)
    fields = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))] + [("decoded", T.StringType())] * decoded
    drop = {text_col.lower(), *(n for n, _ in fields)}
    schema = _with(docs.drop(text_col), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, sp = _encoder(model), _processor(model)
        for batch in batches:
            for r in runs(batch[text_col]):
                ids = encoded(batch[text_col].slice(r.first, len(r)).to_pylist())
                size = np.array([len(x) for x in ids], np.int64)
                new = [pa.array(size), list_array(np.concatenate(ids), np.concatenate([[0], np.cumsum(size)]), pa.int32())]
                if decoded:
                    new.append(pa.array(sp.decode([x.tolist() for x in ids], num_threads=1), pa.string()))
                kept = [(n, c.slice(r.first, len(r))) for n, c in _kept(batch, drop)]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + new, names=[n for n, _ in kept] + [n for n, _ in fields])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded: the texts that the ids stand for."""
    schema = _with(encoded, ("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = sp.decode([x or [] for x in part[ids_col].to_pylist()], num_threads=1)
                kept = _kept(part, {"decoded"})
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(texts, pa.string())], names=[*(n for n, _ in kept), "decoded"])

    return encoded.mapInArrow(run, schema)
