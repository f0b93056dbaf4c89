"""Token ids of whole texts by the tokenizers library, with every distinct piece of text merged once.

A byte-level BPE first cuts a text into pieces, and its merges never cross a cut. So a text's ids are those of its
pieces, in order. The cuts of whole Arrow batches are found by array operations; pieces repeat, so only the distinct
ones go to the library's merges, and their ids are remembered. Texts that hold one of the tokenizer's added tokens, and
all texts of any other kind of tokenizer, are encoded whole by the library.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ._words import chunks

#: Remembered pieces for each worker: when more have come, it starts anew. This bounds memory, not results.
REMEMBER = 500_000
#: Texts are cut in runs of about this many bytes, and the pieces of so many bytes looked up together (or one text, if larger).
RUN, SLAB = 1 << 20, 4 << 20

#: The table of byte-level BPE from bytes to printable characters, and its classes of characters and contractions.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_TABLE = np.array([b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)], np.uint32)
LETTER, NUMBER, OTHER, BLANK = range(4)
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_CLASSES: np.ndarray | None = None
_ENCODERS: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """The class of every code point; made once for a worker."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _CLASSES = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _CLASSES[_BLANKS] = BLANK
    return _CLASSES


def cuts(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point. fresh: whether a text does.

    Runs of letters, of numbers and of other characters are pieces, with one space before; of a blank run that
    something follows, the last character is parted from the others; a contraction is a piece if no space precedes it.
    """
    if not len(points):
        return np.zeros(0, bool)
    kind = _classes()[points]
    ends = np.append(fresh[1:], True)  # the last character of its text
    changes = np.append(True, kind[1:] != kind[:-1]) | fresh
    after_space = np.append(False, points[:-1] == 32) & ~fresh
    blank = kind == BLANK
    cut = changes & (blank | ~after_space)
    cut |= blank & ~ends & np.append(~blank[1:], True)
    quotes = np.flatnonzero((points == 39) & cut)
    quotes = quotes[~ends[quotes]]  # so that the next character is of the same text
    quotes = quotes[kind[quotes + 1] == LETTER]
    for letters in _CONTRACTIONS if len(quotes) else []:
        at = quotes[quotes + len(letters) < len(points)]
        for k, letter in enumerate(letters, 1):
            at = at[(points[at + k] == ord(letter)) & ~fresh[at + k]]
        cut[at + 1] = False
        following = at + 1 + len(letters)
        cut[following[following < len(points)]] = True
    return cut


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        model, first = about["model"], about.get("pre_tokenizer") or {}
        plain = not any([about.get("normalizer"), about.get("truncation"), about.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")])
        self.by_piece = plain and model["type"] == "BPE" and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        self.added = [t["content"] for t in about.get("added_tokens") or []]
        self.model = self.tokenizer.model
        self._forget()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit integers. Null: none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.zeros(len(texts), bool) if self.by_piece else np.ones(len(texts), bool)
        for token in self.added if self.by_piece else []:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        fast = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        slab, size = [], 0
        for start, data, offsets in chunks(fast, RUN):
            slab.append((start, *_pieces(data, offsets)))
            size += len(data)
            if size >= SLAB:
                yield from self._slab(slab, whole, texts)
                slab, size = [], 0
        yield from self._slab(slab, whole, texts)

    def _slab(self, runs: list[tuple[int, pa.Array, np.ndarray]], whole: np.ndarray, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of the texts of some runs (first text, pieces, bounds by text), of which all distinct pieces are looked up together."""
        coded = pa.chunked_array([r[1] for r in runs], pa.large_binary()).dictionary_encode()
        parts = iter(coded.chunks)  # runs without pieces have none
        where = self._remembered(coded.chunk(0).dictionary if len(coded) else self.pieces[:0])
        for start, pieces, bounds in runs:
            code = where[next(parts).indices.to_numpy() if len(pieces) else np.zeros(0, np.int64)]
            lengths = self.size[code]
            after = np.append(0, np.cumsum(lengths))
            ids = self.ids[np.repeat(self.begin[code] - after[:-1], lengths) + np.arange(after[-1])]
            ends = after[bounds]
            for i in range(len(ends) - 1):
                if whole[start + i]:
                    yield np.array(self.tokenizer.encode(texts[start + i].as_py(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[ends[i] : ends[i + 1]]

    def _forget(self) -> None:
        """No remembered pieces; the ids of piece i are ids[begin[i] : begin[i] + size[i]]."""
        self.pieces, self.ids = pa.array([], pa.large_binary()), np.zeros(0, np.uint32)
        self.begin = self.size = np.zeros(0, np.int64)

    def _remembered(self, pieces: pa.Array) -> np.ndarray:
        """The places of distinct pieces among those remembered, after the unknown ones were merged."""
        if len(self.pieces) > REMEMBER:
            self._forget()
        where = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(pc.is_null(where))
        bounds = np.frombuffer(new.buffers()[1], np.int64, len(new) + 1, new.offset * 8).tolist()
        letters = _TABLE[np.frombuffer(new.buffers()[2] or b"", np.uint8)[: bounds[-1]]].tobytes().decode("utf-32-le")
        ids, size = array("I"), []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            tokens = self.model.tokenize(letters[a:b])
            size.append(len(tokens))
            ids.extend([token.id for token in tokens])
        where = where.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        where[where < 0] = len(self.pieces) + np.arange(len(new))
        size = np.array(size, np.int64)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, np.frombuffer(ids, np.uint32))
        self.pieces = pa.concat_arrays([self.pieces, new])
        return where


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a run of texts, and their bounds by text."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
    at = np.searchsorted(begins, offsets)
    fresh = np.zeros(len(points), bool)
    fresh[at[at < len(points)]] = True
    starts = np.flatnonzero(cuts(points, fresh))
    ends = np.append(begins[starts], len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(starts, at)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; tasks of one worker share it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
