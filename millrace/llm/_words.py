"""Words and hashed n-grams of whole Arrow batches of texts, by array operations on their UTF-8 bytes.

To words(), a word is a run of ASCII letters (lower-cased), ASCII digits and characters from U+0080 on. As every byte of
a multi-byte character is 0x80 or more, this holds on bytes as it does on characters. unicode_words() first brings
other characters into a form in which that rule gives runs of letters and digits of any script, in any case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes, so that memory is bounded by one text or this, if larger.
CHUNK_BYTES = 256 << 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256))
_PLACE = mix(np.arange(1000, 1000 + 4096)) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """n odd multipliers, one for each place of a sequence."""
    return _PLACE[:n] if n <= len(_PLACE) else mix(np.arange(1000, 1000 + n)) | np.uint64(1)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets from 0) for runs of texts; a null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(texts))
        part = offsets[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


@dataclass
class Words:
    """The words of a run of texts. Text i has words bounds[i] to bounds[i + 1]."""

    bounds: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    is_word = IS_WORD[low]
    fresh = np.zeros(len(low) + 1, bool)
    fresh[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | fresh[1:-1]
    starts = np.flatnonzero(starts)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(bounds, np.zeros(0, np.uint64))
    kept = low[is_word]
    at = np.cumsum(is_word)[starts] - 1
    lengths = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, lengths)
    return Words(bounds, mix(np.add.reduceat(_BYTE[kept] * places(int(lengths.max()))[place], at)))


#: Scripts written without blanks, whose characters are words one by one: Thai and Lao, Burmese, Khmer, kana, Han.
ALONE = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]


class _Characters(dict):
    """For str.translate: letters, marks and digits stay, invisible characters go, all others part words."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        kind = unicodedata.category(char)
        if point < 128:
            self[point] = char
        elif kind[0] in "LMN":
            self[point] = f" {char} " if any(a <= point <= b for a, b in ALONE) else char
        else:
            self[point] = "" if kind == "Cf" and point != 0x200B else " "
        return self[point]


_CHARACTERS = _Characters()


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, of which those with other than ASCII characters are folded."""
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    if not wide[-1]:
        return data, offsets
    raw, parts = data.tobytes(), []
    for start, end, odd in zip(offsets[:-1].tolist(), offsets[1:].tolist(), np.diff(wide[offsets]).tolist(), strict=True):
        part = raw[start:end]
        if odd:
            text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", part.decode("utf-8", "replace")).casefold())
            part = text.translate(_CHARACTERS).encode("utf-8")
        parts.append(part)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def unicode_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """As words(); but a word is a run of letters, marks and digits by Unicode category, in any case, or a character of ALONE."""
    return words(*_folded(data, offsets))


def text_words(text: str | None, split: Callable[[np.ndarray, np.ndarray], Words] = words) -> np.ndarray:
    """The word hashes of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return split(data, np.array([0, len(data)])).hashes


def windows(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, and their bounds by text. Texts with fewer words have none."""
    counts = np.maximum(np.diff(found.bounds) - (n - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    size = len(found.hashes) - n + 1
    if size <= 0 or not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(size, np.uint64)
    for k, by in enumerate(places(n)):
        total += found.hashes[k : k + size] * by
    starts = np.repeat(found.bounds[:-1], counts) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    return mix(total[starts]), bounds


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(); but a text of 1 to n - 1 words has one shingle, all its words."""
    hashes, bounds = windows(found, n)
    counts = np.diff(found.bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return hashes, bounds
    sums = [(found.hashes[a:b] * places(b - a)).sum(dtype=np.uint64) for a, b in zip(found.bounds[short], found.bounds[short + 1], strict=True)]
    new = np.insert(hashes, bounds[short], mix(np.array(sums, np.uint64) + counts[short].astype(np.uint64)))
    grown = np.zeros(len(counts), np.int64)
    grown[short] = 1
    return new, bounds + np.concatenate([[0], np.cumsum(grown)])
