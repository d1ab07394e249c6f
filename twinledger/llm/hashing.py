"""64-bit hashes of words and word shingles, in numpy over the bytes of a batch of texts.

Texts are handled in blocks of whole documents of about BLOCK bytes, so memory stays bounded by the block or the
longest text. Words are maximal runs of bytes that a table marks; ASCII letters are lower-cased by a second table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SHINGLE = 5


def _byte_table(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words of [^\x20\x09-\x0D]+
SPACED = _byte_table([0x20, *range(0x09, 0x0E)])
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text: digits, a-z and all beyond ASCII.
ALPHANUMERIC = _byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Words(NamedTuple):
    """Words of a block: doc i has hashes[bounds[i]:bounds[i+1]], starts and ends are byte offsets in data."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Splits texts into words and hashes each: sum of byte values times powers of an odd base, then mixed."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, word_bytes: np.ndarray = SPACED):
        self.word_bytes = word_bytes
        lower = np.arange(256)
        lower[65:91] += 32
        self.values = seeded(1, 256)[lower]
        self.up = self.down = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, BLOCK + BLOCK // 4)
            self.up, self.down = powers(self.BASE, n), powers(pow(self.BASE, -1, 1 << 64), n)

    def blocks(self, texts: pa.Array) -> Iterator[Words]:
        """Words of all texts (null: empty) in blocks, in order."""
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        if not n:
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
            last = min(last, n)
            yield self._block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def _block(self, first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
        self._grow(len(data))
        inside = self.word_bytes[data]
        if self.word_bytes[65] != self.word_bytes[97]:  # lower-cased before words are taken
            inside |= (data >= 65) & (data <= 90)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
        total = np.cumsum(self.values[data] * self.up[: len(data)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else total[:0]
        hashes = mix((total[ends] - before) * self.down[starts] + (ends - starts + 1).astype(np.uint64))
        return Words(first, hashes, np.searchsorted(starts, offsets), starts, ends + 1, data)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive ones; empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return hashes[:0]
    weights, out = seeded(7, n), np.zeros(m, np.uint64)
    for i in range(n):
        out += hashes[i : i + m] * weights[i]
    return mix(out)


def shingle_sets(words: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each document of a block, the sorted distinct hashes of its n-word shingles: with fewer words the
    whole sequence as one, without words none."""
    grams = ngrams(words.hashes, n)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngrams(words.hashes[a:b], int(b - a)) + np.uint64(b - a)
        else:
            yield grams[:0]
