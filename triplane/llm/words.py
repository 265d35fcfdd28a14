"""Whole-batch word and byte-range hashing over Arrow string buffers with numpy.

Words are maximal runs of word bytes.  Every hash comes from one prefix sum per buffer: with
S[i] = sum of v(byte j) * B**j for j < i (mod 2**64), the range [a, b) hashes to
(S[b] - S[a]) * B**-a, finished by a 64-bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Byte values with A-Z as a-z.
LOWER_VALUES = _VALUES[_LOWER]
#: Bytes with A-Z as a-z.
LOWER_BYTES = _LOWER.astype(np.uint8)
#: Bytes that are not ASCII white space (x20, x09-x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII digits and letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
#: As ALNUM, without digits.
ALPHA = ALNUM.copy()
ALPHA[48:58] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 2)
        for k, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Empty the caches of operators that a worker has served.
CACHES: list = []


def drop_caches() -> None:
    """For operators without a cache: a worker keeps none of an earlier stage's while it serves them."""
    for clear in CACHES:
        clear()
    release()


def release() -> None:
    """Give freed memory back to the system: idle workers stay small while other stages run."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) over runs of whole texts of about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    release()


class Prefix:
    """Prefix sums of one buffer, for hashes of any byte range."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _VALUES):
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(values[buf] * power[: len(buf)], out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(_U))


class Words:
    """Words of a run of texts: byte ranges, hashes, and each text's range of words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray = LOWER_VALUES):
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = is_word[buf]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        bounds = offsets[(offsets > 0) & (offsets < len(buf))]
        starts[bounds] = inside[1:-1][bounds]
        ends[bounds - 1] = inside[1:-1][bounds - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.prefix = Prefix(buf, values)
        self.hashes = self.prefix.hash(self.starts, self.ends)
        self.docs = np.searchsorted(self.starts, offsets)  # the words of text k: docs[k] to docs[k + 1]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words from each word, and whether they stay in one text."""
        h = self.hashes
        if len(h) < n:
            return np.zeros(len(h), _U), np.zeros(len(h), bool)
        out = np.zeros(len(h), _U)
        total = np.zeros(len(h) - n + 1, _U)
        for k in range(n):
            total = mix(total * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k] + _U(k))
        out[: len(total)] = total
        fits = np.zeros(len(h), bool)
        last = np.repeat(self.docs[1:], np.diff(self.docs))
        fits[:] = np.arange(len(h)) + n <= last
        return out, fits


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the byte ranges of a and b at these places are equal, A-Z as a-z in a; lengths are over 0."""
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    equal = LOWER_BYTES[a[np.repeat(a_at, lengths) + inside]] == b[np.repeat(b_at, lengths) + inside]
    return np.logical_and.reduceat(equal, first) if len(first) else np.zeros(0, bool)


class Bitmap:
    """A set of 64-bit keys as 2**bits bits: no member is missed, others may pass."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h >> self.shift
        return (self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1


class Lookup:
    """Exact set membership of 64-bit keys with a bitmap in front; gives positions in the sorted keys."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.unique(keys)
        self.shift = _U(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that are present, their place in keys)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.map[(h >> self.shift).astype(np.int64)])
        place = np.searchsorted(self.keys, h[at])
        place[place == len(self.keys)] = 0
        good = self.keys[place] == h[at]
        return at[good], place[good]
