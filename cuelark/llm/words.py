"""Vectorised word kernels over Arrow string columns.

Texts are handled as UTF-8 bytes. A word is a run of bytes other than
space and \\t..\\r, all of them ASCII, so bytes and code points agree on
where words begin. Every kernel works on whole texts; a batch is cut between
texts, never inside one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, r in enumerate((_R, _R_INV)):
            step = np.full(size, r, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Slice:
    """Consecutive texts of a column as one byte array."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[Slice]:
    """The column in slices of about `most` bytes, one text at least; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Slice(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """The words of a slice: 64-bit hashes, byte starts, and for each text its first word's index."""

    hashes: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray  # int64, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _segments(full: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of runs of `full`, cut at text boundaries too."""
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    inner = offsets[:-1][offsets[:-1] < len(full)]
    begins[inner] = full[inner]
    return np.flatnonzero(begins)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def hash_words(s: Slice) -> Words:
    full = ~_SPACE[s.data]
    starts = _segments(full, s.offsets)
    up, down = powers(len(s.data))
    hashes = mix(_sums(_BYTE[s.data] * up, starts) * down[starts])
    return Words(hashes, starts, np.searchsorted(starts, s.offsets))


def hash_lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, has a word) of every \\n-separated line that has a byte."""
    breaks = s.data == 0x0A
    starts = _segments(~breaks, s.offsets)
    up, down = powers(len(s.data))
    values = (_BYTE[s.data] + np.uint64(2) * _SPACE[s.data] * (s.data.astype(np.uint64) + np.uint64(1))) * up
    values[breaks] = 0
    hashes = mix(_sums(values, starts) * down[starts])
    wordy = _sums((~_SPACE[s.data]).astype(np.int64), starts) > 0
    return hashes, np.searchsorted(s.offsets, starts, "right") - 1, wordy


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows and their first words' indices; none crosses texts."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words.hashes[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words.hashes[j : n + j]
    left = np.repeat(words.bounds[1:], words.counts)[:n] - np.arange(n)
    ok = np.flatnonzero(left >= k)
    return mix(out[ok]), ok


def per_text(values: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(texts, weights=values, minlength=n).astype(np.int64) if len(texts) else np.zeros(n, np.int64)


def normal_slices(texts: pa.Array) -> Iterator[Slice]:
    """Slices in lower case without ASCII punctuation: words compare without either. A slice at a time, so that copies stay small."""
    for s in slices(texts):
        plain = pa.LargeStringArray.from_buffers(s.n, pa.py_buffer(s.offsets.astype(np.int64)), pa.py_buffer(s.data.tobytes()))
        for low in slices(strip_punctuation(pc.utf8_lower(plain)), 1 << 60):
            yield Slice(s.first, low.data, low.offsets)


_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def strip_punctuation(texts: pa.Array) -> pa.Array:
    """The texts without ASCII punctuation bytes; a word of punctuation alone goes."""
    if not len(texts):
        return texts
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    keep = ~_PUNCT[raw]
    total = np.concatenate([[0], np.cumsum(keep)])
    fresh = total[offsets - offsets[0]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(fresh.astype(np.int64)), pa.py_buffer(raw[keep]))
