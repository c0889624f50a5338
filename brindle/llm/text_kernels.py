"""Vectorised text kernels over the bytes of Arrow string columns: words, hashes of words and of word windows.

Words are told from the rest byte by byte, which is exact for UTF-8 where every byte over 0x7F belongs to a word or, as here,
all ASCII separators are single bytes. Arrays are worked on in slices of about SLICE_BYTES of text; a longer text is a slice of
its own, and its hashes are made piece by piece, so memory beyond the text itself is some 40 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SEEDS = np.random.default_rng(20240607).integers(0, 2**64, 64, dtype=np.uint64) | _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(separators: set[int]) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words of anything but white space.
SPACED = byte_class({0x20, *range(0x09, 0x0E)})
#: Words of digits, letters and all beyond ASCII (texts are lower-cased before).
ALNUM = byte_class({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, SLICE_BYTES + 1)
        inverse = pow(int(_BASE), -1, 2**64)
        ones = np.ones(n, dtype=np.uint64)
        _POWERS, _INVERSES = ones.copy(), ones.copy()
        _POWERS[1:], _INVERSES[1:] = _BASE, _U(inverse)
        np.multiply.accumulate(_POWERS, out=_POWERS)
        np.multiply.accumulate(_INVERSES, out=_INVERSES)
    return _POWERS, _INVERSES


def _piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _SEEDS[63])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        a, b = int(start[i]), int(end[j - 1])
        out[i:j] = _piece_hashes(data[a:b], start[i:j] - a, end[i:j] - a)
        i = j
    return out


@dataclass
class Words:
    """The words of some rows of text: bytes, each word's place and hash, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row, and one more
    hash: np.ndarray
    at: np.ndarray  # each row's first byte, and one more
    raw: np.ndarray | None = None  # the bytes before lower-casing

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def _string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; a null has no bytes."""
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(texts: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their words), a bounded part of the array at a time."""
    at, raw = _string_buffers(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        own = words(_LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i], kind)
        own.raw = raw[at[i] : at[j]]
        yield i, j, own
        i = j


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # words end where rows do
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, first, word_hashes(data, start, end), at)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (first words) of all windows of k words inside single rows, and their hashes."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = w.hash[:n] * _SEEDS[0]
    for j in range(1, k):
        total = total + w.hash[j : n + j] * _SEEDS[j]
    row = w.row
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(total[at] + _U(k))
