"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as UTF-8 bytes in blocks of whole documents, so memory is
bounded by ``BLOCK_BYTES`` or one document, whichever is larger.  All word
classes used here are unions of single ASCII bytes and all bytes from 0x80 up,
which makes byte-wise splitting equal to splitting by code points.

A word's hash is a polynomial over random 64-bit byte values modulo 2**64,
followed by a bijective mix; windows of words are hashed the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WBASE = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]

#: Word bytes: everything but ASCII white space ``[\x20\x09-\x0D]``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes after lower-casing: digits, letters, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        p, q = np.full(size, base, np.uint64), np.full(size, inv, np.uint64)
        p[0] = q[0] = 1
        have = _powers[base] = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


@dataclass
class Block:
    """Whole documents ``first..last-1`` of a batch, and their words."""

    first: int
    last: int
    raw: np.ndarray
    offsets: np.ndarray  # of documents in raw, len n + 1
    starts: np.ndarray  # of words in raw
    ends: np.ndarray
    wfirst: np.ndarray  # first word of each document, len n + 1
    sums: np.ndarray  # prefix sums of the byte polynomial
    words: np.ndarray  # mixed hash of each word

    @property
    def n(self) -> int:
        return self.last - self.first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.wfirst)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of byte spans of raw."""
        inv = powers(_BASE, len(self.raw))[1]
        return mix((self.sums[ends] - self.sums[starts]) * inv[starts])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each window of ``size`` words that lies in one document."""
        return windows(self.words, self.wfirst, size)


def windows(words: np.ndarray, wfirst: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = window_sums(words)
    at = np.arange(n - size + 1)
    end = np.repeat(wfirst[1:], np.diff(wfirst))[: n - size + 1]
    at = at[at + size <= end]
    return at, span_of(sums, at, at + size)


def window_sums(words: np.ndarray) -> np.ndarray:
    p = powers(_WBASE, len(words))[0]
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=out[1:])
    return out


def span_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word sequences ``starts..ends`` from :func:`window_sums`."""
    inv = powers(_WBASE, len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def blocks(col: pa.Array, table: np.ndarray, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents of at most ``limit`` bytes, or of one document."""
    offsets, raw = buffers(col)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield block(first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], table, lower)
        first = last


def block(first: int, last: int, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> Block:
    n = len(raw)
    is_word = table[raw]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    inside = offsets[:-1][offsets[:-1] < n]
    before[inside] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    p, q = powers(_BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[raw] * p[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * q[starts])
    return Block(first, last, raw, offsets, starts, ends, np.searchsorted(starts, offsets), sums, words)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive segments given by their bounds; empty ones give 0."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def cover(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any of the given windows."""
    diff = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)[: n + 1]
    return np.cumsum(diff[:n]) > 0


def minimizers(values: np.ndarray, wfirst: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Winnowing: of each window of ``span`` consecutive grams within one document, the place of
    the least hash (the leftmost of equals).  ``values[i]`` is the hash of the gram that starts
    at word i (only used where it lies within its document).  Returns sorted distinct places."""
    n, counts = len(values), np.diff(wfirst)
    grams = np.maximum(counts - gram + 1, 0)
    if not grams.any():
        return np.zeros(0, np.int64)
    # sliding minimum by doubling on (value, place)
    idx = np.arange(n)
    size = 1
    while size * 2 <= span:
        idx = _least(values, idx[: len(idx) - size], idx[size:])
        size *= 2
    rest = span - size
    if rest:
        idx = _least(values, idx[: len(idx) - rest], idx[rest:])
    ends = wfirst[:-1] + grams  # one past the last gram's start
    whole = grams >= span
    at = np.zeros(n + 1, np.int64)
    np.add.at(at, wfirst[:-1][whole], 1)
    np.add.at(at, (ends - span + 1)[whole], -1)
    chosen = [idx[np.flatnonzero(np.cumsum(at[: len(idx)]) > 0)]]
    return np.unique(np.concatenate(chosen))


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(values[b] < values[a], b, a)
