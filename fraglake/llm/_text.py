"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A column is handled in windows of a few MB, so that temporaries stay small
whatever the Arrow batch size; a single text longer than the window is one
window by itself (about 60 bytes of temporaries for each byte of that text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, for text whose A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * WINDOW_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer for 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


class SpanHash:
    """64-bit hashes of arbitrary byte spans from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self._prefix = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(_TABLE[data] * _powers(_BASE, n)[:n], dtype=np.uint64, out=self._prefix[1:])
        self._inverse = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._inverse[start])


def hash_words(words: list[bytes]) -> np.ndarray:
    """The SpanHash of each word by itself."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(words) else ends
    return SpanHash(data)(starts, ends)


@dataclass
class Window:
    """Rows ``lo`` to ``hi`` of a column; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def windows(column: pa.Array | pa.ChunkedArray, limit: int = WINDOW_BYTES) -> Iterator[Window]:
    """The column in runs of whole texts of at most ``limit`` bytes, or one text; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of several
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, raw = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Window(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags that don't cross an offset: starts, ends, and how many began before each offset."""
    n = len(flags)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = flags[:-1], flags[1:]
    starts = np.flatnonzero(flags & (~before | cut[:-1]))
    ends = np.flatnonzero(flags & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``."""
    total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
