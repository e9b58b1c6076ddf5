"""Vectorised text work on Arrow buffers: words, their 64-bit hashes and shingles, without Python strings."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised pass takes in; temporaries are about ten times this.
SLICE = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trim() -> None:
    """Give freed memory back to the system, so that a long-lived worker is no larger than its last batch."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_kept: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, kept by a worker for its next tasks until one asks for another key."""
    if key not in _kept:
        fresh()
        _kept[key] = make()
    return _kept[key]


def fresh() -> None:
    """Drop what an earlier operator's tasks left in this worker; Spark uses workers again for other stages."""
    if _kept:
        _kept.clear()
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of rows with about ``most`` bytes each; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows; none is held while the next one arrives."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words; ``raw`` is lower-cased already where that matters."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    within = inside[raw]
    before = np.empty_like(within)
    before[1:], before[0] = within[:-1], False
    first = offsets[:-1]
    before[first[first < len(raw)]] = False
    starts = np.flatnonzero(within & ~before)
    del before
    after = np.empty_like(within)
    after[:-1], after[-1] = within[1:], False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(within & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SLICE) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are ascending and apart."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        s, e = starts[i:j], ends[i:j]
        size = e - s
        total = int(size.sum())
        base = np.cumsum(size) - size
        pos = np.arange(total) - np.repeat(base, size)
        byte = raw[np.repeat(s, size) + pos]
        if len(size) and size.max() > len(_POWERS):
            pos = pos % len(_POWERS)
        out[i:j] = mix(np.add.reduceat(_BYTE[byte] * _POWERS[pos], base) + size.astype(np.uint64) * _ODD)
        i = j
    return out


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of runs that hold no ASCII white space."""
    return word_spans(raw, offsets, ~_SPACE)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` successive words and their rows.

    A row with one to ``size`` - 1 words has all of them as its one shingle; a row without words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    k = len(hashes) - size + 1
    parts, of = [], []
    if k > 0:
        h = np.zeros(k, np.uint64)
        for j in range(size):
            h = (h + hashes[j : j + k]) * _ODD
            h ^= h >> np.uint64(29)
        keep = rows[:k] == rows[size - 1 :]
        parts.append(mix(h[keep]))
        of.append(rows[:k][keep])
    for r in short:  # each takes a few words, and none costs more than a long row does
        h = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for x in hashes[first[r] : first[r] + count[r]]:
                h = (h + x) * _ODD
                h ^= h >> np.uint64(29)
        parts.append(mix(np.array([h], np.uint64)))
        of.append(np.array([r]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(parts), np.concatenate(of)
    order = np.argsort(r, kind="stable") if len(short) else slice(None)
    return h[order], r[order]


def counted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs in that order, with their counts."""
    if not len(keys):
        return keys, rows, np.zeros(0, np.int64)
    order = np.argsort(keys)
    r = rows[order]
    order = order[np.argsort(r.astype(np.uint16) if len(r) and r.max() < 65536 else r, kind="stable")]
    k, r = keys[order], rows[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    return k[new], r[new], np.diff(np.r_[new, len(k)])
