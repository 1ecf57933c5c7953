"""Whole texts as numpy arrays: byte buffers, words and 64-bit word fingerprints.

A text column arrives as Arrow (``mapInArrow``); its UTF-8 data buffer is read
in place.  Words are maximal runs of bytes other than space and 0x09-0x0D,
i.e. ``[^\\x20\\x09-\\x0D]+``.  NULL counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _SEED = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` (a ``mapInArrow`` function) with the memory of earlier and of its own batches given back."""
    def wrapped(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One round of a 64-bit finaliser over ``h`` combined with ``v`` (bijective in each)."""
    x = (h * _SEED) ^ v
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64) of an Arrow string column; NULL becomes empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def batches_of(batches, column: str, max_bytes: int, max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut a partition's rows into runs of at most ``max_bytes`` of text (one row at least).

    The cuts depend on the order of rows only, not on how Spark packs them
    into Arrow batches.
    """
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = text_buffer(b.column(column))
        start = 0
        while start < b.num_rows:
            room = max_bytes - size
            stop = int(np.searchsorted(off, off[start] + room, side="right")) - 1
            stop = min(max(stop, start), b.num_rows, start + max_rows - rows)
            if stop == start and not held:
                stop = start + 1
            if stop > start:
                held.append(b.slice(start, stop - start))
                size += int(off[stop] - off[start])
                rows += stop - start
                start = stop
            if start < b.num_rows:
                yield _one(held)
                held, size, rows = [], 0, 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, in order."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ns = ~_WS[buf]
    first = ns.copy()
    first[1:] &= ~ns[:-1]
    last = ns.copy()
    last[:-1] &= ~ns[1:]
    rows_at = off[:-1][np.diff(off) > 0]
    first[rows_at] = ns[rows_at]
    ends_at = off[1:][np.diff(off) > 0] - 1
    last[ends_at] = ns[ends_at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def fingerprints(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each byte span, eight bytes a round; spans over 256 bytes by xxh3."""
    size = end - start
    h = size.astype(np.uint64)
    if not len(size):
        return h
    padded = np.empty(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    padded[len(buf):] = 0
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    h = mix(h, eight[start] & _MASKS[np.minimum(size, 8)])
    for i in np.flatnonzero(size > 256):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i]:end[i]])
    live = np.flatnonzero((size > 8) & (size <= 256))
    at = 8
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live], eight[start[live] + at] & _MASKS[np.minimum(left, 8)])
        at += 8
        live = live[left > 8]
    return h


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start..start+size-1 of every run, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
