"""Elias-Fano sequences and a two-level n-gram trie over them (numpy, memory-mapped)."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary.

    ``words`` is one uint64 array [n, low bits, words of highs, highs...,
    lows...]; it may be a view of a mapped file.
    """

    def __init__(self, words: np.ndarray):
        self.n, self.low, size = int(words[0]), int(words[1]), int(words[2])
        self.highs = words[3:3 + size]
        lows = words[3 + size:]
        raw = lows.view(np.uint8)
        self._eight = np.ndarray((max(0, len(raw) - 7),), "<u8", raw, 0, (1,)) if len(raw) else raw
        ones = np.bitwise_count(self.highs).astype(np.int64)
        self._ones = np.cumsum(ones) - ones                    # ones before each word
        self._zeros = 64 * np.arange(size) - self._ones        # zeros before each word

    @staticmethod
    def encode(values: np.ndarray) -> np.ndarray:
        v = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) >> 6) + 2 if n else 1
        highs = np.zeros(size, np.uint64)
        np.bitwise_or.at(highs, at >> 6, _ONE << (at & 63).astype(np.uint64))
        lows = np.zeros((n * low >> 6) + 3, np.uint64)
        if low:
            bit = np.arange(n, dtype=np.int64) * low
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            part = v & np.uint64((1 << low) - 1)
            np.bitwise_or.at(lows, word, part << shift)
            over = (bit & 63) + low > 64
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return np.concatenate((np.array([n, low, size], np.uint64), highs, lows))

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Bit position of the k-th (from 0) one or zero."""
        before = self._zeros if zeros else self._ones
        w = np.searchsorted(before, k, side="right") - 1
        left = k - before[w]
        x = ~self.highs[w] if zeros else self.highs[w].copy()
        pos = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # halve the word: skip the lower part when the bit is not in it
            c = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            skip = left >= c
            left = np.where(skip, left - c, left)
            x = np.where(skip, x >> np.uint64(step), x)
            pos += np.where(skip, step, 0)
        return (w << 6) + pos

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, False) - i).astype(np.uint64)
        return high << np.uint64(self.low) | self._low_of(i)

    def _low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return (self._eight[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value >= x (n if there is none)."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.low)).astype(np.int64)
        most = int(self._zeros[-1] + 64 - np.bitwise_count(self.highs[-1])) - 1  # zeros that can be selected
        inside = high < most
        h = np.where(inside, high, 0)
        # values with a smaller high part, and with this one at most
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - h + 1, 0)
        hi = self._select(h, True) - h
        want = x & np.uint64((1 << self.low) - 1)
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        while True:  # binary search among the low bits of that bucket
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            less = open_ & (self._low_of(np.where(open_, mid, 0)) < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return np.where(inside, lo, self.n)


class Trie:
    """Contexts -> successors with a code each.

    Level one: context fingerprints and pointers; level two: successors, each
    stored relative to the last value of the context before (plus one), so
    that the whole level is one rising sequence.
    """

    def __init__(self, blob):
        words = np.frombuffer(blob, np.uint64)
        sizes = words[:4].astype(np.int64)
        at = 4 + np.concatenate(([0], np.cumsum(sizes)))
        self.contexts, self.pointers, self.successors = (EliasFano(words[at[k]:at[k + 1]]) for k in range(3))
        self.codes = words[at[3]:at[4]].view(np.uint8)

    @staticmethod
    def build(ctx: np.ndarray, start: np.ndarray, succ: np.ndarray, codes: np.ndarray) -> bytes:
        """From rising contexts, the start of each one's rising successors, and a code for each successor."""
        size = np.diff(np.append(start, len(succ)))
        last = succ[start + size - 1].astype(np.uint64) + _ONE if len(ctx) else np.zeros(0, np.uint64)
        base = np.concatenate((np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)))[:len(ctx)]
        values = succ.astype(np.uint64) + _ONE + np.repeat(base, size)
        padded = np.zeros(-(-len(codes) // 8) * 8, np.uint8)
        padded[:len(codes)] = codes
        parts = [EliasFano.encode(ctx), EliasFano.encode(np.append(start, len(succ))), EliasFano.encode(values), padded.view(np.uint64)]
        return np.concatenate([np.array([len(p) for p in parts], np.uint64), *parts]).tobytes()

    @staticmethod
    def mapped(blob: bytes) -> Trie:
        """The trie over a memory-mapped, already unlinked file."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            return Trie(mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ))

    def lookup(self, ctx: np.ndarray, succ: np.ndarray) -> np.ndarray:
        """Codes of (context, successor) pairs; 0 where the trie has none."""
        out = np.zeros(len(ctx), np.uint8)
        i = self.contexts.successor(ctx)
        known = np.flatnonzero(i < self.contexts.n)
        known = known[self.contexts.access(i[known]) == ctx[known]]
        i = i[known]
        first, end = self.pointers.access(i).astype(np.int64), self.pointers.access(i + 1).astype(np.int64)
        base = np.where(first > 0, self.successors.access(np.maximum(first - 1, 0)), np.uint64(0))
        want = base + succ[known].astype(np.uint64) + _ONE
        at = self.successors.successor(want)
        hit = (at < end) & (self.successors.access(np.minimum(at, max(0, self.successors.n - 1))) == want) if self.successors.n else at < 0
        out[known[hit]] = self.codes[at[hit]]
        return out
