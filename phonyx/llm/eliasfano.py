"""Elias-Fano coded monotone sequences in numpy, with random access and successor search for many queries at once.

A sequence of n values below u keeps the low bits of each value packed, and
the high parts as a bit vector in unary, about 2 + log2(u / n) bits a value.
The only directory is one running count for each 64 bits of that vector. The
arrays can be handed to `Store`, which lays them out in one file and maps it.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

U64 = np.uint64
ONE, SIX, MASK6 = U64(1), U64(6), U64(63)


class Store:
    """Arrays in one memory-mapped file, which is unlinked as soon as it is mapped and so goes with the task."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, array: np.ndarray) -> int:
        self.parts.append(np.ascontiguousarray(array))
        return len(self.parts) - 1

    def map(self) -> list[np.ndarray]:
        with tempfile.NamedTemporaryFile(prefix="trie-", delete=False) as f:
            places = []
            for a in self.parts:
                f.write(b"\0" * (-f.tell() % 8))
                places.append((f.tell(), a.dtype, len(a)))
                f.write(a.tobytes())
            f.write(b"\0" * 8)
        whole = np.asarray(np.memmap(f.name, np.uint8, "r"))
        os.unlink(f.name)
        self.parts = []
        return [whole[at : at + n * d.itemsize].view(d) for at, d, n in places]


def packed(bits: np.ndarray) -> np.ndarray:
    """A vector of zeros and ones as words of 64 bits, lowest first, and one word more."""
    octets = np.packbits(bits, bitorder="little")
    return np.concatenate((octets, np.zeros(-len(octets) % 8 + 8, np.uint8))).view(U64)


class EliasFano:
    def __init__(self, values: np.ndarray, universe: int, store: Store):
        """values: not falling, each below `universe`, at most 2^64."""
        values = values.astype(U64)
        self.n = len(values)
        self.width = max(0, (max(1, universe - 1) // max(1, self.n)).bit_length() - 1) if self.n else 0
        low, high = U64(self.width), values >> U64(self.width)
        self.top = int(high[-1]) if self.n else 0
        if self.width:
            fraction = values & ((ONE << low) - ONE)
            bits = np.empty((self.n, self.width), np.uint8)
            for k in range(self.width):
                bits[:, k] = (fraction >> U64(k)) & ONE
            lows = packed(bits.reshape(-1))
        else:
            lows = np.zeros(1, U64)
        unary = np.zeros(self.n + self.top + 2, np.uint8)
        unary[(high.astype(np.int64) + np.arange(self.n))] = 1
        words = packed(unary)
        counts = np.bitwise_count(words).astype(np.int64)
        self.at = store.put(lows), store.put(words), store.put(np.cumsum(counts) - counts)

    def mapped(self, arrays: list[np.ndarray]) -> EliasFano:
        self.lows, self.words, self.before = (arrays[i] for i in self.at)
        return self

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place in the bit vector of the k-th one, or zero."""
        if zeros:
            # Zeros before word i: 64 * i - ones before it; the search is in ones and zeros alike, on a rising sequence.
            total = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        else:
            total = self.before
        at = np.searchsorted(total, k, "right") - 1
        word = ~self.words[at] if zeros else self.words[at]
        left = (k - total[at]).astype(U64)
        place = at.astype(U64) << SIX
        # Halve the word down to the bit: into the upper half if the lower one has too few ones.
        for half in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(word & U64((1 << half) - 1)).astype(U64)
            up = lower <= left
            left -= lower * up
            step = up * U64(half)
            word >>= step
            place += step
        return place.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        bit = i.astype(U64) * U64(self.width)
        word, shift = (bit >> SIX).astype(np.int64), bit & MASK6
        upper = np.where(shift > 0, self.words_after(word) << ((U64(64) - shift) & MASK6), U64(0))
        return ((self.lows[word] >> shift) | upper) & ((ONE << U64(self.width)) - ONE)

    def words_after(self, word: np.ndarray) -> np.ndarray:
        return self.lows[np.minimum(word + 1, len(self.lows) - 1)]

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, False) - i).astype(U64)
        return (high << U64(self.width)) | self._low(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value not below x, and whether it is x."""
        x = np.asarray(x, U64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> U64(self.width)).astype(np.int64)
        inside = high <= self.top
        high = np.minimum(high, self.top)
        below = np.maximum(high - 1, 0)
        first = np.where(high > 0, self._select(below, True) - below, 0)
        last = self._select(high, True) - high
        want = x & ((ONE << U64(self.width)) - ONE)
        first, last = np.where(inside, first, self.n), np.where(inside, last, self.n)
        end = last.copy()
        # The values between share their high part: halve on the low bits, all queries at once.
        while True:
            live = np.flatnonzero(first < last)
            if not len(live):
                break
            middle = (first[live] + last[live]) >> 1
            less = self._low(middle) < want[live]
            first[live] = np.where(less, middle + 1, first[live])
            last[live] = np.where(less, last[live], middle)
        at = np.minimum(first, self.n - 1)
        return first, inside & (first < end) & (self._low(at) == want)
