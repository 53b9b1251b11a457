"""Word alignment in little memory: the edit table's rows as bits of whole numbers, kept at checkpoints and made again block by block."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from math import isqrt

import numpy as np

#: Bytes of remembered word masks.
MASK_BYTES = 1 << 26


def masks_of(words: Sequence) -> Callable[[object], int]:
    """Where a word stands, as bits; the last masks asked for are remembered."""
    places: dict = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    size = len(words) // 8 + 1

    @lru_cache(maxsize=max(64, MASK_BYTES // size))
    def mask(word) -> int:
        at = places.get(word)
        if at is None:
            return 0
        if len(at) == 1:
            return 1 << at[0]
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    return mask


def next_row(equal: int, up: int, down: int, every: int) -> tuple[int, int, int, int]:
    """From a row's rises and falls along the other side: the next row's, where a diagonal step costs nothing, and where the cost rises from row to row."""
    diagonal = (((equal & up) + up) ^ up) | equal | down
    rises = down | (every & ~(diagonal | up))
    right, left = rises << 1 | 1, (up & diagonal) << 1
    return (left | ~(diagonal | right)) & every, right & diagonal & every, diagonal, rises


def steps(ref: Sequence, hyp: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """A least-cost alignment as two arrays, one entry for each operation: the place in ref and the place in hyp, -1 for none.

    From the end on, ties go to equal or substituted words, then to words left out of hyp, then to words put in.
    Memory grows with len(hyp) * sqrt(len(ref)) bits, besides the two sides.
    """
    n, m, tail = len(ref), len(hyp), 0
    while tail < min(n, m) and ref[n - 1 - tail] == hyp[m - 1 - tail]:
        tail += 1
    i, j = n - tail, m - tail
    refs, hyps = list(range(n - 1, i - 1, -1)), list(range(m - 1, j - 1, -1))
    if i and j:
        mask, block = masks_of(hyp[:j]), isqrt(i) + 1
        every = (1 << j) - 1
        up, down, kept = every, 0, []
        for k in range(i):
            if k % block == 0:
                kept.append((up, down))
            up, down, _, _ = next_row(mask(ref[k]), up, down, every)
        while i and j:
            first = (i - 1) // block * block
            every, size = (1 << j) - 1, (j + 7) // 8
            up, down = (x & every for x in kept[first // block])
            rows = []
            for k in range(first, i):
                up, down, diagonal, rises = next_row(mask(ref[k]) & every, up, down, every)
                rows.append(((diagonal & every).to_bytes(size, "little"), rises.to_bytes(size, "little")))
            while i > first and j:
                diagonal, rises = rows[i - 1 - first]
                at, bit = (j - 1) >> 3, 1 << ((j - 1) & 7)
                if not diagonal[at] & bit or ref[i - 1] == hyp[j - 1]:
                    i, j = i - 1, j - 1
                    refs.append(i)
                    hyps.append(j)
                elif rises[at] & bit:
                    i -= 1
                    refs.append(i)
                    hyps.append(-1)
                else:
                    j -= 1
                    refs.append(-1)
                    hyps.append(j)
    refs += [*range(i - 1, -1, -1), *[-1] * j]
    hyps += [*[-1] * i, *range(j - 1, -1, -1)]
    return np.array(refs[::-1], np.int64), np.array(hyps[::-1], np.int64)
