"""One file for the token ids of a shard: a wavelet matrix over compressed bit planes.

The ids are stored as bit planes from the highest bit down. At each plane the
ids with a zero bit move before those with a one, both in their order, so a
position is followed through all planes by counting bits before it. That gives
the token at a position, the number of times that a token stands in a range,
and the place of its k-th occurrence, each by reading one block for a plane.

Layout, little-endian: 8 bytes of magic, the length of the header as unsigned
32-bit integer, the header as JSON, then the sections that it names by offset
(from the end of the header) and length:

* `documents`: the zstd frame of 64-bit integers: the number of tokens of each
  document, its id, and 1 where the id is null;
* for plane k `ranks-k` (ones before each block, 64-bit), `ends-k` (where each
  block's bytes end, 64-bit) and `blocks-k`: blocks of `block` bytes of bits,
  first bit highest, each as zstd frame where that is shorter.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"phyxwm01"
#: Bytes of bits in a block.
BLOCK = 4096


def planes_of(ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Each plane's bits and the number of zeros among them, from the highest bit down."""
    at = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in range(bits - 1, -1, -1):
        one = (at & at.dtype.type(1 << k)).astype(bool)
        # A mask as index takes several times as long where its bits are mixed.
        zeros, ones = at.compress(~one), at.compress(one)
        yield one, len(zeros)
        at = np.concatenate([zeros, ones])


def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], extra: dict | None = None, block: int = BLOCK) -> bytes:
    """The file's bytes for ids of documents one after another; `extra` goes into the header."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1)
    table = np.concatenate([np.asarray(lengths, "<i8"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "<i8")])
    sections, zeros = {"documents": squeeze.compress(table.tobytes())}, []
    for k, (one, n) in enumerate(planes_of(ids, bits)):
        packed = np.packbits(one)
        data = packed.tobytes()
        raw = [data[a : a + block] for a in range(0, len(data), block)]
        kept = [min(r, squeeze.compress(r), key=len) for r in raw]
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), block), dtype=np.int64) if len(one) else np.zeros(0, np.int64)
        sections[f"ranks-{k}"] = np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()
        sections[f"ends-{k}"] = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype("<i8").tobytes()
        sections[f"blocks-{k}"] = b"".join(kept)
        zeros.append(n)
    places, at = {}, 0
    for name, data in sections.items():
        places[name] = [at, len(data)]
        at += len(data)
    head = json.dumps({**(extra or {}), "tokens": len(ids), "documents": len(doc_ids), "bits": bits, "block": block, "zeros": zeros, "sections": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections.values()])


class Shard:
    """Reads a file's bytes, mapped or held. Blocks are decompressed when a query needs them; the last few hundred are remembered."""

    def __init__(self, data, remembered: int = 256) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", view[8:12])
        self.header = json.loads(bytes(view[12 : 12 + n]))
        self.view, self.base = view, 12 + n
        self.tokens, self.bits, self.block, self.zeros = (self.header[k] for k in ("tokens", "bits", "block", "zeros"))
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self.section("documents"))), "<i8").reshape(3, -1)
        self.lengths, self.starts = table[0], np.concatenate([[0], np.cumsum(table[0])])
        self.doc_ids = [None if gone else int(d) for d, gone in zip(table[1], table[2])]
        self.ranks = [np.frombuffer(self.section(f"ranks-{k}"), "<i8") for k in range(self.bits)]
        self.ends = [np.frombuffer(self.section(f"ends-{k}"), "<i8") for k in range(self.bits)]
        self.blocks = [self.section(f"blocks-{k}") for k in range(self.bits)]
        self._cache: dict[tuple[int, int], bytes] = {}
        self._remembered = remembered

    def section(self, name: str) -> memoryview:
        at, size = self.header["sections"][name]
        return self.view[self.base + at : self.base + at + size]

    def _bytes(self, plane: int, block: int) -> bytes:
        key = (plane, block)
        if key not in self._cache:
            if len(self._cache) >= self._remembered:
                self._cache.pop(next(iter(self._cache)))
            data = bytes(self.blocks[plane][self.ends[plane][block] : self.ends[plane][block + 1]])
            whole = min(self.block, (self.tokens + 7) // 8 - block * self.block)
            self._cache[key] = data if len(data) == whole else zstandard.ZstdDecompressor().decompress(data)
        return self._cache[key]

    def _bit(self, plane: int, i: int) -> int:
        at = i // 8
        return self._bytes(plane, at // self.block)[at % self.block] >> (7 - i % 8) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, inside = divmod(i, 8 * self.block)
        if not inside:
            return int(self.ranks[plane][block])
        data = self._bytes(plane, block)
        return int(self.ranks[plane][block]) + (int.from_bytes(data[: (inside + 7) // 8], "big") >> (-inside % 8)).bit_count()

    def _find(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th such bit of a plane, counted from 0."""
        ones = self.ranks[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * 8 * self.block, self.tokens) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        found = np.flatnonzero(np.unpackbits(np.frombuffer(self._bytes(plane, block), np.uint8)) == bit)
        return block * 8 * self.block + int(found[k - before[block]])

    def access(self, i: int) -> int:
        """The token at a position."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            out, i = out << 1 | bit, self.zeros[k] + ones if bit else i - ones
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, start), self._ones(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token stands among positions start to end."""
        a, b = self._range(token, start, self.tokens if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of a token's k-th occurrence, counted from 0."""
        first, last = self._range(token, 0, self.tokens)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i = first + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._find(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def locate(self, token: int) -> Iterator[int]:
        """All positions of a token, ascending."""
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest."""
        at = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            data = b"".join(self._bytes(k, b) for b in range(len(self.ends[k]) - 1))
            one = np.unpackbits(np.frombuffer(data, np.uint8), count=self.tokens).view(bool)
            out = np.empty_like(at)
            # Places, not masks: those take several times as long where bits are mixed.
            out[np.flatnonzero(~one)] = at[: self.zeros[k]]
            out[np.flatnonzero(one)] = at[self.zeros[k] :] | at.dtype.type(1 << (self.bits - 1 - k))
            at = out
        return at.astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The tokens of the k-th document, one by one."""
        return np.array([self.access(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)
