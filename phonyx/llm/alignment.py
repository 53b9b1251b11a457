"""Tokens of two vocabularies over the same text: minimal groups, links, and how often each pair of ids is linked in the corpus.

The overlap graph of a text has its A and B tokens as nodes; two are joined
where their byte ranges overlap. Its connected components, found by union-find
(vectorised: hooking to the lesser root, then halving of paths), are exactly
the smallest runs that both vocabularies end together. Each component's members
are expanded into their overlapping pairs, the links.

No token crosses the places where `parts_of` cuts a text, in either
vocabulary, so components lie within parts. A task takes texts in blocks,
encodes and aligns each distinct part of a block once, and keeps for each text
the list of its parts. A block's pairs of ids with their counts are summed over
all blocks in a shuffle by pair, joined with the highest count of their B id,
and sent back to the blocks, one row for each block and distinct pair, so a
pair that is everywhere is one row a block. A block holds at most `block`
characters, besides its last text.

Null and empty texts, and those that one of the vocabularies does not give
back byte for byte, have zeros and an empty digest. A text with a part that
is not given back is aligned as a whole. Rows are independent: repeated rows
and ids, null ids and other columns are allowed, and repeated texts count as
often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import byte_tokens, parts_of, piece_tokens

#: Ids of the second vocabulary are below this, so a pair of ids is one number.
RADIX = 1 << 20


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's connected component, by union-find over all edges at once."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a root hangs below the least root it meets
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    return root


class Aligned:
    """Texts one after another, aligned: `ends_a` and `ends_b` are where their tokens end, in bytes of the whole."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        starts_a, starts_b = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (ends_a, ends_b))
        na, nb = len(ends_a), len(ends_b)
        # Each token is joined with the other side's token that holds its first byte: enough to connect every overlap.
        u = np.concatenate([np.arange(na), np.searchsorted(ends_a, starts_b, "right")])
        v = np.concatenate([na + np.searchsorted(ends_b, starts_a, "right"), na + np.arange(nb)])
        root = components(na + nb, u, v)
        # Components cover the bytes from left to right, so their least A tokens number them in order.
        found, group = np.unique(root, return_inverse=True)
        self.group_a, self.group_b, self.groups = group[:na], group[na:], len(found)
        # Members of a component expand into links: an A token meets B tokens from the one with its first byte to the one with its last.
        first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
        many = last - first + 1
        self.link_a = np.repeat(np.arange(na), many)
        self.link_b = np.repeat(first, many) + np.arange(len(self.link_a)) - np.repeat(np.cumsum(many) - many, many)

    def shown(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bytes for each token in the order groups are written, the decimal id and the sign after it padded by zero bytes, and the tokens' order."""
        group = np.concatenate([self.group_a, self.group_b]) * 2
        group[len(ids_a) :] += 1
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([ids_a, ids_b])[order]
        after = np.append(group[1:], group[-1:] + 2)
        sign = np.where(after == group, ord(","), np.where(after // 2 == group // 2, ord("|"), ord(";"))).astype(np.uint8)
        cells = np.zeros((len(ids), 8), np.uint8)
        cells[:, 7] = sign
        left = ids.copy()
        for k in range(6, -1, -1):
            cells[:, k] = np.where((left > 0) | (k == 6), 48 + left % 10, 0)
            left //= 10
        return cells, order


class Numbers(dict):
    """Numbers its keys from 0 as they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Block:
    """The texts of a block and all that the corpus counts are not needed for."""

    def __init__(self, a, b, bytes_a: list[bytes], bytes_b: list[bytes]) -> None:
        self.a, self.b, self.bytes_a, self.bytes_b = a, b, bytes_a, bytes_b
        self.length_a, self.length_b = np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b])
        self.cuts = a.cuts and b.cuts
        self.number = Numbers()
        self.docs: list[np.ndarray | None] = []

    def numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, parts), np.int32, len(parts))

    def add(self, text: str | None) -> None:
        """The space before the text joins its first part, so every part has one before it."""
        self.docs.append(self.numbers(parts_of(text) if self.cuts else [text]) if text else None)

    def encode(self, parts: list[str]) -> tuple:
        """Ids of both sides, their numbers for each part, and whether each part is given back."""
        (flat_a, n_a), (flat_b, n_b) = self.a.flat(parts), self.b.flat(parts)
        want = [b" " + p.encode() for p in parts]
        good = np.ones(len(parts), bool)
        for flat, n, of, size in ((flat_a, n_a, self.bytes_a, self.length_a), (flat_b, n_b, self.bytes_b, self.length_b)):
            ids = flat.tolist()
            if b"".join(map(of.__getitem__, ids)) == b"".join(want) and np.array_equal(np.add.reduceat(size[flat], np.cumsum(n) - n), [len(w) for w in want]):
                continue
            at = 0
            for k, (m, w) in enumerate(zip(n.tolist(), want)):
                if b"".join([of[i] for i in ids[at : at + m]]) != w:
                    good[k] = False
                at += m
        return flat_a, flat_b, n_a, n_b, good

    def finish(self, slab: int = 20_000) -> dict:
        tokens, pairs, shown, good, at = [], [], [], [], 0
        texts = list(self.number)
        while at < len(texts):
            parts = texts[at : at + slab]
            flat_a, flat_b, n_a, n_b, fine = self.encode(parts)
            keep_a, keep_b = np.repeat(fine, n_a), np.repeat(fine, n_b)
            flat_a, flat_b, n_a, n_b = flat_a[keep_a], flat_b[keep_b], n_a * fine, n_b * fine
            found = Aligned(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]))
            of_a, of_b = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
            last_of_group = np.append(found.group_a[1:] != found.group_a[:-1], True) if len(of_a) else np.zeros(0, bool)
            cells, order = found.shown(flat_a, flat_b)
            where = np.concatenate([of_a, of_b])[order]
            edges = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(parts)))])
            shown += [cells[x:y].tobytes().translate(None, b"\0") for x, y in zip(edges[:-1], edges[1:])]
            tokens.append(np.stack([n_a, n_b, np.bincount(of_a[last_of_group], minlength=len(parts)), np.bincount(of_a[found.link_a], minlength=len(parts))]))
            pairs.append(flat_a[found.link_a] * RADIX + flat_b[found.link_b])
            good.append(fine)
            at += slab
            if at >= len(texts):
                # Texts with a part that is not given back are taken whole, as parts of their own; these are last.
                fine = np.concatenate(good)
                for k, d in enumerate(self.docs):
                    if d is not None and len(d) > 1 and not fine[d].all():
                        self.docs[k] = self.numbers([" ".join([texts[i] for i in d])])
                texts = list(self.number)
                if len(texts) > len(fine):
                    at = len(fine)
        counts = np.concatenate(tokens, axis=1) if tokens else np.zeros((4, 0), np.int64)
        pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        fine = np.concatenate(good) if good else np.zeros(0, bool)
        docs = [d if d is not None and fine[d].all() else None for d in self.docs]
        used = np.concatenate([d for d in docs if d is not None] or [np.zeros(0, np.int32)])
        times = np.repeat(np.bincount(used, minlength=len(texts)), counts[3])
        distinct, of = np.unique(pair, return_inverse=True)
        total = np.bincount(of, times, minlength=len(distinct)).astype(np.int64)
        return {"docs": docs, "counts": counts, "shown": shown, "links": of.astype(np.int32), "distinct": distinct, "total": total}


def digest(shown: list[bytes], doc: np.ndarray | None) -> str:
    """The hex digest of a text's groups; the sign after its last token is left out."""
    return "" if doc is None else hashlib.sha256(b"".join([shown[i] for i in doc])[:-1]).hexdigest()


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def blocks_of(docs: DataFrame, byte_path: str, piece_path: str, block: int) -> DataFrame:
    """A row for each block: what is known of its texts, and its distinct pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, part, seq = byte_tokens(byte_path, plain=True), piece_tokens(piece_path), TaskContext.get().partitionId(), 0
        bytes_a, bytes_b = a.token_bytes(), b.token_bytes()
        state, ids, size = Block(a, b, bytes_a, bytes_b), [], 0

        def flush() -> pa.RecordBatch:
            done = state.finish()
            lengths = np.array([0 if d is None else len(d) for d in done["docs"]], np.int32)
            flat = np.concatenate([d for d in done["docs"] if d is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
            row = {
                "block": [f"{part}-{seq}"], "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": [squeezed(lengths)], "parts": [squeezed(flat)], "counts": [squeezed(done["counts"].astype(np.int32))],
                "links": [squeezed(done["links"])], "digests": [[digest(done["shown"], d) for d in done["docs"]]],
                "pair": pa.array([done["distinct"][done["total"] > 0]], pa.list_(pa.int64())), "n": pa.array([done["total"][done["total"] > 0]], pa.list_(pa.int64())), "distinct": [squeezed(done["distinct"])],
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                state.add(t)
                size += len(t or "")
                if size >= block or len(ids) >= 200_000:
                    yield flush()
                    state, ids, size, seq = Block(a, b, bytes_a, bytes_b), [], 0, seq + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    form = "block string, doc_ids array<long>, lengths binary, parts binary, counts binary, links binary, digests array<string>, pair array<long>, n array<long>, distinct binary"
    return materialize(rows.mapInArrow(run, form), "alignblocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): how many links hold each pair of ids in the whole corpus, and whether that is the most of its B id."""
    flat = blocks.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    sums = flat.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(RADIX - 1)))
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return sums.join(most, "b").select("pair", F.shiftright("pair", RADIX.bit_length() - 1).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def finish_block(blocks: pa.Table, weights: pa.Table) -> pa.Table:
    row = blocks.to_pylist()[0]
    lengths, flat, links, distinct = (unsqueezed(row[k], t) for k, t in (("lengths", "<i4"), ("parts", "<i4"), ("links", "<i4"), ("distinct", "<i8")))
    counts = unsqueezed(row["counts"], "<i4").reshape(4, -1).astype(np.int64)
    n, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    at = np.searchsorted(distinct, weights.column("pair").to_numpy())
    n[at], best[at] = weights.column("n").to_numpy(), weights.column("best").to_numpy().astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(counts[3])])
    sums = [np.concatenate([[0], np.cumsum(x[links])]) for x in (best, n)]
    of_part = np.stack([*counts, *(s[edges[1:]] - s[edges[:-1]] for s in sums)])
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    columns = []
    for x in of_part:
        s = np.concatenate([[0], np.cumsum(x[flat])])
        columns.append(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return pa.table([pa.array(row["doc_ids"], pa.int64()), *columns, pa.array(row["digests"], pa.string())], ["doc_id", *names, "groups_sha256"])


def align(docs: DataFrame, byte_path: str, piece_path: str, block: int = 24 << 20) -> DataFrame:
    """A row for each document: tokens of both sides, groups, links, and what the corpus counts say of its links."""
    blocks = blocks_of(docs, byte_path, piece_path, block)
    weights = materialize(pair_counts(blocks).select("pair", "n", "best"), "paircounts")
    each = blocks.select(F.col("block").alias("of"), F.explode("pair").alias("pair")).join(weights, "pair")
    known = blocks.drop("pair", "n").groupBy("block")
    return known.cogroup(each.groupBy("of")).applyInArrow(finish_block, ROWS)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
