"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Documents whose fingerprints differ in at most `radius` bits
are linked, and a component of links is one group.

Candidates come from an exact pigeonhole scheme: the 64 bits are cut into
`blocks` blocks, and two fingerprints within the radius agree on at least
blocks - radius of them, so they meet under one of the keys made of that many
blocks. More blocks make longer keys and smaller groups, for larger corpora.
Within a group the fingerprints stand as bit planes, 64 to a machine word; a
query runs down the planes, adds its differing bits into carry-save counters
of all 64 lanes at once, and is dropped as soon as every lane has passed the
radius. A key with more than `hot` different fingerprints is split again by
the pigeonhole principle over its remaining bits; what is still larger is dealt
into blocks whose pairs are compared in tasks of their own. So no key needs a
cap and no task gets more than a few times `hot` fingerprints of a key.

Exact copies share a fingerprint and are one node from the start. Null and
empty texts have fingerprint zero and are linked like any other. Rows without
an id take part under their fingerprint but have no component of their own
unless another row of the group has an id. Repeated rows get equal results,
as do rows of one id and text; texts of any length are read whole, and other
columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .components import connected_components

#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bit j of every byte value, to turn byte histograms into bit counts.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text; a text of fewer words is one shingle."""
    # bytes.split() cuts at exactly space, tab, \n, \v, \f and \r.
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(joined)]))
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a text."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for i in range(8):
        ones = np.bincount(octets[:, i], minlength=256) @ BYTE_BITS
        for j in np.flatnonzero(2 * ones > len(hashes)).tolist():
            out |= 1 << (8 * i + j)
    return out - (1 << 64) if out >> 63 else out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint_of(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def close_pairs(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (later, earlier) within the radius inside consecutive groups of the given sizes, bit-sliced."""
    found = list(close_slabs(prints[:, None], sizes, radius))
    none = np.zeros(0, np.int64)
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (none, none)


def close_slabs(prints: np.ndarray, sizes: np.ndarray, radius: int, slab: int = 1 << 19, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of close_pairs slab by slab, for fingerprints of any number of 64-bit words (one row each).

    With roots, a word of lanes that all have the query's root is passed over.
    """
    bits = 64 * prints.shape[1]
    width = (radius + 1).bit_length() - 1
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(prints)) - np.repeat(first, sizes)
    lane, word = (at & 63).astype(np.uint64), at >> 6
    words_in = (sizes + 63) >> 6
    word_base = np.repeat(np.cumsum(words_in) - words_in, sizes)
    opens = np.flatnonzero(lane == 0)
    one = np.uint64(1)
    planes = np.stack([np.add.reduceat(((prints[:, b >> 6] >> np.uint64(b & 63)) & one) << lane, opens) for b in range(bits)])
    word_row = opens  # the row of lane 0 of each word
    if root is not None and len(root):
        least, most = np.minimum.reduceat(root, opens), np.maximum.reduceat(root, opens)
    todo = np.cumsum(word + 1)
    row = 0
    while row < len(prints):
        stop = max(row + 1, int(np.searchsorted(todo, (todo[row - 1] if row else 0) + slab, "right")))
        rows = np.arange(row, stop)
        n = word[rows] + 1
        query = np.repeat(rows, n)
        step = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        target = word_base[query] + step
        if root is not None:
            other = np.flatnonzero((least[target] != root[query]) | (most[target] != root[query]))
            query, step, target = query[other], step[other], target[other]
            if not len(query):
                row = stop
                continue
        mask = np.where(step == word[query], (one << lane[query]) - one, ~np.uint64(0))
        q = prints[query]
        counters = [np.zeros(len(query), np.uint64) for _ in range(width)]
        beyond = ~mask
        for b in range(bits):
            carry = planes[b][target] ^ (np.uint64(0) - ((q[:, b >> 6] >> np.uint64(b & 63)) & one))
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            beyond |= carry
            if b % 8 == 7:
                live = np.flatnonzero(~beyond)
                if len(live) < len(query):
                    query, target, q, beyond = query[live], target[live], q[live], beyond[live]
                    counters = [c[live] for c in counters]
                if not len(live):
                    break
        near = ~beyond
        found_a, found_b = [], []
        for b in range(64):
            hit = np.flatnonzero((near >> np.uint64(b)) & one)
            if len(hit):
                found_a.append(query[hit])
                found_b.append(word_row[target[hit]] + b)
        row = stop
        if found_a:
            yield np.concatenate(found_a), np.concatenate(found_b)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each of n rows reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def star_links(radius: int):
    """For mapInArrow over rows (key, fp, node) sorted by key: spanning links (u, v) of each key's close pairs."""

    def links(fp: np.ndarray, node: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
        several = np.repeat(sizes > 1, sizes)
        fp, node, sizes = fp[several], node[several], sizes[sizes > 1]
        if not len(sizes):
            return None
        a, b = close_pairs(fp.view(np.uint64), sizes, radius)
        root = local_roots(len(fp), a, b)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["u", "v"]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(upto_last_key: bool) -> pa.RecordBatch | None:
            key, fp, node = (np.concatenate(x) for x in zip(*held))
            held.clear()
            cut = int(np.searchsorted(key, key[-1])) if upto_last_key else len(key)
            if cut < len(key):
                held.append((key[cut:], fp[cut:], node[cut:]))
            if not cut:
                return None
            edges = np.concatenate(([0], np.flatnonzero(np.diff(key[:cut])) + 1, [cut]))
            return links(fp[:cut], node[:cut], np.diff(edges))

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
                if sum(len(x[0]) for x in held) >= 200_000 and (out := flush(True)) is not None:
                    yield out
        if held and (out := flush(False)) is not None:
            yield out

    return run


def block_keys(radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each key: the (shift, width) of the blocks it is made of; together they meet every pair within the radius."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [list(x) for x in combinations(parts, blocks - radius)]


def bits_of(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def in_cells(keyed: DataFrame, keys: DataFrame, hot: int) -> DataFrame:
    """The rows of crowded keys (key, n) in cells that are keys of their own: one cell for each pair of a key's blocks of about `hot` rows."""
    blocks = F.ceil(F.col("n") / hot).cast("int")
    placed = keyed.join(keys.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).withColumn("_b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    other = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.withColumn("key", F.xxhash64("key", F.least("_b", "_o"), F.greatest("_b", "_o"))).select(keyed.columns)


def crowded_keys(keyed: DataFrame, hot: int) -> DataFrame:
    return materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot-keys")


def links(nodes: DataFrame, radius: int = 3, blocks: int = 5, hot: int = 4096) -> DataFrame:
    """Spanning links (u, v) between nodes (fp, node) whose fingerprints differ in at most `radius` bits.

    nodes holds every fingerprint once. radius must be 2^w - 1, where the
    counters overflow, and less than blocks.
    """
    if (radius + 1) & radius or radius >= blocks:
        raise ValueError("radius must be 2^w - 1 and less than blocks")
    keys, rests = [], []
    for t, chosen in enumerate(block_keys(radius, blocks)):
        keys.append(F.xxhash64(F.lit(t), *[bits_of(*p) for p in chosen]))
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        free = [b for b in range(64) if not mask >> b & 1]
        # The key's free bits in radius + 1 parts, of which one is equal in any close pair.
        masks = [sum(1 << b for b in free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)]) for i in range(radius + 1)]
        rests.append(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)]))
    # Keys are hashed; a collision only adds comparisons, which are exact.
    both = F.arrays_zip(F.array(*keys).alias("k"), F.array(*rests).alias("r"))
    keyed = nodes.select("fp", "node", F.explode(both).alias("x")).select(F.col("x.k").alias("key"), "fp", "node", F.col("x.r").alias("rest"))
    crowded = crowded_keys(keyed, hot)
    plain = keyed.drop("rest")
    if not crowded.isEmpty():
        split = keyed.join(crowded, "key", "left_semi").select(F.explode("rest").alias("part"), "key", "fp", "node").select(F.xxhash64("key", "part").alias("key"), "fp", "node")
        still = crowded_keys(split, hot)
        plain = keyed.join(crowded, "key", "left_anti").drop("rest").unionByName(split.join(still, "key", "left_anti")).unionByName(in_cells(split, still, hot))
    return plain.repartition("key").sortWithinPartitions("key").mapInArrow(star_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least doc_id of its group.

    The last join gives every document its fingerprint's component; a
    fingerprint that very many documents share (that of the empty text) is
    skew on the documents' side alone, which adaptive execution splits.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    roots = connected_components(links(classes.where("node IS NOT NULL"), radius, blocks))
    rooted = classes.join(roots, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("component_id"))
    return prints.join(rooted, F.col("fp") == F.col("_fp"), "left").drop("_fp")


#: keep_one: words of a shingle, least Jaccard similarity, share of pairs at just that similarity that the bands may miss,
#: documents that a band's key holds on average, and differing bits of the first 128 that a candidate may have.
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_MISS, STAGE_GROUP, STAGE_RADIUS = 5, 0.8, 0.001, 1024, 31
#: First bits of the fingerprint that cut a crowded key while only nearest neighbours are looked for.
CELL_BITS = 16


def bands_for(documents: int) -> tuple[int, int]:
    """(bands, bits of each): keys long enough for the corpus, and as many of them as the recall needs."""
    width = max(10, math.ceil(math.log2(max(1, documents) / STAGE_GROUP)))
    differ = math.acos(2 * STAGE_SIMILARITY / (1 + STAGE_SIMILARITY)) / math.pi
    return math.ceil(math.log(STAGE_MISS) / math.log(1 - (1 - differ) ** width)), width


def wide_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The majority bits of a set of shingle hashes, each spread over as many 64-bit words as are needed."""
    steps = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, bits // 64 + 1, dtype=np.uint64)
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 4096):
        x = hashes[i : i + 4096, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        octets = (x ^ (x >> np.uint64(31))).view(np.uint8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return (2 * ones > len(hashes)).astype(np.uint8)


def shingle_set(text: str | None) -> tuple[np.ndarray, int]:
    """The different shingle hashes of a text, and a signed digest of them, which names the set."""
    own = np.unique(shingle_hashes(text, STAGE_SHINGLE))
    digest = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return own, digest - (1 << 64) if digest >> 63 else digest


def row_key(docs: DataFrame) -> list[Column]:
    """What a row is known by: its id and a hash of its text."""
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key")]


def stage_prints(docs: DataFrame, bands: int, width: int) -> DataFrame:
    """(doc_id, text_key, node, f0, f1, keys): the set's digest, 128 bits of its wide fingerprint and the keys of its bands."""
    bits = 64 * max(2, -(-bands * width // 64))
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                prints = [(d, wide_bits(s, bits)) for s, d in (shingle_set(t.as_py()) for t in part.column(2))]
                wide = np.stack([w for _, w in prints])
                short = np.packbits(wide[:, :128], axis=1, bitorder="little").view(np.int64)
                keys = wide[:, : bands * width].reshape(-1, bands, width).astype(np.int64) @ powers + (np.arange(bands, dtype=np.int64) << width)
                offsets = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([d for d, _ in prints], pa.int64()), pa.array(short[:, 0].copy()), pa.array(short[:, 1].copy()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    ["doc_id", "text_key", "node", "f0", "f1", "keys"],
                )

    return docs.select(*row_key(docs), docs["text"]).mapInArrow(run, "doc_id long, text_key long, node long, f0 long, f1 long, keys array<long>")


def by_key(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by their first column in runs of whole keys, of about `most` rows where keys allow."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            key = b.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(key, key[-1]))
            done = [*held[:-1], b.slice(0, cut)]
            # A key that goes on through all that is held waits for its end.
            if done[0].num_rows and done[0].column(0)[0].as_py() != key[-1]:
                ends = [int(np.searchsorted(x.column(0).to_numpy(zero_copy_only=False), key[-1])) for x in held]
                yield [x.slice(0, e) for x, e in zip(held, ends) if e]
                held = [x.slice(e) for x, e in zip(held, ends) if e < x.num_rows]
    if held:
        yield held


def columns_of(part: list[pa.RecordBatch], n: int) -> list[np.ndarray]:
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in part]) for i in range(n)]


def apart(key: np.ndarray, band: np.ndarray, f: np.ndarray, root: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, differing bits) of rows with one key, within the radius and of different roots; rows are sorted by key.

    Each pair under the first of its common bands, as far as f's bits show them.
    """
    if not len(key):
        return
    sizes = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    f, root, band, sizes = f[several], root[several], band[several], sizes[sizes > 1]
    for a, b in close_slabs(f, sizes, STAGE_RADIUS, 1 << 15, root) if len(f) else ():
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        differ = f[a] ^ f[b]
        bits = np.unpackbits(differ.view(np.uint8).reshape(len(a), -1), axis=1, bitorder="little")
        shown = bits.shape[1] // width
        common = ~bits[:, : shown * width].reshape(len(a), shown, width).any(2)
        first = np.where(common.any(1), common.argmax(1), shown)
        keep = first >= np.minimum(band[a], shown)
        yield several[a[keep]], several[b[keep]], bits[keep].sum(1, dtype=np.int64)


def dealt(nodes: DataFrame, first_bits: bool, hot: int) -> tuple[DataFrame, DataFrame]:
    """(key, band, f0, f1, node, root): nodes (node, f0, f1, keys, root) under each of their keys, crowded keys in cells; and the crowded keys.

    Keys whose nodes all have one root are left out where they are crowded. A
    key of more than `hot` nodes is cut by its nodes' first bits, so that only
    nodes of one cell meet, or into cells for all pairs of blocks.
    """
    keyed = nodes.select(F.posexplode("keys").alias("band", "key"), "f0", "f1", "node", "root").select("key", "band", "f0", "f1", "node", "root")
    counted = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where(F.col("n") > hot), "hot-keys")
    crowded = counted.select("key", "n")
    if crowded.isEmpty():
        return keyed, crowded
    mixed = counted.where("least < most").select("key", "n")
    many = keyed.join(mixed, "key", "left_semi")
    cells = many.withColumn("key", F.xxhash64("key", F.shiftrightunsigned("f0", 64 - CELL_BITS))) if first_bits else in_cells(many, mixed, hot)
    return keyed.join(crowded, "key", "left_anti").unionByName(cells.select(keyed.columns)), crowded


def neighbours(nodes: DataFrame, width: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v): each node with the nearest and with the least node of another root that it meets; and the crowded keys.

    Nodes of a large group meet in few least ones, which joins it.
    """
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_key(batches, 50_000):
            key, band, f0, f1, node, root = columns_of(part, 6)
            n = len(node)
            best, least = np.full(n, none), np.full(n, none)
            for a, b, far in apart(key, np.zeros(n, np.int64), np.stack((f0, f1), 1).view(np.uint64), root, width):
                np.minimum.at(best, a, far * n + b)
                np.minimum.at(best, b, far * n + a)
                np.minimum.at(least, a, node[b])
                np.minimum.at(least, b, node[a])
            a = np.flatnonzero(best < none)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[best[a] % n]), pa.array(best[a] // n)], ["u", "v", "far"])
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(least[a]), pa.array(np.full(len(a), -1))], ["u", "v", "far"])

    rows, crowded = dealt(nodes, True, hot)
    found = rows.repartition("key").sortWithinPartitions("key", "root").mapInArrow(run, "u long, v long, far long")
    found = found.groupBy("u", (F.col("far") < 0).alias("least")).agg(F.min(F.struct("far", "v")).alias("m")).select("u", "m.v")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), crowded


def remaining_links(nodes: DataFrame, sets: DataFrame, width: int, hot: int) -> DataFrame:
    """Links (u, v) that join all nodes of different roots which share a key, are within the radius and have the similarity, exactly.

    First which nodes have such a candidate, under which key; those then meet
    with their shingle sets, and each key's pairs are checked from the nearest
    on, where they stand. Pairs that links found before join need no check, so
    what leaves a task are fewer links than nodes.
    """

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_key(batches, 50_000):
            key, band, f0, f1, node, root = columns_of(part, 6)
            met = np.zeros(len(node), bool)
            for a, b, _ in apart(key, band, np.stack((f0, f1), 1).view(np.uint64), root, width):
                met[a] = met[b] = True
            k = np.flatnonzero(met)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (key, band, f0, f1, node, root)], ["key", "band", "f0", "f1", "node", "root"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_key(batches, 2_000):
            key, band, f0, f1, node, root = columns_of(part, 6)
            own = [x for b in part for x in b.column(6)]
            found = list(apart(key, band, np.stack((f0, f1), 1).view(np.uint64), root, width))
            if not found:
                continue
            a, b, far = (np.concatenate(x) for x in zip(*found))
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            out = []
            for i, j in zip(a[order := np.argsort(far, kind="stable")].tolist(), b[order].tolist()):
                ri, rj = top(int(root[i])), top(int(root[j]))
                if ri != rj:
                    x, y = (own[k].values.to_numpy() for k in (i, j))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= STAGE_SIMILARITY * (len(x) + len(y) - both):
                        up[max(ri, rj)] = min(ri, rj)
                        out.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])

    rows, _ = dealt(nodes, False, hot)
    schema = "key long, band int, f0 long, f1 long, node long, root long"
    met = materialize(rows.repartition("key").sortWithinPartitions("key", "root").mapInArrow(needed, schema), "stage-met")
    full = met.join(sets, "node").select("key", "band", "f0", "f1", "node", "root", "shingles")
    return full.repartition("key").sortWithinPartitions("key", "root").mapInArrow(check, "u long, v long").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                sets = [shingle_set(t.as_py()) for t in b.slice(at, 1000).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([d for _, d in sets], pa.int64()), pa.array([s.view(np.int64) for s, _ in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have the Jaccard similarity, exactly."""
    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("u", "a"), ("v", "b")))
    both = pairs.join(a, "u").join(b, "v").withColumn("n", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("n") / (F.size("a") + F.size("b") - F.col("n")) >= STAGE_SIMILARITY).select("u", "v")


def with_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined with keys (doc_id, text_key) as given by row_key."""
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_key"]), how)


def similar_groups(docs: DataFrame, hot: int = 8192) -> DataFrame:
    """(doc_id, text_key, component_id, head) of every row, by links of Jaccard similarity 0.8 of five-word shingles.

    head (none, doc_id, text_key) is the least row of the group, those without
    an id last; component_id is its id, text_key the hash of the text. Equal shingle sets are one
    node. Bands of a wide SimHash make the candidates, 128 of its bits choose
    among them bit-sliced, and every link is checked on the shingle sets. Two
    turns link each node with two neighbours of another group; what
    they leave in different groups is compared pair by pair, so a large group
    costs few checks. Keys of more than `hot` nodes are compared in parts.
    """
    bands, width = bands_for(docs.count())
    prints = materialize(stage_prints(docs, bands, width), "stage-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = materialize(prints.groupBy("node").agg(first.alias("head"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("keys").alias("keys")), "stage-classes")
    found, crowded = neighbours(classes.withColumn("root", F.col("node")), width, hot)
    edges = materialize(found, "stage-candidates")
    # Whatever has a candidate at all has one in the first turn, or is in a crowded key.
    some = edges.select(F.explode(F.array("u", "v")).alias("node"))
    if not crowded.isEmpty():
        some = some.unionByName(classes.select(F.explode("keys").alias("key"), "node").join(crowded, "key", "left_semi").select("node"))
    near = materialize(classes.join(some.distinct(), "node", "left_semi"), "stage-near")
    heads = near.select("head.doc_id", "head.text_key").distinct()
    sets = shingle_sets(with_key(docs, heads, "left_semi")).join(near.select("node"), "node", "left_semi")
    sets = materialize(sets.dropDuplicates(["node"]), "stage-sets")
    linked = materialize(similar(edges, sets), "stage-links")
    for last in (False, True):
        rooted = near.join(connected_components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = materialize(rooted, "stage-rooted")
        more = remaining_links(rooted, sets, width, hot) if last else similar(neighbours(rooted, width, hot)[0], sets)
        old, linked = linked, materialize(linked.unionByName(more), "stage-links")
        discard(old)
        discard(rooted)
    roots = connected_components(linked)
    rooted = materialize(classes.select("node", "head").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "head"), "stage-roots")
    for old in (edges, near, sets, linked, classes):
        discard(old)
    least = rooted.groupBy("root").agg(F.min("head").alias("head"))
    return prints.select("doc_id", "text_key", "node").join(rooted.select("node", "root"), "node").join(least, "root").select("doc_id", "text_key", F.col("head.doc_id").alias("component_id"), "head")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar_groups: the least id, of rows with one id the least hash of the text.

    Rows without an id stay only if no row of their group has one. Rows equal
    in id and text are copies of each other and leave one, any of them if they
    differ in other columns. Extra columns travel along under any name.
    """
    grouped = similar_groups(docs)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    heads = materialize(grouped.where(own == F.col("head")).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")), "groups")
    kept = with_key(docs, heads.where("n = 1"), "left_semi")
    if not heads.where("n > 1").isEmpty():
        kept = kept.unionByName(with_key(docs, heads.where("n > 1"), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def op1(spark, sf_dir: str) -> DataFrame:
    grouped = near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
