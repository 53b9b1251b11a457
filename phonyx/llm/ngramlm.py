"""Language-model scores of documents from an Elias-Fano n-gram trie that is sharded over the cluster.

The model is a trigram model with absolute discounting that backs off without
exclusion: a seen n-gram has (count - discount) / count of its context, an
unseen one the mass its context has left over times the shorter n-gram's
probability; a word has (count + 1) / (all + kinds + 1). Logarithms of these
products are sums, so a document's score is the sum of terms that can be found
in different places. No part of the model is ever in one place as a whole.

Every token travels once, as (token before, token, token after, document), to
the shard of the token in the middle; there stand all the counts that its
terms need: of the word, of its predecessors (contexts), of its successors and
of the trigrams around it. A task gathers the records of its shard, builds the
trie of the training records, answers all of its records from the trie, and
sends one row of sums for each document. The levels of the trie are Elias-Fano
coded arrays in a memory-mapped file: words; for each word the successors; for
each word the contexts; for each context its successors as places among the
successors of the word (context-relative numbers), found by successor search.
Pointers between levels are Elias-Fano coded, too; probabilities and backed-off
masses are quantised to 8 bits.

Words that alone make up more than twice a shard's share are split: half of a
token's terms goes to the shard of (token before, token), half to that of
(token, token after), and pairs of such words by all three; their totals come
from an exact count that is made before and broadcast. There are at most half
as many such words as shards, and a shard has some `shard_tokens` tokens, so
this table (24 bytes a word) grows with the input, by some 12 bytes for each
million tokens. Records of a document that are equal travel as one with a
count. A partition holds one shard, so a task's memory is that of one shard.

Words and tokens are told apart by 64-bit hashes, neighbours within a word's
lists by 32 bits. Null and empty texts are one end token. Rows without an id
are scored, not learned from, and count as not held out. Repeated rows are
scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .eliasfano import EliasFano, Store
from .importance import text_bytes

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DISCOUNT = 0.8
LOG = np.log10


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, at: np.ndarray, powers: dict, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of texts (bytes `data`, offsets `at`), chunk by chunk of whole words."""
    hashes, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    a, n = int(at[0]), int(at[-1])
    while a < n:
        b = min(n, a + chunk)
        while b < n:  # to the next blank, or the next text
            gap = np.flatnonzero(SPACE[data[b : b + chunk]])
            following = int(at[np.searchsorted(at, b, "left")])
            b = min(n, following, b + int(gap[0]) if len(gap) else min(n, b + chunk))
            if len(gap) or b == following:
                break
        part = data[a:b]
        space = SPACE[part]
        cut = at[(at > a) & (at < b)] - a
        starts = ~space
        starts[1:] &= space[:-1]
        starts[cut[~space[cut]]] = True
        ends = ~space
        ends[:-1] &= space[1:]
        ends[cut[~space[cut - 1]] - 1] = True
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if len(part) > powers.get("n", 0):
            powers["n"] = len(part)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                powers[name] = np.concatenate((np.ones(1, U64), np.cumprod(np.full(len(part), base))))
        terms = np.cumsum((LOWER[part].astype(U64) + U64(1)) * powers["up"][: len(part)])
        before = np.where(first > 0, terms[np.maximum(first - 1, 0)], U64(0))
        hashes.append(mixed((terms[last - 1] - before) * powers["down"][first] + (last - first).astype(U64)))
        rows.append(np.searchsorted(at, first + a, "right") - 1)
        a = b
    return np.concatenate(hashes), np.concatenate(rows)


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(ids, training, hashes, rows) of groups of documents with about `most` words; columns: id, training, text."""
    powers: dict = {}
    for b in batches:
        data, at = text_bytes(b.column(2))
        ids, training = b.column(0), np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
        i = 0
        while i < len(ids):
            # Six bytes a word, on average; a longer text is a group of its own.
            j = min(len(ids), i + 30_000, max(i + 1, int(np.searchsorted(at, at[i] + 6 * most, "right")) - 1))
            hashes, rows = word_hashes(data, at[i : j + 1], powers)
            yield ids.slice(i, j - i), training[i:j], hashes, rows
            i = j


def sequences(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(word, before, after, row) of every token, begin and end tokens of all n documents included."""
    sizes = np.bincount(rows, minlength=n) + 2
    first = np.cumsum(sizes) - sizes
    w = np.empty(int(sizes.sum()), U64)
    w[first], w[first + sizes - 1] = BEGIN, END
    w[np.arange(len(hashes)) + 2 * rows + 1] = hashes
    before, after = np.zeros_like(w), np.zeros_like(w)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[first], after[first + sizes - 1] = U64(0), U64(0)
    return w, before, after, np.repeat(np.arange(n), sizes)


def short(h: np.ndarray) -> np.ndarray:
    return (h & U64(0xFFFFFFFF)).astype(np.uint32)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (((mixed(key) >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def pair_key(w: np.ndarray, other: np.ndarray, salt: int) -> np.ndarray:
    return mixed(w + U64(salt)) ^ (other.astype(U64) * BASE)


def member(table_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of x in a sorted table and whether it is there."""
    if not len(table_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table_, x), len(table_) - 1)
    return at, table_[at] == x


# -- words that are too frequent for one shard -------------------------------------------------------------------


def shards_for(docs: DataFrame, shard_tokens: int, least: int) -> int:
    """How many shards the texts are dealt to: by their bytes, six to a token, and two tokens more for each text."""
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return max(least, -(-(size // 6 + 2 * n) // shard_tokens))


def frequent(docs: DataFrame, shards: int) -> SimpleNamespace:
    """The exact totals of words, and pairs of words, with over twice a shard's share."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, defaultdict(int)
        for _, training, hashes, _ in batches_of(batches, 400_000):
            total += len(hashes) + 2 * len(training)
            keys, n = np.unique(hashes, return_counts=True)
            # What has a share of 1 / shards overall has it in some task; a task's list of those is short.
            often = n * shards >= len(hashes)
            for k, c in zip(keys[often].tolist(), n[often].tolist()):
                counts[k] += c
            for k in (BEGIN, END):
                counts[int(k)] += len(training)
        keys = [0, *counts]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, U64).view(np.int64)), pa.array([total, *counts.values()], pa.int64())], ["word", "n"])

    found = materialize(docs.mapInArrow(candidates, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = found.where("word = 0").agg(F.sum("n")).first()[0] or 0
    limit = 2 * total / shards
    hot = np.sort(np.array([r["word"] for r in found.where((F.col("word") != 0) & (F.col("n") > limit)).select("word").collect()], np.int64).view(U64))
    discard(found)
    none = SimpleNamespace(words=hot, count=np.zeros(len(hot)), kinds=np.zeros(len(hot)), pairs=np.zeros(0, U64), pair_count=np.zeros(0), pair_kinds=np.zeros(0))
    if not len(hot):
        return none
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for ids, training, hashes, rows in batches_of(batches, 400_000):
            w, before, after, row = sequences(hashes, rows, len(ids))
            after_end = w != END
            is_hot = member(words, w)[1]
            both = is_hot & member(words, before)[1] & (before != 0)
            for chosen, key in ((is_hot, w), (both, pair_key(w, short(before), 1))):
                at = np.flatnonzero(chosen)
                # A group is a word or a pair, with one token after it.
                joint = pair_key(key[at], short(after[at]), 9)
                _, first, inverse, n = np.unique(joint, return_index=True, return_inverse=True, return_counts=True)
                learned = np.bincount(inverse, training[row[at]], minlength=len(first)).astype(np.int64)
                k = at[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[k].view(np.int64)), pa.array(after[k].view(np.int64)), pa.array(after_end[k]), pa.array(n), pa.array(learned), pa.array(np.full(len(k), chosen is both))],
                    ["key", "after", "goes_on", "n", "learned", "pair"],
                )

    each = docs.mapInArrow(followers, "key long, after long, goes_on boolean, n long, learned long, pair boolean").groupBy("pair", "key", "after").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))
    totals = each.groupBy("pair", "key").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"), F.count_if(F.col("learned") > 0).alias("kinds")).where(~F.col("pair") | (F.col("n") > limit)).toPandas()
    of_words, of_pairs = totals[~totals["pair"]], totals[totals["pair"]]
    keys = of_words["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    none.words, none.count, none.kinds = keys[order], of_words["learned"].to_numpy(float)[order], of_words["kinds"].to_numpy(float)[order]
    keys = of_pairs["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    none.pairs, none.pair_count, none.pair_kinds = keys[order], of_pairs["learned"].to_numpy(float)[order], of_pairs["kinds"].to_numpy(float)[order]
    return none


# -- records on their way to the shards --------------------------------------------------------------------------

#: Which terms of its token a record stands for: all; those of the word and the trigram; those of the bigram.
ALL, FIRST, SECOND = 0, 1, 2


def pack(w: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, merge: bool) -> bytes:
    """Records sorted by word and token before, as bytes; equal ones as one with a count if `merge`."""
    words, place = np.unique(w, return_inverse=True)
    order = np.lexsort((row, b, a, place)) if merge else np.argsort((place.astype(U64) << U64(32)) | a)
    place, a, b, row = place[order], a[order], b[order], row[order]
    n = np.ones(len(a), np.uint32)
    if merge and len(a):
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (row[1:] != row[:-1])))
        at = np.flatnonzero(new)
        n = np.diff(np.concatenate((at, [len(a)]))).astype(np.uint32)
        place, a, b, row = place[at], a[at], b[at], row[at]
    opens = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (a[1:] != a[:-1])))) if len(a) else np.zeros(0, np.int64)
    per_context = np.diff(np.concatenate((opens, [len(a)]))).astype(np.uint32)
    per_word = np.bincount(place[opens], minlength=len(words)).astype(np.uint32)
    per_word, per_context, n = narrow(per_word), narrow(per_context), narrow(n)
    sizes = np.array([len(words), len(opens), len(a), per_word.itemsize, per_context.itemsize, n.itemsize if merge else 0], np.int64)
    return b"".join(x.tobytes() for x in (sizes, words, per_word, a[opens], per_context, b, row.astype(np.uint16), n if merge else n[:0]))


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(word, before, after, row, count) of packed records."""
    n_words, n_contexts, n, word_bytes, context_bytes, count_bytes = np.frombuffer(blob, np.int64, 6).tolist()
    at = 48

    def take(kind: type | str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, k, at)
        at += out.nbytes
        return out

    words, per_word, contexts, per_context = take(U64, n_words), take(f"u{word_bytes}", n_words), take(np.uint32, n_contexts), take(f"u{context_bytes}", n_contexts)
    b, row = take(np.uint32, n), take(np.uint16, n)
    count = take(f"u{count_bytes}", n) if count_bytes else np.ones(n, np.uint8)
    return np.repeat(np.repeat(words, per_word), per_context), np.repeat(contexts, per_context), b, row, count


def routed(hot: SimpleNamespace, w: np.ndarray, before: np.ndarray, after: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(terms, tokens, shard of each)."""
    is_hot = member(hot.words, w)[1]
    plain = np.flatnonzero(~is_hot)
    yield ALL, plain, shard_of(w[plain], shards)
    at = np.flatnonzero(is_hot)
    if not len(at):
        return
    a, b = short(before[at]), short(after[at])
    left, right = pair_key(w[at], a, 1), pair_key(w[at], b, 2)
    three = pair_key(left, b, 3)
    yield FIRST, at, shard_of(np.where(member(hot.pairs, left)[1], three, left), shards)
    # The pair (token, token after) is looked up under the later word.
    ahead = pair_key(after[at], short(w[at]), 1)
    goes_on = w[at] != END
    yield SECOND, at[goes_on], shard_of(np.where(member(hot.pairs, ahead)[1], three, right), shards)[goes_on]


#: Most documents to a group: rows and the training flag share 16 bits.
TRAINED = 1 << 15


# -- the trie of one shard ---------------------------------------------------------------------------------------


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of values and the codebook: means of equally full bins of the different values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    kinds = np.unique(values)
    bin_of = np.arange(len(kinds)) * min(levels, len(kinds)) // len(kinds)
    book = np.bincount(bin_of, kinds) / np.bincount(bin_of)
    return bin_of[np.searchsorted(kinds, values)].astype(np.uint8), book


class Trie:
    """Counts of the training records of one shard as a trie; `terms` looks records up in it."""

    def __init__(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, hot: SimpleNamespace, discount: float):
        self.hot = hot
        n = n.astype(float)
        # Records come sorted by word and context.
        new_word = np.concatenate((np.ones(min(1, len(w)), bool), w[1:] != w[:-1]))
        words, wi = w[new_word], (np.cumsum(new_word) - 1).astype(U64)
        goes_on = w != END
        count = np.bincount(wi.astype(np.int64), n, minlength=len(words))
        succ, si = np.unique((wi << U64(32) | b)[goes_on], return_inverse=True)
        succ_word = (succ >> U64(32)).astype(np.int64)
        succ_count = np.bincount(si, n[goes_on], minlength=len(succ))
        kinds = np.bincount(succ_word, minlength=len(words)).astype(float)
        at, there = member(hot.words, words)
        if there.any():
            count[there], kinds[there] = hot.count[at[there]], hot.kinds[at[there]]
        ctx = wi << U64(32) | a
        new_ctx = np.concatenate((np.ones(min(1, len(w)), bool), ctx[1:] != ctx[:-1]))
        ctx, ci = ctx[new_ctx], np.cumsum(new_ctx) - 1
        ctx_word = (ctx >> U64(32)).astype(np.int64)
        ctx_count = np.bincount(ci, n, minlength=len(ctx))
        # Context-relative numbers: a trigram's last word is its place among the successors of the middle word.
        succ_first = np.searchsorted(succ_word, np.arange(len(words) + 1))
        room = np.diff(succ_first)[ctx_word]
        offset = np.cumsum(room) - room
        relative = si - succ_first[wi[goes_on].astype(np.int64)]
        child, ti = np.unique((offset[ci[goes_on]] + relative).astype(U64), return_inverse=True)
        child_count = np.bincount(ti, n[goes_on], minlength=len(child))
        child_ctx = np.zeros(len(child), np.int64)
        child_ctx[ti] = ci[goes_on]
        ctx_kinds = np.bincount(child_ctx, minlength=len(ctx)).astype(float)
        if len(hot.pairs) and there.any():
            near = np.flatnonzero(there[ctx_word])
            at, known = member(hot.pairs, pair_key(words[ctx_word[near]], (ctx[near] & U64(0xFFFFFFFF)).astype(np.uint32), 1))
            ctx_count[near[known]], ctx_kinds[near[known]] = hot.pair_count[at[known]], hot.pair_kinds[at[known]]
            # A bigram whose two words are frequent: its own total, too.
            for k in np.flatnonzero(there[succ_word]).tolist() if len(hot.pairs) else ():
                following = hot.words[short(hot.words) == np.uint32(succ[k] & U64(0xFFFFFFFF))]
                key = pair_key(following, np.repeat(short(words[succ_word[k] : succ_word[k] + 1]), len(following)), 1)
                place, known = member(hot.pairs, key)
                if known.any():
                    succ_count[k] = hot.pair_count[place[known][0]]
        store = Store()
        self.words = EliasFano(words, 1 << 64, store)
        self.succ = EliasFano(succ, len(words) << 32, store)
        self.ctx = EliasFano(ctx, len(words) << 32, store)
        self.first = EliasFano(succ_first.astype(U64), len(succ) + 1, store)
        self.offset = EliasFano(offset.astype(U64), int(room.sum()) + 1, store)
        self.child = EliasFano(child, int(room.sum()) + 1, store)
        seen2, self.book2 = quantised(LOG(np.maximum(succ_count - discount, 1 - discount) / np.maximum(count[succ_word], 1)))
        seen3, self.book3 = quantised(LOG(np.maximum(child_count - discount, 1 - discount) / np.maximum(ctx_count[child_ctx], 1)))
        left1, self.book1 = quantised(LOG(discount * np.maximum(kinds, 0.5) / np.maximum(count, 1)))
        left2, self.book_ctx = quantised(LOG(discount * np.maximum(ctx_kinds, 0.5) / np.maximum(ctx_count, 1)))
        places = [store.put(x) for x in (seen2, seen3, left1, left2, count)]
        arrays = store.map()
        for level in (self.words, self.succ, self.ctx, self.first, self.offset, self.child):
            level.mapped(arrays)
        self.seen2, self.seen3, self.left1, self.left2, self.count = (arrays[i] for i in places)
        self.kinds = len(words)

    def terms(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each record: the word's count, the sum of its terms, and whether the word itself is backed off to."""
        zero = np.zeros(len(w))
        if not self.kinds:
            at, there = member(self.hot.words, w)
            count = np.where(there, self.hot.count[at], 0.0) if len(self.hot.words) else zero
            return count, zero, np.ones(len(w), bool)
        # Records come in runs of one word and of one context, so each is looked up once.
        new_w = np.concatenate(([True], w[1:] != w[:-1]))
        new_a = new_w | np.concatenate(([True], a[1:] != a[:-1]))
        of_w, of_a = np.cumsum(new_w) - 1, np.cumsum(new_a) - 1
        wi, w_there = self.words.find(w[new_w])
        wi = np.minimum(wi, self.kinds - 1)
        ci, c_there = self.ctx.find(wi[of_w[new_a]].astype(U64) << U64(32) | a[new_a])
        c_there &= w_there[of_w[new_a]]
        ci = np.minimum(ci, self.ctx.n - 1)
        count = np.where(w_there, self.count[wi], 0.0)
        at, is_hot = member(self.hot.words, w[new_w])
        if is_hot.any():
            count[is_hot] = self.hot.count[at[is_hot]]
        goes_on = w != END
        si, s_there = self.succ.find(wi[of_w].astype(U64) << U64(32) | b)
        s_there &= w_there[of_w] & goes_on
        both = np.flatnonzero(s_there & c_there[of_a])
        seen = np.zeros(len(w), bool)
        total = np.zeros(len(w))
        if len(both):
            context = ci[of_a[both]]
            begin = self.first.access(wi)[of_w[both]].astype(np.int64)
            place = self.offset.access(ci)[of_a[both]] + (si[both] - begin).astype(U64)
            ti, t_there = self.child.find(place)
            hit = both[t_there]
            seen[hit] = True
            if kind != SECOND:
                total[hit] = self.book3[self.seen3[ti[t_there]]]
        back = goes_on & ~seen
        if kind != SECOND:
            at = np.flatnonzero(back & c_there[of_a])
            total[at] += self.book_ctx[self.left2[ci[of_a[at]]]]
        if kind != FIRST:
            at = np.flatnonzero(back & s_there)
            total[at] += self.book2[self.seen2[si[at]]]
            at = np.flatnonzero(back & ~s_there)
            left = np.where(w_there, self.book1[self.left1[wi]], 0.0)
            place, is_hot = member(self.hot.words, w[new_w])
            if is_hot.any():
                place = place[is_hot]
                left[is_hot] = np.where(self.hot.count[place] > 0, LOG(DISCOUNT * np.maximum(self.hot.kinds[place], 0.5) / np.maximum(self.hot.count[place], 1)), 0.0)
            total[at] += left[of_w[at]]
        return count[of_w], total, ~c_there[of_a]


def answers(blobs: list[tuple[int, int, bytes]], kind: int, hot: SimpleNamespace, discount: float) -> tuple[tuple[np.ndarray, ...], int, int]:
    """Sums by document row of the records of one shard, and the shard's training tokens and kinds of words."""
    parts = [unpack(x) for _, _, x in blobs]
    batch = np.repeat(np.array([k for k, _, _ in blobs], np.int64), [len(p[0]) for p in parts])
    blobs.clear()  # each document group's records are views of its blob until the next line
    w, a, b, row, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
    del parts
    order = np.argsort(w)
    w, a, b, row, n, batch = w[order], a[order], b[order], row[order], n[order], batch[order]
    # Within a word by context: the places of words are small numbers.
    rank = np.cumsum(np.concatenate(([0], w[1:] != w[:-1]))).astype(U64)
    order = np.argsort(rank << U64(32) | a)
    w, a, b, row, n, batch = w[order], a[order], b[order], row[order], n[order], batch[order]
    trained = row >= TRAINED
    trie = Trie(w[trained], a[trained], b[trained], n[trained], hot, discount)
    count, total, back = trie.terms(w, a, b, kind)
    key, inverse = np.unique(batch + (row & (TRAINED - 1)), return_inverse=True)
    own = (w != BEGIN) & (kind != SECOND)
    sums = lambda x: np.bincount(inverse, x * n, minlength=len(key))
    log_count = np.where(own, LOG(count + 1), 0.0)
    out = key, sums(own & (count > 0)), sums(own & back), sums(log_count), -sums(total + np.where(back, log_count, 0.0))
    if kind != ALL:
        return out, 0, 0
    mine = trained & own
    kinds = int((w[mine][1:] != w[mine][:-1]).sum()) + 1 if mine.any() else 0
    return out, int(n[mine].sum()), kinds


# -- sums on their way back --------------------------------------------------------------------------------------

#: Sums travel as whole multiples of these: of the base score, and of the model's terms.
BASE_STEP, TERM_STEP = 2.0**-32, 2.0**-16


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers, not negative, in as many bytes each as the largest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_numbers(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = blob[at]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 1).reshape(n, width)
    return wide.view("<u8").reshape(-1).astype(np.int64), at + 1 + n * width


def pack_sums(first: int, sums: tuple[np.ndarray, ...]) -> bytes:
    rows, known, back, base, terms = sums
    # Terms are at or below zero but for a rounding of the quantised masses; their sign has a bit of its own.
    minus = np.rint(terms / TERM_STEP).astype(np.int64)
    columns = (np.diff(rows - first, prepend=0), known.astype(np.int64), back.astype(np.int64), np.rint(base / BASE_STEP).astype(np.int64), np.abs(minus) * 2 + (minus < 0))
    return len(rows).to_bytes(4, "little") + b"".join(map(pack_numbers, columns))


def unpack_sums(blob: bytes) -> list[np.ndarray]:
    """Rows within the group, known words, words backed off to, base sums and terms."""
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for _ in range(5):
        x, at = unpack_numbers(blob, at, n)
        out.append(x)
    out[0] = np.cumsum(out[0])
    out[3] = out[3] * BASE_STEP
    out[4] = (out[4] >> 1) * np.where(out[4] & 1, 1.0, -1.0) * TERM_STEP
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, n_back long, base double, terms double, train_tokens long, train_kinds long"
KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
SCHEMA = pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in SCORED.split(", ")])


def whole(table_: pa.Table, parts: int, held: int) -> pa.Table:
    """The documents of one group with the sums that all shards sent back, or the totals of all shards."""
    first, kinds, blobs = (table_.column(c).to_pylist() for c in ("first", "kind", "records"))
    if first[0] < 0:
        totals = sum(np.frombuffer(x, np.int64, 2) for x in blobs)
        columns = {"train_tokens": [int(totals[0])], "train_kinds": [int(totals[1])]}
    else:
        head = blobs[kinds.index(-1)]
        n = len(head) // 18
        ids, null = np.frombuffer(head, np.int64, n), np.frombuffer(head, bool, n, 8 * n)
        sums = [np.zeros(n) for _ in range(4)]
        # In an order of its own, so that reruns agree to the last bit.
        for blob in sorted(b for k, b in zip(kinds, blobs) if k >= 0):
            rows, *found = unpack_sums(blob)
            for total, x in zip(sums, found):
                total[rows] += x
        columns = {
            "doc_id": pa.array(ids, mask=null), "held_out": crc_held(ids, null, parts, held), "n_tokens": np.frombuffer(head[10 * n :], np.int64, n),
            "n_known": sums[0].astype(np.int64), "n_back": sums[1].astype(np.int64), "base": sums[2], "terms": sums[3],
        }
    n = len(next(iter(columns.values())))
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def score(docs: DataFrame, shard_tokens: int = 1_000_000, group_tokens: int = 500_000, discount: float = DISCOUNT, parts: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder != held, F.lit(False)).alias("training"), "text")
    shards = shards_for(rows, shard_tokens, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = frequent(rows, shards)
    shared = spark.sparkContext.broadcast(hot)
    schema = "shard int, kind int, first long, records binary"

    def batch_of(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        s, k, f, x = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(f, pa.int64()), pa.array(x, pa.binary())], ["shard", "kind", "first", "records"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for ids, training, hashes, rows in batches_of(batches, group_tokens):
            first = (task << 36) | number
            number += len(ids)
            w, before, after, row = sequences(hashes, rows, len(ids))
            n_tokens = np.bincount(rows, minlength=len(ids)) + 1
            flagged = row + np.where(training[row], TRAINED, 0)
            # The documents themselves: spread over the shards like the rest.
            head = ids.cast(pa.int64()).fill_null(0).to_numpy().tobytes() + np.array(ids.is_null()).tobytes() + training.tobytes() + n_tokens.astype(np.int64).tobytes()
            out = [(number % shards, -1, first, head)]
            for kind, at, shard in routed(shared.value, w, before, after, shards):
                order = np.argsort(shard, kind="stable")
                at, shard = at[order], shard[order]
                ends = np.flatnonzero(np.concatenate((shard[1:] != shard[:-1], [True]))) + 1 if len(shard) else []
                begin = 0
                for end in ends:
                    k = at[begin:end]
                    out.append((int(shard[begin]), kind, first, pack(w[k], short(before[k]), short(after[k]), flagged[k], kind != ALL)))
                    begin = end
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], list] = defaultdict(list)
        for batch in batches:
            for shard, kind, first, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind < 0:
                    yield batch_of([(shard, kind, first, blob)])
                else:
                    kept[shard, kind].append((first, shard, blob))
        for shard, kind in sorted(kept):
            blobs = kept.pop((shard, kind))
            groups = np.unique([first for first, _, _ in blobs])
            sums, tokens, kinds = answers(blobs, kind, shared.value, discount)
            ends = np.searchsorted(sums[0], np.append(groups[1:], np.iinfo(np.int64).max))
            out = [(shard, -2, -1, np.array([tokens, kinds], np.int64).tobytes())]
            begin = 0
            for first, end in zip(groups.tolist(), ends.tolist()):
                out.append((shard, kind, first, pack_sums(first, tuple(x[begin:end] for x in sums))))
                begin = end
            for i in range(0, len(out), 64):
                yield batch_of(out[i : i + 64])

    sent = rows.mapInArrow(send, schema)
    # Partition k holds shard k and nothing else.
    back = sent.repartitionById(shards, F.col("shard")).mapInArrow(gather, schema)
    summed = materialize(back.groupBy("first").applyInArrow(lambda t: whole(t, parts, held), SCORED), "scores")
    # Frequent words are not counted in any one shard: they come from their exact counts.
    n, v = summed.where("doc_id IS NULL AND train_tokens IS NOT NULL").agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_kinds"), F.lit(0))).first()
    frequent_counts = [c for c, k in zip(hot.count.tolist(), hot.words.tolist()) if k != int(BEGIN) and c > 0]
    n, v = int(n + sum(frequent_counts)), int(v + len(frequent_counts))
    log_all = float(LOG(n + v + 1.0))
    return summed.where("train_tokens IS NULL").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * log_all).alias("base_score"), (F.col("terms") - F.col("n_back") * log_all).alias("score"),
    )


def crc_held(ids: np.ndarray, null: np.ndarray, parts: int, held: int) -> list[bool]:
    from zlib import crc32

    return [not gone and crc32(str(i).encode()) % parts == held for i, gone in zip(ids.tolist(), null.tolist())]


def op9(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
