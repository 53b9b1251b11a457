"""Benchmark decontamination by BM25 retrieval over an index of the test items.

The test items are the indexed side, the training passages are the queries.
Items are put in classes by their length, doubling from `LEAST_STRETCH` words;
for each class a passage is two neighbouring stretches of a document's words,
a stretch as long as the class's longest possible item, so every item lies
inside one. Item scores are BM25 sums divided by the item's own score, so 1
means that a passage has all of an item's terms and one threshold serves all
items. Retrieval is exact block-max WAND, run for a batch of passages at a
time: a passage is dropped if the sum of its terms' maxima stays below the
threshold; of the others only those blocks of items are opened whose block
maxima reach it; only postings in open blocks are added up. Every item above
the threshold is then verified: at least `overlap` of its five-word shingles
stand in the passage, and at least half of those of its question (the first
half, if the items have no `answer` column) and of its answer.

Document frequencies and the mean length are those of all items, counted
first. The index goes to the executors in parts of at most `part_words` words
of items, each a bounded broadcast; documents are read once for each part, and
results do not depend on the number of parts. Null and empty texts contain
nothing, like texts without any word of an item; null and empty items are in
no document; an item of under five words is one shingle. Repeated documents
are each reported, repeated items each match. Documents and items of any
length are read whole. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import materialize, table

K1, B = 1.2, 0.75
#: Words of a stretch in the class of the shortest items.
LEAST_STRETCH = 64
#: Stripped from words where shingles are compared.
PUNCTUATION = b".,;:!?\"'()[]{}"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], k: int = 5) -> set[bytes]:
    plain = [w.strip(PUNCTUATION) or w for w in words]
    return {b" ".join(plain[i : i + k]) for i in range(max(1, len(plain) - k + 1))} if plain else set()


#: The index is a plain namespace of arrays, which a broadcast carries without this module's classes.
Index = SimpleNamespace


def build_index(items: list[tuple[int, str | None, str | None]], frequencies: dict[bytes, int], n_items: int, mean_length: float, block_size: int = 16) -> Index:
    """The inverted index of items (id, question, answer); without an answer the text's first half is the question.

    `frequencies`, `n_items` and `mean_length` are those of all items, not only
    of these. One index for each length class, by its stretch, shares `terms`.
    Postings (`item`, `impact`: the share of the item's own score) are ordered
    by term, then item. Term t has the blocks block_first[t] to
    block_first[t + 1], each a run of `block_size` items with its number
    `block`, its maximum `block_max` and its postings from `block_posting` on.
    """
    terms: dict[bytes, int] = {}
    by_class: dict[int, list] = {}
    for item_id, question, answer in items:
        q, a = words_of(question), words_of(answer)
        if q or a:
            for w in q + a:
                terms.setdefault(w, len(terms))
            half = len(q) if a or len(q) < 2 else len(q) // 2
            stretch = LEAST_STRETCH
            while stretch < len(q) + len(a):
                stretch *= 2
            by_class.setdefault(stretch, []).append((item_id, q + a, shingles(q[:half]), shingles(q[half:] + a)))
    v = max(1, len(terms))
    idf = np.zeros(v)
    for w, t in terms.items():
        idf[t] = np.log1p((n_items - frequencies[w] + 0.5) / (frequencies[w] + 0.5))
    classes = []
    for stretch, members in sorted(by_class.items()):
        ids, docs, questions, answers = zip(*members)
        n = len(docs)
        length = np.array([len(d) for d in docs], np.float64)
        of = np.repeat(np.arange(n), length.astype(np.int64))
        pair, tf = np.unique(np.array([terms[w] for d in docs for w in d], np.int64) * n + of, return_counts=True)
        term, item = pair // n, pair % n
        raw = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean_length))
        impact = raw / np.bincount(item, raw, minlength=n)[item]
        term_max = np.zeros(v)
        np.maximum.at(term_max, term, impact)
        width = n // block_size + 1
        blocks, first = np.unique(term * width + item // block_size, return_index=True)
        classes.append(Index(
            stretch=stretch, ids=ids, item=item, impact=impact, term_max=term_max, block_first=np.searchsorted(blocks // width, np.arange(v + 1)),
            block=blocks % width, block_max=np.maximum.reduceat(impact, first), block_posting=np.concatenate((first, [len(item)])).astype(np.int64), questions=questions, answers=answers,
        ))
    return Index(terms=terms, classes=classes)


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range [first, last): its number, repeated, and its members."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def retrieve(index: Index, term: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(text number, passage number, item, score) of every passage and item of a class whose score reaches the threshold.

    term: the number of every word of the texts, one after another, or -1; sizes: words of each text.
    """
    stretches = np.maximum(1, -(-sizes // index.stretch))
    base = np.cumsum(stretches) - stretches
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = term >= 0
    v = len(index.term_max)
    # Distinct terms of each stretch; a passage is a stretch and the next one of its text.
    pairs = np.unique((base[text] + at // index.stretch)[known] * v + term[known])
    stretch, term = pairs // v, pairs % v
    total = int(stretches.sum())
    # Without any known word bincount counts in whole numbers.
    bound = np.bincount(stretch, index.term_max[term], minlength=total).astype(np.float64)
    last = np.zeros(total, bool)
    last[base + stretches - 1] = True
    bound[:-1] += np.where(last[:-1], 0.0, bound[1:])
    open_ = np.flatnonzero(bound >= threshold)
    if not len(open_):
        return
    ends = np.searchsorted(stretch, np.arange(total + 1))
    passage, entry = expand(ends[open_], ends[np.where(last[open_], open_ + 1, open_ + 2)])
    pairs = np.unique(passage * v + term[entry])
    passage, term = pairs // v, pairs % v
    # Block maxima: which blocks of items can still reach the threshold in which passage.
    entry, block = expand(index.block_first[term], index.block_first[term + 1])
    width = int(index.block.max()) + 1
    key, where = np.unique(passage[entry] * width + index.block[block], return_inverse=True)
    alive = (np.bincount(where, index.block_max[block]) >= threshold)[where]
    entry, block = entry[alive], block[alive]
    which, posting = expand(index.block_posting[block], index.block_posting[block + 1])
    n = len(index.ids)
    key, where = np.unique(passage[entry[which]] * n + index.item[posting], return_inverse=True)
    score = np.bincount(where, index.impact[posting])
    text_of = np.repeat(np.arange(len(sizes)), stretches)
    for k, s in zip(key[score >= threshold].tolist(), score[score >= threshold].tolist()):
        p = int(open_[k // n])
        yield int(text_of[p]), p - int(base[text_of[p]]), k % n, s


def matches(index: Index, texts: list[str | None], threshold: float, overlap: float, slab: int = 200_000) -> Iterator[tuple[int, int, float, float]]:
    """(text number, item id, score, share of shingles found) of verified items, each text and item once."""
    get, i = index.terms.get, 0
    while i < len(texts):
        words, size, j = [], 0, i
        while j < len(texts) and size < slab:
            words.append(words_of(texts[j]))
            size += len(words[-1])
            j += 1
        term, sizes = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, size), np.array([len(w) for w in words], np.int64)
        best: dict[tuple[int, int, int], tuple[float, float]] = {}
        for c, part in enumerate(index.classes):
            for t, p, item, score in retrieve(part, term, sizes, threshold):
                seen = shingles(words[t][p * part.stretch : (p + 2) * part.stretch])
                q, a = part.questions[item], part.answers[item]
                share = len((q | a) & seen) / len(q | a)
                enough = all(not side or 2 * len(side & seen) >= len(side) for side in (q, a))
                if share >= overlap and enough:
                    best[t, c, item] = max(best.get((t, c, item), (0.0, 0.0)), (share, score))
        for (t, c, item), (share, score) in sorted(best.items()):
            yield i + t, index.classes[c].ids[item], score, share
        i = j


def index_parts(benchmark: DataFrame, part_words: int = 2_000_000) -> Iterator[Index]:
    """Indexes of the items in parts of about `part_words` words, the bound of what is collected and broadcast at once."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    parts = int(size // (4 * part_words)) + 1
    placed = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's different words, and its length in a row without a word."""
        for b in batches:
            for part, *texts in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = [w for t in texts for w in words_of(t)]
                own = [None, *sorted(set(words))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array(own, pa.binary()), pa.array([len(words)] * len(own), pa.int64())], ["part", "term", "words"])

    held = materialize(placed.select("part", "text", "answer").mapInArrow(terms, "part int, term binary, words long"), "terms")
    n, mean = held.where("term IS NULL AND words > 0").agg(F.count("*"), F.avg("words")).first()
    counted = held.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    for p in range(parts):
        rows = placed.where(F.col("part") == p).select("item_id", "text", "answer").orderBy("item_id", "text", "answer").collect()
        own = held.where((F.col("part") == p) & F.col("term").isNotNull()).select("term").distinct().join(counted, "term").collect()
        yield build_index([tuple(r) for r in rows], {bytes(r["term"]): r["n"] for r in own}, n, mean or 1.0)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, overlap) of every document and every item it contains."""
    found = None
    for index in index_parts(benchmark, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = list(matches(shared.value, b.column(1).to_pylist(), threshold, overlap))
                if hits:
                    rows, items, scores, shares = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                        ["doc_id", "item_id", "score", "overlap"],
                    )

        part = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, overlap double")
        found = part if found is None else found.unionByName(part)
    return found


def is_clean(shared: Broadcast, threshold: float, overlap: float) -> Callable[..., Column]:
    """Column function: whether a text contains no item of the broadcast index."""

    @arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.ones(len(column), bool)
            for row, *_ in matches(shared.value, column.to_pylist(), threshold, overlap):
                out[row] = False
            yield pa.array(out)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_words: int = 2_000_000) -> DataFrame:
    """docs without the documents that contain an item; decided where the text stands, so no text moves."""
    for index in index_parts(benchmark, part_words):
        docs = docs.where(is_clean(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap)("text"))
    return docs


def op5(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
