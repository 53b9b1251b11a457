"""Repetition rules from suffix arrays over words.

The words of many documents share one suffix array, ranked within their
documents by prefix doubling: each round sorts only the suffixes that are not
told apart yet, so text without repeats costs two or three rounds. Ranks kept
from every round give the common prefix of neighbours by binary descent. At
position i the longest repeated substring is the larger of the two
neighbouring common prefixes; the maximal repeats are the intervals of equal
prefix, and the union of their spans is the union of these per-position spans.

A document fails if repeats of `min_words` words or more cover over
`max_covered` of it, or one repeat is over `max_longest` words. Null and empty
texts have no words and fail the base rule. Each row is judged by itself, so
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring there that occurs elsewhere in its document.

    words: word numbers; doc: document numbers, not falling.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    at = np.argsort(key, kind="stable")
    ends = np.searchsorted(doc, doc, "right")

    def regroup(order: np.ndarray, keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each of the sorted suffixes (the place of its group's first) and which groups have several."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((first, [len(order)])))
        return base[np.repeat(first, sizes)], np.repeat(sizes > 1, sizes)

    rank = np.empty(n, np.int64)
    place = np.arange(n)
    rank[at], several = regroup(at, key[at], place)
    repeated = at[several]
    if not len(repeated):
        return longest
    levels = [rank.copy()]
    active, slots, h = repeated, place[several], 1
    while len(active):
        beyond = active + h
        second = np.where(beyond < ends[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = rank[active] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        got, several = regroup(active, both, slots)
        rank[active] = got
        levels.append(rank.copy())
        active, slots, h = active[several], slots[several], 2 * h
    # The suffix array of the repeated words, and the common prefixes of neighbours in it.
    sa = repeated[np.argsort(rank[repeated])]
    a, b = sa[:-1], sa[1:]
    lcp = (levels[0][a] == levels[0][b]).astype(np.int64)
    deep = np.flatnonzero(levels[1][a] == levels[1][b]) if len(levels) > 1 else np.zeros(0, np.int64)
    a2, b2 = a[deep], b[deep]
    length = np.zeros(len(deep), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a2 + length, b2 + length
        inside = (x < ends[a2]) & (y < ends[b2])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length += same.astype(np.int64) << k
    lcp[deep] = length
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def covered_words(longest: np.ndarray, least: int) -> np.ndarray:
    """1 for each position inside a repeat of at least `least` words."""
    starts = np.flatnonzero(longest >= least)
    steps = np.zeros(len(longest) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + longest[starts], -1)
    return (np.cumsum(steps)[:-1] > 0).astype(np.int64)


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif line.strip(SPACES):
            seen.add(line)
    return found


def repetition_rules(docs: DataFrame, min_words: int = 10, max_covered: float = 0.5, max_longest: int = 100, slab: int = 400_000) -> DataFrame:
    """Counts, the base rule's verdict and the repetition rule's verdict for every document."""

    def slabs(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str], list[list[bytes]]]]:
        i, words, size = 0, [], 0
        for j, t in enumerate(texts):
            words.append(t.encode("utf-8", "surrogatepass").split())
            size += len(words[-1])
            if size >= slab:
                yield ids[i : j + 1], texts[i : j + 1], words
                i, words, size = j + 1, [], 0
        if words:
            yield ids[i:], texts[i:], words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for ids, part, words in slabs(batch.column(0).to_pylist(), texts):
                number: dict[bytes, int] = {}
                sizes = np.array([len(w) for w in words], np.int64)
                code = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
                doc = np.repeat(np.arange(len(words)), sizes)
                longest = longest_repeats(code, doc)
                count = lambda x: np.bincount(doc, weights=x, minlength=len(words)).astype(np.int64)
                repeat_words = count(covered_words(longest, 3))
                covered = count(covered_words(longest, min_words))
                most = np.zeros(len(words), np.int64)
                np.maximum.at(most, doc, longest)
                base_failed = (sizes < 50) | (100 * repeat_words > 50 * sizes)
                share = covered / np.maximum(sizes, 1)
                kept = ~base_failed & (share <= max_covered) & (most <= max_longest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(sizes),
                        pa.array([len(t) - sum(map(t.count, SPACES)) for t in part], pa.int64()),
                        pa.array([sum(map(t.count, SYMBOLS)) for t in part], pa.int64()),
                        pa.array([duplicate_lines(t) for t in part], pa.int64()),
                        pa.array(repeat_words), pa.array(base_failed), pa.array(kept),
                        pa.array(share), pa.array(most),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_fraction", "longest_repeat"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
