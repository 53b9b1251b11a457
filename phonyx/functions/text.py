"""Text lenses, tokens, word distances, n-grams and numeric entities as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .numbers import digits_to_words, words_to_digits
from .rows import lists

# Accents that fold to plain letters (umlauts stay), quotes, fillers, and patterns of the lenses.
ACCENTED = "àáâãåçèéêëìíîïñòóôõøùúûýÿÀÁÂÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÕØÙÚÛÝ"
FOLDED = "aaaaaceeeeiiiinooooouuuyyAAAAACEEEEIIIINOOOOOUUUY"
QUOTES, PLAIN_QUOTES = "„“”‚‘’«»", "\"\"\"'''\"\""
FILLER_STOPLIST = ("äh", "ähm", "ähhh", "hmm", "hm", "öh", "öhm", "also", "halt", "ne", "nö")
FILLERS = r"(?iU)\b(mhm+|hm+|äh+|ähm+|öh+|ähem|em|ää+|ehm|hmm+)\b"
SPEAKER_TAGS = (r"sprecher[^\]]*", r"speaker[\s_]*\d+", r"[a-z]{1,3}")
NUMBER = r"[0-9]+(?:[.,:][0-9]+)*"
THOUSANDS = r"^[0-9]{1,3}(\.[0-9]{3})+$"
LOCALE_TAG = r"<[a-z]{2,3}-[A-Z]{2}>"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def before_punctuation(text: Column) -> Column:
    """The canonical lens up to its punctuation strip, where numbers still have their shape; number words are digits."""
    plain = F.replace(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit(",,"), F.lit("")), F.lit('"'), F.lit(""))
    folded = words_to_digits(F.translate(plain, QUOTES + ACCENTED, PLAIN_QUOTES + FOLDED))
    return F.regexp_replace(F.regexp_replace(folded, r"\[.*?\]", ""), "['\"]", "")


def canonical(text: Column) -> Column:
    """Accents folded but for umlauts, number words read, brackets, quotes and punctuation gone, blanks squeezed; case stays."""
    return squeeze(F.regexp_replace(before_punctuation(text), r"(?U)[^\w\s]", ""))


def speaker_tags_out(text: Column, labels: Sequence[str] = ()) -> Column:
    """Bracketed speaker tags, general ones and the given labels, become blanks."""
    quoted = [rf"\Q{x.strip()}\E" for x in labels if x.strip()]
    return F.regexp_replace(text, rf"(?i)\[({'|'.join([*SPEAKER_TAGS, *quoted])})\]", " ")


def permissive(text: Column, labels: Sequence[str] = ()) -> Column:
    return squeeze(F.regexp_replace(F.lower(speaker_tags_out(text, labels)), r"(?U)[^\w\s]", " "))


def strict(text: Column, labels: Sequence[str] = ()) -> Column:
    """Ranking-grade lens: tags, fillers and punctuation gone, digits spelled out."""
    low = F.replace(F.lower(speaker_tags_out(text, labels)), F.lit("ß"), F.lit("ss"))
    return squeeze(F.regexp_replace(F.regexp_replace(digits_to_words(low), FILLERS, " "), r"(?U)[^\w\s]", " "))


def verbatim(text: Column, labels: Sequence[str] = ()) -> Column:
    return squeeze(F.lower(speaker_tags_out(text, labels)))


def locale_tags_out(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, LOCALE_TAG, " "))


def words(text: Column) -> Column:
    """Words of a text; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return words(F.lower(canonical(F.coalesce(text, F.lit("")))))


def fillers_out(tokens_: Column, stoplist: Sequence[str] = FILLER_STOPLIST) -> Column:
    return F.filter(tokens_, lambda w: ~F.lower(w).isin(*stoplist))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Least insertions, deletions and substitutions between two sequences, a column of the table at a time as bits of whole numbers."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, cost = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0  # where the column rises, and falls, from one row to the next
    for x in b:
        equal = places.get(x, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        cost += 1 if right & last else -1 if left & last else 0
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & every, right & diagonal & every
    return cost


@arrow_udf(LongType())
def word_edits(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Word edit distance of two token arrays of any length and vocabulary; null for null."""
    return pa.array([None if r is None or h is None else edit_distance(r, h) for r, h in zip(lists(reference), lists(hypothesis))], pa.int64())


@pandas_udf(ArrayType(LongType()))
def ngram_matches(hypothesis: pd.Series, references: pd.Series, order: pd.Series) -> pd.Series:
    """For n = 1 to `order`, how many n-grams of a token array its references have, each as often as the one that has most of it."""
    from collections import Counter

    def matches(h, refs, n: int) -> list[int]:
        h, refs = tuple(h) if h is not None else (), [tuple(r) for r in refs if r is not None] if refs is not None else []
        count = lambda x, k: Counter(x if k == 1 else zip(*(x[i:] for i in range(k))))
        out = []
        for k in range(1, n + 1):
            most: Counter = Counter()
            for r in refs:
                most |= count(r, k)
            out.append((count(h, k) & most).total())
        return out

    return pd.Series([matches(h, r, n) for h, r, n in zip(hypothesis, references, order)])


def ngrams(tokens_: Column, n: int) -> Column:
    """All n-grams of a token array, joined by blanks, in order."""
    last = F.size(tokens_) - n
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens_, i + 1, n), " "))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def entities(text: Column) -> Column:
    """Numbers of a text, thousands points removed."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"))
    return F.transform(found, lambda x: F.when(x.rlike(THOUSANDS), F.replace(x, F.lit("."), F.lit(""))).otherwise(x))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short arrays, such as the numbers of a text."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v))).cast("long")


def ngram_hashes(tokens_: Column, n: int) -> Column:
    """A hash for each n-gram of a token array, in order."""
    last = F.size(tokens_) - n
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens_, i + k) for k in range(n)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))
