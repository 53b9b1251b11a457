"""Toxicity of documents, scored on text restored from its disguises.

Tokens go through the noisy channel of `deobfuscate`; the restored words and
their beginnings are the features of a logistic regression. The character
model is counted on the words of all documents; of its n-grams the `grams`
most frequent are kept, and rarer ones are smoothed from shorter ones like
those never seen. The choice of features and the regression are fitted on at
most `sample` labelled rows, those with the least hashes among rows that are
not held out; every document is scored, whole. Labels, language, source and id
are never inputs of a score.

A text without tokens (null, empty, blank) gets the share of toxic rows among
those learned from, (toxic + 1) / (rows + 3), as score; so does every text if
there are none. Of several texts under one labelled id the one with the least
hash is learned from. Rows are scored one by one, so repeated rows get equal
scores; rows without an id are scored and never learned from, and count as not
held out. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .deobfuscate import HEAD, LETTER, LETTERS, MARKED, SPACED, CharacterModel, character_counts, may_have, restore, suspect

PREFIXES = range(3, 9)


def features_of(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if k < len(word))]


def tokens_of(text: str) -> tuple[set[str], list[str]]:
    """Different tokens of a text, and its runs of spaced-out characters."""
    return set(text.split()), SPACED.findall(text)


class Reader:
    """Features of texts, remembered by token; `chosen` (feature to number) leaves the others out."""

    def __init__(self, model: CharacterModel, chosen: dict[str, int] | None = None, most: int = 1 << 19):
        self.model, self.chosen, self.most = model, chosen, most
        self.heads = {f[:3] for f in chosen or ()} | {f[:2] for f in chosen or () if len(f) == 3} | {f[:1] for f in chosen or () if len(f) == 2}
        self.begun = {f[:k] for f in chosen or () for k in range(len(f) + 1)} | {""}
        self.seen: dict[str, tuple] = {}
        self.earlier: dict[str, tuple] = {}

    def token(self, token: str) -> tuple:
        plain = token.lower()
        # Nothing that a token without blanks may stand for has a chosen feature: no search, and most need no look at their rest.
        alone = self.chosen is not None and len(plain.split()) == 1
        if alone and HEAD.match(plain) and plain[:3] not in self.begun:
            words = ()
        elif marked := MARKED.match(plain):
            words = (marked[1],)
        elif not suspect(plain):
            words = (plain,)
        elif alone and LETTER.search(plain) and not may_have(plain, self.chosen, self.begun):
            words = ()
        else:
            words = restore(token, self.model).split()
        if self.chosen is None:
            found = [f for w in words for f in features_of(w)]
        else:
            get = self.chosen.get
            found = [i for w in words if w[:3] in self.heads for f in features_of(w) if (i := get(f)) is not None]
        return tuple(found)

    def remember(self, token: str) -> tuple:
        """A token's features; those of tokens not met since the memory was last half full go."""
        if len(self.seen) >= self.most // 2:
            self.earlier, self.seen = self.seen, {}
        own = self.earlier.get(token)
        self.seen[token] = own = self.token(token) if own is None else own
        return own

    def text(self, text: str | None) -> tuple[Counter, int]:
        """How many different tokens of a text have each feature, and how many there are."""
        if not text:
            return Counter(), 0
        tokens, spaced = tokens_of(text)
        found: list = []
        for t in (*tokens, *spaced):
            own = self.seen.get(t)
            if own is None:
                own = self.remember(t)
            if own:
                found += own
        return Counter(found), len(tokens)


def held_out(doc_id: str = "doc_id", parts: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` ids.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return met.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_toxic").cast("int").alias("toxic")).select("text", "toxic")


def fit_characters(docs: DataFrame, order: int = 4, grams: int = 200_000) -> dict[str, int]:
    """Counts of the most frequent character n-grams of the words of all texts, at most `grams`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            counts = character_counts(((w, n) for w, n in words.items() if LETTERS.match(w)), order)
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                words.update((text or "").lower().split())
                if len(words) >= 200_000:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.orderBy(F.desc("n"), "gram").limit(grams).collect()}


def reader_of(shared: dict) -> Reader:
    """The reader for broadcast counts and features, kept with them, so that a worker's tasks share what it has read."""
    if "reader" not in shared:
        shared["reader"] = Reader(CharacterModel(shared["counts"]), shared.get("chosen"))
    return shared["reader"]


def choose_features(rows: DataFrame, counts: dict[str, int], most: int, least_rows: int) -> list[str]:
    """The features whose presence tells most about the label, by the signed likelihood-ratio weight."""
    # Plain values only: workers build the model from them and need no package of ours.
    shared = rows.sparkSession.sparkContext.broadcast({"counts": counts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bad, all_ = reader_of(shared.value), Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = reader.text(text)[0].keys()
                all_.update(found)
                if toxic == 1:
                    bad.update(found)
        names = list(all_)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([all_[x] for x in names], pa.int64()), pa.array([bad[x] for x in names], pa.int64())], ["feature", "n", "toxic"]
        )

    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    counted = rows.select("text", "toxic").mapInArrow(run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n - bad + 1.0))
    weight = F.abs(odds) * F.sqrt("n")
    best = counted.where(F.col("n") >= least_rows).select("feature", weight.alias("w")).orderBy(F.desc("w"), "feature").limit(most)
    return sorted(r["feature"] for r in best.collect())


def strengths(found: Counter, tokens: int, n_features: int) -> tuple[list[int], list[float]]:
    """Columns and values of a text: log counts of its features, and the log of its size in the last column."""
    ids = sorted(found)
    return [*ids, n_features], [*(math.log2(1 + found[i]) for i in ids), math.log2(1 + tokens) / 8]


def logistic(rows: list[tuple[list[int], list[float]]], y: np.ndarray, n_columns: int, ridge: float = 0.2, steps: int = 600) -> np.ndarray:
    """Weights, the last one the intercept, by accelerated gradient descent on the regularised likelihood."""
    which = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    column = np.fromiter((c for cs, _ in rows for c in cs), np.int64, len(which))
    value = np.fromiter((v for _, vs in rows for v in vs), np.float64, len(which))
    w = np.zeros(n_columns + 1)
    p0 = (y.sum() + 1) / (len(y) + 3)
    w[-1] = np.log(p0 / (1 - p0))
    look, last = w.copy(), w.copy()
    # A bound of the curvature in each column: a row's values share its prediction.
    mass = np.bincount(which, value, minlength=len(rows)) + 1
    bound = np.bincount(column, value * mass[which], minlength=n_columns + 1) / 4 + ridge
    bound[-1] = mass.sum() / 4
    penalty = np.full(n_columns + 1, ridge)
    penalty[-1] = 0
    for step in range(steps):
        z = np.bincount(which, look[column] * value, minlength=len(rows)) + look[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.bincount(column, error[which] * value, minlength=n_columns + 1) + penalty * look
        grad[-1] += error.sum()
        w = look - grad / bound
        look = w + step / (step + 3) * (w - last)
        last = w
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, most: int = 4096, least_rows: int = 4) -> dict:
    """Plain values: n-gram `counts`, features `chosen` and their numbers, `weights` (features, text's size, intercept) and the score of an `empty` text."""
    rows = materialize(learning_rows(docs, labels, sample), "toxic-sample")
    counts = fit_characters(docs)
    names = choose_features(rows, counts, most, least_rows)
    model = {"counts": counts, "chosen": {f: i for i, f in enumerate(names)}}
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for b in batches:
            found = [strengths(*reader.text(t), len(reader.chosen)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64())), b.column(1)], ["columns", "values", "toxic"]
            )

    # At most `sample` short lists of feature numbers, in an order of their own so that sums do not depend on partitions.
    read = rows.select("text", "toxic").mapInArrow(run, "columns array<int>, values array<double>, toxic int").collect()
    read = sorted((r["toxic"], r["columns"], r["values"]) for r in read)
    y = np.array([float(t == 1) for t, *_ in read])
    empty = float((y.sum() + 1) / (len(y) + 3))
    if not read:
        return model | {"weights": [0.0, math.log(0.5)], "empty": empty}
    return model | {"weights": logistic([(c, v) for _, c, v in read], y, len(names) + 1).tolist(), "empty": empty}


def score(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights, empty = reader_of(shared.value), shared.value["weights"], shared.value["empty"]

        def of(text: str | None) -> float:
            found, tokens = reader.text(text)
            if not tokens or len(weights) < 3:
                return empty
            z = weights[-1] + sum(weights[c] * v for c, v in zip(*strengths(found, tokens, len(weights) - 2)))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([of(t) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
