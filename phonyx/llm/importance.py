"""Quality selection by importance resampling.

Two bag-of-n-gram models over hashed byte n-grams are counted: one on all raw
text, one on target text (labelled good). A text's log weight is the log of
the ratio of the two likelihoods, target over raw, for each n-gram of the text
(for each order the mean over its n-grams), times one temperature that holds
for texts of every length: n-grams of one text are far from independent, and a
plain sum over a long text would be ruled by the chance differences between a
small target sample and the raw text. Sampling without replacement in proportion to the weights is
the Gumbel top-k rule: add a Gumbel variate, fixed by a hash of the row, to
each log weight and take the k largest keys. k is the number of texts whose
log weight is above the least cut that tells the labelled good texts from the
others with the fewest errors, whatever their share.

Models of target text and the cut come from at most `sample` labelled rows,
those with the least hashes; the raw model and k cover every row. An id that
is labelled twice counts as good if one label says so. Null text is empty;
a text without n-grams has weight one (log weight 0). Rows equal in id and
text have equal keys, and keys equal to the k-th all stay. Without labelled
good texts every weight is one, and without labelled bad ones k is the number
of rows; either way everything is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import discard, materialize, table

ORDERS = (2, 4)
#: Bytes scored or counted at a time; arrays of a task are a few times as large.
SLAB = 1 << 18
#: What the mean log ratio of a text's n-grams is multiplied by.
TEMPERATURE = 100.0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null is empty."""
    flat = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(flat.type) or pa.types.is_large_binary(flat.type)
    _, offsets, data = flat.buffers()
    if offsets is None or not len(flat):
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slabs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLAB bytes together."""
    i = 0
    while i < len(at) - 1:
        j = min(len(at) - 1, max(i + 1, int(np.searchsorted(at, at[i] + SLAB, "right")) - 1))
        yield i, j
        i = j


def hashed_ngrams(data: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    key = np.zeros(len(data), np.uint32)
    for j in range(min(order, len(data))):
        key[: len(data) - j] |= data[j:].astype(np.uint32) << np.uint32(8 * j)
    mixed = ((key * np.uint32(2654435761)) ^ (key >> np.uint32(15))) * np.uint32(2246822519)
    return (mixed >> np.uint32(33 - buckets.bit_length())).astype(np.int32)


def whole_ngrams(bounds: np.ndarray, order: int) -> np.ndarray:
    """Whether an n-gram of the given length that begins at a byte ends within its text."""
    whole = np.ones(int(bounds[-1]), bool)
    for j in range(1, order):
        last = bounds[1:] - j
        whole[last[last >= bounds[:-1]]] = False
    return whole


def ngram_counts(docs: DataFrame, target: Column, buckets: int) -> DataFrame:
    """(slot, raw, target): counts of each order's buckets over all rows, and over those where `target` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(len(ORDERS) * buckets, np.int64), np.zeros(len(ORDERS) * buckets, np.int64)
        for b in batches:
            data, at = text_bytes(b.column(0))
            chosen = np.asarray(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for i, j in slabs(at):
                part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
                of_target = np.repeat(chosen[i:j], np.diff(bounds))
                for k, order in enumerate(ORDERS):
                    whole = whole_ngrams(bounds, order)
                    bucket = hashed_ngrams(part, order, buckets)
                    where = slice(k * buckets, (k + 1) * buckets)
                    raw[where] += np.bincount(bucket[whole], minlength=buckets)
                    if of_target.any():
                        good[where] += np.bincount(bucket[whole & of_target], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["slot", "raw", "target"])

    counted = docs.select("text", target.alias("target")).mapInArrow(run, "slot long, raw long, target long")
    return counted.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def labelled_sample(labels: DataFrame, sample: int) -> DataFrame:
    """(_id, _quality) of at most `sample` labelled ids, those with the least hashes."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(sample)


def fit(rows: DataFrame, buckets: int = 1 << 14, prior: float = 20.0) -> np.ndarray:
    """Log ratios by order and bucket (a bounded array), from rows (text, _quality)."""
    counts = ngram_counts(rows, F.coalesce(F.col("_quality") == 1, F.lit(False)), buckets).toPandas()
    raw, target = np.zeros(len(ORDERS) * buckets), np.zeros(len(ORDERS) * buckets)
    slots = counts["slot"].to_numpy()
    raw[slots], target[slots] = counts["raw"], counts["target"]
    raw, target = raw.reshape(len(ORDERS), buckets), target.reshape(len(ORDERS), buckets)
    if not target.any():
        return np.zeros(raw.shape)
    # The raw model is the prior of the target model, worth `prior` n-grams in each bucket: an n-gram that a small
    # sample lacks by chance costs little, one that raw text is full of costs much.
    model_raw = (raw + 1) / (raw.sum(1, keepdims=True) + buckets)
    expected = target.sum(1, keepdims=True) * model_raw
    model_target = model_raw * (target + prior) / (expected + prior)
    model_target /= model_target.sum(1, keepdims=True)
    return np.log(model_target / model_raw)


def log_weight(ratios: np.ndarray) -> Callable[..., Column]:
    """Column function: the temperature times a text's mean log ratio under the fitted models, summed over the orders."""
    buckets = ratios.shape[1]

    @arrow_udf("double")
    def weight(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, at = text_bytes(column)
            out = np.zeros(len(at) - 1)
            for i, j in slabs(at):
                part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
                for k, order in enumerate(ORDERS):
                    sums = np.zeros(len(part) + 1)
                    np.cumsum(np.where(whole_ngrams(bounds, order), ratios[k][hashed_ngrams(part, order, buckets)], 0.0), out=sums[1:])
                    out[i:j] += (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds) - order + 1)
            yield pa.array(np.round(TEMPERATURE * out, 6))

    return weight


def gumbel(seed: int, *columns: Column) -> Column:
    """A standard Gumbel variate fixed by a hash of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def kth_largest(values: DataFrame, column: str, k: int, enough: int = 5000) -> float | None:
    """The k-th largest value of a column, by counting in ever narrower bins; at most `enough` values come to the driver."""
    c = F.col(column)
    low, high, n = values.agg(F.min(c), F.max(c), F.count(c)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    left, bins = k, 1000
    inside = n
    while inside > enough and low < high:
        width = (high - low) / bins
        bin_of = F.least(F.floor((c - low) / width), F.lit(bins - 1)) if width else F.lit(0)
        found = values.where((c >= low) & (c <= high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy(F.desc("b")).collect()
        for row in found:
            if left <= row["n"]:
                break
            left -= row["n"]
        if row["lo"] == low and row["hi"] == high and row["n"] == inside:
            break
        low, high, inside = row["lo"], row["hi"], row["n"]
    if low == high:
        return low
    top = values.where((c >= low) & (c <= high)).orderBy(c.desc()).limit(left).agg(F.min(c)).first()
    return top[0]


def level(labelled: list[tuple[float, int]]) -> float:
    """The least cut above which (log weight, quality) rows are told apart with the fewest errors; -inf without good or bad ones.

    Between the last row that is cut off and the first one that stays any cut
    would do; the least one keeps the most, and labelled good rows, which the
    model knows, weigh more than others of their kind.
    """
    if not any(q == 1 for _, q in labelled):
        return -np.inf
    weights, good = np.array([w for w, _ in labelled]), np.array([q == 1 for _, q in labelled])
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    # Errors if the first i rows are rejected: good ones among them, and bad ones after them.
    errors = np.concatenate(([0], np.cumsum(good))) + (~good).sum() - np.concatenate(([0], np.cumsum(~good)))
    possible = np.concatenate(([True], weights[1:] != weights[:-1], [True]))
    best = int(np.flatnonzero(possible & (errors == errors[possible].min()))[0])
    return float(weights[best - 1]) if best else -np.inf


def select(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> tuple[DataFrame, Callable[..., Column], float | None]:
    """Scored rows (doc_id, _log_weight, _key), the weight function, and the key of the last row of the top k."""
    known = materialize(labelled_sample(labels, sample), "labelled")
    # At most `sample` ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left")
    weight = log_weight(fit(rows))
    scored = rows.withColumn("_log_weight", weight("text")).select("doc_id", "_log_weight", (F.col("_log_weight") + gumbel(seed, F.col("doc_id"), F.col("text"))).alias("_key"), "_quality")
    keys = materialize(scored, "keys")
    discard(known)
    labelled = keys.where("_quality IS NOT NULL").groupBy("doc_id").agg(F.min("_log_weight"), F.max("_quality")).collect()
    least = level([(w, q) for _, w, q in labelled])
    k = keys.where(F.col("_log_weight") > F.lit(least)).count()
    return keys, weight, kth_largest(keys, "_key", k)


def resample(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """(doc_id, log_weight, key, selected) of every document."""
    keys, _, least = select(docs, labels, sample, seed)
    return keys.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("key"), (F.lit(least is not None) & (F.col("_key") >= F.lit(least or 0.0))).alias("selected"))


def select_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """docs without the ones the resampling leaves out; keys are scored again where the text stands, so no text moves."""
    keys, weight, least = select(docs, labels, sample, seed)
    discard(keys)
    if least is None:
        return docs.limit(0)
    return docs.where(weight("text") + gumbel(seed, F.col("doc_id"), F.col("text")) >= F.lit(least))


def op3(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
