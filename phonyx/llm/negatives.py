"""Hard negatives of anchor vectors, by blocked dense matrix products.

Anchors are multiplied with all rows in two passes. Anchors come in waves of at
most `wave_bytes` bytes; a wave is broadcast, and each task multiplies it with
its candidate blocks in float64, `rows` by `rows` at a time. The first pass
keeps for each anchor its best rows of the same label, the second, which knows
their scores, keeps for each (anchor, positive) the best rows of other labels
inside the window that the positive's score opens. What a task keeps is merged
with what the others keep, so a wave's shuffle has at most so many rows for
each anchor and task as are asked for.

Components are floor(256 * x). Products are exact: float64 while every sum must
stay below 2^53, which is checked for each pair of blocks, else 64-bit integers.
Components are held within `limit(dimensions)`, the greatest magnitude for which a
hundredfold product still fits 64 bits (about 150,000 before scaling for 64
dimensions); larger ones count as that.

Rows with a null label, vector or id, or with a null or non-finite component
take no part. Vectors of unlike length are compared over their common
components; an empty one scores 0 with all. A row never is a partner of a row
with its own id; otherwise rows that repeat an id count one by one, as anchors
and as partners. Ties go to the smaller id. Other columns play no part. An
empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, table

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LOW = np.iinfo(np.int64).min


def limit(dimensions: int) -> int:
    return math.isqrt((2**63 - 1) // (100 * max(1, dimensions)))


def prepared(rows: DataFrame) -> DataFrame:
    """(id, label, v): rows that take part, labels changed where the id is divisible by 7, components scaled and whole."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    taking = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.filter(taking).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("double")).alias("v"))


def matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros, components held within the limit."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    most = float(limit(dimensions))
    out = np.zeros((len(sizes), dimensions))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(flat, -most, most)
    return out


class Candidates:
    """A block of rows, sorted by label and id."""

    def __init__(self, batches: list[pa.RecordBatch], dimensions: int) -> None:
        ids, labels = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
        v = np.concatenate([matrix(b.column(2), dimensions) for b in batches])
        order = np.lexsort([ids, labels])
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.most = float(np.abs(v).max(initial=0))

    def of(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))


def blocks_of(batches: Iterator[pa.RecordBatch], dimensions: int, rows: int) -> Iterator[Candidates]:
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            held.append(part)
            n += part.num_rows
            if n >= rows:
                yield Candidates(held, dimensions)
                held, n = [], 0
    if n:
        yield Candidates(held, dimensions)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """All inner products, exact, as 64-bit integers; `most` bounds any product of two components."""
    if most * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best k (score, id) of each of n lists: scores descending, ids ascending. Empty places have the least score."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.id = np.full((n, k), LOW), np.zeros((n, k), np.int64)

    def merge(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """scores[i, j] is offered to list lists[i], with ids[j], where allowed[i, j]. Lists are distinct."""
        scores = np.where(allowed, scores, LOW)
        last = self.score[lists, -1]
        if scores.shape[1] > self.k:
            last = np.maximum(last, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, col = np.nonzero((scores >= last[:, None]) & (scores > LOW))
        mine = scores[at, col]
        # An equal score enters a full list by a smaller id alone.
        enters = (mine > self.score[lists[at], -1]) | (ids[col] < self.id[lists[at], -1])
        at, col, mine = at[enters], col[enters], mine[enters]
        if not len(at):
            return
        touched = np.unique(at)
        where = np.concatenate([at, np.repeat(touched, self.k)])
        score = np.concatenate([mine, self.score[lists[touched]].ravel()])
        of = np.concatenate([ids[col], self.id[lists[touched]].ravel()])
        order = np.lexsort([of, -(score + 1), where])  # the least score plus one can be negated
        where, score, of = where[order], score[order], of[order]
        first = np.searchsorted(where, touched)
        take = first[:, None] + np.arange(self.k)
        self.score[lists[touched]], self.id[lists[touched]] = score[take], of[take]

    def rows(self, names: tuple[str, str, str], start: int = 0) -> Iterator[pa.RecordBatch]:
        at, k = np.nonzero(self.score > LOW)
        for i in range(0, len(at), 100_000):
            a, b = at[i : i + 100_000], k[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a + start, pa.int64()), pa.array(self.id[a, b]), pa.array(self.score[a, b])], list(names))


def first_pass(wave: dict, dimensions: int, k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wave.value
        best = Best(len(w["id"]), k)
        for block in blocks_of(batches, dimensions, rows):
            for label in np.unique(w["label"]):
                same, mine = block.of(label), np.flatnonzero(w["label"] == label)
                if same.start == same.stop:
                    continue
                for at in range(0, len(mine), rows):
                    some = mine[at : at + rows]
                    scores = products(w["v"][some], block.v[same], w["most"] * block.most)
                    best.merge(some, scores, block.ids[same], w["id"][some][:, None] != block.ids[same][None, :])
        yield from best.rows(("anchor", "positive_id", "positive_score"))

    return run


def second_pass(wave: dict, dimensions: int, k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wave.value
        best = Best(len(w["pair_anchor"]), k)
        for block in blocks_of(batches, dimensions, rows):
            for at in range(0, len(w["id"]), rows):
                scores = products(w["v"][at : at + rows], block.v, w["most"] * block.most)
                other = w["label"][at : at + rows][:, None] != block.labels[None, :]
                hundred = 100 * scores
                for slot in range(int(w["pair_slot"].max(initial=-1)) + 1):
                    mine = np.flatnonzero((w["pair_slot"] == slot) & (w["pair_anchor"] >= at) & (w["pair_anchor"] < at + rows))
                    if len(mine):
                        of, p = w["pair_anchor"][mine] - at, w["pair_score"][mine][:, None]
                        inside = other[of] & (w["low"] * p <= hundred[of]) & (hundred[of] <= w["high"] * p)
                        best.merge(mine, scores[of], block.ids, inside)
        yield from best.rows(("pair", "negative_id", "negative_score"))

    return run


def waves_of(anchors: DataFrame, dimensions: int, wave_bytes: int) -> Iterator[dict]:
    """The anchors in waves of bounded size, one partition of them at a time on the driver."""
    most = max(1, wave_bytes // (8 * max(1, dimensions)))
    ids, labels, vs = [], [], []

    def wave() -> dict:
        v = pa.array(vs, pa.list_(pa.float64()))
        m = matrix(v, dimensions)
        return {"id": np.array(ids, np.int64), "label": np.array(labels, np.int64), "v": m, "most": float(np.abs(m).max(initial=0))}

    for r in anchors.toLocalIterator():
        ids.append(r["id"])
        labels.append(r["label"])
        vs.append(r["v"])
        if len(ids) >= most:
            yield wave()
            ids, labels, vs = [], [], []
    if ids:
        yield wave()


def merged(found: DataFrame, key: str, partner: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), partner)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 1024, wave_bytes: int = 32 << 20) -> DataFrame:
    """The first `negatives` rows of other labels for each anchor and positive, with a score of low to high percent of the positive's."""
    spark = rows.sparkSession
    ready = materialize(prepared(rows), "vectors")
    dimensions = ready.agg(F.max(F.size("v"))).first()[0] or 0
    place = f"{shared_dir(spark)}/phonyx/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(place)
    for w in waves_of(ready.filter(F.col("id") % every == 0), dimensions, wave_bytes):
        sent = spark.sparkContext.broadcast(w)
        best = ready.mapInArrow(first_pass(sent, dimensions, positives, block), "anchor long, positive_id long, positive_score long")
        # At most so many rows for each anchor of the wave.
        pairs = merged(best, "anchor", "positive_id", "positive_score", positives).orderBy("anchor", "rank").collect()
        sent.unpersist()
        anchor, slot, score, positive = (np.array([p[c] for p in pairs], np.int64) for c in ("anchor", "rank", "positive_score", "positive_id"))
        sent = spark.sparkContext.broadcast({**w, "pair_anchor": anchor, "pair_slot": slot - 1, "pair_score": score, "low": low, "high": high})
        found = ready.mapInArrow(second_pass(sent, dimensions, negatives, block), "pair long, negative_id long, negative_score long")
        best = merged(found, "pair", "negative_id", "negative_score", negatives)
        of = pa.table({"pair": np.arange(len(pairs)), "anchor_id": w["id"][anchor], "positive_id": positive, "positive_score": score})
        named = best.join(F.broadcast(spark.createDataFrame(of)), "pair")
        named.selectExpr("anchor_id", "positive_id", "cast(rank as int) as rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(place)
        sent.unpersist()
    discard(ready)
    return spark.read.schema(OUT).parquet(place)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
