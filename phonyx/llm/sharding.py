"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to `bits` bits, the cells are visited in the
order of the Hilbert curve, and the visit is cut into runs of equally many
rows. A run is compact in all dimensions at once, so the minima and maxima of
its file prune filters on any of them. Cells of a number hold equally many
rows, by exact quantiles of all of them, so one far value does not put all
others in one cell.

Equal texts form a group: the whole group takes the place on the curve of its
least document, so its rows stand together, and are apart only where a cut
between two shards falls in the group, as equal row counts demand.

Null in a dimension is the lowest cell; null text has size 1 (no bytes, plus
one) and the checksum of the empty string. Repeated rows are kept and get
slots of their own, in any order among themselves where they are equal in id
and text; ties on the curve are broken by text, document id and metadata.
Texts of any length count whole, and extra columns may have any names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import global_rank, materialize, table, unused


def hilbert_of(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (rows) with `bits` bits a dimension, all at once.

    Works bit by bit from the top: undoes the rotations and reflections the
    curve makes in each sub-cube, Gray-codes the corner and interleaves.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(high, p, swap if i else 0)
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def hilbert_index(dimensions: list[Column], bits: int) -> Column:
    if bits * len(dimensions) > 62:
        raise ValueError("the curve index must fit in 62 bits")

    @pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(hilbert_of(np.column_stack([c.to_numpy(np.int64) for c in columns]), bits))

    return index(*dimensions)


def quantiles(df: DataFrame, column: str, n: int) -> list[float]:
    """The different values at n - 1 evenly spaced ranks of all of a column's numbers, found by one range sort; nulls have no rank."""
    ranked = global_rank(df.select(F.col(column).cast("double").alias("_value")).where("_value IS NOT NULL"), ["_value"], "_rank", "numbers")
    rows = ranked.count()
    wanted = sorted({k * rows // n for k in range(1, n)})
    # At most n - 1 rows.
    return sorted({r["_value"] for r in ranked.where(F.col("_rank").isin(wanted)).collect()}) if rows else []


def quantise_numbers(df: DataFrame, columns: list[str], outs: list[str], bits: int) -> DataFrame:
    """Cells between the quantiles of all rows, so that each has about as many rows; null is cell 0."""
    for c, out in zip(columns, outs):
        # The number of cuts that are not above the value.
        below = sum(((F.col(c) >= x).cast("int") for x in quantiles(df, c, 1 << bits)), F.lit(0))
        df = df.withColumn(out, F.when(F.col(c).isNull(), 0).otherwise(below).cast("int"))
    return df


def quantise_category(df: DataFrame, column: str, out: str, bits: int) -> DataFrame:
    """Order-preserving cells: the value's rank among the distinct values, scaled; null is cell 0.

    The distinct values are ranked by a range sort, and joined back without a
    hint: Spark broadcasts them only while they are small.
    """
    values = global_rank(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("_one")).drop("_one"), [column], "_rank", "values")
    n = max(1, values.count())
    cells = values.select(F.col(column).alias("_value"), F.least(F.floor((F.col("_rank") + 1) * (1 << bits) / F.lit(n + 1)), F.lit((1 << bits) - 1)).cast("int").alias("_cell"))
    return df.join(cells, F.col(column) == F.col("_value"), "left").withColumn(out, F.coalesce("_cell", F.lit(0))).drop("_value", "_cell")


def curve_of(df: DataFrame, categories: list[str], numbers: list[str], bits: int, out: str) -> DataFrame:
    """df with the curve index of its cells in the given dimensions, numbers first."""
    cells = [f"_cell{i}" for i in range(len(numbers) + len(categories))]
    df = quantise_numbers(df, numbers, cells[: len(numbers)], bits)
    for c, cell in zip(categories, cells[len(numbers) :]):
        df = quantise_category(df, c, cell, bits)
    return df.withColumn(out, hilbert_index([F.col(c) for c in cells], bits)).drop(*cells)


def cut(ranked: DataFrame, n: int, shards: int, rank: str, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """ranked with the shard of each row and its slot within it; row counts of shards differ by one at most.

    Shard k takes the ranks from ceil(k*n/shards) on; `slot` counts from 0.
    """
    # Integer arithmetic, so that no rounding moves a boundary.
    at = F.expr(f"({rank} * {shards}) div {max(1, n)}")
    first = F.expr(f"({shard} * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn(shard, at.cast("int")).withColumn(slot, (F.col(rank) - first).cast("long")).drop(rank)


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, size, text_crc32, text_hash) of every document, written out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
            (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        ),
        "metadata",
    )


def placed(meta: DataFrame, bits: int) -> DataFrame:
    """meta with `curve`: that of the least document (id, lang, source) of its equal texts."""
    group = ["size", "text_crc32", "text_hash"]
    heads = meta.groupBy(*group).agg(F.min(F.struct("doc_id", "lang", "source")).alias("h"), F.count("*").alias("n"))
    lone = materialize(heads.select(*group, "h.*", "n").withColumn("log_size", F.log2(F.col("size").cast("double"))), "heads")
    curved = curve_of(lone, ["lang", "source"], ["log_size", "doc_id"], bits, "curve").select(*group, "curve")
    # A very frequent text is skew on the documents' side alone, which adaptive execution splits.
    return meta.join(curved, group)


TIES = ["curve", "size", "text_hash", "doc_id", "source", "lang"]


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 6) -> DataFrame:
    """Curve index, shard, slot and metadata of every document; the text itself stays where it is."""
    ranked = global_rank(placed(metadata(docs), bits), TIES, "_rank", "curve")
    return cut(ranked, ranked.count(), shards, "_rank").drop("text_hash")


def shard_rows(docs: DataFrame, shards: int = 8, bits: int = 6) -> DataFrame:
    """docs, whole rows, with `shard` and `slot`, sorted by shard and slot, ready to be written by shard.

    Repeated rows keep their number. Columns of docs with the names `shard`
    or `slot` are replaced. The rows move once, in the sort along the curve.
    """
    docs = docs.drop("shard", "slot")
    curved = materialize(placed(metadata(docs), bits).groupBy("size", "text_crc32", "text_hash").agg(F.first("curve").alias("curve")), "curves")
    size, crc, digest, curve, source, lang, rank = names = unused(docs.columns, 7)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*[docs[f"`{c}`"] for c in docs.columns], (F.octet_length(text).cast("long") + 1).alias(size), F.crc32(text.cast("binary")).alias(crc), F.xxhash64(text).alias(digest),
                        F.col("lang").cast("string").alias(lang), F.col("source").cast("string").alias(source))
    met = keyed.join(curved.toDF(f"{size}b", f"{crc}b", f"{digest}b", curve), (F.col(size) == F.col(f"{size}b")) & (F.col(crc) == F.col(f"{crc}b")) & (F.col(digest) == F.col(f"{digest}b")))
    ranked = global_rank(met, [curve, size, digest, "doc_id", source, lang], rank, "sharded")
    out = cut(ranked, ranked.count(), shards, rank)
    return out.drop(*names, f"{size}b", f"{crc}b", f"{digest}b")


def op8(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
