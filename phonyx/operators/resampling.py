"""Seeded bootstrap intervals of ratios, and paired intervals of ratio differences."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import same

RESAMPLES, SEED, CONFIDENCE = 10_000, 20260903, 0.95
#: Draws of a group that one task makes.
DRAWS_A_TASK = 1 << 28


#: Where a generator stands: its words, its place in them, and how many accepted draws are to be left out first.
Place = tuple[bytes, int, int]


def _source(place: Place | None, seed: int) -> np.random.RandomState:
    words, at = random.Random(seed).getstate()[1][:-1], random.Random(seed).getstate()[1][-1]
    out = np.random.RandomState()
    out.set_state(("MT19937", np.array(words, np.uint32) if place is None else np.frombuffer(place[0], np.uint32), at if place is None else place[1]))
    return out


def places(n: int, cuts: Sequence[int], seed: int, chunk: int = 1 << 20) -> list[Place]:
    """Where the generator of draws below n stands after so many draws, for ascending counts: words are made and counted, nothing is drawn."""
    source, shift, accepted, out = _source(None, seed), 32 - n.bit_length(), 0, []
    while len(out) < len(cuts):
        _, words, at, *_ = source.get_state()
        found = int(np.count_nonzero(source.randint(0, 1 << 32, size=chunk, dtype=np.uint32) >> np.uint32(shift) < n))
        while len(out) < len(cuts) and cuts[len(out)] < accepted + found:
            out.append((words.tobytes(), int(at), cuts[len(out)] - accepted))
        accepted += found
    return out


def draw_slabs(n: int, sizes: Iterable[int], seed: int, place: Place | None = None) -> Iterator[np.ndarray]:
    """Uniform draws below n, as many at a time as `sizes` says: 32-bit words of a Mersenne Twister, their top bits, drawn again where too large.

    With a place from `places` they begin there.
    """
    source, skip = _source(place, seed), 0 if place is None else place[2]
    shift, left = 32 - n.bit_length(), np.zeros(0, np.uint32)
    for count in sizes:
        found, have = [left], len(left)
        while have < count + skip:
            words = source.randint(0, 1 << 32, size=count + skip - have + 1024, dtype=np.uint32) >> np.uint32(shift)
            found.append(words[words < n])
            have += len(found[-1])
        every = np.concatenate(found)[skip:]
        left, skip = every[count:], 0
        yield every[:count].astype(np.int64)


def index_draws(n: int, count: int, seed: int) -> np.ndarray:
    """The first `count` draws of draw_slabs."""
    return next(draw_slabs(n, [count], seed))


def resampled_sums(values: np.ndarray, resamples: int, seed: int, slab: int = 1 << 20, place: Place | None = None) -> np.ndarray:
    """Sums of `resamples` samples, as large as the data, of the rows of `values`; about `slab` draws are held at a time."""
    n = len(values)
    step = max(1, slab // n)
    sizes = (min(step, resamples - i) * n for i in range(0, resamples, step))
    return np.concatenate([values[draws.reshape(-1, n)].sum(1) for draws in draw_slabs(n, sizes, seed, place)])


def percentiles(draws: np.ndarray, confidence: float) -> tuple[float, float]:
    """Interval ends: order statistics at the floor of the tail, without interpolation."""
    ordered, tail = np.sort(draws), (1 - confidence) / 2
    last = len(ordered) - 1
    return float(ordered[int(tail * last)]), float(ordered[int((1 - tail) * last)])


def _ratio(sums: np.ndarray) -> np.ndarray:
    return np.divide(100.0 * sums[..., 0], sums[..., 1], out=np.zeros(sums.shape[:-1]), where=sums[..., 1] != 0)


def statistics(units: DataFrame, keys: Sequence[str], order: str | Sequence[str], columns: Sequence[str], statistic: Callable, resamples: int, seed: int, confidence: float, draws_a_task: int) -> DataFrame:
    """(keys, point, lo, hi, n): a statistic of each group's column sums, with its percentile interval.

    A group's samples are dealt over tasks of about `draws_a_task` draws. One
    small task a group makes the generator's words to find where it stands
    before each share; the shares then draw what one task would have drawn. A
    share holds the group's units once and a slab of draws. The samples'
    statistics meet in one row a group, of fixed size.
    """
    kinds = dict(units.dtypes)
    form = "".join(f"{k} {kinds[k]}, " for k in keys)
    values = [f"cast({c} as double) as _v{i}" for i, c in enumerate(columns)]
    by = [f"_order{i}" for i in range(len([order] if isinstance(order, str) else order))]
    rows = units.selectExpr(*keys, *[f"{c} as {b}" for c, b in zip([order] if isinstance(order, str) else order, by)], *values)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                n = int(row.n)
                step = max(1, min(resamples, draws_a_task // n))
                firsts = list(range(0, resamples, step))
                found = places(n, [f * n for f in firsts], seed) if len(firsts) > 1 else [None]
                out += [(*row[:-1], k, min(step, resamples - f), *(p or (None, None, None))) for k, (f, p) in enumerate(zip(firsts, found))]
            yield pd.DataFrame(out, columns=[*keys, "_share", "_samples", "_words", "_at", "_skip"])

    shares = counts.mapInPandas(plan, form + "_share long, _samples long, _words binary, _at long, _skip long")
    many = counts.select(*keys, F.ceil(F.lit(resamples) / F.greatest(F.lit(1), F.least(F.lit(resamples), F.floor(F.lit(draws_a_task) / F.col("n"))))).alias("_many")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    # Each share of a group gets the group's units.
    dealt = rows.join(many, same(keys, [f"_of_{k}" for k in keys])).select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many").cast("long") - 1)).alias("_share"))

    def draw(own: pa.Table, share: pa.Table) -> pa.Table:
        # The units stay Arrow columns: no more than their numbers and their order are held.
        v = np.column_stack([own.column(f"_v{i}").to_numpy() for i in range(len(columns))])[pc.sort_indices(own.select(by), [(b, "ascending") for b in by]).to_numpy()]
        s = share.slice(0, 1).to_pylist()[0]
        place = None if s["_words"] is None else (s["_words"], int(s["_at"]), int(s["_skip"]))
        found = statistic(resampled_sums(v, int(s["_samples"]), seed, place=place))
        return pa.table({**{k: share.column(k).slice(0, 1) for k in keys}, "_found": pa.array([found], pa.list_(pa.float64())), "_point": [float(statistic(v.sum(0)))], "n": pa.array([len(v)], pa.int64())})

    drawn = dealt.groupBy(*keys, "_share").cogroup(shares.groupBy(*keys, "_share")).applyInArrow(draw, form + "_found array<double>, _point double, n long")
    ordered = drawn.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_all"), F.first("_point").alias("point"), F.first("n").alias("n"))
    tail = (1 - confidence) / 2
    end = lambda q: F.get("_all", F.lit(int(q * (resamples - 1))))
    return ordered.select(*keys, "point", end(tail).alias("lo"), end(1 - tail).alias("hi"), "n")


def ratio_interval(units: DataFrame, keys: Sequence[str], order: str | Sequence[str], resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE, draws_a_task: int = DRAWS_A_TASK) -> DataFrame:
    """(keys, point, lo, hi, n): 100 * sum(num) / sum(den) of each group with its percentile interval.

    A group is a run's sampling units (files, utterances, windows) in their order.
    """
    return statistics(units, keys, order, ["num", "den"], _ratio, resamples, seed, confidence, draws_a_task)


def pair_units(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Units of two runs side by side; a unit that only one of them has is an error."""
    both = a.select(key, F.col("num").alias("num_a"), F.col("den").alias("den_a"), F.lit(True).alias("_a")).join(
        b.select(key, F.col("num").alias("num_b"), F.col("den").alias("den_b"), F.lit(True).alias("_b")), key, "full_outer"
    )
    refused = F.raise_error(F.concat(F.lit("unit in one run only: "), F.col(key).cast("string"))).cast("double")
    return both.select(key, F.when(F.col("_a") & F.col("_b"), F.col("num_a")).otherwise(refused).alias("num_a"), "den_a", "num_b", "den_b")


def _difference(sums: np.ndarray) -> np.ndarray:
    return _ratio(sums[..., :2]) - _ratio(sums[..., 2:])


def paired_interval(pairs: DataFrame, key: str | Sequence[str], resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE, draws_a_task: int = DRAWS_A_TASK) -> DataFrame:
    """(point, lo, hi, n) of ratio(a) - ratio(b); each sample of units scores both sides."""
    every = pairs.withColumn("_every", F.lit(1))
    return statistics(every, ["_every"], key, ["num_a", "den_a", "num_b", "den_b"], _difference, resamples, seed, confidence, draws_a_task).drop("_every")
