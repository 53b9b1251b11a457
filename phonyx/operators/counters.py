"""Counter logs of machines and processes: process text read, deltas of monotone counters, shares of busy time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def machine_times(text: Column) -> Column:
    """(busy, total) of the aggregate line of a machine's stat text: all but idle and waiting time, and all; null without such a line."""
    line = F.regexp_extract(text, r"(?m)^cpu +(.+)$", 1)
    v = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.when(line != "", F.struct((total - F.get(v, F.lit(3)) - F.coalesce(F.get(v, F.lit(4)), F.lit(0.0))).alias("busy"), total.alias("total")))


def process_seconds(text: Column, ticks: float = 100.0) -> Column:
    """Seconds of processor time, user's and system's, of a process's or thread's stat line; its name may hold blanks and brackets; null where the fields are missing."""
    f = F.split(F.trim(F.substring_index(text, ")", -1)), r"\s+")
    number = lambda k: F.get(f, F.lit(k)).try_cast("double")
    return (number(11) + number(12)) / ticks


def deltas(samples: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """samples with `before`, `seconds` since the key's sample before, `delta`, and `reset` where the counter fell, which counts as no growth; a key's first sample has none of them."""
    along = Window.partitionBy(*keys).orderBy(at)
    moved = samples.withColumn("before", F.lag(value).over(along)).withColumn("seconds", F.col(at) - F.lag(at).over(along))
    return moved.withColumn("delta", F.greatest(F.col(value) - F.col("before"), F.lit(0.0))).withColumn("reset", F.col(value) < F.col("before"))


def busy_share(samples: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """(keys, at, busy_pct) from samples of `machine_times` as columns busy and total; null where no time has passed."""
    along = Window.partitionBy(*keys).orderBy(at)
    passed = F.col("total") - F.lag("total").over(along)
    share = F.round(100.0 * (F.col("busy") - F.lag("busy").over(along)) / F.nullif(F.greatest(passed, F.lit(0.0)), F.lit(0.0)), 1)
    return samples.select(*keys, at, share.alias("busy_pct")).where("busy_pct IS NOT NULL")


def group_load(samples: DataFrame, group: str, member: str, tick: str, at: str, value: str) -> DataFrame:
    """(group, tick, sum_pct, max_pct): of one core, by the members of a group seen at a sampling and at the one before it.

    samples: one row for each group, sampling and member; samplings of a group are numbered without gaps and have one time.
    """
    along = Window.partitionBy(group, member).orderBy(tick)
    ticks = samples.groupBy(group, tick).agg(F.min(at).alias("_at")).select(F.col(group).alias("_g"), (F.col(tick) + 1).alias("_t"), "_at")
    both = samples.withColumn("_was", F.lag(value).over(along)).withColumn("_then", F.lag(tick).over(along)).where(F.col("_then") == F.col(tick) - 1)
    met = both.join(ticks, (F.col(group) == F.col("_g")) & (F.col(tick) == F.col("_t")))
    pct = 100.0 * F.greatest(F.col(value) - F.col("_was"), F.lit(0.0)) / F.nullif(F.col(at) - F.col("_at"), F.lit(0.0))
    return met.groupBy(group, tick).agg(F.round(F.sum(pct), 1).alias("sum_pct"), F.round(F.max(pct), 1).alias("max_pct"))


def load_summary(loads: DataFrame, group: str) -> DataFrame:
    """(group, samplings, mean_pct, thread_max_pct) of a step."""
    return loads.groupBy(group).agg(F.count("*").alias("samplings"), F.round(F.avg("sum_pct"), 1).alias("mean_pct"), F.max("max_pct").alias("thread_max_pct"))
