"""Running sums and maxima, and following values, of groups of any size, in two levels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what several parts of a plan read; df itself where spark.checkpoint.dir names none."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/phonyx/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(a: Sequence[str], b: Sequence[str]) -> Column:
    """Null-safe equality of columns with those of another frame."""
    on = F.lit(True)
    for x, y in zip(a, b):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def running(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], amounts: Mapping[str, tuple[Callable, str]], before: bool = False, following: Mapping[str, str] | None = None
) -> DataFrame:
    """df with, for each `out: (F.sum or F.max, column)` in `amounts`, that of its key's rows up to its own (or before it).

    `bucket` must not fall along `order`; a bucket is what one task sorts, so
    a key with a third of all rows is dealt over as many tasks as it has
    buckets. Only one row for each key and bucket meets in a window by key.
    `following` (out: column) adds the column's value in the key's next row;
    the column must not fall along `order`. Sums begin at 0, maxima at null.
    """
    following = following or {}
    cut = df.withColumn("_bucket", bucket)
    each = cut.groupBy(*keys, "_bucket").agg(
        *[f(c).alias(f"_{out}") for out, (f, c) in amounts.items()], *[F.min(c).alias(f"_{out}") for out, c in following.items()], F.lit(1).alias("_one")
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_bucket").alias("_key_bucket"),
        *[f(F.col(f"_{out}")).over(earlier).alias(f"_{out}") for out, (f, _) in amounts.items()], *[F.lead(f"_{out}").over(along).alias(f"_{out}") for out in following],
    )
    # Every row meets its bucket; as an outer join, the rows themselves are never what is broadcast, however small their files look.
    met = cut.join(base, same([*keys, "_bucket"], [*(f"_key_{k}" for k in keys), "_key_bucket"]), "left")
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def value(f: Callable, c: str, out: str) -> Column:
        own, rest = f(c).over(upto), F.col(f"_{out}")
        return F.coalesce(own, F.lit(0)) + F.coalesce(rest, F.lit(0)) if f is F.sum else F.greatest(own, rest)

    found = met.select(
        *[F.col(f"`{c}`") for c in df.columns], *[value(f, c, out).alias(out) for out, (f, c) in amounts.items()],
        *[F.coalesce(F.lead(c).over(local), F.col(f"_{out}")).alias(out) for out, c in following.items()],
    )
    return found


def buckets_by_value(df: DataFrame, column: str, n: int = 256) -> Column:
    """A bucket for each value of a numeric column: ranges of it that hold about as many rows each.

    The cuts are n - 1 approximate quantiles, which is all that the driver
    sees; they decide how the work is dealt, never a result.
    """
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    kept = sorted(set(cuts))
    if not kept:
        return F.lit(0)
    # Places of a sorted literal array: how many cuts are not above the value.
    return F.size(F.filter(F.array(*[F.lit(x) for x in kept]), lambda x: x <= F.col(column)))
