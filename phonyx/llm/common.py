"""Helpers the training-data operators share: input tables, lineage cuts and global ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], n: int) -> list[str]:
    """n column names that are none of the given ones."""
    taken, out, i = {c.lower() for c in columns}, [], 0
    while len(out) < n:
        if f"_own{i}" not in taken:
            out.append(f"_own{i}")
        i += 1
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset one of our own, on a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="phonyx-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    With a bound of its rows, a file is written for each million of them. The files survive the loss of executors. They stay until the folder is
    cleared or `discard` is called with the returned frame.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phonyx/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // 1_000_000)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._phonyx_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `materialize` wrote for df; only for frames that nothing reads any more."""
    path = getattr(df, "_phonyx_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def global_rank(df: DataFrame, order: list[str], rank: str = "rank", name: str = "ranked") -> DataFrame:
    """df with a gapless 0-based rank in the order of the given columns (nulls first).

    One range exchange sorts the rows; each row's offset in its partition and
    the partitions' sizes (one small row per partition) give the rank, so no
    task sees more than its own range. `order` should be a total order:
    rows equal in all its columns get ranks in any order among themselves.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    at, of, size, before = unused([*df.columns, rank], 4)
    kept = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), name)
    part = F.shiftright(at, 33)
    sizes = kept.groupBy(part.alias(of)).agg(F.count("*").alias(size))
    earlier = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range exchange.
    offsets = sizes.select(F.col(of), F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    joined = kept.join(F.broadcast(offsets), part == F.col(of))
    return joined.withColumn(rank, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, of, before)
