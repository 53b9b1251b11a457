"""Scans of speech corpora: rows of Parquet shards or tab-separated lists as samples, with what was dropped and why."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALL_SUBSETS = "All"
EMPTY_REFERENCE, CLIP_MISSING = "empty_reference", "clip_missing"


@dataclass(frozen=True)
class Corpus:
    """How the rows of a corpus are read: the first text column that is not empty is the reference."""

    subset: str
    text_columns: Sequence[str]
    #: Column that names a row's own subset, for corpora of mixed sources, and other names of subsets.
    source_column: str | None = None
    aliases: Mapping[str, str] = field(default_factory=dict)
    #: Column with the sample's own id; without one ids are the subset and the row's number.
    id_column: str | None = None
    #: Whether a row without a reference is kept.
    keep_empty: bool = False


# Text columns of public corpora.
CORPORA = {
    "fleurs": Corpus("fleurs", ("raw_transcription", "transcription")),
    "voxpopuli-de": Corpus("voxpopuli-de", ("raw_text", "normalized_text")),
    "mls-de": Corpus("mls-de", ("transcript",)),
    "avemio-german-mixed-test": Corpus("avemio-german-mixed-test", ("transkription",)),
    "mixed": Corpus("mixed", ("references",), source_column="from", keep_empty=True),
}


def numbered_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The rows of Parquet files with `row_number`, their place in all files in the order of the files' names, from 0.

    A place is the row's number in its file and the rows of the files before,
    of which there is one count for each file.
    """
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_file").alias("_of"), F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each file
    return rows.join(F.broadcast(before), F.col("_file") == F.col("_of")).withColumn("row_number", F.col("_before") + F.col("_at")).drop("_file", "_at", "_of", "_before")


def first_text(rows: DataFrame, columns: Sequence[str]) -> Column:
    """The first of the columns that are there which is not empty; an empty text if none is."""
    there = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns if c in rows.columns]
    return F.coalesce(*there, F.lit(""))


def samples(rows: DataFrame, corpus: Corpus, subset: str = ALL_SUBSETS) -> DataFrame:
    """(sample_id, subset, reference, reason, and the rows' columns): rows of a subset; `reason` says why a row is dropped, null if it is not.

    Rows of other subsets are not of the sample at all. Ids count all rows,
    also those of other subsets and dropped ones, so filters do not move them.
    """
    wanted = corpus.aliases.get(subset, subset)
    if corpus.source_column is None:
        if wanted not in (corpus.subset, ALL_SUBSETS):
            raise ValueError(f"unknown subset {subset!r}")
        own = F.lit(corpus.subset)
    else:
        own = F.coalesce(F.col(corpus.source_column), F.lit("unknown"))
        if wanted != ALL_SUBSETS:
            rows = rows.where(F.col(corpus.source_column) == wanted)
    number = F.concat_ws("-", own, F.col("row_number").cast("string"))
    sample_id = number if corpus.id_column is None else F.coalesce(F.nullif(F.col(corpus.id_column).cast("string"), F.lit("")), number)
    reference = first_text(rows, corpus.text_columns)
    reason = F.lit(None).cast("string") if corpus.keep_empty else F.when(reference == "", EMPTY_REFERENCE)
    return rows.select(sample_id.alias("sample_id"), own.alias("subset"), reference.alias("reference"), reason.alias("reason"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def kept(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Samples that are not dropped; with a limit the first ones in the order of the corpus."""
    out = found.where("reason IS NULL")
    return out if limit is None else out.orderBy("row.row_number").limit(limit)


def tally(found: DataFrame) -> DataFrame:
    """(reason, n): rows by why they are dropped; `yielded` are the rest."""
    return found.groupBy(F.coalesce("reason", F.lit("yielded")).alias("reason")).agg(F.count("*").alias("n"))


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size) of the files in tar archives; a task reads one archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer())) as tar:
                    found = [(m.name, m.size) for m in tar if m.isfile()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([m for m, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["archive", "member", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, size long")


def listed_clips(spark: SparkSession, tsv: str, members: DataFrame | None, prefix: str, text_column: str = "sentence", region_column: str = "accent") -> DataFrame:
    """(sample_id, region, reference, reason, path) of a tab-separated list of clips; quotes are plain characters.

    Ids are prefix-region-stem of the clip. A row without text, or whose clip
    is in no archive, is dropped and says why.
    """
    rows = spark.read.csv(tsv, sep="\t", quote="", header=True)
    region = F.coalesce(F.nullif(F.trim(F.coalesce(F.col(region_column), F.lit(""))), F.lit("")), F.lit("unknown"))
    clip = F.coalesce(F.nullif(F.regexp_replace(F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1), r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("unknown"))
    reference = F.coalesce(F.col(text_column), F.lit(""))
    out = rows.select(F.concat_ws("-", F.lit(prefix), region, clip).alias("sample_id"), region.alias("region"), reference.alias("reference"), "path")
    missing = F.lit(False)
    if members is not None:
        there = members.select(F.col("member").alias("_member")).distinct().withColumn("_there", F.lit(True))
        out = out.join(there, F.concat(F.lit("clips/"), "path") == F.col("_member"), "left")
        missing = F.col("_there").isNull()
    return out.select("sample_id", "region", "reference", F.when(F.col("reference") == "", EMPTY_REFERENCE).when(missing, CLIP_MISSING).alias("reason"), "path")


def region_of(sample_id: Column, prefix: str) -> Column:
    """The region in an id of listed_clips; an id of another make is an error."""
    found = F.regexp_extract(sample_id, rf"^\Q{prefix}\E-([^-]+)-.+$", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no region in the sample id "), sample_id)))
