"""Scans and sinks of the file formats, as DataFrames; parsing is done by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import PASS_FIELDS

PREDICTION = "sample_id string, reference string, prediction string, latency_s double, error string, raw_prediction string, segments array<struct<speaker:string,start_s:double,end_s:double,text:string>>, capped_post_hoc boolean"
PASS = "started_at string, finished_at string, wall_s double, n_requests long, n_ok long, audio_s double, concurrency long, adapter string, hardware string, interrupted boolean, serving string"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def rttm_lines(lines: DataFrame) -> DataFrame:
    """Segments of lines (file, ord, line): speaker lines with eight fields and numbers; comments and the rest are passed over."""
    f = F.split(F.trim("line"), r"\s+")
    start, length = F.expr("try_cast(f[3] AS double)"), F.expr("try_cast(f[4] AS double)")
    rows = lines.withColumn("f", f).where((F.element_at("f", 1) == "SPEAKER") & (F.size("f") >= 8))
    return rows.select("file", "ord", start.alias("start"), (start + length).alias("end"), F.element_at("f", 8).alias("speaker")).where("start IS NOT NULL AND end IS NOT NULL")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rttm").text(path, wholetext=True)
    lines = whole.select(stem(F.col("_metadata.file_path")).alias("file"), F.posexplode(F.split("value", r"\R")).alias("ord", "line"))
    return rttm_lines(lines)


def rttm_text(segments: DataFrame) -> DataFrame:
    """(file, value): the RTTM text of each file, in the order of time."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>\n", "file", "start", F.col("end") - F.col("start"), "speaker")
    lines = segments.select("file", F.struct("start", "end", "speaker", line.alias("line")).alias("x"))
    return lines.groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("file", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("value"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PREDICTION).option("recursiveFileLookup", "true").option("pathGlobFilter", "predictions_*.jsonl").json(path)
    return rows.withColumn("subset", F.regexp_extract("_metadata.file_name", r"predictions_(.*)\.jsonl$", 1)).withColumn("file", F.col("_metadata.file_path"))


def read_passes(spark: SparkSession, path: str) -> DataFrame:
    """Passes of a log; torn lines and lines that lack a field are left out."""
    rows = spark.read.schema(PASS + ", _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    complete = F.lit(True)
    for field in PASS_FIELDS:
        complete = complete & F.col(field).isNotNull()
    return rows.where(F.col("_torn").isNull() & complete).drop("_torn")


def vtt_cues(files: DataFrame) -> DataFrame:
    """(file, ord, start, end, text) of WebVTT texts (file, value)."""
    clock = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("ord", "block"))
    timed = blocks.withColumn("a", F.regexp_extract("block", clock + r"\s*-->\s*" + clock, 1)).withColumn("b", F.regexp_extract("block", clock + r"\s*-->\s*" + clock, 2)).where("a <> ''")

    def seconds(c: str) -> Column:
        parts = F.transform(F.reverse(F.split(F.replace(F.col(c), F.lit(","), F.lit(".")), ":")), lambda x: x.cast("double"))
        return F.element_at(parts, 1) + 60 * F.element_at(parts, 2) + 3600 * F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(0.0))

    body = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n?(.*)$", 1), "<[^>]*>", "")
    return timed.select("file", "ord", seconds("a").alias("start"), seconds("b").alias("end"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def zipped_segments(rows: DataFrame, file: str, starts: str, ends: str, speakers: str) -> DataFrame:
    """Segments of rows with parallel arrays; unequal lengths are an error, turns without length are dropped."""
    equal = (F.size(starts) == F.size(ends)) & (F.size(starts) == F.size(speakers))
    checked = F.when(equal, F.arrays_zip(F.col(starts).alias("start"), F.col(ends).alias("end"), F.col(speakers).alias("speaker"))).otherwise(F.raise_error(F.concat(F.lit("arrays of unequal length in "), F.col(file).cast("string"))))
    return rows.select(F.col(file).alias("file"), F.posexplode(checked).alias("ord", "s")).select("file", "ord", "s.start", "s.end", "s.speaker").where("end > start")


def gauges(lines: DataFrame) -> DataFrame:
    """(name, value): gauge lines of an exposition text, summed over labels."""
    rows = lines.where(~F.col("line").startswith("#")).select(F.regexp_extract("line", r"^([a-zA-Z_:][\w:]*)", 1).alias("name"), F.expr(r"try_cast(regexp_extract(line, '(\\S+)\\s*$', 1) AS double)").alias("value"))
    return rows.where("name <> '' AND value IS NOT NULL").groupBy("name").agg(F.sum("value").alias("value"))


def manifest_lines(lines: DataFrame) -> DataFrame:
    """(path, digest) of checksum lines; a path listed twice is an error."""
    rows = lines.where(F.trim("line") != "").select(F.regexp_extract("line", r"^([0-9a-f]{64})\s+\*?(.+)$", 1).alias("digest"), F.regexp_extract("line", r"^([0-9a-f]{64})\s+\*?(.+)$", 2).alias("path"))
    return rows.groupBy("path").agg(F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("listed twice: "), F.first("path"))).cast("string")).otherwise(F.first("digest")).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("digest"))


def manifest_text(digests: DataFrame) -> DataFrame:
    """(path, line) in the format of checksum files."""
    return digests.select("path", F.concat("digest", F.lit("  "), "path").alias("line")).orderBy("path")


def append_passes(passes: DataFrame, path: str) -> None:
    passes.write.mode("append").json(path)
