"""The driver's tables seen as speech-evaluation data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.scan import held, running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1e6


def spans(spark: SparkSession, sf_dir: str, minutes: float = 60.0) -> DataFrame:
    """Events as spans: value minutes (of `minutes` seconds) from their time on."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", seconds().alias("start"), (seconds() + minutes * F.col("value")).alias("end"))


def turns_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference turns by day and a disturbed hypothesis of them, as segments."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("ord"), seconds().alias("t"), F.col("value"), F.pmod("user_id", F.lit(3)).alias("s"))
    ref = e.select("file", "ord", F.col("t").alias("start"), (F.col("t") + 60 * F.col("value")).alias("end"), F.col("s").cast("string").alias("speaker"), F.lit("ref").alias("side"))
    turn = F.when(F.col("ord") % 11 == 0, 2).otherwise(1)
    hyp = e.where("ord % 7 <> 0").select(
        "file", "ord", (F.col("t") + 1).alias("start"), (F.col("t") + 60 * F.col("value") + F.when(F.col("ord") % 5 == 0, 900).otherwise(0)).alias("end"),
        F.concat(F.lit("h"), ((F.col("s") + turn) % 3).cast("string")).alias("speaker"), F.lit("hyp").alias("side"),
    )
    return ref.unionByName(hyp)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn with the one after it: (id, reference, prediction, conv_id)."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return c.select("conv_id", "turn", F.col("text").alias("reference")).join(after, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("prediction", F.lit("")).alias("prediction")
    )


def copied_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r, h): the numbers of documents and of their predecessor in language and source, where both have text.

    Texts are reduced to their numbers where they stand; the predecessor is
    found on ids alone, in ranges of ids, so that no source is one task's.
    """
    d = table(spark, sf_dir, "documents")
    ids = d.select("doc_id", "lang", "source")
    before = running(ids, ["lang", "source"], F.floor(F.col("doc_id") / 100_000), ["doc_id"], {"prev": (F.max, "doc_id")}, before=True)
    # Both sides read them, so the texts would be looked through twice.
    found = held(d.select("doc_id", metrics.numbers(F.col("text")).alias("n")).where("n IS NOT NULL"), "numbers")
    own = before.select(F.col("doc_id").alias("id"), "prev").join(found.select(F.col("doc_id").alias("id"), F.col("n").alias("h")), "id")
    return own.join(found.select(F.col("doc_id").alias("prev"), F.col("n").alias("r")), "prev").select("id", "r", "h")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recordings of ten seconds a turn: (rid, reference, duration_s); the reference is all turns' text."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    n = F.size("t") - F.when(F.col("conv_id") % 4 == 1, 2).otherwise(0)
    return c.select(F.col("conv_id").alias("rid"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("reference"), (10.0 * n).alias("duration_s"))


def recorded_answers(spark: SparkSession, sf_dir: str, variant: int = 0) -> DataFrame:
    """Answers of a model that fails on some turns, repeats some and hears others wrong; of every fourth recording the audio ends two turns early."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    k = F.col("conv_id") + F.col("turn") + variant
    text = F.coalesce("text", F.lit(""))
    heard = F.when(k % 6 == 0, F.lit(None)).when(k % 25 == 0, F.concat_ws(" ", text, text, text, text)).when(k % 5 == 0, F.concat_ws(" ", text, text)).when(k % 3 == 1, F.replace(text, F.lit("e"), F.lit("a"))).otherwise(text)
    met = c.join(last, "conv_id").where((F.col("conv_id") % 4 != 1) | (F.col("turn") <= F.col("_last") - 2))
    return met.select(F.col("conv_id").alias("rid"), F.col("turn").cast("long").alias("index"), (10.0 * F.col("turn")).alias("source_start"), (10.0 * F.col("turn") + 9.5).alias("source_end"), heard.alias("text"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as outputs of three kinds of models: (conv_id, form, raw).

    By the remainder of the id by three: records, the last one broken off nine characters before its text ends where those are
    plain; marks of time and speaker; sentences with locale tags.
    """
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    record = lambda x: F.to_json(F.struct((x["turn"] * 10).alias("Start"), (x["turn"] * 10 + 9.5).alias("End"), (x["turn"] % 2).alias("Speaker"), x["text"].alias("Content")))
    whole = F.concat(F.lit("["), F.array_join(F.transform("t", record), ","), F.lit("]"))
    tail = F.right(F.element_at("t", -1)["text"], F.lit(12))
    records = F.when(tail.rlike("^[A-Za-z .]{12}$"), F.substring(whole, F.lit(1), F.length(whole) - 12)).otherwise(whole)
    time = lambda x, add: F.concat(F.lit("["), (x["turn"] * 10 + add).cast("string"), F.lit(".25]"))
    marks = F.array_join(F.transform("t", lambda x: F.concat(time(x, 0), F.lit("[S0"), (x["turn"] % 2).cast("string"), F.lit("] "), x["text"], F.lit(" "), time(x, 9))), "")
    tags = F.array_join(F.transform("t", lambda x: x["text"]), " <de-DE> ")
    k = F.col("conv_id") % 3
    return c.select(
        "conv_id", F.when(k == 0, "vibevoice-json").when(k == 1, "moss-timed-speakers").otherwise("nemotron-locale-tags").alias("form"), F.when(k == 0, records).when(k == 1, marks).otherwise(tags).alias("raw")
    )


def coupled_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as live answers and as batch answers to most of them."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "ts", "value", seconds().alias("s"))
    k, said = F.col("event_id"), F.concat_ws(" ", F.col("event_type"), F.lit("said"), (F.col("user_id") % 7).cast("string"))
    live = e.select(
        F.col("event_type").alias("session"), k.alias("idx"), F.col("ts").cast("timestamp").alias("at"), F.col("s").alias("t_speech_end"), (F.col("s") + F.col("value") / 100).alias("t_done"),
        F.when(k % 41 == 0, "").when(k % 7 == 0, F.concat(said, F.lit(" more"))).otherwise(said).alias("text"), F.when(k % 53 == 0, "closed").alias("error"),
    )
    finals = e.where(k % 5 != 0).select(
        F.col("event_type").alias("session"), k.alias("idx"), (F.col("ts") + F.expr("INTERVAL 3 SECONDS")).cast("timestamp").alias("final_at"), (F.col("s") + k % 17 / 10).alias("t_final_done"),
        F.when(k % 13 == 0, "empty").otherwise("ok").alias("status"), F.when(k % 13 == 0, "").otherwise(said).alias("final_text"),
    )
    return live, finals


def detector_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events as two detectors' scores on sixteen tracks: (scores, thresholds, tracks, labels)."""
    w = Window.partitionBy("track").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("track", F.col("user_id") % 16).withColumn("frame", (F.row_number().over(w) - 1).cast("long"))
    scores = e.select(F.explode(F.array(F.struct(F.lit("values").alias("arm"), (F.col("value") / 100).alias("score")), F.struct(F.lit("places").alias("arm"), (F.col("event_id") * 37 % 100 / 100).alias("score")))).alias("x"), "track", "frame")
    tracks = e.groupBy("track").agg(F.count("*").alias("n"))
    kind = F.when(F.col("event_type").isin("purchase", "click"), "target").when(F.col("event_type") == "view", "crosstalk")
    labels = e.select("track", kind.alias("kind"), (F.col("frame") * 0.01).alias("start"), ((F.col("frame") + 1) * 0.01).alias("end")).where("kind IS NOT NULL")
    sweep = [(a, t / 10, round(t / 10 - 0.15, 2)) for a in ("values", "places") for t in range(1, 10)]
    return scores.select("x.arm", "track", "frame", "x.score"), spark.createDataFrame(sweep, "arm string, threshold double, off double"), tracks, labels


def hosted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a hosted service's answer: (user_id, raw), by the remainder of the id by five with channels, with utterances, or no JSON."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("speaker"))
    start, end = F.col("event_id") * 250, F.col("event_id") * 250 + 200
    word = F.struct((start / 1000).alias("start"), (end / 1000).alias("end"), "speaker")
    own = F.when(F.col("event_id") % 3 != 0, F.array(F.struct(start.alias("start"), end.alias("end"))))
    said = F.struct(start.alias("start"), end.alias("end"), "speaker", own.alias("words"))
    g = e.groupBy("user_id").agg(F.collect_list(word).alias("w"), F.collect_list(said).alias("u"))
    channels = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("w").alias("words"))).alias("alternatives"))).alias("channels")).alias("results")))
    k = F.col("user_id") % 5
    return g.select("user_id", F.when(k < 2, channels).when(k < 4, F.to_json(F.struct(F.col("u").alias("utterances")))).otherwise("{broken").alias("raw"))
