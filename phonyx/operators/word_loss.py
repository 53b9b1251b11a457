"""Words lost between a detector and a transcript: blocks of speech in time order against the owner's own words, arm by arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .runs import align

#: Fixed value: an arm's name with the cross-talk flag, and the level in decibels below which it spares a track.
FLAGGED = r"^(.+)\+xt(?:-f(\d+(?:\.\d+)?))?$"


def arm_of(name: Column) -> Column:
    """(base, flagged, floor_db) of an arm's name: `base+xt` has the flag on, `base+xt-f48` with a floor at -48 dB."""
    base, floor = F.regexp_extract(name, FLAGGED, 1), F.regexp_extract(name, FLAGGED, 2)
    return F.struct(F.when(base != "", base).otherwise(name).alias("base"), (base != "").alias("flagged"), F.when(floor != "", -floor.try_cast("double")).alias("floor_db"))


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """(keys, out): the words of a key's texts one after another, in order; equal places go by text."""
    said = F.array_sort(F.collect_list(F.struct(*order, "_text", "_words")))
    read = rows.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", T.tokens(F.col("text")))
    return read.groupBy(*keys).agg(said.alias("_t")).select(*keys, F.flatten(F.transform("_t", lambda x: x["_words"])).alias(out))


def word_loss(utterances: DataFrame, blocks: DataFrame) -> DataFrame:
    """(arm, track, ref_words, equal, substitute, delete, insert, foreign_insert, blocks, failed_blocks, sent_s) of every track an arm sent blocks of.

    utterances: (track, role: own or leak, start_s, text), blocks: (arm, track, index, text, sent_s), a failed block's text null. Inserted
    words that a partner said and that leaked into the track are foreign, each as often as it leaked at most.
    """
    words = lambda role: utterances.where(F.col("role") == role)
    reference = in_order(words("own"), ["track"], ["start_s"], "reference")
    heard = in_order(blocks, ["arm", "track"], ["index"], "hypothesis")
    sent = blocks.groupBy("arm", "track").agg(F.count("*").alias("blocks"), F.count_if(F.col("text").isNull()).alias("failed_blocks"), F.round(F.sum("sent_s"), 3).alias("sent_s"))
    both = heard.join(reference, "track", "left").withColumn("reference", F.coalesce("reference", F.array().cast("array<string>")))
    ops = both.select("arm", "track", F.size("reference").cast("long").alias("ref_words"), "hypothesis", align("reference", "hypothesis").alias("ops"))
    inserted = F.transform(F.filter("ops", lambda o: o["kind"] == "insert"), lambda o: F.get(F.col("hypothesis"), o["hyp"]))
    count = lambda kind: F.size(F.filter("ops", lambda o: o["kind"] == kind)).cast("long").alias(kind)
    counted = ops.select("arm", "track", "ref_words", *[count(k) for k in ("equal", "substitute", "delete", "insert")], inserted.alias("_inserted"))
    leaked = words("leak").select("track", F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("track", "word").agg(F.count("*").alias("_leaked"))
    claims = counted.select("arm", "track", F.explode("_inserted").alias("word")).groupBy("arm", "track", "word").agg(F.count("*").alias("_n")).join(leaked, ["track", "word"])
    foreign = claims.groupBy("arm", "track").agg(F.sum(F.least("_n", "_leaked")).alias("foreign_insert"))
    met = counted.drop("_inserted").join(foreign, ["arm", "track"], "left").join(sent, ["arm", "track"])
    return met.withColumn("foreign_insert", F.coalesce("foreign_insert", F.lit(0).cast("long")))


def loss_summary(per_track: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of each key (an arm, an arm and a level) with rates in percent of the reference words."""
    counts = ("equal", "substitute", "delete", "insert", "foreign_insert", "blocks", "failed_blocks")
    sums = per_track.groupBy(*keys).agg(F.count("*").alias("tracks"), F.sum("ref_words").alias("ref_words"), *[F.sum(F.col(f"`{c}`")).alias(c) for c in counts], F.round(F.sum("sent_s"), 1).alias("sent_s"))
    pct = lambda x: F.coalesce(F.round(100.0 * x / F.nullif(F.col("ref_words"), F.lit(0)), 2), F.lit(0.0))
    return sums.withColumns({
        "deletion_pct": pct(F.col("delete")), "insertion_pct": pct(F.col("insert")), "foreign_insertion_pct": pct(F.col("foreign_insert")), "recognised_pct": pct(F.col("equal")),
        "wer_pct": pct(F.col("delete") + F.col("insert") + F.col("substitute")),
    })
