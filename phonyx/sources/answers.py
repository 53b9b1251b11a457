"""Answers of hosted diarization services, of unlike shapes: the first shape that can be read wins, else a named refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the two kinds of answers keep their words, and that the second counts in milliseconds.
CHANNELS, ALTERNATIVES, CHANNEL_WORDS = "$.results.channels", "$.results.channels[0].alternatives", "$.results.channels[0].alternatives[0].words"
UTTERANCES, WORDS, MS = "$.utterances", "$.words", 1000.0


def items(value: Column, path: str) -> Column:
    """The list at a path; null where there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def field(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def labelled(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["speaker"].isNotNull())


def span(value: Column, per_second: float, speaker: Column) -> Column:
    return F.struct((field(value, "start", "double") / per_second).alias("start"), (field(value, "end", "double") / per_second).alias("end"), speaker.alias("speaker"))


def channel_spans(answer: Column) -> Column:
    """(spans, refused) of an answer with channels: its first channel's first alternative's words that have a speaker.

    Words without any speaker are refused: the service did not tell speakers apart, which is not one speaker.
    """
    words = items(answer, CHANNEL_WORDS)
    name = lambda w: F.concat(F.lit("speaker_"), field(w, "speaker", "string"))
    spans = labelled(F.transform(words, lambda w: span(w, 1.0, name(w))))
    empty = lambda path: F.coalesce(F.size(items(answer, path)), F.lit(0)) <= 0
    refused = (
        F.when(answer.isNull(), "no JSON").when(empty(CHANNELS), "no channels").when(empty(ALTERNATIVES), "no alternatives").when(words.isNull(), "no word list")
        .when((F.size(words) > 0) & (F.size(spans) == 0), "no word has a speaker")
    )
    return F.struct(F.when(refused.isNull(), spans).alias("spans"), refused.alias("refused"))


def utterance_spans(answer: Column) -> Column:
    """(spans, refused) of an answer with utterances, in milliseconds: their words, a word without a speaker its utterance's; an utterance without such words itself; without any, the answer's own words."""
    given = lambda v: F.nullif(field(v, "speaker", "string"), F.lit(""))

    def of(u: Column) -> Column:
        words = labelled(F.transform(F.coalesce(items(u, WORDS), F.array().cast("array<variant>")), lambda w: span(w, MS, F.coalesce(given(w), given(u)))))
        return F.when(F.size(words) > 0, words).otherwise(labelled(F.array(span(u, MS, given(u)))))

    first = F.flatten(F.transform(items(answer, UTTERANCES), of))
    second = labelled(F.transform(items(answer, WORDS), lambda w: span(w, MS, given(w))))
    some = lambda c: F.when(F.size(c) > 0, c)
    spans = F.coalesce(some(first), some(second))
    return F.struct(spans.alias("spans"), F.when(answer.isNull(), "no JSON").when(spans.isNull(), "no word or utterance has a speaker").alias("refused"))


def answer_spans(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """answers with `spans` (start, end, speaker) and `refused`: an answer with channels is read as such, any other by its utterances."""
    value = answers.withColumn("_v", F.try_parse_json(raw))
    both = value.withColumn("_c", channel_spans(F.col("_v"))).withColumn("_u", utterance_spans(F.col("_v")))
    channels = items(F.col("_v"), CHANNELS).isNotNull()
    return both.withColumns({"spans": F.when(channels, F.col("_c.spans")).otherwise(F.col("_u.spans")), "refused": F.when(channels, F.col("_c.refused")).otherwise(F.col("_u.refused"))}).drop("_v", "_c", "_u")
