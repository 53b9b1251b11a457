"""Scoring of long recordings: answers put in time order, one alignment a recording, read by windows of reference words and by answers.

recordings: (rid, reference, duration_s), answers: (rid, index, source_start,
source_end, text), a failed answer's text null. A recording is aligned in one
task, in memory that grows with its length times the root of its length in
bits; everything after is grouped by recording and window or answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import lists
from .runs import KINDS, WINDOW_WORDS, coded_steps, loop_spans, places
from .scan import held

# How near the end a recording's last answer must come, and the word ratios beyond which a window or an answer is flagged.
END_SLACK_S, WINDOW_RUNAWAY, WINDOW_DROPOUT, ANSWER_RUNAWAY = 120.0, 1.5, 0.5, 3.0


#: Recordings whose operations leave a task together.
TOGETHER = 64


def owned_steps(ref: list, hyp: list, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Operations of an alignment (code of the kind, anchor, place in ref) with the answer that each hypothesis word is from (`owner`).

    `span` is given to reference words from the first to the last one aligned to words of one answer: that answer. None is -1.
    """
    codes, r, h, anchor = coded_steps(ref, hyp)
    n, both = len(r), (r >= 0) & (h >= 0)
    own = np.where(h >= 0, owner[np.maximum(h, 0)] if len(owner) else -1, -1)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(both, place, -1))
    after = np.minimum.accumulate(np.where(both, place, n)[::-1])[::-1]
    inside = (r >= 0) & (before >= 0) & (after < n)
    span = np.where(inside & (own[np.clip(before, 0, None)] == own[np.clip(after, None, n - 1)]), own[np.clip(before, 0, None)], -1) if n else own
    return codes, anchor, r, own, span


def each_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, reference, hypothesis, owners) as rows of owned_steps, those of some recordings at a time; `word` is the reference word of a span."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            found, words = [], []
            for ref, hyp, owner in zip(*(lists(part.column(c)) for c in ("reference", "hypothesis", "owners"))):
                found.append([x.astype(np.int32) for x in owned_steps(ref, hyp, np.asarray(owner, np.int64))])
                words += [ref[i] if s >= 0 else None for i, s in zip(found[-1][2].tolist(), found[-1][4].tolist())]
            codes, anchor, r, own, span = (np.concatenate([x[k] for x in found]) for k in range(5))
            of = pa.array(np.repeat(np.arange(part.num_rows), [len(x[0]) for x in found]))
            n_ref = part.column("reference").value_lengths().take(of)
            yield pa.RecordBatch.from_arrays(
                [part.column("rid").take(of), n_ref, pa.array(KINDS).take(pa.array(codes)), pa.array(anchor), places(r), places(own), places(span), pa.array(words, pa.string())],
                ["rid", "n_ref", "kind", "anchor", "ref", "owner", "span", "word"],
            )


class Scored:
    """What the reports on recordings read: `steps`, one row an operation, and `answers` and `recordings` with their words counted."""

    def __init__(self, recordings: DataFrame, answers: DataFrame, window_words: int = WINDOW_WORDS) -> None:
        self.window_words = window_words
        order = Window.partitionBy("rid").orderBy("source_start", "index")
        placed = answers.select("rid", "index", "source_start", "source_end", F.col("text").isNull().alias("failed"), T.tokens(F.col("text")).alias("words"), (F.row_number().over(order) - 1).alias("owner"))
        self.answers = held(placed, "answers")
        per = self.answers.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("owner", "words"))).alias("a"))
        known = recordings.select("rid", "duration_s", T.tokens(F.col("reference")).alias("reference"))
        none = F.array().cast("array<string>")
        joined = known.join(per, "rid", "left").select(
            "rid", "reference", F.coalesce(F.flatten(F.transform("a", lambda x: x["words"])), none).alias("hypothesis"),
            F.coalesce(F.flatten(F.transform("a", lambda x: F.array_repeat(x["owner"], F.size(x["words"])))), F.array().cast("array<int>")).alias("owners"),
        )
        self.recordings = known.select("rid", "duration_s", F.size("reference").cast("long").alias("ref_words"), "reference")
        rid = joined.select("rid").schema["rid"].dataType.simpleString()
        rows = joined.mapInArrow(each_step, f"rid {rid}, n_ref int, kind string, anchor int, ref int, owner int, span int, word string")
        last_window = F.greatest(F.ceil(F.col("n_ref") / window_words), F.lit(1)) - 1
        self.steps = held(rows.withColumn("window", F.least(F.floor(F.col("anchor") / window_words), last_window).cast("long")).drop("n_ref"), "steps")

    def windows(self) -> DataFrame:
        """(rid, window, ...): each window's words, edits, flags, the time span of the answers its words came from, loops in its reference, and whether the audio ended before it.

        A window is beyond the audio if it and all after it got no word, although the recording's last answer with words came near its end.
        """
        w = self.window_words
        last = F.greatest(F.ceil(F.col("ref_words") / w), F.lit(1)).cast("long") - 1
        every = self.recordings.select("rid", "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"), "reference")
        every = every.select("rid", "duration_s", "window", F.slice("reference", (F.col("window") * w + 1).cast("int"), w).alias("_words"))
        kind = lambda k: F.count_if(F.col("kind") == k)
        sums = self.steps.groupBy("rid", "window").agg(
            F.count("owner").alias("hyp_words"), kind("substitute").alias("substitutions"), kind("delete").alias("deletions"), kind("insert").alias("insertions"),
            F.min("owner").alias("_first"), F.max("owner").alias("_last"),
        )
        ends = self.answers.groupBy("rid").agg(F.max_by("source_end", F.when(F.size("words") > 0, F.col("owner"))).alias("_end"))
        heard = sums.groupBy("rid").agg(F.max(F.when(F.col("hyp_words") > 0, F.col("window"))).alias("_heard"))
        met = every.join(sums, ["rid", "window"], "left").join(ends, "rid", "left").join(heard, "rid", "left")
        start, end = self.answers.select("rid", F.col("owner").alias("_first"), "source_start"), self.answers.select("rid", F.col("owner").alias("_last"), "source_end")
        met = met.join(start, ["rid", "_first"], "left").join(end, ["rid", "_last"], "left")
        zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("hyp_words", "substitutions", "deletions", "insertions")}
        met = met.withColumns({**zero, "ref_words": F.size("_words").cast("long"), "ref_loops": F.size(loop_spans("_words")).cast("long")})
        errors, ratio = F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("hyp_words") / F.nullif(F.col("ref_words"), F.lit(0))
        reached = F.coalesce(F.coalesce("_end", F.lit(0.0)) >= F.col("duration_s") - END_SLACK_S, F.lit(False))
        return met.select(
            "rid", "window", "ref_words", "hyp_words", "substitutions", "deletions", "insertions", errors.alias("errors"), F.round(100.0 * errors / F.nullif(F.col("ref_words"), F.lit(0)), 2).alias("wer_pct"),
            F.round(ratio, 3).alias("len_ratio"), F.coalesce(ratio > WINDOW_RUNAWAY, F.lit(False)).alias("runaway"), F.coalesce(ratio < WINDOW_DROPOUT, F.lit(False)).alias("dropout"),
            F.round("source_start", 1).alias("t_start"), F.round("source_end", 1).alias("t_end"), "ref_loops", (reached & (F.col("window") > F.coalesce("_heard", F.lit(-1)))).alias("beyond_audio"),
        )

    def by_answer(self) -> DataFrame:
        """(rid, index, failed, ref_words, hyp_words, edits, runaway, loops): each answer against the reference words between the first and the last it was aligned to."""
        spans = self.steps.where("span IS NOT NULL").groupBy("rid", F.col("span").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref", "word"))), lambda x: x["word"]).alias("_ref"))
        met = self.answers.join(spans, ["rid", "owner"], "left").withColumn("_ref", F.coalesce("_ref", F.array().cast("array<string>")))
        return met.select(
            "rid", "index", "failed", F.size("_ref").cast("long").alias("ref_words"), F.size("words").cast("long").alias("hyp_words"), T.word_edits("_ref", "words").alias("edits"),
            (~F.col("failed") & (F.size("words") > ANSWER_RUNAWAY * F.size("_ref"))).alias("runaway"), loop_spans("words").alias("loops"),
        )

    def summary(self) -> DataFrame:
        """One row a recording: counts of words, edits, windows and answers, with the rates over all and over the audible windows."""
        w = self.windows()
        pct = lambda a, b, places=3: F.round(100.0 * a / F.nullif(b, F.lit(0)), places)
        heard = ~F.col("beyond_audio")
        sums = w.groupBy("rid").agg(
            *[F.sum(c).alias(c) for c in ("ref_words", "hyp_words", "substitutions", "deletions", "insertions", "errors")], F.sum("ref_loops").alias("ref_loop_count"),
            F.coalesce(F.sum(F.when(heard, F.col("ref_words"))), F.lit(0)).alias("ref_words_audible"), F.sum(F.when(heard, F.col("errors"))).alias("_heard"), F.count_if("beyond_audio").alias("windows_beyond_audio"),
            F.count_if("runaway").alias("runaway_windows"), F.count_if(F.col("dropout") & heard).alias("dropout_windows"), F.max("wer_pct").alias("worst_window_wer_pct"),
        )
        a = self.by_answer().groupBy("rid").agg(
            F.count("*").alias("answers"), F.count_if("failed").alias("failed_answers"), F.count_if(~F.col("failed") & (F.col("hyp_words") == 0)).alias("empty_answers"), F.sum(F.size("loops")).alias("loop_count"),
            F.count_if("runaway").alias("runaway_answers"), pct(F.sum(F.when(F.col("runaway"), F.col("edits")).otherwise(0)), F.sum(F.when(~F.col("failed"), F.col("edits")))).alias("runaway_edit_share_pct"),
        )
        met = sums.join(a, "rid", "left").fillna(0, ["answers", "failed_answers", "empty_answers", "loop_count", "runaway_answers"])
        return met.withColumns({
            "wer_pct": pct(F.col("errors"), F.col("ref_words")), "wer_pct_audible": pct(F.col("_heard"), F.col("ref_words_audible")), "insertion_rate_pct": pct(F.col("insertions"), F.col("ref_words")),
            "deletion_rate_pct": pct(F.col("deletions"), F.col("ref_words")), "hyp_over_ref": F.round(F.col("hyp_words") / F.nullif(F.col("ref_words"), F.lit(0)), 4),
        }).drop("_heard")


def window_units(windows: DataFrame, audible: bool = False) -> DataFrame:
    """(unit, num, den) of windows for an interval; with `audible` without those beyond the audio."""
    kept = windows.where(~F.col("beyond_audio")) if audible else windows
    return kept.select(F.concat_ws("/", "rid", "window").alias("unit"), "rid", "window", F.col("errors").cast("double").alias("num"), F.col("ref_words").cast("double").alias("den"))


def shared_units(a: DataFrame, b: DataFrame, audible: bool = False) -> DataFrame:
    """(unit, rid, window, num_a, den_a, num_b, den_b) of two runs' windows; with `audible` the ones that both heard.

    The runs must have the same windows, else the first unmatched one is an error.
    """
    rename = lambda w, side: w.select("rid", "window", *[F.col(c).alias(f"{c}_{side}") for c in ("errors", "ref_words", "beyond_audio")])
    both = rename(a, "a").join(rename(b, "b"), ["rid", "window"], "full_outer")
    refused = F.raise_error(F.concat(F.lit("window in one run only: "), F.concat_ws("/", "rid", "window"))).cast("double")
    complete = F.col("errors_a").isNotNull() & F.col("errors_b").isNotNull()
    rows = both.select(
        F.concat_ws("/", "rid", "window").alias("unit"), "rid", "window", F.when(complete, F.col("errors_a").cast("double")).otherwise(refused).alias("num_a"), F.col("ref_words_a").cast("double").alias("den_a"),
        F.col("errors_b").cast("double").alias("num_b"), F.col("ref_words_b").cast("double").alias("den_b"), (F.coalesce("beyond_audio_a", F.lit(False)) | F.coalesce("beyond_audio_b", F.lit(False))).alias("_beyond"),
    )
    return (rows.where(~F.col("_beyond")) if audible else rows).drop("_beyond")
