"""Live sessions coupled with a batch model: speech is cut a pause after it ends, and the batch answer to the same audio is joined to the live one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.runs import exact_percentiles
from ..operators.scan import same

# The pause that ends an utterance, and how loudness decides where speech ends (frames of 20 ms, 30 dB below the loudest, -50 dB at least).
PAUSE_S, FRAME_S, BELOW_DB, FLOOR_DB = 0.7, 0.02, 30.0, -50.0


def speech_end_s(samples: Column, rate: int) -> Column:
    """Where the last loud frame of 16-bit samples ends; the whole length where no frame is loud."""
    size = int(FRAME_S * rate)
    frames = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(samples) / size) - 1, F.lit(0)).cast("int")), lambda k: F.slice(samples, k * size + 1, F.lit(size)))
    power = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v / 32768.0) * (v / 32768.0)) / F.greatest(F.size(x), F.lit(1))
    level = F.transform(frames, lambda x: 10.0 * F.log10(F.greatest(power(x), F.lit(1e-12))))
    cut = F.greatest(F.array_max(level) - BELOW_DB, F.lit(FLOOR_DB))
    loud = F.filter(F.transform(level, lambda v, k: F.when(v > cut, k + 1)), lambda k: k.isNotNull())
    return F.when((F.size(samples) >= size) & (F.size(loud) > 0), F.array_max(loud) * FRAME_S).otherwise(F.size(samples) / rate)


def endpointed(utterances: DataFrame, rate: int = 16_000, pause_s: float = PAUSE_S) -> DataFrame:
    """utterances (samples: array of 16-bit numbers, ...) whose samples end `pause_s` after speech does, cut or filled up with zeros, with `speech_end_s` and `duration_s`."""
    ended = utterances.withColumn("speech_end_s", speech_end_s(F.col("samples"), rate))
    n = F.round((F.col("speech_end_s") + pause_s) * rate).cast("int")
    filled = F.concat(F.slice("samples", F.lit(1), n), F.array_repeat(F.lit(0).cast("int"), F.greatest(n - F.size("samples"), F.lit(0))))
    return ended.withColumn("samples", filled).withColumn("duration_s", F.size("samples") / rate)


def couple(live: DataFrame, finals: DataFrame, late: str = "30 seconds", apart: str = "2 minutes") -> DataFrame:
    """Each live answer with the batch answer to the same utterance, with both latencies after speech and the edits between the texts.

    live: (session, idx, at, t_speech_end, t_done, text, error), finals: (session, idx, final_at, t_final_done, status, final_text); `at` and
    `final_at` are event times. On streams both sides wait for each other: rows more than `late` behind their side's newest are dropped, and
    state goes once no partner within `apart` can come any more. On tables it is the same join.
    """
    a = live.withWatermark("at", late)
    b = finals.select(F.col("session").alias("_session"), F.col("idx").alias("_idx"), "final_at", "t_final_done", "status", "final_text").withWatermark("final_at", late)
    near = F.col("final_at").between(F.col("at") - F.expr(f"INTERVAL {apart}"), F.col("at") + F.expr(f"INTERVAL {apart}"))
    both = a.join(b, (F.col("session") == F.col("_session")) & (F.col("idx") == F.col("_idx")) & near)
    live_words, final_words = T.tokens(F.col("text")), T.tokens(F.col("final_text"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return both.select(
        "session", "idx", "at", "final_at", (F.col("t_done") - F.col("t_speech_end")).alias("stream_after_s"), (F.col("t_final_done") - F.col("t_speech_end")).alias("final_after_s"),
        (F.col("error").isNull() & ~blank(F.col("text"))).alias("stream_ok"), ((F.col("status") == "ok") & ~blank(F.col("final_text"))).alias("final_ok"),
        T.word_edits(final_words, live_words).alias("edits"), F.size(final_words).cast("long").alias("final_words"),
    )


def coupled_summary(pairs: DataFrame, keys: Sequence[str], threshold_s: float = 1.0) -> DataFrame:
    """One row a key: latencies of both sides after speech, failures, the live text's error rate against the batch text, and whether the key holds the rule.

    It does if the batch answers' p95 is within the threshold and no answer of either side failed or was empty.
    """
    both = F.col("stream_ok") & F.col("final_ok")
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("utterances"), F.count_if(~F.col("stream_ok")).alias("stream_empty"), F.count_if(~F.col("final_ok")).alias("final_errors"),
        F.round(100.0 * F.sum(F.when(both, F.col("edits"))) / F.nullif(F.sum(F.when(both, F.col("final_words"))), F.lit(0)), 3).alias("stream_vs_final_wer_pct"),
    )
    out = sums
    for side in ("stream", "final"):
        at = exact_percentiles(pairs.where(F.col(f"{side}_ok")), keys, f"{side}_after_s", {f"{side}_p{q}": q / 100 for q in (50, 95, 99)}, places=6).withColumnsRenamed({k: f"_{side}_{k}" for k in keys})
        out = out.join(at, same(keys, [f"_{side}_{k}" for k in keys]), "left").drop(*[f"_{side}_{k}" for k in keys])
    rule = F.coalesce(F.col("final_p95") <= threshold_s, F.lit(False)) & (F.col("final_errors") == 0) & (F.col("stream_empty") == 0)
    return out.withColumn("within_threshold", rule)
