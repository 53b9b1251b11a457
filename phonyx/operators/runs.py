"""Logs of runs: requests, capacity steps, throughput passes, drift, backfill, batches, loops and long recordings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.alignment import steps
from ..functions.rows import lists
from .scan import buckets_by_value, running, same

WINDOW_WORDS, LOOP_MAX_N, LOOP_MIN_REPS, LOOP_MIN_WORDS = 600, 10, 3, 12
PASS_FIELDS = ("started_at", "finished_at", "wall_s", "n_requests", "n_ok", "audio_s", "concurrency", "adapter", "hardware", "interrupted")


def answer_budget_s(audio_s: Column) -> Column:
    """Seconds a request may take: a minute and the audio's length, five minutes at most."""
    return F.least(F.lit(300.0), F.lit(60.0) + audio_s)


def endpoint_failure(status: Column, transport_error: Column) -> Column:
    """Whether a failed request speaks against the endpoint: transport errors and 5xx do, 4xx do not."""
    return F.coalesce(transport_error, F.lit(False)) | F.coalesce(status >= 500, F.lit(False))


def latencies(utterances: DataFrame) -> DataFrame:
    """Derived latencies of live utterances; null where an event is missing."""
    return utterances.withColumns({
        "ttfp_s": F.col("t_first_text") - F.col("t_first_send"), "final_s": F.col("t_done") - F.col("t_audio_end"),
        "first_text_after_speech_s": F.col("t_first_text") - F.col("t_first_send") - F.col("speech_onset_s"),
    })


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], places: int = 4) -> DataFrame:
    """(keys, names of `wanted`): percentiles of each key with linear interpolation, rounded.

    Values are counted first; the ones at the two ranks around each percentile
    are found in running counts over ranges of values, so no task holds a key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    upto = running(counted, keys, buckets_by_value(counted, value), [value], {"_upto": (F.sum, "_n")})
    met = upto.join(totals.withColumnsRenamed({k: f"_of_{k}" for k in keys}), same(keys, [f"_of_{k}" for k in keys]))
    at = lambda q: F.lit(q) * (F.col("_all") - 1)
    reach = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    ends = met.groupBy(*keys).agg(*[x for name, q in wanted.items() for x in (reach(F.floor(at(q))).alias(f"_lo_{name}"), reach(F.ceil(at(q))).alias(f"_hi_{name}"), F.first(at(q) - F.floor(at(q))).alias(f"_at_{name}"))])
    between = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_at_{name}")
    return ends.select(*keys, *[F.round(between(name), places).alias(name) for name in wanted])


def capacity(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From steps (keys, ord, n, within): the largest n before the first failed step, and what to do next."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = steps.withColumn("_ok", F.bool_and("within").over(w))
    first_failed = F.min(F.when(~F.col("within"), F.col("ord")))
    return marked.groupBy(*keys).agg(
        F.max_by("n", F.when(F.col("_ok"), F.col("ord"))).alias("max_n"),
        F.when(first_failed.isNull(), "continue").when(first_failed == F.max("ord"), "one_more").otherwise("stop").alias("next_action"),
    )


def failure_streaks(outcomes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Longest run of failures (`failed`) in order; a success starts the count anew."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = outcomes.withColumn("_run", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.count_if("failed").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_streak"))


def throughput(passes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll-up of passes: sums, real-time factor, the different settings, and why passes do not compare."""
    wall, audio, ok = F.round(F.sum("wall_s"), 3), F.round(F.sum("audio_s"), 3), F.sum("n_ok")
    out = passes.groupBy(*keys).agg(
        wall.alias("total_wall_s"), audio.alias("total_audio_s"), ok.alias("n_ok"), F.count("*").alias("passes"),
        F.array_sort(F.collect_set("concurrency")).alias("concurrency"), F.array_sort(F.collect_set("hardware")).alias("hardware"),
    )
    why = F.concat_ws(
        "; ",
        F.when(F.size("concurrency") > 1, F.concat(F.lit("passes ran at different concurrency ["), F.array_join(F.col("concurrency").cast("array<string>"), ", "), F.lit("]"))),
        F.when(F.size("hardware") > 1, F.concat(F.lit("passes ran on different hardware ['"), F.array_join("hardware", "', '"), F.lit("']"))),
    )
    rate = lambda x: F.when(F.col("total_wall_s") > 0, F.round(F.col(x) / F.col("total_wall_s"), 4))
    return out.withColumns({"rtfx": rate("total_audio_s"), "utterances_per_s": rate("n_ok"), "comparable_reason": F.nullif(why, F.lit(""))}).withColumn("comparable", F.col("comparable_reason").isNull())


def drift(committed: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of keys whose digest differs, or that only one side has."""
    a, b = committed.select(key, F.col(digest).alias("_a")), found.select(key, F.col(digest).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").withColumn("state", state).where("state IS NOT NULL").select(key, "state")


def backfill(committed: DataFrame, recomputed: DataFrame, keys: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """(keys, committed, recomputed, action): keep what agrees, add what is absent, and block every write on a conflict."""
    a = committed.select(*keys, F.col("value").alias("committed"), F.lit(True).alias("_had"))
    b = recomputed.select(*keys, F.col("value").alias("recomputed"))
    both = a.join(b, list(keys), "full_outer")
    action = F.when(F.col("_had").isNull(), "add").when(F.col("recomputed").isNull(), "keep").when(
        F.col("committed").eqNullSafe(F.col("recomputed")) | (F.abs(F.col("committed") - F.col("recomputed")) <= tolerance), "keep"
    ).otherwise("conflict")
    marked = both.withColumn("action", action).drop("_had")
    any_conflict = marked.agg(F.coalesce(F.bool_or(F.col("action") == "conflict"), F.lit(False)).alias("blocked"))  # one row
    return marked.join(F.broadcast(any_conflict))


def micro_batches(items: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], max_size: int, max_wait_s: float, bucket_s: float | None = None) -> DataFrame:
    """items with `batch`: a new one after a pause of over `max_wait_s`, and after every `max_size` items.

    With `bucket_s` a key's items are dealt by time, so many seconds to a task.
    """
    if bucket_s is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        opened = items.withColumn("_opens", F.coalesce((F.col(at) - F.lag(at).over(w) > max_wait_s).cast("int"), F.lit(1)))
        bursts = opened.withColumn("_burst", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_place", F.row_number().over(w) - 1)
    else:
        bucket = F.floor(F.col(at) / bucket_s)
        # The item before is the latest one: times do not fall along the order.
        last = running(items.withColumn("_one", F.lit(1)), keys, bucket, order, {"_last": (F.max, at), "_place": (F.sum, "_one")}, before=True)
        opened = last.withColumn("_opens", F.coalesce((F.col(at) - F.col("_last") > max_wait_s).cast("int"), F.lit(1)))
        bursts = running(opened, keys, bucket, order, {"_burst": (F.sum, "_opens")})
    # Places in a burst: from the place of its first item, a row for each burst.
    first = bursts.groupBy(*keys, "_burst").agg(F.min("_place").alias("_first")).withColumnsRenamed({k: f"_b_{k}" for k in (*keys, "_burst")})
    placed = bursts.join(first, same([*keys, "_burst"], [f"_b_{k}" for k in (*keys, "_burst")]))
    return placed.select(*[F.col(f"`{c}`") for c in items.columns], F.concat_ws("/", "_burst", F.floor((F.col("_place") - F.col("_first")) / max_size).cast("long")).alias("batch"))


def fit_through_origin(points: DataFrame, keys: Sequence[str], power: int = 1) -> DataFrame:
    """Least squares y = k * x^power without intercept, and the root mean square of what is left."""
    x = F.pow("x", F.lit(power))
    sums = points.groupBy(*keys).agg(F.sum(x * F.col("y")).alias("xy"), F.sum(x * x).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"))
    k = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    return sums.withColumn("k", k).withColumn("rms", F.sqrt(F.greatest(F.col("yy") - F.col("k") * F.col("xy"), F.lit(0.0)) / F.col("n"))).select(*keys, "k", "rms", "n")


def drop_tally(rows: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n): how many rows each reason drops, first match wins; 'yielded' are the rest."""
    case = F
    for name, condition in reasons:
        case = case.when(condition, F.lit(name))
    return rows.groupBy(case.otherwise("yielded").alias("reason")).agg(F.count("*").alias("n"))


def last_prediction(lines: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, prediction): the last line that has a prediction, by file and line."""
    return lines.where("prediction IS NOT NULL").groupBy(key).agg(F.max_by("prediction", F.struct("file", "line")).alias("prediction"))


def structs(**fields: str) -> ArrayType:
    kinds = {"int": IntegerType(), "string": StringType()}
    return ArrayType(StructType([StructField(k, kinds[v]) for k, v in fields.items()]))


@arrow_udf(structs(start="int", n="int", reps="int"))
def loop_spans(tokens: pa.Array) -> pa.Array:
    """Back-to-back repetitions in token arrays, from left to right, the shortest period first."""

    def spans(words) -> list[tuple[int, int, int]]:
        found, i, size = [], 0, len(words)
        while i < size:
            step = 1
            for n in range(1, min(LOOP_MAX_N, (size - i) // 2) + 1):
                # Positions in a row that equal the one a period later.
                run = 0
                while i + run + n < size and words[i + run] == words[i + run + n]:
                    run += 1
                reps = run // n + 1
                if reps >= LOOP_MIN_REPS and n * reps >= LOOP_MIN_WORDS:
                    found.append((i, n, reps))
                    step = n * reps
                    break
            i += step
        return found

    # Most texts have no loops, so the structs are few.
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "n", "reps")]))
    return pa.array([[dict(zip(("start", "n", "reps"), x)) for x in spans(w)] if w else [] for w in lists(tokens)], kind)


#: Kinds of operations, by their code.
KINDS = ("equal", "substitute", "delete", "insert")


def coded_steps(ref: list, hyp: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A least-cost alignment as four arrays: code of the kind, place in ref and in hyp (-1 for none), and anchor."""
    r, h = steps(ref, hyp)
    codes = np.where(r < 0, 3, np.where(h < 0, 2, 1))
    both = np.flatnonzero(codes == 1)
    codes[both] = [ref[i] != hyp[j] for i, j in zip(r[both].tolist(), h[both].tolist())]
    return codes, r, h, np.clip(np.cumsum(r >= 0) - (r >= 0), 0, max(len(ref) - 1, 0))


def places(at: np.ndarray) -> pa.Array:
    """Places as an Arrow column, null for -1."""
    return pa.array(at.astype(np.int32), mask=at < 0)


@arrow_udf(structs(kind="string", ref="int", hyp="int", anchor="int"))
def align(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Operations of a least-cost word alignment; on ties equal or substitute first, then delete, then insert.

    `anchor` is the reference word an operation belongs to: an insertion's is the next one, at the end the last.
    """
    found = [[x.astype(np.int32) for x in coded_steps(a or [], b or [])] for a, b in zip(lists(reference), lists(hypothesis))]
    ends = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
    codes, r, h, anchor = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in found)]) for k in range(4))
    ops = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(codes)), places(r), places(h), pa.array(anchor)], ["kind", "ref", "hyp", "anchor"])
    return pa.ListArray.from_arrays(pa.array(ends), ops)


def operations(ref: list, hyp: list) -> list[tuple[str, int | None, int | None, int]]:
    """What `align` returns for one pair."""
    return [(KINDS[c], None if i < 0 else i, None if j < 0 else j, a) for c, i, j, a in zip(*(x.tolist() for x in coded_steps(ref, hyp)))]


def reference_windows(recordings: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Edits by windows of reference words: recordings (rid, reference: tokens, hypothesis: tokens) aligned once each.

    An insertion belongs to the next reference word, at the end to the last one.
    """
    n_ref = F.size("reference")
    ops = recordings.select("rid", n_ref.alias("n_ref"), F.explode(align("reference", "hypothesis")).alias("op"))
    last_window = F.greatest(F.ceil(F.col("n_ref") / window_words).cast("long"), F.lit(1)) - 1
    placed = ops.withColumn("window", F.least(F.floor(F.col("op.anchor") / window_words), last_window))
    kind = lambda k: F.count_if(F.col("op.kind") == k)
    sums = placed.groupBy("rid", "window").agg(
        F.count("op.ref").alias("ref_words"), F.count("op.hyp").alias("hyp_words"), kind("substitute").alias("substitutions"), kind("delete").alias("deletions"), kind("insert").alias("insertions")
    )
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    ratio = F.col("hyp_words") / F.nullif(F.col("ref_words"), F.lit(0))
    return sums.withColumns({"errors": errors, "wer_pct": F.round(100.0 * errors / F.nullif(F.col("ref_words"), F.lit(0)), 2), "runaway": F.coalesce(ratio > 1.5, F.lit(False)), "dropout": F.coalesce(ratio < 0.5, F.lit(False))})


def foreign_insertions(inserted: DataFrame, leaked: DataFrame, track: str = "track") -> DataFrame:
    """Inserted words that a partner said, with multiplicity: per track and word the lesser of both counts."""
    a = inserted.groupBy(track, "word").agg(F.count("*").alias("n_ins"))
    b = leaked.groupBy(track, "word").agg(F.count("*").alias("n_leak"))
    return a.join(b, [track, "word"]).groupBy(track).agg(F.sum(F.least("n_ins", "n_leak")).alias("foreign"))
