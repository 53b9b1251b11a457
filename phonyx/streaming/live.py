"""Live audio frames, live utterances and turn sessions as streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_idle_state(rows: DataFrame, key: str, fold: Callable, out: str, kept: str, mode: str, idle_ms: int) -> DataFrame:
    """applyInPandasWithState whose state goes once its key has had no row for `idle_ms`, by the time at which rows arrive."""
    timed = rows.withColumn("_at", F.current_timestamp()).withWatermark("_at", f"{idle_ms} milliseconds")

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(parts))
        yield from fold(name, own, state)
        state.setTimeoutTimestamp(int(own["_at"].max().timestamp() * 1000) + idle_ms)

    return timed.groupBy(key).applyInPandasWithState(run, out, kept, mode, GroupStateTimeout.EventTimeTimeout)


def cut_frames(chunks: DataFrame, frame: int, idle_ms: int = 600_000) -> DataFrame:
    """Frames of exactly `frame` samples from chunks (stream, seq, samples, last), in the order of seq, which counts from 0.

    What does not fill a frame waits as state, and so do chunks after a gap in
    seq until the gap is filled; a chunk that came before is dropped. The last
    chunk is filled up with zeros and ends the stream; chunks after it are an
    error of the sender and are dropped. State goes `idle_ms` after a stream's
    last chunk; a stream that stops without a last chunk, or in a gap, has
    failed by then, and what waited of it is dropped with its state.
    """

    def fold(key: tuple, own: pd.DataFrame, state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number, following, over, seqs, waiting, lasts = state.get if state.exists else ([], 0, 0, False, [], [], [])
        # State takes plain numbers only, not numpy's.
        rest = [int(x) for x in rest]
        held = {int(s): (list(w), bool(x)) for s, w, x in zip(seqs, waiting, lasts)}
        for seq, samples, last in zip(own["seq"], own["samples"], own["last"]):
            if not over and seq >= following:
                held.setdefault(int(seq), ([] if samples is None else samples, bool(last)))
        rows = []
        while not over and following in held:
            samples, last = held.pop(following)
            following += 1
            rest += [int(x) for x in samples]
            while len(rest) >= frame:
                rows.append((key[0], number, rest[:frame], number == 0, False, frame))
                rest, number = rest[frame:], number + 1
            if last:
                rows.append((key[0], number, rest + [0] * (frame - len(rest)), number == 0, True, len(rest)))
                rest, held, over = [], {}, True
        order = sorted(held)
        state.update((rest, number + over, following, over, order, [[int(x) for x in held[s][0]] for s in order], [held[s][1] for s in order]))
        yield pd.DataFrame(rows, columns=["stream", "frame", "samples", "is_first", "is_last", "length"])

    return with_idle_state(
        chunks, "stream", fold, "stream string, frame long, samples array<int>, is_first boolean, is_last boolean, length int",
        "rest array<int>, number long, following long, over boolean, seqs array<long>, waiting array<array<int>>, lasts array<boolean>", "append", idle_ms,
    )


def fold_utterances(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """One row for each utterance as events (utterance, kind, t, text) come: first send, first text, end of audio, done, error.

    Done or error ends an utterance; what comes later is dropped. State goes
    `idle_ms` after an utterance's last event.
    """
    place = {"send": 0, "text": 1, "audio_end": 2, "done": 3}

    def fold(key: tuple, own: pd.DataFrame, state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, None, None, None, "", None]
        ended = now[3] is not None or now[5] is not None
        own = own.sort_values("t", kind="stable")
        for kind, t, text in zip(own["kind"], own["t"], own["text"]):
            if ended:
                break
            at = place.get(kind)
            if at in (0, 1) and now[at] is None or at in (2, 3):
                now[at] = float(t)
            if kind in ("text", "done") and text:
                now[4] = text if kind == "done" else now[4] + text
            if kind == "error":
                now[5] = text or "error"
            ended = kind in ("done", "error")
        state.update(tuple(now))
        yield pd.DataFrame([(key[0], *now)], columns=["utterance", "t_first_send", "t_first_text", "t_audio_end", "t_done", "text", "error"])

    kinds = "t_first_send double, t_first_text double, t_audio_end double, t_done double, text string, error string"
    return with_idle_state(events, "utterance", fold, f"utterance string, {kinds}", kinds, "update", idle_ms)


def turn_sessions(spans: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Turns of a stream of spans (file, speaker, ts): sessions with the given gap, closed by a watermark."""
    return spans.withWatermark("ts", late).groupBy("file", "speaker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("spans")).select("file", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spans")


def sampled(gauges: DataFrame, every: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Mean and maximum of gauges (name, ts, value) over fixed intervals."""
    return gauges.withWatermark("ts", late).groupBy("name", F.window("ts", every).alias("w")).agg(F.avg("value").alias("mean"), F.max("value").alias("max")).select("name", F.col("w.start").alias("start"), "mean", "max")


def untranscribed(samples: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples without a successful prediction yet; failures stay for another try."""
    return samples.join(done.where("prediction IS NOT NULL AND error IS NULL").select(key).distinct(), key, "left_anti")
