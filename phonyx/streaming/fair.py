"""Frames of many live streams in rounds that serve the stream which has waited longest first.

A lane (one server's pipeline) is what state is kept for: its streams share one
order. A lane's streams are as many as one server steps, so a lane is one
task's; streams are dealt over lanes by whoever routes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "lane string, round long, stream string, samples array<int>, is_first boolean, is_last boolean, length int"
#: What a stream is known by: samples not sent, its ticket (0: it does not wait), whether it began, ended and failed, when it last spoke.
KNOWN = "samples array<int>, ticket long, begun boolean, ended boolean, failed boolean, seen long"


class FairFrames(StatefulProcessor):
    """One frame of each ready stream a round, at most `most` a round, oldest ticket first.

    A stream draws a ticket when it begins to wait, and a new one after each
    frame while it has samples left. It is ready with a whole frame, or ended
    with something to close: what is left, padded by zeros, or, where its
    samples ended on a frame's border, one zero sample. A failed stream's
    samples are dropped and so is what still comes of it, until it ends; a
    timer forgets streams that are silent for `idle_ms`.
    """

    def __init__(self, frame: int, most: int, idle_ms: int) -> None:
        self.frame, self.most, self.idle_ms = frame, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streams = handle.getMapState("streams", "stream string", KNOWN)
        self.counters = handle.getValueState("counters", "ticket long, round long")

    def _apply(self, live: dict, rows: pd.DataFrame, ticket: int, now: int) -> int:
        for stream, event, samples in zip(rows["stream"], rows["event"], rows["samples"]):
            own = live.setdefault(stream, {"samples": [], "ticket": 0, "begun": False, "ended": False, "failed": False})
            own["seen"] = now
            if own["failed"]:
                if event == "end":
                    del live[stream]
                continue
            if event == "failed":
                if own["ended"]:
                    del live[stream]
                else:
                    own.update(failed=True, samples=[], ticket=0)
                continue
            if own["ended"]:
                continue  # the sender's error: nothing comes after the end
            if event == "end":
                own["ended"] = True
            elif samples is not None:
                own["samples"] = own["samples"] + [int(x) for x in samples]
            if not own["ticket"] and (own["samples"] or own["ended"]):
                ticket += 1
                own["ticket"] = ticket
        return ticket

    def _rounds(self, lane: str, live: dict, ticket: int, number: int) -> tuple[list[tuple], int, int]:
        out = []
        while True:
            for stream in [s for s, x in live.items() if x["ended"] and not x["samples"] and not x["begun"]]:
                del live[stream]  # ended without a sample: nobody knows of it
            ready = sorted((x["ticket"], s) for s, x in live.items() if not x["failed"] and (len(x["samples"]) >= self.frame or x["ended"]))
            if not ready:
                return out, ticket, number
            for _, stream in ready[: self.most]:
                own = live[stream]
                now, own["samples"] = own["samples"][: self.frame], own["samples"][self.frame :]
                last = own["ended"] and not own["samples"]
                out.append((lane, number, stream, now + [0] * (self.frame - len(now)), not own["begun"], last, len(now) or 1))
                own["begun"] = True
                if last:
                    del live[stream]
                    continue
                ticket += bool(own["samples"] or own["ended"])
                own["ticket"] = ticket if own["samples"] or own["ended"] else 0
            number += 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        live = {k[0]: dict(zip(("samples", "ticket", "begun", "ended", "failed", "seen"), (list(v[0] or []), *v[1:]))) for k, v in self.streams.iterator()}
        before = set(live)
        ticket, number = self.counters.get() if self.counters.exists() else (0, 0)
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        ticket = self._apply(live, own, ticket, now)
        out, ticket, number = self._rounds(key[0], live, ticket, number)
        for stream in before - set(live):
            self.streams.removeKey((stream,))
        for stream, x in live.items():
            self.streams.updateValue((stream,), (x["samples"], x["ticket"], x["begun"], x["ended"], x["failed"], x["seen"]))
        self.counters.update((ticket, number))
        self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=["lane", "round", "stream", "samples", "is_first", "is_last", "length"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for k, v in list(self.streams.iterator()):
            if v[5] + self.idle_ms <= now:
                self.streams.removeKey(k)
        yield pd.DataFrame(columns=["lane", "round", "stream", "samples", "is_first", "is_last", "length"])

    def close(self) -> None:
        pass


def fair_frames(chunks: DataFrame, frame: int, most: int, idle_ms: int = 600_000) -> DataFrame:
    """Frames (lane, round, stream, samples, is_first, is_last, length) of chunks (lane, stream, seq, event, samples).

    `event` is audio, end or failed; `seq` orders a lane's chunks of a micro-batch. Needs the RocksDB state store.
    """
    return chunks.groupBy("lane").transformWithStateInPandas(statefulProcessor=FairFrames(frame, most, idle_ms), outputStructType=ROWS, outputMode="Append", timeMode="ProcessingTime")
