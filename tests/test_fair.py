"""Fair rounds over live streams."""

import os
import time

from phonyx.streaming import fair

FORM = "lane string, stream string, seq long, event string, samples array<int>"


def play(spark, tmp_path, batches, name, idle_ms=600_000, pause=0.0, trigger=None):
    folder = tmp_path / name
    folder.mkdir()
    for k, rows in enumerate(batches):
        part = tmp_path / f"{name}-{k}"
        spark.createDataFrame(rows, FORM).coalesce(1).write.json(str(part))
        (file,) = part.glob("*.json")
        file.rename(folder / f"{k}.json")
        os.utime(folder / f"{k}.json", (time.time() - 100 + k, time.time() - 100 + k))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).json(str(folder))
        q = fair.fair_frames(stream, 2, 2, idle_ms).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.unset(store)
    return sorted((r["lane"], r["round"], r["stream"], list(r["samples"]), r["is_first"], r["is_last"], r["length"]) for r in spark.table(name).collect())


def test_oldest_waiting_first_and_so_many_a_round(spark, tmp_path):
    first = [("l", "a", 1, "audio", [1, 1, 1, 1, 1]), ("l", "b", 2, "audio", [2, 2, 2, 2]), ("l", "c", 3, "audio", [3, 3]), ("l", "d", 4, "audio", [4]), ("m", "z", 1, "audio", [9, 9])]
    second = [("l", "d", 5, "audio", [4]), ("l", "a", 6, "end", None), ("l", "b", 7, "end", None), ("l", "c", 8, "failed", None), ("l", "c", 9, "audio", [3, 3, 3]), ("l", "c", 10, "end", None), ("l", "e", 11, "end", None), ("m", "z", 2, "end", None)]
    got = play(spark, tmp_path, [first, second], "rounds")
    lane = [x[1:] for x in got if x[0] == "l"]
    # Two frames a round: a and b, then c (it has waited since before a's second turn) and a, then b.
    assert [(r, s) for r, s, *_ in lane] == [(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "b"), (3, "a"), (3, "d"), (4, "b")]
    assert lane[5] == (3, "a", [1, 0], False, True, 1)
    # b's samples ended on a border: it closes with one zero sample. c failed, e never spoke.
    assert lane[7] == (4, "b", [0, 0], False, True, 1)
    assert [x[1:] for x in got if x[0] == "m"] == [(0, "z", [9, 9], True, False, 2), (1, "z", [0, 0], False, True, 1)]


class Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        self.pop(k, None)


def test_a_timer_forgets_silent_streams():
    p = fair.FairFrames(2, 2, 1000)
    p.streams = Map({("old",): ([1], 1, True, False, False, 0), ("failed",): ([], 0, True, False, True, 100), ("new",): ([1], 2, True, False, False, 900)})
    list(p.handleExpiredTimer(("l",), Timers(1200), None))
    assert set(p.streams) == {("new",)}
