"""Streaming operators, fed from files and run until all input is used."""

import numpy as np

from phonyx.streaming import live


def run(spark, rows, schema, transform, tmp_path, name, mode):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/{name}")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/{name}")
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_frames_are_cut_and_padded(spark, tmp_path):
    rows = [("s", 0, [1, 2, 3], False), ("s", 1, [4, 5], True), ("t", 0, [7], False)]
    out = run(spark, rows, "stream string, seq long, samples array<int>, last boolean", lambda s: live.cut_frames(s, 2), tmp_path, "frames", "append")
    got = sorted((r["stream"], r["frame"], tuple(np.array(r["samples"]).tolist()), r["is_first"], r["is_last"], r["length"]) for r in out)
    assert got == [("s", 0, (1, 2), True, False, 2), ("s", 1, (3, 4), False, False, 2), ("s", 2, (5, 0), False, True, 1)]


def test_utterances_are_folded(spark, tmp_path):
    rows = [("u", "send", 0.0, None), ("u", "text", 0.5, "ha"), ("u", "text", 0.7, "llo"), ("u", "audio_end", 1.0, None), ("u", "done", 1.2, "hallo")]
    out = run(spark, rows, "utterance string, kind string, t double, text string", live.fold_utterances, tmp_path, "utterances", "update")
    r = out[-1]
    assert (r["t_first_send"], r["t_first_text"], r["t_audio_end"], r["t_done"], r["text"], r["error"]) == (0.0, 0.5, 1.0, 1.2, "hallo", None)


def test_untranscribed(spark):
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    d = spark.createDataFrame([("a", "x", None), ("b", None, "timeout")], "sample_id string, prediction string, error string")
    assert sorted(r["sample_id"] for r in live.untranscribed(s, d).collect()) == ["b", "c"]
