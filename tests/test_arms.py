"""Detector arms against frame by frame counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonyx.operators import arms


def plain_islands(score, on, off):
    active, out = False, []
    for k, s in enumerate(score):
        was, active = active, True if s >= on else False if s < off else active
        if active and not was:
            out.append([k, k])
        elif active:
            out[-1][1] = k
    return out


def plain_blocks(lengths, most=30.0):
    blocks, filled = 0, 0.0
    for x in lengths:
        if filled + x > most:
            parts = max(1, int(np.ceil(x / most)))
            blocks, filled = blocks + parts, x - most * (parts - 1)
        else:
            blocks, filled = blocks + (filled == 0), filled + x
    return blocks


@pytest.mark.parametrize("bucket", [7, 6000])
def test_sweep_counts_frames(spark, monkeypatch, bucket):
    monkeypatch.setattr(arms, "BUCKET", bucket)
    r = np.random.default_rng(11)
    sizes, sweep = {"a": 400, "b": 90, "c": 5, "d": 60}, [("x", 0.3, 0.2), ("x", 0.5, 0.35), ("x", 0.9, 0.1), ("y", 0.5, 0.5), ("y", 2.0, 1.0)]
    score = {(arm, t): np.round(np.convolve(r.random(n + 4), np.ones(5) / 5, "valid"), 2) if t != "d" else np.zeros(n) for arm in "xy" for t, n in sizes.items()}
    labels = [(t, k, float(s), float(s + w)) for t in "abc" for k in ("target", "crosstalk") for s, w in zip(r.uniform(-0.1, sizes[t] / 100, 9), r.uniform(0, 0.4, 9))]
    scores = spark.createDataFrame([(a, t, k, float(v)) for (a, t), vs in score.items() for k, v in enumerate(vs)], "arm string, track string, frame long, score double").repartition(3)
    tracks = spark.createDataFrame(list(sizes.items()), "track string, n long")
    thresholds = spark.createDataFrame(sweep, "arm string, threshold double, off double")
    islands = arms.sweep(scores, thresholds, tracks)
    got = {}
    for x in islands.orderBy("first").collect():
        got.setdefault((x["arm"], x["threshold"], x["track"]), []).append([x["first"], x["last"]])
    want = {(a, on, t): plain_islands(score[a, t], on, off) for a, on, off in sweep for t in sizes}
    assert got == {k: v for k, v in want.items() if v}
    counts = {(x["arm"], x["threshold"], x["track"]): x for x in arms.track_counts(islands, spark.createDataFrame(labels, "track string, kind string, start double, end double"), tracks, thresholds).collect()}
    assert set(counts) == set(want)
    for (a, on, t), own in want.items():
        n = sizes[t]
        mask = {k: np.zeros(n, bool) for k in ("sent", "target", "crosstalk")}
        for f, l in own:
            mask["sent"][f : l + 1] = True
        for track, kind, s, e in labels:
            if track == t:
                mask[kind] |= (np.arange(n) + 0.5 >= s * 100 - 1e-9) & (np.arange(n) + 0.5 < e * 100 - 1e-9)
        x, sent, target, xt = counts[a, on, t], mask["sent"], mask["target"], mask["crosstalk"] & ~mask["target"]
        for name, m in (("duration_s", sent | ~sent), ("speech_s", target), ("missed_s", target & ~sent), ("nonspeech_s", ~target), ("false_alarm_s", ~target & sent), ("sent_s", sent), ("crosstalk_s", xt), ("crosstalk_sent_s", xt & sent)):
            assert x[name] == pytest.approx(m.sum() / 100), (a, on, t, name)
        assert x["blocks"] == plain_blocks([(l - f + 1) / 100 for f, l in own])


def test_blocks_of_islands(spark):
    for lengths in ([], [5.0], [20.0, 10.0, 0.5], [29.0, 2.0, 29.0], [95.0, 3.0], [10.0] * 10, [61.0, 28.0, 2.0]):
        assert spark.createDataFrame([(lengths,)], "x array<double>").select(arms.blocks_of(F.col("x")).alias("n")).first()["n"] == plain_blocks(lengths)


def test_arms_at_equal_false_alarm(spark):
    curve = [("x", 0.3, 5.0, 20.0), ("x", 0.5, 9.0, 8.0), ("x", 0.7, 30.0, 1.0), ("y", 0.2, 4.0, 9.0), ("y", 0.4, 7.0, 8.0), ("y", 0.6, 7.0, 4.0), ("z", 0.5, 1.0, 50.0)]
    rows = spark.createDataFrame([(*c, 0.0, 0.0, 0.0, 0.0, 0.0) for c in curve], "arm string, threshold double, missed_pct double, false_alarm_rate_pct double, false_alarm_s_per_h double, crosstalk_sent_pct double, sent_share_pct double, dense_track_share_pct double, blocks_per_audio_h double")
    got = {(x["arm"], x["pick"]): x["threshold"] for x in arms.compared(rows, spark.createDataFrame([("x", 0.5), ("y", 0.4)], "arm string, threshold double"), "x", [5.0]).collect()}
    assert got == {("x", "at_reference_fa"): 0.5, ("y", "at_reference_fa"): 0.6, ("x", "at_fa_5pct"): 0.7, ("y", "at_fa_5pct"): 0.6}
    runs = spark.createDataFrame([("x", "a", 3600.0, 10.0), ("x", "b", 1800.0, 5.0), ("y", "a", 3600.0, None)], "arm string, track string, duration_s double, cpu_s double")
    assert {x["arm"]: x["cpu_s_per_audio_h"] for x in arms.cost(runs).collect()} == {"x": 10.0, "y": None}
