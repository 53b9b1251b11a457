"""Islands are counted and packed in order: no pair of island and stretch is a row, no track's islands are one list."""

import numpy as np
import pytest

from phonyx.operators import arms


def test_counts_without_pairs(spark):
    r = np.random.default_rng(3)
    n = {"a": 90_000, "b": 20_000, "c": 40}
    islands = []
    for track, size in n.items():
        for threshold in (0.2, 0.6):
            cuts = np.sort(r.choice(size, 2 * min(20, size // 8), replace=False)).tolist()
            islands += [("x", threshold, track, f, l) for f, l in zip(cuts[::2], cuts[1::2])]
    labels = [(t, k, float(s), float(s + w)) for t in "ab" for k in ("target", "crosstalk") for s, w in zip(r.uniform(0, n[t] / 100, 12), r.uniform(0, 60, 12))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        counts = arms.track_counts(
            frame(islands, "arm string, threshold double, track string, first long, last long"), frame(labels, "track string, kind string, start double, end double"),
            frame(list(n.items()), "track string, n long"), frame([("x", 0.2, 0.1), ("x", 0.6, 0.5), ("y", 0.6, 0.5)], "arm string, threshold double, off double"),
        )
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "collect_list(struct(first" not in plan
        got = {(x["arm"], x["threshold"], x["track"]): x for x in counts.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(got) == {(*s, t) for s in (("x", 0.2), ("x", 0.6), ("y", 0.6)) for t in n}
    for (arm, threshold, track), x in got.items():
        own = [i[3:] for i in islands if i[:3] == (arm, threshold, track)]
        sent, kinds, blocks, filled = np.zeros(n[track], bool), {k: np.zeros(n[track], bool) for k in ("target", "crosstalk")}, 0, 0.0
        for f, l in own:
            sent[f : l + 1] = True
            length = (l - f + 1) * 0.01
            if filled + length > 30:
                parts = max(1, int(np.ceil(length / 30)))
                blocks, filled = blocks + parts, length - 30 * (parts - 1)
            else:
                blocks, filled = blocks + (filled == 0), filled + length
        for t, kind, s, e in labels:
            if t == track:
                kinds[kind] |= (np.arange(n[track]) + 0.5 >= s * 100 - 1e-9) & (np.arange(n[track]) + 0.5 < e * 100 - 1e-9)
        only = kinds["crosstalk"] & ~kinds["target"]
        want = {"sent_s": sent, "missed_s": kinds["target"] & ~sent, "false_alarm_s": sent & ~kinds["target"], "crosstalk_sent_s": sent & only}
        assert {k: x[k] for k in want} == {k: pytest.approx(m.sum() / 100) for k, m in want.items()}
        assert x["blocks"] == blocks
