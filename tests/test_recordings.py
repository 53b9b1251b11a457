"""Long recordings against a plain reading of the same rules; samples dealt over tasks."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phonyx.functions.alignment import steps
from phonyx.functions.text import edit_distance
from phonyx.operators import recordings, resampling


def plain_steps(ref, hyp):
    n, m = len(ref), len(hyp)
    cost = np.zeros((n + 1, m + 1), int)
    cost[:, 0], cost[0] = range(n + 1), range(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    i, j, out = n, m, []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def test_alignment_equals_the_table():
    r = np.random.default_rng(4)
    for k in range(150):
        ref = r.integers(0, (2, 5, 40)[k % 3], r.integers(0, 70)).tolist()
        hyp = [x if r.random() < 0.8 else 99 for x in ref if r.random() < 0.8] if k % 2 else r.integers(0, 5, r.integers(0, 70)).tolist()
        assert list(zip(*(x.tolist() for x in steps(ref, hyp)))) == plain_steps(ref, hyp)


def test_alignment_of_a_thousand_words_equals_the_table():
    r = np.random.default_rng(5)
    ref = [f"w{x}" for x in r.zipf(1.4, 1000)]
    hyp = [x if r.random() < 0.85 else "other" for x in ref for _ in range(r.integers(0, 3) if r.random() < 0.1 else 1)]
    assert list(zip(*(x.tolist() for x in steps(ref, hyp)))) == plain_steps(ref, hyp)


def test_hundred_thousand_words_in_little_memory():
    code = """
import random, resource
from phonyx.functions.alignment import steps
r = random.Random(1)
ref = [f"w{int(r.paretovariate(0.7)) % 30000}" for _ in range(100_000)]
hyp = [x if r.random() < 0.85 else "other" for x in ref if r.random() < 0.95]
assert len(steps(ref, hyp)[0]) >= 100_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], timeout=600, check=True)
    assert int(out.stdout) < 500


def plain_score(reference, answers, duration, size):
    """The rules of windows and answers, read word by word."""
    answers = sorted(answers, key=lambda a: (a[1], a[0]))
    ref = reference.split()
    hyp, owner = [], []
    for k, a in enumerate(answers):
        hyp += (a[3] or "").split()
        owner += [k] * len((a[3] or "").split())
    ops, n_win = plain_steps(ref, hyp), max(1, -(-len(ref) // size))
    win = [{"ref_words": 0, "hyp_words": 0, "substitutions": 0, "deletions": 0, "insertions": 0, "answers": set()} for _ in range(n_win)]
    nxt = max(len(ref) - 1, 0)
    for i, j in reversed(ops):
        nxt = i if i >= 0 else nxt
        w = win[min(nxt // size, n_win - 1)]
        w["ref_words"] += i >= 0
        w["hyp_words"] += j >= 0
        kind = "insertions" if i < 0 else "deletions" if j < 0 else "substitutions" if ref[i] != hyp[j] else None
        if kind:
            w[kind] += 1
        if j >= 0:
            w["answers"].add(owner[j])
    spoken = [a for a in answers if (a[3] or "").split()]
    reached = duration is not None and (spoken[-1][2] if spoken else 0.0) >= duration - 120
    heard = max((k for k, w in enumerate(win) if w["hyp_words"]), default=-1)
    rows = [(k, w["ref_words"], w["hyp_words"], w["substitutions"], w["deletions"], w["insertions"], answers[min(w["answers"])][1] if w["answers"] else None, answers[max(w["answers"])][2] if w["answers"] else None, reached and k > heard) for k, w in enumerate(win)]
    per = []
    for k, a in enumerate(answers):
        met = [i for i, j in ops if i >= 0 and j >= 0 and owner[j] == k]
        own, words = ref[met[0] : met[-1] + 1] if met else [], (a[3] or "").split()
        per.append((a[0], len(own), len(words), edit_distance(own, words), a[3] is not None and len(words) > 3 * len(own)))
    return rows, sorted(per)


def test_recordings_against_a_plain_reading(spark):
    r = np.random.default_rng(9)
    recs, answers, want = [], [], {}
    for rid in range(8):
        ref = [f"w{x}" for x in r.integers(0, 30 if rid < 4 else 300, [0, 1, 20, 35, 120, 120, 80, 130][rid])]
        own, at = [], 0
        for k in range(6):
            part = ref[at : at + 9]
            at += 9
            said = [x if r.random() < 0.7 else "zz" for x in part if r.random() < 0.8] * (5 if k == 2 and rid not in (5, 7) else 1) + (["noise"] * 3 if r.random() < 0.3 and rid not in (5, 7) else [])
            own.append((k, float([1, 2, 2, 3, 4, 5][k]) * 100, float([1, 2, 2, 3, 4, 5][k]) * 100 + 90, None if k == rid % 6 else " ".join(said)))
        own = [] if rid == 3 else own
        duration = None if rid == 4 else 600.0 if rid % 2 else 2000.0
        recs.append((rid, " ".join(ref), duration))
        answers += [(rid, *a) for a in own]
        want[rid] = plain_score(" ".join(ref), own, duration, 10)
    s = recordings.Scored(spark.createDataFrame(recs, "rid long, reference string, duration_s double"), spark.createDataFrame(answers, "rid long, index long, source_start double, source_end double, text string"), 10)
    got = {}
    for x in s.windows().orderBy("rid", "window").collect():
        got.setdefault(x["rid"], []).append((x["window"], x["ref_words"], x["hyp_words"], x["substitutions"], x["deletions"], x["insertions"], x["t_start"], x["t_end"], x["beyond_audio"]))
        assert x["errors"] == x["substitutions"] + x["deletions"] + x["insertions"]
        assert x["runaway"] == bool(x["ref_words"] and x["hyp_words"] / x["ref_words"] > 1.5) and x["dropout"] == bool(x["ref_words"] and x["hyp_words"] / x["ref_words"] < 0.5)
    assert got == {k: v[0] for k, v in want.items()} and any(w[-1] for v in got.values() for w in v)
    per = {}
    for x in s.by_answer().collect():
        per.setdefault(x["rid"], []).append((x["index"], x["ref_words"], x["hyp_words"], x["edits"], x["runaway"]))
    assert {k: sorted(v) for k, v in per.items()} == {k: v[1] for k, v in want.items() if v[1]}
    for x in s.summary().collect():
        rows, own = want[x["rid"]]
        audible = [w for w in rows if not w[-1]]
        assert (x["errors"], x["windows_beyond_audio"], x["ref_words_audible"]) == (sum(sum(w[3:6]) for w in rows), len(rows) - len(audible), sum(w[1] for w in audible))
        assert x["answers"] == len(own) and x["runaway_answers"] == sum(a[4] for a in own)
        heard = sum(w[1] for w in audible)
        assert x["wer_pct_audible"] == (round(100 * sum(sum(w[3:6]) for w in audible) / heard, 3) if heard else None)


def test_windows_of_two_runs(spark):
    cols = "rid long, window long, errors long, ref_words long, beyond_audio boolean"
    a = spark.createDataFrame([(1, 0, 2, 10, False), (1, 1, 3, 10, False), (1, 2, 10, 10, True)], cols)
    b = spark.createDataFrame([(1, 0, 1, 10, False), (1, 1, 9, 10, True), (1, 2, 10, 10, True)], cols)
    assert [x["unit"] for x in recordings.shared_units(a, b).orderBy("unit").collect()] == ["1/0", "1/1", "1/2"]
    assert [x["unit"] for x in recordings.shared_units(a, b, audible=True).collect()] == ["1/0"]
    assert recordings.window_units(a, audible=True).agg(F.sum("num")).first()[0] == 5.0
    with pytest.raises(Exception, match="window in one run only: 1/2"):
        recordings.shared_units(a, b.where("window < 2")).collect()


def test_shares_of_a_group_draw_what_one_task_draws(spark):
    r = np.random.default_rng(2)
    rows = [(g, i, float(r.random()), float(r.random() + 1)) for g, n in (("a", 37), ("b", 1), (None, 64)) for i in range(n)]
    units = spark.createDataFrame(rows, "run string, i long, num double, den double").repartition(5)
    one = {x["run"]: x for x in resampling.ratio_interval(units, ["run"], "i", 300).collect()}
    for draws in (1, 40, 700):
        assert {x["run"]: x for x in resampling.ratio_interval(units, ["run"], "i", 300, draws_a_task=draws).collect()} == one
    frame = pd.DataFrame(rows, columns=["run", "i", "num", "den"])
    for g, x in one.items():
        v = frame[frame["run"].isna() if g is None else frame["run"] == g][["num", "den"]].to_numpy()
        sums = resampling.resampled_sums(v, 300, resampling.SEED)
        assert (x["lo"], x["hi"]) == resampling.percentiles(100 * sums[:, 0] / sums[:, 1], 0.95)


def test_places_of_the_generator():
    want = resampling.index_draws(1000, 5000, 3)
    for cut, place in zip((0, 1, 999, 4000), resampling.places(1000, (0, 1, 999, 4000), 3, chunk=700)):
        assert next(resampling.draw_slabs(1000, [900], 3, place)).tolist() == want[cut : cut + 900].tolist()
