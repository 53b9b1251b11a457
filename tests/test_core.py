"""Hand-computed values of the analytics operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonyx.functions import text as T
from phonyx.operators import frames, intervals, metrics, resampling, runs
from phonyx.sources import files

SEGMENT = "file string, side string, ord long, start double, end double, speaker string"


def der(spark, ref, hyp, collar=0.0, skip=False):
    rows = [("f", "ref", i, float(a), float(b), s) for i, (a, b, s) in enumerate(ref)] + [("f", "hyp", i, float(a), float(b), s) for i, (a, b, s) in enumerate(hyp)]
    return intervals.corpus_der(intervals.diarization_seconds(spark.createDataFrame(rows, SEGMENT), collar, skip)).first()


@pytest.mark.parametrize(
    "ref,hyp,want",
    [
        ([(0, 10, "A")], [(0, 8, "A")], 0.2),
        ([(0, 10, "A"), (10, 20, "B")], [(0, 20, "Z")], 0.5),
        ([(0, 10, "A")], [(0, 10, "A"), (10, 15, "B")], 0.5),
        ([(0, 10, "A"), (10, 10, "B")], [(0, 10, "X")], 0.0),
    ],
)
def test_diarization_error(spark, ref, hyp, want):
    assert der(spark, ref, hyp)["der"] == pytest.approx(want)


def test_collar_leaves_out_edges(spark):
    assert der(spark, [(0, 10, "A")], [(0.1, 9.9, "A")], 0.25)["der"] == pytest.approx(0.0)


def test_corpus_is_not_the_mean(spark):
    rows = [("a", "ref", 0, 0.0, 10.0, "A"), ("a", "ref", 1, 10.0, 20.0, "B"), ("a", "hyp", 0, 0.0, 20.0, "Z"), ("b", "ref", 0, 0.0, 10.0, "A"), ("b", "hyp", 0, 0.0, 8.0, "A")]
    out = intervals.corpus_der(intervals.diarization_seconds(spark.createDataFrame(rows, SEGMENT))).first()
    assert out["der"] == pytest.approx(0.4) and out["file_mean_der"] == pytest.approx(0.35)


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(30):
        m = r.random((int(r.integers(1, 5)), int(r.integers(1, 5))))
        small, large = sorted(m.shape)
        w = m if m.shape[0] <= m.shape[1] else m.T
        best = max(sum(w[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(m[a, b] for a, b in intervals.best_assignment(m)) == pytest.approx(best)


def test_missing_hypothesis_is_refused(spark):
    gold = spark.createDataFrame([("a", 0, 0.0, 1.0, "A")], "file string, ord long, start double, end double, speaker string")
    with pytest.raises(Exception, match="no hypothesis for a"):
        intervals.paired_segments(gold, gold.where("file = 'x'")).collect()


def test_folding_and_overlap(spark):
    s = spark.createDataFrame([("f", "A", 0.0, 0.4), ("f", "A", 0.6, 1.0), ("f", "A", 3.0, 5.0), ("f", "B", 6.0, 11.0)], "file string, speaker string, start double, end double")
    got = sorted(map(tuple, intervals.fold_turns(s, ["file", "speaker"]).collect()))
    assert got == [("f", "A", 0.0, 1.0), ("f", "A", 3.0, 5.0), ("f", "B", 6.0, 11.0)]
    o = spark.createDataFrame([("f", 0.0, 10.0), ("f", 8.0, 18.0)], "file string, start double, end double")
    row = intervals.overlap_stats(o, ["file"]).first()
    assert (row["overlap_s"], row["speech_s"], row["speaker_time_s"]) == (2.0, 18.0, 20.0)


def test_text(spark):
    row = spark.range(1).select(
        T.canonical(F.lit("Müller, Straße!")).alias("n"), T.entities(F.lit("1.234 und 3,5 um 10:30")).alias("e"),
        T.bag_overlap(F.array(F.lit("3"), F.lit("3"), F.lit("9")), F.array(F.lit("3"), F.lit("9"))).alias("b"),
        T.word_edits(F.split(F.lit("wir gehen heute"), " "), F.split(F.lit("wir gehen"), " ")).alias("w"), T.tokens(F.lit(None).cast("string")).alias("t"),
        T.strict(F.lit("[Sprecher 1] Ähm, das Haus.")).alias("s"),
    ).first()
    assert row["n"] == "Müller Strasse" and row["e"] == ["1234", "3,5", "10:30"] and row["b"] == 2 and row["w"] == 1 and row["t"] == [] and row["s"] == "das haus"


def test_bleu_of_equal_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id long, reference string, prediction string")
    counts = metrics.bleu_counts(rows, T.words(F.col("reference")), T.words(F.col("prediction")))
    assert metrics.corpus_bleu(counts).first()["bleu"] == pytest.approx(100.0)


def test_runaway_is_strict(spark):
    units = spark.createDataFrame([(2, 6, 4), (2, 7, 5)], "ref_words long, hyp_words long, edits long")
    assert metrics.runaways(units).first()["n_runaway"] == 1


def test_leak_names_its_source(spark):
    a, b = "eins zwei drei vier fünf sechs", "sieben acht neun zehn elf zwölf"
    rows = spark.createDataFrame([(0, a, f"{a} {b}"), (1, b, b)], "id long, reference string, prediction string")
    assert [tuple(r) for r in metrics.cross_leaks(rows).collect()] == [(0, 1)]


def test_failed_request_is_refused(spark):
    rows = spark.createDataFrame([(0, "a", None, "timeout")], "id long, reference string, prediction string, error string")
    with pytest.raises(Exception, match="failed request: 0"):
        metrics.checked(rows).collect()


def test_bootstrap_repeats_and_covers(spark):
    units = spark.createDataFrame([("r", i, float(i % 3), 2.0) for i in range(40)], "run string, i long, num double, den double")
    a, b = (resampling.ratio_interval(units, ["run"], "i", 500).first() for _ in range(2))
    assert a == b and a["lo"] <= a["point"] <= a["hi"] and a["n"] == 40


def test_draws_follow_the_standard_generator():
    import random

    for n in (1, 2, 7, 1000):
        r = random.Random(5)
        assert resampling.index_draws(n, 50, 5).tolist() == [r.randrange(n) for _ in range(50)] if n > 1 else True


def test_pair_units_refuses_one_sided(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0)], "k long, num double, den double")
    with pytest.raises(Exception, match="unit in one run only"):
        resampling.pair_units(a, a.withColumn("k", F.lit(2).cast("long")), "k").collect()


def test_frames(spark):
    g = frames.to_grid(spark.createDataFrame([("t", 0.0, 0.02, 10), ("t", 0.05, 0.05, 10)], "track string, start double, end double, n long"))
    assert sorted(r["frame"] for r in g.collect()) == [0, 1]
    h = spark.createDataFrame([("t", i, v) for i, v in enumerate([0.4, 0.6, 0.4, 0.2, 0.4])], "track string, frame long, v double")
    assert [r["active"] for r in frames.hysteresis(h, "track", "frame", "v", 0.5, 0.3).orderBy("frame").collect()] == [False, True, True, False, False]
    auc = frames.roc_auc(spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "s double, y boolean"), "s", "y").first()["auc"]
    assert auc == pytest.approx(0.875)


def test_alignment_and_windows(spark):
    r = spark.createDataFrame([(1, "a b c d".split(), "a x c d e".split())], "rid long, reference array<string>, hypothesis array<string>")
    ops = r.select(F.explode(runs.align("reference", "hypothesis")).alias("o")).select("o.kind").collect()
    assert [o["kind"] for o in ops] == ["equal", "substitute", "equal", "equal", "insert"]
    w = {x["window"]: x["errors"] for x in runs.reference_windows(r, 2).collect()}
    assert w == {0: 1, 1: 1}


def test_loops(spark):
    row = spark.createDataFrame([(["a"] + ["x", "y"] * 6 + ["b"],)], "t array<string>").select(runs.loop_spans("t").alias("s")).first()["s"]
    assert [(s["start"], s["n"], s["reps"]) for s in row] == [(1, 2, 6)]


def test_capacity(spark):
    steps = spark.createDataFrame([("m", i, 2**i, ok) for i, ok in enumerate([True, True, False, True])], "m string, ord long, n long, within boolean")
    assert tuple(runs.capacity(steps, ["m"]).first()) == ("m", 2, "stop")


def test_rttm_and_vtt(spark):
    text = "SPEAKER f 1 0.5 1.25 <NA> <NA> A <NA> <NA>\n; note\nSPEAKER f 1 x 1 <NA> <NA> A <NA> <NA>\nOTHER f\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, ord long, line string")
    assert [tuple(r) for r in files.rttm_lines(lines).collect()] == [("f", 0, 0.5, 1.75, "A")]
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.500\nHallo <b>du</b>\n\n01:00:00.000 --> 01:00:01.000 align:start\nzwei\nzeilen\n"
    cues = files.vtt_cues(spark.createDataFrame([("v", vtt)], "file string, value string")).orderBy("start").collect()
    assert [(c["start"], c["end"], c["text"]) for c in cues] == [(1.0, 2.5, "Hallo du"), (3600.0, 3601.0, "zwei zeilen")]


def test_drift(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, digest string")
    b = spark.createDataFrame([("x", "9"), ("z", "3")], "path string, digest string")
    assert sorted(map(tuple, runs.drift(a, b, "path", "digest").collect())) == [("x", "modified"), ("y", "missing"), ("z", "unlisted")]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def conversations(spark, path, texts):
    """Turns of conversations, written as the table of that name."""
    rows = [(c, t, "user", x) for c, own in enumerate(texts) for t, x in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")


def test_wer_pairs_scores_pairs_of_many_words(spark, tmp_path):
    from phonyx.plans import queries

    texts = [[" ".join(f"w{(i * k) % 211}" for i in range(120)) for k in (1, 2, 3)], ["a b c", "a c", None]]
    conversations(spark, tmp_path, texts)
    got = {x["id"]: (x["edits"], x["ref_words"], x["hyp_words"]) for x in queries.QUERIES["wer_pairs"](spark, str(tmp_path)).collect()}
    words = [[(x or "").split() for x in own] for own in texts]
    assert got == {c * 1000 + t: (edit_distance(a, b), len(a), len(b)) for c, own in enumerate(words) for t, (a, b) in enumerate(zip(own, own[1:]))}


def test_word_edits_of_very_many_words(spark):
    many = [f"w{i}" for i in range(35_368)]
    cases = [(many, many[-3:]), (["a", "b"], ["b"]), ([], [])]
    rows = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(cases)], "i int, r array<string>, h array<string>")
    got = {x["i"]: x["e"] for x in rows.select("i", T.word_edits(F.col("r"), F.col("h")).alias("e")).collect()}
    assert got == {0: len(many) - 3, 1: 1, 2: 0}


def test_cer_pairs_counts_characters_of_all_turns(spark, tmp_path):
    from phonyx.plans import queries

    texts = [["schön – ja", "schon ja", "ça va", "plain"], ["ä", "ö𝄞"], ["abc", "abd"], ["x", None]]
    conversations(spark, tmp_path, texts)
    got = {x["conv_id"]: x["cer_pct"] for x in queries.QUERIES["cer_pairs"](spark, str(tmp_path)).collect()}
    for c, own in enumerate(texts):
        pairs = [(a or "", b or "") for a, b in zip(own, own[1:])]
        assert got[c] == pytest.approx(100 * sum(edit_distance(a, b) for a, b in pairs) / sum(len(a) for a, _ in pairs), abs=1e-6)


def test_interval_queries_take_ten_thousand_samples(spark, tmp_path):
    import random

    from phonyx.plans import queries

    r = np.random.default_rng(3)
    rows = [(k, "A", f, float(r.random()), float(r.integers(1, 99))) for k in range(6) for f in "OF" for _ in range(2)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")

    def units(flags):
        own = [[x for x in rows if x[0] == k and x[2] in flags] for k in range(6)]
        return [(sum(x[3] * x[4] for x in xs), sum(x[4] for x in xs)) for xs in own]

    def ends(rate):
        g = random.Random(20260903)
        found = sorted(rate([g.randrange(6) for _ in range(6)]) for _ in range(10_000))
        tail = (1 - 0.95) / 2
        return found[int(tail * 9999)], found[int((1 - tail) * 9999)]

    pct = lambda us, at: 100 * sum(us[i][0] for i in at) / sum(us[i][1] for i in at)
    both, o, f = units("OF"), units("O"), units("F")
    for name, rate in (("bootstrap_ci", lambda at: pct(both, at)), ("paired_interval", lambda at: pct(o, at) - pct(f, at))):
        got, want = queries.QUERIES[name](spark, str(tmp_path)).first(), ends(rate)
        assert (got["lo"], got["hi"]) == pytest.approx(want, abs=1e-9)


def test_resamples_do_not_depend_on_slabs():
    values = np.random.default_rng(1).random((7, 2))
    assert (resampling.resampled_sums(values, 300, 5, 50) == resampling.resampled_sums(values, 300, 5)).all()
    assert (resampling.resampled_sums(values, 300, 5) == values[resampling.index_draws(7, 2100, 5).reshape(300, 7)].sum(1)).all()
