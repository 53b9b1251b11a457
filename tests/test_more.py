"""Operators against brute force and hand-computed values."""

import io
import itertools
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonyx.functions import numbers as N
from phonyx.functions import text as T
from phonyx.operators import frames, intervals, metrics, resampling, runs, scan
from phonyx.sources import corpora
from phonyx.streaming import live

SEGMENT = "file string, side string, ord long, start double, end double, speaker string"


def segments(spark, ref, hyp, file="f"):
    rows = [(file, "ref", i, float(a), float(b), s) for i, (a, b, s) in enumerate(ref)] + [(file, "hyp", i, float(a), float(b), s) for i, (a, b, s) in enumerate(hyp)]
    return spark.createDataFrame(rows, SEGMENT)


# -- scans in two levels ----------------------------------------------------------------------------------------------


def test_running_values_do_not_depend_on_buckets(spark):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(None if i % 7 == 0 else f"k{i % 2}", i, float(r.integers(0, 50))) for i in range(200)], "k string, t long, x double")
    for width in (1, 13, 1000):
        got = scan.running(rows, ["k"], F.floor(F.col("t") / width), ["t"], {"s": (F.sum, "x"), "m": (F.max, "x")}, before=True, following={"next": "t"}).collect()
        for key in (None, "k0", "k1"):
            own = sorted((x for x in got if x["k"] == key), key=lambda x: x["t"])
            for i, x in enumerate(own):
                before = [y["x"] for y in own[:i]]
                assert x["s"] == sum(before) and x["m"] == (max(before) if before else None) and x["next"] == (own[i + 1]["t"] if i + 1 < len(own) else None)


def test_folding_and_batches_by_time_agree_with_whole_keys(spark):
    r = np.random.default_rng(1)
    spans = spark.createDataFrame([("a", float(s), float(s + d), i) for i, (s, d) in enumerate(zip(r.integers(0, 5000, 300), r.integers(0, 60, 300)))], "k string, start double, end double, id long")
    whole, dealt = (sorted(map(tuple, intervals.fold_turns(spans, ["k"], 2.0, b).collect())) for b in (None, 100.0))
    assert whole == dealt and len(whole) > 20
    for b in (None, 70.0):
        found = {x["id"]: x["batch"] for x in runs.micro_batches(spans, ["k"], "start", ["start", "id"], 4, 9.0, b).collect()}
        if b is None:
            want = found
    assert found == want


def test_exact_percentiles_and_ranks(spark):
    r = np.random.default_rng(2)
    values = [(f"g{i % 3}", float(x)) for i, x in enumerate(r.normal(0, 1, 500).round(2))]
    rows = spark.createDataFrame(values, "g string, x double")
    for x in runs.exact_percentiles(rows, ["g"], "x", {"p50": 0.5, "p99": 0.99}, places=6).collect():
        own = [v for g, v in values if g == x["g"]]
        assert x["p50"] == pytest.approx(np.percentile(own, 50), abs=1e-6) and x["p99"] == pytest.approx(np.percentile(own, 99), abs=1e-6)
    scored = rows.withColumn("y", F.col("g") == "g0")
    pos, neg = [v for g, v in values if g == "g0"], [v for g, v in values if g != "g0"]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert frames.roc_auc(scored, "x", "y").first()["auc"] == pytest.approx(auc)
    cut = sorted(neg)[math.ceil(0.9 * (len(neg) - 1) - 1e-9)]
    assert frames.miss_at_frame_fpr(scored, "x", "y", 10.0).first()["miss_pct"] == round(100 * np.mean([p <= cut for p in pos]), 3)


# -- diarization ------------------------------------------------------------------------------------------------------


def plain_der(ref, hyp, collar, skip):
    """(total, miss, false alarm, confusion) on a fine grid, with the best of all mappings."""
    step = 0.25
    marks = {t for a, b, _ in ref for t in (a, b)}
    names_r, names_h = sorted({s for *_, s in ref}), sorted({s for *_, s in hyp})
    cells = []
    for i in range(int(60 / step)):
        t = (i + 0.5) * step
        r, h = [s for a, b, s in ref if a <= t < b], [s for a, b, s in hyp if a <= t < b]
        if any(abs(t - m) < collar / 2 for m in marks) or skip and len(r) > 1:
            continue
        cells.append((r, h))
    wide = max(len(names_r), len(names_h))
    best = max(sum(min(r.count(x), h.count(y)) for r, h in cells for x, y in zip(names_r, p)) for p in itertools.permutations(names_h + [None] * (wide - len(names_h)), len(names_r))) if names_r and names_h else 0
    both = sum(min(len(r), len(h)) for r, h in cells)
    return [step * x for x in (sum(len(r) for r, _ in cells), sum(max(len(r) - len(h), 0) for r, h in cells), sum(max(len(h) - len(r), 0) for r, h in cells), both - best)]


@pytest.mark.parametrize("collar,skip", [(0.0, False), (1.0, False), (0.0, True), (1.0, True)])
def test_diarization_error_against_a_grid(spark, collar, skip):
    r = np.random.default_rng(5)
    files, want = None, {}
    for k in range(6):
        some = lambda n, names: [(a := 0.5 * int(r.integers(0, 90)), a + 0.5 * int(r.integers(1, 30)), str(r.choice(names))) for _ in range(n)]
        ref, hyp = some(8, ["A", "B", "C"][: 1 + k % 3]), some(7, ["x", "y", "z", "w"])
        ref, hyp = ([*{(a, b): (a, min(b, 60.0), s) for a, b, s in side}.values()] for side in (ref, hyp))
        one = segments(spark, ref, hyp, f"f{k}")
        files = one if files is None else files.unionByName(one)
        want[f"f{k}"] = plain_der([*{(a, b): (a, b, s) for a, b, s in ref}.values()], [*{(a, b): (a, b, s) for a, b, s in hyp}.values()], collar, skip)
    got = {x["file"]: [x["total_s"], x["miss_s"], x["false_alarm_s"], x["confusion_s"]] for x in intervals.diarization_seconds(files, collar, skip, bucket_s=7.0).collect()}
    for f, w in want.items():
        assert got[f] == pytest.approx(w, abs=1e-6), f


def test_boundaries_and_missed_speech(spark):
    gold = [(0, 5, "A"), (20, 25, "B")]
    perfect = intervals.boundary_report(segments(spark, gold, gold)).first()
    assert (perfect["offset_median_ms"], perfect["within_pct"], perfect["missed_short_s"] + perfect["missed_long_s"]) == (0.0, 100.0, 0.0)
    late = intervals.boundary_report(segments(spark, gold, [(a + 0.1, b + 0.1, s) for a, b, s in gold])).first()
    assert late["offset_median_ms"] == pytest.approx(100.0)
    swapped = intervals.boundary_report(segments(spark, gold, [(0, 5, "B"), (20, 25, "A")])).first()
    assert swapped["offset_median_ms"] == pytest.approx(0.0) and swapped["unmatched_boundaries"] == 0
    one = intervals.boundary_report(segments(spark, gold, [(0, 5, "A"), (20, 25, "A")])).first()
    assert one["unmatched_boundaries"] == 2 and one["missed_long_s"] == pytest.approx(5.0)
    none = intervals.boundary_report(segments(spark, [(0, 30, "A"), (40, 40.2, "B")], [(60, 61, "A")])).first()
    assert none["missed_short_s"] == pytest.approx(0.2) and none["missed_long_s"] == pytest.approx(30.0) and none["offset_median_ms"] is None


def test_error_by_number_of_speakers(spark):
    two = segments(spark, [(0, 10, "A"), (10, 20, "B")], [(0, 20, "x")], "two").unionByName(segments(spark, [(0, 10, "A")], [(0, 8, "x")], "one"))
    got = {r["bucket"]: r["der"] for r in intervals.der_by_speakers(two).collect()}
    assert got == {"2": pytest.approx(0.5), "1": pytest.approx(0.2)}


# -- words and numbers ------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_against_the_table():
    r = np.random.default_rng(3)
    for _ in range(400):
        a, b = (list(r.choice(["a", "b", "c", "d"], int(r.integers(0, 12)))) for _ in range(2))
        assert T.edit_distance(a, b) == plain_distance(a, b)
    words = [f"w{i}" for i in range(40_000)]
    assert T.edit_distance(words, words[1:] + ["new"]) == 2


def test_number_words():
    assert all(N.RUN.sub(lambda m: N.read_run(m[0]), N.spelled(n)) == str(n) for n in [*range(3, 3000), 10_001, 123_456, 999_999, 10**6, 2 * 10**6 + 17, 5 * 10**9])
    read = lambda t: N.RUN.sub(lambda m: m[0] if m[0].lower() in ("ein", "eine") else N.read_run(m[0]), t)
    cases = {"zwei Hunde und drei komma fünf Liter": "zwei Hunde und 3,5 Liter", "ein Mann hat eine Million Euro": "ein Mann hat 1000000 Euro", "drei vier fünf": "3 4 5", "minus fünf Grad": "-5 Grad", "null Fehler": "null Fehler", "zwei tausend": "2000", "achtung vierteln": "achtung vierteln"}
    assert {t: read(t) for t in cases} == cases
    assert [N.spelled_token(x) for x in ("3,5", "12.03", "17", "1000000")] == ["drei Komma fünf", "zwölf Komma null drei", "siebzehn", "eine Million"]


def test_lenses_read_and_spell_numbers(spark):
    row = spark.createDataFrame([("Es kamen dreiundzwanzig Leute, ähm [ab] 23.",)], "t string").select(T.canonical(F.col("t")).alias("c"), T.strict(F.col("t")).alias("s")).first()
    assert row["c"] == "Es kamen 23 Leute ähm 23" and row["s"] == "es kamen dreiundzwanzig leute dreiundzwanzig"


def test_strict_corpus_rate(spark):
    rows = [(1, "Ich habe 21 Äpfel.", "ich habe einundzwanzig äpfel"), (2, "ja nein", ""), (3, "", "zu viel"), (4, "äh, das ist gut", "das war gut"), (5, "Straße 35 km", "strasse sechsunddreißig km")]
    units = metrics.strict_units(spark.createDataFrame(rows, "id long, reference string, prediction string"))
    got = {x["id"]: (x["num"], x["den"]) for x in units.collect()}
    assert got == {1: (0, 4), 2: (2, 2), 3: (0, 0), 4: (1, 3), 5: (1, 3)}
    total = metrics.corpus_strict_wer(units).first()
    assert (total["strict_wer_pct"], total["ref_words"], total["utterances"]) == (pytest.approx(100 * 4 / 12), 12, 4)


def test_pair_stack(spark):
    rows = spark.createDataFrame([("a", "Das ist ein Test.", "das ist kein Test heute"), ("b", "Wort", ""), ("c", "", ""), ("d", "", "x")], "id string, reference string, prediction string")
    got = {r["id"]: r for r in metrics.pair_stack(rows).collect()}
    a = got["a"]
    assert (a["sub"], a["ins"], a["del"], a["ref_words"], a["ier"]) == (1, 1, 0, 4, 0.25) and a["wer_strict"] == a["wer_permissive"] == 0.5 and a["wer_verbatim"] == 0.75
    assert a["cer"] == pytest.approx(plain_distance("das ist ein test", "das ist kein test heute") / 16)
    assert [got[k]["wer_strict"] for k in "bcd"] == [1.0, 0.0, 1.0] and got["b"]["del"] == 0


def test_fillers_do_not_count(spark):
    rows = spark.createDataFrame([("a", "ja ähm also gut", "ja gut")], "id string, reference string, prediction string")
    assert metrics.word_units(rows).first()["edits"] == 2 and metrics.filler_tolerant_units(rows).first()["edits"] == 0


def plain_bleu(pairs, effective=False):
    """Corpus BLEU of (references, hypothesis) token lists, with exponential smoothing."""
    match, total, ref_len, hyp_len = [0] * 4, [0] * 4, 0, 0
    for refs, h in pairs:
        hyp_len += len(h)
        ref_len += min((abs(len(r) - len(h)), len(r)) for r in refs)[1]
        for n in range(1, 5):
            grams = [tuple(h[i : i + n]) for i in range(len(h) - n + 1)]
            total[n - 1] += len(grams)
            match[n - 1] += sum(min(grams.count(g), max(sum(tuple(r[i : i + n]) == g for i in range(len(r) - n + 1)) for r in refs)) for g in set(grams))
    if not any(match) or not effective and not all(total):
        return 0.0
    smooth, logs, orders = 1.0, 0.0, 0
    for m, t in zip(match, total):
        if not t:
            break
        orders += 1
        if m == 0:
            smooth *= 2
        logs += math.log(100 / (smooth * t) if m == 0 else 100 * m / t)
    return (math.exp(1 - ref_len / hyp_len) if hyp_len < ref_len else 1.0) * math.exp(logs / (orders if effective else 4))


def test_bleu_of_several_references_and_of_sentences(spark):
    r = np.random.default_rng(8)
    text = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "mat", "."], int(r.integers(1, 12))))
    data = [(i, text(), text(), text()) for i in range(40)] + [(40, "the cat sat on the mat", "a", "the cat")]
    rows = spark.createDataFrame(data, "id long, reference string, other string, prediction string")
    refs = [T.words(F.col("reference")), T.words(F.col("other"))]
    counts = metrics.bleu_counts(rows, refs, T.words(F.col("prediction")))
    pairs = [([a.split(), b.split()], h.split()) for _, a, b, h in data]
    assert metrics.corpus_bleu(counts).first()["bleu"] == pytest.approx(plain_bleu(pairs))
    single = metrics.bleu_counts(rows, refs[0], T.words(F.col("prediction")))
    assert metrics.corpus_bleu(single).first()["bleu"] == pytest.approx(plain_bleu([(p[:1], h) for p, h in pairs]))
    for x in metrics.sentence_bleu(counts).collect():
        assert x["sentence_bleu"] == pytest.approx(plain_bleu([pairs[x["id"]]], True))


def test_contained_ngrams(spark):
    r = np.random.default_rng(4)
    texts = [list(r.choice(["a", "b"], int(n))) for n in r.integers(0, 30, 40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t array<string>")
    items = spark.createDataFrame([(100 + i, t[:9]) for i, t in enumerate(texts[:5])], "source long, t array<string>")
    grams = lambda t: [tuple(t[i : i + 4]) for i in range(len(t) - 3)]
    want = {}
    for i, t in enumerate(texts):
        hits = [(pos, 100 + k) for pos, g in enumerate(grams(t)) for k, s in enumerate(texts[:5]) if g in grams(s[:9])]
        if hits:
            want[i] = (min(hits)[1], len({k for _, k in hits}))
    for most in (0, 50_000):
        assert {x["id"]: (x["source"], x["sources"]) for x in metrics.contained_ngrams(docs, items, 4, most).collect()} == want


def test_loop_spans_and_windows_against_plain_scans(spark):
    r = np.random.default_rng(6)
    texts = [list(r.choice(["a", "b"], 40)) for _ in range(15)] + [["x", "y", "z"] * 8 + ["end"], []]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t array<string>")
    for x in rows.select("id", runs.loop_spans("t").alias("s")).collect():
        words, want, i = texts[x["id"]], [], 0
        while i < len(words):
            step = 1
            for n in range(1, runs.LOOP_MAX_N + 1):
                reps = 1
                while words[i + reps * n : i + (reps + 1) * n] == words[i : i + n] and i + (reps + 1) * n <= len(words):
                    reps += 1
                if reps >= runs.LOOP_MIN_REPS and reps * n >= runs.LOOP_MIN_WORDS:
                    want.append((i, n, reps))
                    step = n * reps
                    break
            i += step
        assert [tuple(s) for s in x["s"]] == want
    pairs = spark.createDataFrame([(i, texts[i], texts[i + 1]) for i in range(15)], "rid long, reference array<string>, hypothesis array<string>")
    total = {x["rid"]: x for x in runs.reference_windows(pairs, 7).groupBy("rid").agg(F.sum("errors").alias("errors"), F.sum("ref_words").alias("r"), F.sum("hyp_words").alias("h")).collect()}
    assert all((total[i]["errors"], total[i]["r"], total[i]["h"]) == (plain_distance(texts[i], texts[i + 1]), len(texts[i]), len(texts[i + 1])) for i in range(15))


# -- frames, corpora, streams -----------------------------------------------------------------------------------------


def test_interval_counts_agree_with_frames(spark):
    r = np.random.default_rng(7)
    rows = [(f"t{i % 3}", ["sent", "target", "crosstalk"][i % 3 - 1 if i % 5 else 0], float(s), float(s + d)) for i, (s, d) in enumerate(zip(r.uniform(-0.2, 3, 60), r.uniform(0, 0.5, 60)))]
    iv = spark.createDataFrame(rows, "track string, kind string, start double, end double")
    tracks = spark.createDataFrame([("t0", 250), ("t1", 320), ("t2", 10), ("t3", 5)], "track string, n long")
    all_ = tracks.select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    for kind in ("sent", "target", "crosstalk"):
        grid = frames.to_grid(iv.where(F.col("kind") == kind).join(tracks, "track")).withColumn(kind, F.lit(True))
        all_ = all_.join(grid, ["track", "frame"], "left").fillna(False, [kind])
    want = {x["track"]: x.asDict() for x in frames.frame_counts(all_, ["track"]).collect()}
    for x in frames.interval_counts(iv, tracks).collect():
        assert {k: v if not isinstance(v, float) else pytest.approx(v) for k, v in x.asDict().items()} == want[x["track"]]


def test_levels_edges_and_veto(spark):
    levels = spark.createDataFrame([("a", i, -60.0 + 10 * (i in (3, 4, 5)) + 30 * (i == 4), i in (3, 4)) for i in range(10)], "track string, frame long, level double, speech boolean")
    assert frames.own_speech_level(levels, "track").first()["own_level"] == pytest.approx(np.percentile([-50, -20], 95))
    edges = frames.speech_edges(levels, "track").first()
    assert (edges["onset_s"], edges["offset_s"]) == (pytest.approx(0.08), pytest.approx(0.1))
    own = spark.createDataFrame([("m", "a", i, -50.0 + i % 3, False) for i in range(30)], "meeting string, track string, frame long, level double, speech boolean")
    loud = own.withColumn("track", F.lit("b")).withColumn("level", F.col("level") + 20).withColumn("speech", F.lit(True))
    assert frames.veto(own, loud, window=10).where("vetoed").count() == 30
    assert frames.veto(own, loud.withColumn("level", F.col("level") - 15), window=10).where("vetoed").count() == 0
    held = spark.range(6).select(frames.hold_at(0.03, F.col("id"), F.lit(2)).alias("s")).collect()
    assert [x["s"] for x in held] == [0, 0, 0, 1, 1, 1]


def test_latencies_and_endpoint_failures(spark):
    u = spark.createDataFrame([(1.0, 2.5, 4.0, 5.0, 0.5), (1.0, None, 4.0, None, 0.5)], "t_first_send double, t_first_text double, t_audio_end double, t_done double, speech_onset_s double")
    got = runs.latencies(u).collect()
    assert (got[0]["ttfp_s"], got[0]["final_s"], got[0]["first_text_after_speech_s"]) == (1.5, 1.0, 1.0) and got[1]["ttfp_s"] is None
    e = spark.createDataFrame([(503, None), (404, None), (None, True), (None, None)], "status int, transport boolean").select(runs.endpoint_failure(F.col("status"), F.col("transport")).alias("x"))
    assert [r["x"] for r in e.collect()] == [True, False, True, False]


def test_corpus_rows_keep_their_numbers(spark, tmp_path):
    rows = [(f"a{i}", "" if i == 3 else None if i == 5 else f"text {i}", "src1" if i % 2 else "src0") for i in range(8)]
    df = spark.createDataFrame(rows, "raw_text string, normalized_text string, origin string").select(F.lit(None).cast("string").alias("raw_text"), "normalized_text", "origin")
    df.coalesce(1).write.parquet(f"{tmp_path}/c/part0")
    df.limit(2).coalesce(1).write.parquet(f"{tmp_path}/c/part1")
    numbered = corpora.numbered_rows(spark, [f"{tmp_path}/c/part0", f"{tmp_path}/c/part1"])
    own = corpora.Corpus("all", ("raw_text", "normalized_text"), source_column="origin", aliases={"odd": "src1"})
    found = corpora.samples(numbered, own, "odd")
    assert sorted((r["sample_id"], r["reference"], r["reason"]) for r in found.collect()) == [("src1-1", "text 1", None), ("src1-3", "", "empty_reference"), ("src1-5", "", "empty_reference"), ("src1-7", "text 7", None), ("src1-9", "text 1", None)]
    assert [r["sample_id"] for r in corpora.kept(found, 2).collect()] == ["src1-1", "src1-7"]
    assert {r["reason"]: r["n"] for r in corpora.tally(found).collect()} == {"yielded": 3, "empty_reference": 2}
    with pytest.raises(ValueError):
        corpora.samples(numbered, corpora.CORPORA["fleurs"], "other")


def test_listed_clips_and_archives(spark, tmp_path):
    (tmp_path / "list.tsv").write_text('path\tsentence\taccent\na.mp3\tsie sagt "ja\tZH\nb.mp3\t\tBE\nc.mp3\tda\t\nd.mp3\tweg\tZH\n', encoding="utf-8")
    with tarfile.open(tmp_path / "clips.tar", "w") as tar:
        for name in ("a", "b", "c"):
            info = tarfile.TarInfo(f"clips/{name}.mp3")
            info.size = 3
            tar.addfile(info, io.BytesIO(b"xyz"))
    members = corpora.tar_members(spark, str(tmp_path / "clips.tar"))
    assert sorted((r["member"], r["size"]) for r in members.collect()) == [(f"clips/{x}.mp3", 3) for x in "abc"]
    clips = corpora.listed_clips(spark, str(tmp_path / "list.tsv"), members, "dialects")
    got = {r["sample_id"]: (r["reference"], r["reason"]) for r in clips.collect()}
    assert got == {"dialects-ZH-a": ('sie sagt "ja', None), "dialects-BE-b": ("", "empty_reference"), "dialects-unknown-c": ("da", None), "dialects-ZH-d": ("weg", "clip_missing")}
    assert clips.where("sample_id = 'dialects-ZH-a'").select(corpora.region_of(F.col("sample_id"), "dialects").alias("r")).first()["r"] == "ZH"


def test_pairing_refuses_units_of_one_run(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "k long, num double, den double")
    with pytest.raises(Exception, match="unit in one run only"):
        resampling.pair_units(a, a.limit(1), "k").collect()


def stream(spark, batches, schema, transform, tmp_path, name, mode):
    """Rows of a streaming query that gets one file at a time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/{name}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}")
        q = transform(source).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/{name}-out").start()
        assert q.awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/{name}-out").collect()


def test_frames_wait_for_chunks_that_come_late(spark, tmp_path):
    schema = "stream string, seq long, samples array<int>, last boolean"
    batches = [[("s", 0, [1], False), ("s", 2, [4, 5], False)], [("s", 1, [2, 3], False), ("s", 3, [6], True)], [("s", 4, [9], False), ("s", 0, [1], False)]]
    out = stream(spark, batches, schema, lambda s: live.cut_frames(s, 2), tmp_path, "late", "append")
    got = sorted((r["frame"], tuple(r["samples"]), r["is_first"], r["is_last"], r["length"]) for r in out)
    assert got == [(0, (1, 2), True, False, 2), (1, (3, 4), False, False, 2), (2, (5, 6), False, False, 2), (3, (0, 0), False, True, 0)]


def test_sessions_and_samples_of_streams(spark, tmp_path):
    spans = [("f", "A", "2026-01-01 00:00:00"), ("f", "A", "2026-01-01 00:00:00.300"), ("f", "A", "2026-01-01 00:00:05"), ("f", "B", "2026-01-01 02:00:00")]
    rows = spark.createDataFrame(spans, "file string, speaker string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.json(f"{tmp_path}/spans")
    source = spark.readStream.schema("file string, speaker string, ts timestamp").json(f"{tmp_path}/spans")
    q = live.turn_sessions(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = sorted((r["speaker"], r["spans"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [("A", 1), ("A", 2)]  # B's session is not closed by the watermark yet
    gauges = spark.createDataFrame([("cpu", "2026-01-01 00:00:00.100", 1.0), ("cpu", "2026-01-01 00:00:00.200", 3.0), ("cpu", "2026-01-01 01:00:00", 9.0)], "name string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    gauges.coalesce(1).write.json(f"{tmp_path}/gauges")
    source = spark.readStream.schema("name string, ts timestamp, value double").json(f"{tmp_path}/gauges")
    live.sampled(source).writeStream.format("parquet").option("path", f"{tmp_path}/out2").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["mean"], r["max"]) for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == [(2.0, 3.0)]
