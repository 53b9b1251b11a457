"""Parsers of model outputs, the token cap, coupled sessions."""

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonyx.functions import outputs
from phonyx.streaming import coupled

MARKED = "[4.18][S01] Für die besten Aussichten verlassen und zum gegenüberliegenden[10.96][10.96][S01] Ufer fahren.[13.81]"
RECORDS = '[{"Start":0,"End":15.43,"Speaker":0,"Content":"Guten Tag und willkommen."},{"Start":15.43,"End":21.05,"Speaker":1,"Content":"Danke, schön hier zu sein."}]'


def test_marks_become_turns():
    text, turns = outputs.marked_turns(MARKED)
    assert text == "Für die besten Aussichten verlassen und zum gegenüberliegenden Ufer fahren."
    assert turns == [("S01", 4.18, 10.96, "Für die besten Aussichten verlassen und zum gegenüberliegenden"), ("S01", 10.96, 13.81, "Ufer fahren.")]
    for raw in ("[0,48][S01]hallo welt[3,12]", "[12][S01]hallo welt[13]", "[0.48][s01]hallo welt[3.12]", "[ 0.48 ][ S01 ]hallo welt[ 3.12 ]", "[S01] hallo welt", "[0.48] hallo welt [3.12]", "hallo welt"):
        assert outputs.marked_turns(raw)[0] == "hallo welt"
    assert outputs.marked_turns("[0,48][S01]hallo[3,12]")[1] == [("S01", 0.48, 3.12, "hallo")]
    assert outputs.marked_turns("[5.81][5.81][S01] und.[6.81][6.81][S02][6.83]") == ("und.", [("S01", 5.81, 6.81, "und.")])
    assert outputs.marked_turns("[1.0][1.0][S01][S01] hallo[2.0][2.0]")[0] == "hallo"
    assert outputs.marked_turns("hallo") == ("hallo", [(None, None, None, "hallo")])
    for raw, text in (("[0.35[S01]Mehrere Bücher.[5.24]", "Mehrere Bücher."), ("[S01] wir wollen[4.33", "wir wollen"), ("[S01] hochwertige[[S01] ausbildung[5.21]", "hochwertige ausbildung"), ("[0.1][S01] Standard 802.11 und 3,5[4.0]", "Standard 802.11 und 3,5")):
        assert outputs.marked_turns(raw)[0] == text
    assert "[Musik]" in outputs.marked_turns("[0.1][S01] hallo [Musik][2.0]")[0]


def test_records_become_turns():
    assert outputs.json_turns(RECORDS)[1] == [("S00", 0.0, 15.43, "Guten Tag und willkommen."), ("S01", 15.43, 21.05, "Danke, schön hier zu sein.")]
    assert outputs.json_turns('[{"Start":0,"End":1,"Speaker":0,"Content":"Gr\\u00fc\\u00dfe \\"Anna\\""}]')[0] == 'Grüße "Anna"'
    cut = outputs.json_turns(RECORDS[:-1] + ',{"Start":21.05,"End":30,"Speaker":0,"Content":"Und dann sa')
    assert cut[0].endswith("hier zu sein. Und dann sa") and cut[1][-1] == (None, None, None, "Und dann sa")
    assert outputs.json_turns("  nur  Text ") == ("nur Text", []) and outputs.json_turns("[]") == ("", []) and outputs.json_turns('[{"Content":""}]') == ("", [])
    raw = ('assistant\n[{"Start":0.0,"End":4.0,"Speaker":0,"Content":"[Noise] Guten Tag."},{"Start":4.0,"Content":"[Silence]"},{"Content":"[Unintelligible Speech]"},'
           '{"Start":13.0,"End":14.0,"Speaker":0,"Content":"Danke [Noise] sehr."},{"Content":"[Noise] [Noise]"},{"Start":15.0,"Content":"[Mus')
    assert outputs.json_turns(raw) == ("Guten Tag. Danke sehr.", [("S00", 0.0, 4.0, "Guten Tag."), ("S00", 13.0, 14.0, "Danke sehr.")])
    assert outputs.json_turns('[{"Content":"[Heidi] kam."}]')[0] == "[Heidi] kam."
    assert outputs.json_turns('[{"Content":"ein } Wort"},{"Speaker":true,"Start":"1.5","End":"x","Content":"zwei"}]')[1] == [(None, 1.5, None, "zwei")]
    assert outputs.json_turns('[{"Speaker":"7","Content":"a"},{"Speaker":"Anna","Content":"b"},{"Speaker":2.5,"Content":"c"}]')[1] == [("S07", None, None, "a"), ("Anna", None, None, "b"), ("2.5", None, None, "c")]
    assert outputs.untagged("gut<de-DE>Morgen  <3 <b> <de> <DE-de>") == ("gut Morgen <3 <b> <de> <DE-de>", [])


def test_every_prefix_parses_to_a_prefix():
    r = random.Random(3)
    words = ["ja", "nein", "größer", "\\", 'sagt "so"', "3,5", "heute", "\n"]
    for _ in range(6):
        said = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(5)]
        raw = json.dumps([{"Start": k, "End": k + 1, "Speaker": k % 2, "Content": s} for k, s in enumerate(said)], ensure_ascii=r.random() < 0.5)
        full = outputs.json_turns(raw)[1]
        for n in range(len(raw)):
            got = outputs.json_turns(raw[:n])[1]
            whole = [t for t in got if t[1] is not None]
            assert whole == full[: len(whole)] and len(got) - len(whole) <= 1
            if len(got) > len(whole) and not got[-1][3].endswith(("\\", "u")) and "\\" not in got[-1][3]:
                assert len(whole) == len(full) or full[len(whole)][3].startswith(got[-1][3])
        plain = [" ".join(r.choice(["ja", "nein", "größer", "heute"]) for _ in range(r.randint(1, 6))) for _ in range(5)]
        raw = "".join(f"[{k}.25][S{k % 2:02d}] {s} [{k}.75]" for k, s in enumerate(plain))
        full = outputs.marked_turns(raw)[1]
        for n in range(len(raw)):
            got = outputs.marked_turns(raw[:n])[1]
            assert got[:-1] == full[: max(len(got) - 1, 0)]
            # Of a mark that is cut off a few signs can be left, as a last word.
            if got and len(got) <= len(full):
                words = got[-1][3].split()
                assert full[len(got) - 1][3].startswith(" ".join(words if words[-1].strip("sS0123456789.,") else words[:-1]))


def test_lines_are_read_again(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    cols = "id long, subset string, prediction string, raw_prediction string, error string, form string"
    rows = [(1, "a", "x", MARKED, None, "moss-timed-speakers"), (2, "a", "plain text", None, None, None), (3, "a", None, None, "timeout", "vibevoice-json"), (4, "b", RECORDS, None, None, "vibevoice-json"), (5, "b", "und dann " * 50, None, None, None)]
    before = spark.createDataFrame(rows, cols)
    once = outputs.reparsed(before, F.col("form"), 80, path)
    got = {x["id"]: x for x in once.collect()}
    assert got[1]["prediction"] == outputs.marked_turns(MARKED)[0] and got[1]["raw_prediction"] == MARKED and [s["speaker"] for s in got[1]["segments"]] == ["S01", "S01"]
    assert got[2]["prediction"] == "plain text" and got[2]["raw_prediction"] is None and got[2]["segments"] is None
    assert got[3]["prediction"] is None and got[4]["raw_prediction"] == RECORDS and got[4]["segments"][1]["start_s"] == 15.43
    assert got[5]["capped_post_hoc"] and got[5]["raw_prediction"] == "und dann " * 50 and ("und dann " * 50).startswith(got[5]["prediction"]) and len(got[5]["prediction"]) < 300
    twice = {x["id"]: x for x in outputs.reparsed(once, F.col("form"), 80, path).collect()}
    assert twice == got
    report = {x["subset"]: (x["lines"], x["changed"], x["capped"]) for x in outputs.reparse_report(before, once, "id", "subset").collect()}
    assert report == {"a": (3, 1, 0), "b": (2, 2, 1)}
    with pytest.raises(Exception, match="unknown output format"):
        outputs.reparsed(before, F.lit("no-such-format")).collect()


def tone(seconds, rate=16_000):
    return (0.3 * np.sin(2 * np.pi * 220 * np.arange(int(rate * seconds)) / rate) * 32767).astype(int).tolist()


def test_speech_is_cut_a_pause_after_its_end(spark):
    rows = [("long", tone(1.0) + [0] * 48_000), ("short", tone(1.0) + [0] * 1600), ("middle", [0] * 8000 + tone(1.0) + [0] * 32_000), ("silent", [0] * 16_000), ("none", [])]
    got = {x["id"]: x for x in coupled.endpointed(spark.createDataFrame(rows, "id string, samples array<int>")).collect()}
    for name, end in (("long", 1.0), ("short", 1.0), ("middle", 1.5), ("silent", 1.0), ("none", 0.0)):
        assert got[name]["speech_end_s"] == pytest.approx(end, abs=0.021) and got[name]["duration_s"] == pytest.approx(got[name]["speech_end_s"] + 0.7, abs=1e-3)
    assert got["short"]["samples"][-200:] == [0] * 200


LIVE = "session string, idx long, at timestamp, t_speech_end double, t_done double, text string, error string"
FINAL = "session string, idx long, final_at timestamp, t_final_done double, status string, final_text string"


def test_coupled_summary(spark):
    live = [("s", i, f"2026-01-01 00:00:{i:02d}", 1.3, 2.05, "hallo welt", None) for i in range(4)]
    final = [("s", i, f"2026-01-01 00:00:{i:02d}", 2.1, "ok", "hallo welt") for i in range(4)]

    def summary(a, b):
        frame = lambda rows, form: spark.createDataFrame(rows, form.replace("timestamp", "string")).transform(lambda d: d.withColumns({c: F.col(c).cast("timestamp") for c in d.columns if c in ("at", "final_at")}))
        return coupled.coupled_summary(coupled.couple(frame(a, LIVE), frame(b, FINAL)), ["session"]).first()

    s = summary(live, final)
    assert s["within_threshold"] and s["final_p95"] == pytest.approx(0.8) and s["stream_p50"] == pytest.approx(0.75) and s["stream_vs_final_wer_pct"] == 0.0
    s = summary(live, [*final[:2], ("s", 2, "2026-01-01 00:00:02", 1.8, "empty", ""), final[3]])
    assert s["final_errors"] == 1 and not s["within_threshold"]
    s = summary([live[0], (*live[1][:5], "", None), *live[2:]], final)
    assert s["stream_empty"] == 1 and not s["within_threshold"]
    assert not summary(live, [*final[:3], ("s", 3, "2026-01-01 00:00:03", 5.3, "ok", "hallo welt")])["within_threshold"]


def test_streams_meet_and_late_rows_are_dropped(spark, tmp_path):
    def feed(side, batches, form):
        folder = tmp_path / side
        for k, rows in enumerate(batches):
            part = tmp_path / f"{side}-{k}"
            spark.createDataFrame(rows, form.replace("timestamp", "string")).coalesce(1).write.json(str(part))
            folder.mkdir(exist_ok=True)
            (file,) = part.glob("*.json")
            target = folder / f"{k}.json"
            file.rename(target)
            os.utime(target, (time.time() - 100 + k, time.time() - 100 + k))
        return spark.readStream.schema(form).option("maxFilesPerTrigger", 1).json(str(folder))

    at = lambda m, s: f"2026-01-01 00:{m:02d}:{s:02d}"
    live = feed("live", [[("s", 0, at(0, 1), 1.0, 1.5, "hallo welt", None), ("s", 1, at(0, 2), 2.0, 2.5, "guten tag", None)], [("s", 2, at(20, 0), 9.0, 9.4, "spät", None)], [("s", 5, at(20, 2), 9.0, 9.4, "allein", None)], [("s", 3, at(0, 3), 3.0, 3.5, "zu spät", None), ("s", 4, at(20, 5), 9.5, 9.9, "da", None)]], LIVE)
    final = feed("final", [[("s", 0, at(0, 4), 1.8, "ok", "hallo welt")], [("s", 1, at(0, 6), 2.9, "ok", "guten tag auch"), ("s", 2, at(20, 1), 9.9, "ok", "spät")], [("s", 6, at(20, 3), 9.9, "ok", "allein")], [("s", 3, at(0, 7), 3.9, "ok", "zu spät"), ("s", 4, at(20, 9), 9.9, "ok", "da")]], FINAL)
    q = coupled.couple(live, final).writeStream.format("memory").queryName("coupled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {x["idx"]: x for x in spark.table("coupled").collect()}
    # Answer 1 meets its partner in the next batch; both sides of 3 come when the watermark has passed them.
    assert sorted(got) == [0, 1, 2, 4]
    assert got[1]["edits"] == 1 and got[1]["final_after_s"] == pytest.approx(0.9) and got[1]["stream_after_s"] == pytest.approx(0.5)
