"""Counters, and words lost between detector and transcript."""

from pyspark.sql import functions as F

from phonyx.operators import counters, word_loss


def test_process_text_is_read(spark):
    rows = [(1, "cpu  100 0 50 800 50 0 0 0\ncpu0 1 1 1 1\nintr 5"), (2, "intr 5\n"), (3, "cpu 10 0 5 80"), (4, None)]
    got = {x["id"]: x["t"] for x in spark.createDataFrame(rows, "id int, text string").select("id", counters.machine_times(F.col("text")).alias("t")).collect()}
    assert (got[1]["busy"], got[1]["total"]) == (150.0, 1000.0) and got[2] is None and (got[3]["busy"], got[3]["total"]) == (15.0, 95.0) and got[4] is None
    line = "12 (a (b) c d) S 1 2 3 4 5 6 7 8 9 10 250 50 0 0"
    got = [x["s"] for x in spark.createDataFrame([(line,), ("12 (x) S 1",), ("",), (None,)], "text string").select(counters.process_seconds(F.col("text")).alias("s")).collect()]
    assert got == [3.0, None, None, None]


def test_deltas_and_resets(spark):
    rows = [("a", 0.0, 5.0), ("a", 2.0, 9.0), ("a", 3.0, 1.0), ("a", 4.0, 4.0), ("b", 1.0, 7.0)]
    got = [(x["k"], x["seconds"], x["delta"], x["reset"]) for x in counters.deltas(spark.createDataFrame(rows, "k string, at double, v double"), ["k"], "at", "v").orderBy("k", "at").collect()]
    assert got[0][2] is None or got[0][2] == 0.0
    assert got[1:4] == [("a", 2.0, 4.0, False), ("a", 1.0, 0.0, True), ("a", 1.0, 3.0, False)]
    busy = counters.busy_share(spark.createDataFrame([("m", 0, 10.0, 100.0), ("m", 1, 60.0, 200.0), ("m", 2, 60.0, 200.0)], "m string, at int, busy double, total double"), ["m"], "at").collect()
    assert [(x["at"], x["busy_pct"]) for x in busy] == [(1, 50.0)]


def test_group_load_counts_members_seen_at_both_ends(spark):
    rows = [("g", 0, 0.0, "x", 1.0), ("g", 0, 0.0, "y", 1.0), ("g", 1, 2.0, "x", 2.0), ("g", 1, 2.0, "z", 9.0), ("g", 2, 4.0, "x", 1.0), ("g", 2, 4.0, "y", 3.0), ("g", 2, 4.0, "z", 10.0)]
    loads = counters.group_load(spark.createDataFrame(rows, "grp string, tick int, at double, member string, cpu double"), "grp", "member", "tick", "at", "cpu")
    assert {(x["tick"], x["sum_pct"], x["max_pct"]) for x in loads.collect()} == {(1, 50.0, 50.0), (2, 50.0, 50.0)}
    s = counters.load_summary(loads, "grp").first()
    assert (s["samplings"], s["mean_pct"], s["thread_max_pct"]) == (2, 50.0, 50.0)


def test_arm_names(spark):
    got = [tuple(x["a"]) for x in spark.createDataFrame([("base",), ("base+xt",), ("base+xt-f48",), ("a+xt-f4.5",)], "n string").select(word_loss.arm_of(F.col("n")).alias("a")).collect()]
    assert got == [("base", False, None), ("base", True, None), ("base", True, -48.0), ("a", True, -4.5)]


def test_words_lost_and_foreign(spark):
    said = [("t", "own", 5.0, "wie geht es dir denn heute so frisch"), ("t", "own", 1.0, "guten tag anna"), ("t", "leak", 2.0, "und ja und"), ("u", "own", 0.0, "ja"), ("v", "leak", 0.0, "nein")]
    blocks = [("p", "t", 1, "geht es dir denn heute so frisch und und und ja", 3.0), ("p", "t", 0, "guten tag", 2.0), ("p", "t", 2, None, 1.0), ("p", "u", 0, "ja ja", 1.0), ("q", "v", 0, "nein nein", 1.0)]
    out = word_loss.word_loss(spark.createDataFrame(said, "track string, role string, start_s double, text string"), spark.createDataFrame(blocks, "arm string, track string, index int, text string, sent_s double"))
    got = {(x["arm"], x["track"]): x for x in out.collect()}
    t = got["p", "t"]
    # anna and wie are lost; und, three times, and ja are put in, of which the partner said und twice and ja once.
    assert (t["ref_words"], t["equal"], t["delete"], t["substitute"], t["insert"], t["blocks"], t["failed_blocks"], t["sent_s"]) == (11, 9, 2, 0, 4, 3, 1, 6.0)
    assert t["foreign_insert"] == 3 and got["q", "v"]["foreign_insert"] == 1 and got["q", "v"]["ref_words"] == 0 and got["p", "u"]["foreign_insert"] == 0
    s = {x["arm"]: x for x in word_loss.loss_summary(out, ["arm"]).collect()}
    assert s["p"]["ref_words"] == 12 and s["p"]["deletion_pct"] == 16.67 and s["p"]["recognised_pct"] == 83.33 and s["q"]["deletion_pct"] == 0.0 and s["p"]["wer_pct"] == 58.33
