"""Registered queries over long recordings, model outputs, detector arms and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import outputs, ratio
from ..operators import arms, counters, recordings, resampling, word_loss
from ..sources import answers
from ..streaming import coupled
from . import tables as src
from .queries import LENS, edits_sql, query, rounded


# -- long recordings -------------------------------------------------------------------------------------------


def scored(spark: SparkSession, d: str, variant: int = 0, window_words: int = 60) -> recordings.Scored:
    return recordings.Scored(src.recordings(spark, d), src.recorded_answers(spark, d, variant), window_words)


RECORDED_SQL = edits_sql(f"""c AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id + turn) AS k, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
a AS (SELECT conv_id, turn, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 25 = 0 THEN concat_ws(' ', text, text, text, text) WHEN k % 5 = 0 THEN concat_ws(' ', text, text) WHEN k % 3 = 1 THEN replace(text, 'e', 'a') ELSE text END AS said FROM c WHERE conv_id % 4 <> 1 OR turn <= last - 2),
w AS (SELECT conv_id, turn, said, {LENS.format("coalesce(said, '')")} AS words FROM a),
n AS (SELECT conv_id, count(*) AS answers, count(*) FILTER (said IS NULL) AS failed_answers, count(*) FILTER (said IS NOT NULL AND len(words) = 0) AS empty_answers, flatten(list(words ORDER BY turn)) AS h FROM w GROUP BY conv_id),
t AS MATERIALIZED (SELECT conv_id AS id, {LENS.format("string_agg(text, ' ' ORDER BY turn)")} AS r, coalesce(any_value(h), []) AS h FROM c LEFT JOIN n USING (conv_id) GROUP BY conv_id)""")


@query("recording_scores", f"""{RECORDED_SQL}
SELECT id AS rid, ref_words, hyp_words, edits AS errors, round(100.0 * edits / nullif(ref_words, 0), 3) AS wer_pct, round(hyp_words / nullif(ref_words, 0), 4) AS hyp_over_ref,
  coalesce(answers, 0)::BIGINT AS answers, coalesce(failed_answers, 0)::BIGINT AS failed_answers, coalesce(empty_answers, 0)::BIGINT AS empty_answers FROM edits LEFT JOIN n ON n.conv_id = id""")
def recording_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words, edits and answers of every recording."""
    return scored(spark, d).summary().select("rid", "ref_words", "hyp_words", "errors", "wer_pct", "hyp_over_ref", "answers", "failed_answers", "empty_answers")


@query("recording_windows")
def recording_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every recording's windows of 60 reference words."""
    return scored(spark, d).windows()


@query("recording_answers")
def recording_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every answer against the reference words it was aligned to."""
    return scored(spark, d).by_answer().withColumn("loops", F.size("loops").cast("long"))


@query("window_interval")
def window_interval(spark: SparkSession, d: str) -> DataFrame:
    """Corpus error rate over audible windows, with its interval."""
    units = recordings.window_units(scored(spark, d).windows(), audible=True).withColumn("run", F.lit("a"))
    return resampling.ratio_interval(units, ["run"], ["rid", "window"], 2000, 20261110).drop("run")


@query("window_delta")
def window_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two models' error rates over the windows that both heard, and the interval of their difference."""
    units = recordings.shared_units(scored(spark, d).windows(), scored(spark, d, 1).windows(), audible=True)
    return resampling.paired_interval(units, ["rid", "window"], 2000, 20261110).withColumn("verdict", ratio.verdict("lo", "hi"))


# -- model outputs and coupled sessions ------------------------------------------------------------------------


@query("model_outputs", r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations),
b AS (SELECT *, conv_id % 3 = 0 AND last AND regexp_matches(right(text, 12), '^[A-Za-z .]{12}$') AS broken FROM t),
s AS (SELECT conv_id, turn, broken, trim(regexp_replace(CASE WHEN broken THEN left(text, length(text) - 9) ELSE text END, '\s+', ' ', 'g')) AS said FROM b),
w AS (SELECT conv_id, turn, said, CASE WHEN NOT broken THEN 'S0' || (turn % 2) END AS speaker, CASE WHEN NOT broken THEN turn * 10 + CASE WHEN conv_id % 3 = 1 THEN 0.25 ELSE 0 END END AS start_s,
  CASE WHEN NOT broken THEN turn * 10 + CASE WHEN conv_id % 3 = 1 THEN 9.25 ELSE 9.5 END END AS end_s FROM s WHERE conv_id % 3 <> 2 AND said <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, speaker, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s, said AS text FROM w
UNION ALL SELECT conv_id, 0, NULL, NULL, NULL, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\s+', ' ', 'g')) FROM t WHERE conv_id % 3 = 2 GROUP BY conv_id""")
def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Turns of all outputs, or their text where the format carries none."""
    read = src.model_outputs(spark, d).select("conv_id", outputs.parsed("raw", "form").alias("o"))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.col("o.text").alias("text")))
    turns = read.select("conv_id", F.posexplode(F.when(F.size("o.turns") > 0, F.col("o.turns")).otherwise(plain)).alias("ord", "t"))
    return turns.select("conv_id", F.col("ord").cast("long").alias("ord"), "t.speaker", "t.start_s", "t.end_s", "t.text")


@query("coupled_latency", """
WITH l AS (SELECT event_type AS session, event_id AS idx, value / 100 AS stream_after_s, event_id % 41 <> 0 AND event_id % 53 <> 0 AS stream_ok, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS edits FROM events),
p AS (SELECT l.*, (event_id % 17) / 10 AS final_after_s, event_id % 13 <> 0 AS final_ok FROM l JOIN events ON event_id = idx WHERE event_id % 5 <> 0)
SELECT session, count(*) AS utterances, count(*) FILTER (NOT stream_ok) AS stream_empty, count(*) FILTER (NOT final_ok) AS final_errors,
  round(100.0 * sum(edits) FILTER (stream_ok AND final_ok) / (3 * count(*) FILTER (stream_ok AND final_ok)), 3) AS stream_vs_final_wer_pct,
  round(quantile_cont(stream_after_s, 0.5) FILTER (stream_ok), 5) AS stream_p50, round(quantile_cont(stream_after_s, 0.95) FILTER (stream_ok), 5) AS stream_p95,
  round(quantile_cont(final_after_s, 0.5) FILTER (final_ok), 5) AS final_p50, round(quantile_cont(final_after_s, 0.95) FILTER (final_ok), 5) AS final_p95, false AS within_threshold FROM p GROUP BY session""")
def coupled_latency(spark: SparkSession, d: str) -> DataFrame:
    """Live and batch answers of all events by session: latencies after speech, failures, and how far the texts differ."""
    out = coupled.coupled_summary(coupled.couple(*src.coupled_pairs(spark, d)), ["session"])
    return rounded(out, "stream_p50", "stream_p95", "final_p50", "final_p95", places=5).drop("stream_p99", "final_p99")


# -- detector arms ---------------------------------------------------------------------------------------------

ARMS_SQL = """
WITH e AS (SELECT user_id % 16 AS track, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS frame, value, event_id, event_type IN ('purchase', 'click') AS target, event_type = 'view' AS xt FROM events),
s AS (SELECT 'values' AS arm, track, frame, value / 100 AS score, target, xt FROM e UNION ALL SELECT 'places', track, frame, (event_id * 37 % 100) / 100, target, xt FROM e),
t AS (SELECT k / 10 AS threshold, round(k / 10 - 0.15, 2) AS off FROM (SELECT unnest(range(1, 10)) AS k)),
h AS (SELECT arm, threshold, track, target, xt, coalesce(last_value(CASE WHEN score >= threshold THEN true WHEN score < off THEN false END IGNORE NULLS) OVER (PARTITION BY arm, threshold, track ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS sent FROM s, t),
c AS (SELECT arm, threshold, count(*) / 100 AS d, count(*) FILTER (target) AS sp, count(*) FILTER (target AND NOT sent) AS mi, count(*) FILTER (NOT target) AS ns, count(*) FILTER (NOT target AND sent) AS fa, count(*) FILTER (sent) AS se,
  count(*) FILTER (xt) AS x, count(*) FILTER (xt AND sent) AS xs FROM h GROUP BY 1, 2),
p AS (SELECT arm, threshold, 100 * avg(CASE WHEN share > 0.6 THEN 1 ELSE 0 END) AS dense FROM (SELECT arm, threshold, track, count(*) FILTER (sent) / count(*) AS share FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2),
curve AS (SELECT arm, threshold, round(100.0 * mi / sp, 3) AS missed_pct, round(100.0 * fa / ns, 3) AS false_alarm_rate_pct, round(fa / 100 / (d / 3600), 1) AS false_alarm_s_per_h, round(100.0 * xs / x, 3) AS crosstalk_sent_pct,
  round(100.0 * se / (100 * d), 3) AS sent_share_pct, round(dense, 1) AS dense_track_share_pct FROM c JOIN p USING (arm, threshold))"""


def arms_curve(spark: SparkSession, d: str) -> DataFrame:
    scores, thresholds, tracks, labels = src.detector_runs(spark, d)
    return arms.curve(arms.track_counts(arms.sweep(scores, thresholds, tracks), labels, tracks, thresholds))


@query("arms_sweep", f"{ARMS_SQL} SELECT * FROM curve")
def arms_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every arm at every threshold, in one pass over the scores."""
    return arms_curve(spark, d).select("arm", "threshold", "missed_pct", "false_alarm_rate_pct", "false_alarm_s_per_h", "crosstalk_sent_pct", "sent_share_pct", "dense_track_share_pct")


@query("arms_compared", f"""{ARMS_SQL}, k AS (SELECT 'at_reference_fa' AS pick, false_alarm_rate_pct AS most_pct FROM curve WHERE arm = 'values' AND threshold = 0.5 UNION ALL VALUES ('at_fa_5pct', 5.0), ('at_fa_10pct', 10.0), ('at_fa_20pct', 20.0))
SELECT arm, pick, most_pct, threshold, missed_pct, false_alarm_rate_pct FROM curve JOIN k ON false_alarm_rate_pct <= most_pct + 1e-9
QUALIFY row_number() OVER (PARTITION BY arm, pick ORDER BY missed_pct, false_alarm_rate_pct, threshold) = 1""")
def arms_compared(spark: SparkSession, d: str) -> DataFrame:
    """Both arms at no more false alarm than the first one at its default, and than fixed rates."""
    defaults = spark.createDataFrame([("values", 0.5), ("places", 0.5)], "arm string, threshold double")
    return arms.compared(arms_curve(spark, d), defaults, "values").select("arm", "pick", "most_pct", "threshold", "missed_pct", "false_alarm_rate_pct")


# -- word loss and counters ------------------------------------------------------------------------------------


@query("word_loss")
def lost_words(spark: SparkSession, d: str) -> DataFrame:
    """Two arms on all conversations: own words lost and foreign words let in, track by track; odd turns are a partner's that leaks."""
    c = src.table(spark, d, "conversations")
    said = c.select(F.col("conv_id").alias("track"), F.when(F.col("turn") % 2 == 0, "own").otherwise("leak").alias("role"), (10.0 * F.col("turn")).alias("start_s"), "text")
    sent = lambda arm, variant: src.recorded_answers(spark, d, variant).select(F.lit(arm).alias("arm"), F.col("rid").alias("track"), "index", "text", (F.col("source_end") - F.col("source_start")).alias("sent_s"))
    return word_loss.word_loss(said, sent("plain", 0).unionByName(sent("plain+xt", 1).where("index % 2 = 0")))


COUNTERS_SQL = """
WITH s AS (SELECT event_type AS grp, user_id % 8 AS member, dense_rank() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS tick, epoch_us(date_trunc('day', ts)) / 1e6 AS sec, event_id FROM events),
c AS (SELECT grp, member, tick, min(sec) AS sec, CASE WHEN member = 3 AND tick % 5 = 0 THEN 0.0 ELSE max(event_id) * 40.0 END AS cpu_s FROM s GROUP BY 1, 2, 3),
t AS (SELECT grp, tick + 1 AS tick, min(sec) AS before FROM c GROUP BY 1, 2),
l AS (SELECT *, lag(cpu_s) OVER w AS was, lag(tick) OVER w AS last FROM c WINDOW w AS (PARTITION BY grp, member ORDER BY tick))
SELECT grp, tick, round(sum(100.0 * greatest(cpu_s - was, 0) / (sec - before)), 1) AS sum_pct, round(max(100.0 * greatest(cpu_s - was, 0) / (sec - before)), 1) AS max_pct FROM l JOIN t USING (grp, tick) WHERE last = tick - 1 GROUP BY 1, 2"""


@query("group_load", COUNTERS_SQL)
def group_load(spark: SparkSession, d: str) -> DataFrame:
    """Events as counters of eight threads a group, sampled once a day, with resets: their load of one core."""
    day = F.date_trunc("day", F.col("ts"))
    e = src.table(spark, d, "events").select(F.col("event_type").alias("grp"), (F.col("user_id") % 8).alias("member"), day.alias("day"), src.seconds("date_trunc('day', ts)::timestamp_ntz").alias("at"), "event_id")
    days = e.select("grp", "day").distinct().withColumn("tick", F.row_number().over(Window.partitionBy("grp").orderBy("day")).cast("long"))
    rows = e.join(days, ["grp", "day"]).groupBy("grp", "member", "tick").agg(F.min("at").alias("at"), F.max("event_id").alias("_e"))
    cpu = F.when((F.col("member") == 3) & (F.col("tick") % 5 == 0), 0.0).otherwise(F.col("_e") * 40.0)
    return counters.group_load(rows.withColumn("cpu_s", cpu), "grp", "member", "tick", "at", "cpu_s")


@query("hosted_answers", """
SELECT user_id, event_id * 250 / 1000.0 AS start, (event_id * 250 + 200) / 1000.0 AS "end", CASE WHEN user_id % 5 < 2 THEN 'speaker_' ELSE '' END || event_type AS speaker, NULL::VARCHAR AS refused FROM events WHERE event_id % 7 <> 0 AND user_id % 5 < 4
UNION ALL SELECT DISTINCT user_id, NULL, NULL, NULL, 'no JSON' FROM events WHERE user_id % 5 = 4""")
def hosted_answers(spark: SparkSession, d: str) -> DataFrame:
    """Spans of answers of two shapes, and why others are refused."""
    read = answers.answer_spans(src.hosted_answers(spark, d))
    return read.select("user_id", F.explode_outer("spans").alias("s"), "refused").select("user_id", "s.start", "s.end", "s.speaker", "refused")
