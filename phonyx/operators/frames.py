"""Frame grids, hysteresis, moving statistics, detector curves and cross-talk, on rows (track, frame, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import buckets_by_value, running

#: Seconds a frame.
HOP = 0.01


def n_frames(duration: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(duration / HOP - 1e-9)).cast("long")


def frame_range(start: Column, end: Column, n: Column) -> Column:
    """Frames whose centre lies in [start, end), as an array; none for an empty stretch."""
    first = F.greatest(F.lit(0), F.ceil(start / HOP - 0.5)).cast("long")
    last = F.least(n, F.ceil(end / HOP - 0.5).cast("long"))
    return F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))


def to_grid(intervals: DataFrame, track: str = "track") -> DataFrame:
    """(track, frame): frames that some interval (track, start, end, n: frames of the track) covers, each once."""
    return intervals.select(track, F.explode(frame_range(F.col("start"), F.col("end"), F.col("n"))).alias("frame")).distinct()


def hold_at(hop_s: float, frame: Column, n_source: Column) -> Column:
    """Source frame (hop_s seconds each) that holds at a grid frame's centre; the last one holds on."""
    return F.least(n_source - 1, F.floor((frame + 0.5) * HOP / hop_s))


def hysteresis(rows: DataFrame, track: str, along: str, value: str, on: float, off: float) -> DataFrame:
    """rows with `active`: begins at a value of at least `on`, ends below `off`, stays in between."""
    if off > on:
        raise ValueError("off must not be above on")
    event = F.when(F.col(value) >= on, True).when(F.col(value) < off, False)
    past = Window.partitionBy(track).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("active", F.coalesce(F.last(event, True).over(past), F.lit(False)))


def islands(rows: DataFrame, track: str, frame: str, active: str) -> DataFrame:
    """(track, first, last) of runs of consecutive active frames."""
    run = F.col(frame) - F.row_number().over(Window.partitionBy(track).orderBy(frame))
    return rows.where(F.col(active)).withColumn("_run", run).groupBy(track, "_run").agg(F.min(frame).alias("first"), F.max(frame).alias("last")).drop("_run")


def trailing_average(value: str, track: str, along: str, window: int) -> Column:
    return F.avg(value).over(Window.partitionBy(track).orderBy(along).rowsBetween(1 - window, 0))


def centred_sum_over(value: str, track: str, along: str, window: int) -> Column:
    """Centred moving sum divided by the full window, also at the ends, where zeros stand in."""
    return F.sum(value).over(Window.partitionBy(track).orderBy(along).rowsBetween(-(window // 2), window // 2)) / window


def rolling_correlation(a: str, b: str, track: str, along: str, window: int) -> Column:
    """Pearson correlation over a centred window, cut at the ends; 0 where a side hardly varies."""
    w = Window.partitionBy(track).orderBy(along).rowsBetween(-(window // 2), window // 2)
    mean = lambda x: F.avg(x).over(w)
    cov = mean(F.col(a) * F.col(b)) - mean(F.col(a)) * mean(F.col(b))
    va, vb = (F.greatest(mean(F.col(x) * F.col(x)) - mean(F.col(x)) * mean(F.col(x)), F.lit(0.0)) for x in (a, b))
    den = F.sqrt(va * vb)
    return F.when(den > 1e-9, cov / den).otherwise(0.0)


def veto(own: DataFrame, partners: DataFrame, min_lead_db: float = 10.0, min_corr: float = 0.5, window: int = 100) -> DataFrame:
    """(track, frame, vetoed): frames where a partner of the meeting speaks, is louder by the lead and moves alike.

    own, partners: (meeting, track, frame, level, speech); joined on meeting and frame, never within a track.
    """
    p = partners.select("meeting", F.col("track").alias("partner"), "frame", F.col("level").alias("p_level"), F.col("speech").alias("p_speech"))
    both = own.join(p, ["meeting", "frame"]).where(F.col("track") != F.col("partner")).withColumn("_pair", F.concat_ws("/", "track", "partner"))
    corr = rolling_correlation("level", "p_level", "_pair", "frame", window)
    hit = F.col("p_speech") & (F.col("p_level") - F.col("level") >= min_lead_db) & (corr >= min_corr)
    return both.withColumn("_hit", hit).groupBy("track", "frame").agg(F.bool_or("_hit").alias("vetoed"))


def own_speech_level(levels: DataFrame, track: str) -> DataFrame:
    """95th percentile of the levels in the track's own speech; -100 without speech."""
    return levels.groupBy(track).agg(F.coalesce(F.percentile(F.when(F.col("speech"), F.col("level")), 0.95), F.lit(-100.0)).alias("own_level"))


def frame_counts(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds and rates from frames (keys, sent, target, crosstalk)."""
    return with_rates(frames.groupBy(*keys).agg(*second_columns(lambda c: F.count_if(c) * HOP)))


def interval_counts(intervals: DataFrame, tracks: DataFrame, track: str = "track") -> DataFrame:
    """The columns of `frame_counts` from intervals (track, kind: sent, target or crosstalk, start, end) and tracks (track, n: frames), without a row for each frame.

    A frame belongs to an interval if its centre lies in it. The ends of the
    intervals on the frame grid are swept; each stretch counts its frames.
    """
    first = F.greatest(F.lit(0), F.ceil(F.col("start") / HOP - 0.5)).cast("long")
    last = F.least("n", F.ceil(F.col("end") / HOP - 0.5).cast("long"))
    kinds = ("sent", "target", "crosstalk")
    on_grid = intervals.where(F.col("kind").isin(*kinds)).join(tracks, track).select(track, "kind", first.alias("f"), last.alias("l")).where("l > f")
    ends = on_grid.select(track, "kind", F.explode(F.array(F.struct(F.col("f").alias("t"), F.lit(1).alias("d")), F.struct(F.col("l").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    whole = tracks.select(track, F.lit(None).cast("string").alias("kind"), F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("t"), F.lit(0).alias("d"))
    marks = ends.select(track, "kind", "e.t", "e.d").unionByName(whole).groupBy(track, "t").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"d_{k}") for k in kinds])
    along = Window.partitionBy(track).orderBy("t")
    swept = marks.select(track, "t", F.lead("t").over(along).alias("until"), *[(F.sum(f"d_{k}").over(along.rowsBetween(Window.unboundedPreceding, 0)) > 0).alias(k) for k in kinds])
    length = F.coalesce(F.col("until") - F.col("t"), F.lit(0))
    seconds = lambda c: F.sum(F.when(c, length).otherwise(0)) * HOP
    return with_rates(swept.groupBy(track).agg(*second_columns(seconds)))


def second_columns(seconds: Callable[[Column], Column]) -> list[Column]:
    """Seconds by what is sent, spoken and cross-talk, given how seconds of a condition are summed."""
    sent, target = F.col("sent"), F.col("target")
    xt = F.col("crosstalk") & ~target
    return [
        seconds(F.lit(True)).alias("duration_s"), seconds(target).alias("speech_s"), seconds(target & ~sent).alias("missed_s"), seconds(~target).alias("nonspeech_s"),
        seconds(~target & sent).alias("false_alarm_s"), seconds(sent).alias("sent_s"), seconds(xt).alias("crosstalk_s"), seconds(xt & sent).alias("crosstalk_sent_s"),
    ]


def with_rates(totals: DataFrame) -> DataFrame:
    """Rates in percent from summed seconds; null where there is nothing to divide by."""
    pct = lambda a, b: F.round(100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 3)
    return totals.withColumns({
        "missed_pct": pct("missed_s", "speech_s"), "false_alarm_rate_pct": pct("false_alarm_s", "nonspeech_s"),
        "sent_share_pct": pct("sent_s", "duration_s"), "crosstalk_sent_pct": pct("crosstalk_sent_s", "crosstalk_s"),
    })


def roc_auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """(auc,): the Mann-Whitney statistic with average ranks, from counts of the different scores.

    Scores are first counted by value; ranks are running sums over ranges of
    values, so equal scores need no rows of their own and no task has them all.
    """
    counted = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(label).alias("p"))
    summed = running(counted, [], buckets_by_value(counted, score), [score], {"before": (F.sum, "n")}, before=True)
    ranked = summed.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    p, n = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return ranked.agg(F.when((p > 0) & (n > 0), (F.sum(F.col("rank") * F.col("p")) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def pipeline_auc(curve: DataFrame) -> DataFrame:
    """(auc,) under the upper envelope of measured points (false_alarm_rate_pct, missed_pct), ends pinned."""
    spark = curve.sparkSession
    ends = spark.range(2).select(F.col("id").cast("double").alias("fa"), F.col("id").cast("double").alias("hit"), F.lit(False).alias("measured"))
    points = curve.where("false_alarm_rate_pct IS NOT NULL AND missed_pct IS NOT NULL").select((F.col("false_alarm_rate_pct") / 100.0).alias("fa"), (1 - F.col("missed_pct") / 100.0).alias("hit"), F.lit(True).alias("measured"))
    w = Window.orderBy("fa", "hit")  # a row for each swept setting
    envelope = points.unionByName(ends).withColumn("y", F.max("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = envelope.withColumn("area", (F.col("fa") - F.lag("fa").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2)
    return steps.agg(F.when(F.bool_or("measured"), F.sum("area")).alias("auc"))


def best_at_false_alarm(curve: DataFrame, keys: Sequence[str], most_pct: float) -> DataFrame:
    """The measured point with the least miss whose false-alarm rate is at most `most_pct`, the lower rate on ties."""
    ok = curve.where((F.col("false_alarm_rate_pct") <= most_pct + 1e-9) & F.col("missed_pct").isNotNull())
    point = F.struct(*[c for c in curve.columns if c not in keys])
    return ok.groupBy(*keys).agg(F.min_by(point, F.struct("missed_pct", "false_alarm_rate_pct")).alias("_best")).select(*keys, "_best.*")


def miss_at_frame_fpr(scores: DataFrame, score: str, label: str, fpr_pct: float) -> DataFrame:
    """(miss_pct,): positives not above the (1 - fpr) order statistic of the negatives, taken upwards."""
    negatives = scores.where(~F.col(label)).groupBy(score).agg(F.count("*").alias("n"))
    summed = running(negatives, [], buckets_by_value(negatives, score), [score], {"_upto": (F.sum, "n")})
    total = negatives.agg(F.sum("n").alias("all"))
    at = F.ceil((1 - fpr_pct / 100.0) * (F.col("all") - 1) - 1e-9) + 1
    cut = summed.join(F.broadcast(total)).where(F.col("_upto") >= at).agg(F.min(score).alias("cut"))  # one row each
    return scores.where(F.col(label)).join(F.broadcast(cut)).agg(F.round(100.0 * F.count_if(F.col(score) <= F.col("cut")) / F.nullif(F.count("*"), F.lit(0)), 3).alias("miss_pct"))


def speech_edges(frames: DataFrame, track: str, relative_db: float = 30.0, floor_db: float = -50.0, frame_s: float = 0.02) -> DataFrame:
    """First and last second within `relative_db` of a track's loudest frame and above the floor."""
    peak = F.max("level").over(Window.partitionBy(track))
    loud = frames.withColumn("_loud", (F.col("level") > F.greatest(peak - relative_db, F.lit(floor_db))))
    return loud.groupBy(track).agg((F.min(F.when(F.col("_loud"), F.col("frame"))) * frame_s).alias("onset_s"), ((F.max(F.when(F.col("_loud"), F.col("frame"))) + 1) * frame_s).alias("offset_s"))
