"""Voice detectors compared: every arm at every threshold in one sweep over the frames, and arms side by side at equal false alarm."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .scan import held

# The share of a track beyond which what is sent is called dense, and the most seconds of speech in a block.
DENSE_SHARE, BLOCK_SPEECH_S = 0.6, 30.0
#: Frames of a track that one task joins at a time.
BUCKET = 6000


def sweep(scores: DataFrame, thresholds: DataFrame, tracks: DataFrame) -> DataFrame:
    """(arm, track, threshold, first, last): islands of all arms and thresholds, in frames, the last one included.

    scores: (arm, track, frame, score), thresholds: (arm, threshold, off), tracks: (track, n: frames). An island begins at a score of at least
    the threshold and ends before one below `off`. Each frame's score is compared with the one before it once; a threshold gets a row only
    where the score crosses it, so the thresholds of a sweep do not multiply the frames.
    """
    along = Window.partitionBy("arm", "track").orderBy("frame")
    swept = thresholds.groupBy("arm").agg(F.collect_list(F.struct("threshold", "off")).alias("_swept"))  # a list for each arm
    moved = scores.withColumn("_before", F.lag("score").over(along)).join(swept, "arm")
    up = lambda t: (F.col("score") >= t["threshold"]) & (F.col("_before").isNull() | (F.col("_before") < t["threshold"]))
    down = lambda t: (F.col("score") < t["off"]) & (F.col("_before").isNull() | (F.col("_before") >= t["off"]))
    each = moved.select("arm", "track", "frame", "score", "_before", F.explode("_swept").alias("t"))  # in passing: only what crosses is sent on
    crossed = each.where(up(F.col("t")) | down(F.col("t"))).select("arm", "track", F.col("t.threshold").alias("threshold"), "frame", (F.col("score") >= F.col("t.threshold")).alias("on"))
    events = Window.partitionBy("arm", "track", "threshold").orderBy("frame")
    turns = crossed.withColumn("_was", F.lag("on", 1, False).over(events)).where(F.col("on") != F.col("_was"))
    ended = turns.withColumn("_next", F.lead("frame").over(events)).where("on").join(tracks.select("track", "n"), "track")
    return ended.select("arm", "track", "threshold", F.col("frame").alias("first"), (F.coalesce("_next", F.col("n")) - 1).alias("last"))


def stretches(labels: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track, from, until, target, crosstalk): the frames of each track cut where a label (track, kind, start, end) begins or ends."""
    first = F.greatest(F.lit(0), F.ceil(F.col("start") / frames.HOP - 0.5)).cast("long")
    last = F.least("n", F.ceil(F.col("end") / frames.HOP - 0.5).cast("long"))
    on_grid = labels.join(tracks, "track").select("track", "kind", first.alias("f"), last.alias("l")).where("l > f")
    ends = on_grid.select("track", "kind", F.explode(F.array(F.struct(F.col("f").alias("t"), F.lit(1).alias("d")), F.struct(F.col("l").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("track", "kind", "e.t", "e.d")
    whole = tracks.select("track", F.lit(None).cast("string").alias("kind"), F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("t"), F.lit(0).alias("d"))
    kinds = ("target", "crosstalk")
    marks = ends.unionByName(whole).groupBy("track", "t").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"d_{k}") for k in kinds])
    along = Window.partitionBy("track").orderBy("t")
    swept = marks.select("track", F.col("t").alias("from"), F.lead("t").over(along).alias("until"), *[(F.sum(f"d_{k}").over(along.rowsBetween(Window.unboundedPreceding, 0)) > 0).alias(k) for k in kinds])
    return swept.where("until > from")


def blocks_of(lengths: Column, most: float = BLOCK_SPEECH_S) -> Column:
    """How many blocks islands of such seconds (an array, in order) make: one is closed where the next island would take it over the most; longer islands are cut."""
    step = lambda s, x: F.struct(
        (s["blocks"] + F.when(s["filled"] + x > most, F.greatest(F.ceil(x / most), F.lit(1))).otherwise(F.when(s["filled"] == 0, 1).otherwise(0))).cast("long").alias("blocks"),
        F.when(s["filled"] + x > most, x - most * (F.greatest(F.ceil(x / most), F.lit(1)) - 1)).otherwise(s["filled"] + x).alias("filled"),
    )
    return F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("blocks"), F.lit(0.0).alias("filled")), step, lambda s: s["blocks"])


def blocks_in_order(islands: DataFrame) -> DataFrame:
    """(arm, threshold, track, blocks) by the rule of blocks_of, read off islands as they come in order: no track's are held together."""
    keys = ["arm", "threshold", "track"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, blocks, filled = None, None, 0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            named = pa.Table.from_batches([b]).select(keys)
            # Where the keys change, found on whole columns.
            codes = [pc.dictionary_encode(c, null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False) for c in named.columns]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            lengths = (pc.add(pc.subtract(b.column("last"), b.column("first")), 1).to_numpy(zero_copy_only=False) * frames.HOP).tolist()
            out = []
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                here = tuple(named.slice(first, 1).to_pylist()[0].values())
                if head is None or here != key:
                    if head is not None:
                        out.append((head, blocks))
                    key, head, blocks, filled = here, named.slice(first, 1), 0, 0.0
                for x in lengths[first:last]:
                    if filled + x > BLOCK_SPEECH_S:
                        parts = max(1, math.ceil(x / BLOCK_SPEECH_S))
                        blocks, filled = blocks + parts, x - BLOCK_SPEECH_S * (parts - 1)
                    else:
                        blocks, filled = blocks + (filled == 0), filled + x
            yield from done(out)
        if head is not None:
            yield from done([(head, blocks)])

    def done(found: list[tuple[pa.Table, int]]) -> list[pa.RecordBatch]:
        return pa.concat_tables([h.append_column("blocks", pa.array([n], pa.int64())) for h, n in found]).combine_chunks().to_batches() if found else []

    of = {f.name: f.dataType.simpleString() for f in islands.schema}
    ordered = islands.select(*keys, "first", "last").repartition(*keys).sortWithinPartitions(*keys, "first", "last")
    return ordered.mapInArrow(run, ", ".join(f"{k} {of[k]}" for k in keys) + ", blocks long")


def sent_frames(islands: DataFrame, cut: DataFrame) -> DataFrame:
    """(arm, threshold, track, sent, hit, xt): frames of the islands, those with the target, and those with cross-talk alone.

    Islands meet the labelled stretches by track and bucket of frames, so a long track is many tasks' and labels are not repeated for
    each setting. In a bucket what an island holds is the difference of running counts at its ends: no pair of the two is a row.
    """
    bucketed = lambda d, a, z: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(z) / BUCKET))))
    clipped = lambda a, z: (F.greatest(a, F.col("_b") * BUCKET).alias("a"), F.least(z, (F.col("_b") + 1) * BUCKET).alias("z"))
    own = bucketed(islands, "first", "last").select("arm", "threshold", "track", "_b", *clipped("first", F.col("last") + 1))
    kinds = bucketed(cut.withColumn("_to", F.col("until") - 1), "from", "_to").select(F.col("track").alias("_track"), F.col("_b").alias("_at"), *clipped("from", "until"), "target", (F.col("crosstalk") & ~F.col("target")).alias("xt"))

    def count(i: pa.Table, k: pa.Table) -> pa.Table:
        order = np.argsort(k["a"].to_numpy(), kind="stable")
        a, z = k["a"].to_numpy()[order], k["z"].to_numpy()[order]
        ends = {c: i[c].to_numpy() for c in "az"}
        for name, mask in (("sent", np.ones(len(a), np.int64)), ("hit", k["target"].to_numpy()[order].astype(np.int64)), ("xt", k["xt"].to_numpy()[order].astype(np.int64))):
            upto = np.append(0, np.cumsum((z - a) * mask))

            def at(p: np.ndarray) -> np.ndarray:
                place = np.searchsorted(a, p, "right") - 1
                inside = np.maximum(place, 0)
                return np.where(place < 0, 0, upto[inside] + (np.minimum(p, z[inside]) - a[inside]) * mask[inside])

            i = i.append_column(name, pa.array(at(ends["z"]) - at(ends["a"]) if len(a) else np.zeros(len(i), np.int64)))
        return i.group_by(["arm", "threshold", "track"]).aggregate([(c, "sum") for c in ("sent", "hit", "xt")]).rename_columns(["arm", "threshold", "track", "sent", "hit", "xt"])

    of = {f.name: f.dataType.simpleString() for f in islands.schema}
    met = own.groupBy("track", "_b").cogroup(kinds.groupBy("_track", "_at")).applyInArrow(count, ", ".join(f"{c} {of[c]}" for c in ("arm", "threshold", "track")) + ", sent long, hit long, xt long")
    return met.groupBy("arm", "threshold", "track").agg(*[F.sum(c).alias(c) for c in ("sent", "hit", "xt")])


def track_counts(islands: DataFrame, labels: DataFrame, tracks: DataFrame, settings: DataFrame) -> DataFrame:
    """(arm, threshold, track, seconds by kind, blocks) of every track at every setting (arm, threshold), also where nothing is sent."""
    # Both are read twice.
    cut, islands = held(stretches(labels, tracks), "stretches"), held(islands, "islands")
    sent = sent_frames(islands, cut).where("sent > 0").select(
        "arm", "threshold", "track", (F.col("sent") * frames.HOP).alias("sent_s"), (F.col("hit") * frames.HOP).alias("_hit_s"),
        ((F.col("sent") - F.col("hit")) * frames.HOP).alias("false_alarm_s"), (F.col("xt") * frames.HOP).alias("crosstalk_sent_s"),
    )
    xt = F.col("crosstalk") & ~F.col("target")
    size = F.col("until") - F.col("from")
    all_of = lambda c: (F.sum(F.when(c, size).otherwise(0)) * frames.HOP)
    whole = cut.groupBy("track").agg(all_of(F.lit(True)).alias("duration_s"), all_of(F.col("target")).alias("speech_s"), all_of(~F.col("target")).alias("nonspeech_s"), all_of(xt).alias("crosstalk_s"))
    per = blocks_in_order(islands)
    # Settings are an arm's few thresholds: each track has them all as one list.
    every = settings.select("arm", "threshold").distinct().agg(F.collect_list(F.struct("arm", "threshold")).alias("_s"))
    pairs = whole.join(F.broadcast(every)).select(*whole.columns, F.explode("_s").alias("_s")).select(*whole.columns, "_s.arm", "_s.threshold")
    out = pairs.join(sent, ["arm", "threshold", "track"], "left").join(per, ["arm", "threshold", "track"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("sent_s", "_hit_s", "false_alarm_s", "crosstalk_sent_s")}
    return out.withColumns({**zero, "blocks": F.coalesce("blocks", F.lit(0).cast("long"))}).withColumn("missed_s", F.col("speech_s") - F.col("_hit_s")).drop("_hit_s")


def curve(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row a setting (and further keys of the counts): rates over all tracks, the share of dense tracks, blocks for an hour of audio."""
    names = ("duration_s", "speech_s", "missed_s", "nonspeech_s", "false_alarm_s", "sent_s", "crosstalk_s", "crosstalk_sent_s")
    sums = counts.groupBy("arm", "threshold", *keys).agg(
        F.count("*").alias("tracks"), *[F.sum(c).alias(c) for c in names], F.sum("blocks").alias("_blocks"),
        F.round(100.0 * F.count_if(F.col("sent_s") / F.col("duration_s") > DENSE_SHARE) / F.count("*"), 1).alias("dense_track_share_pct"),
    )
    hours = F.nullif(F.col("duration_s"), F.lit(0.0)) / 3600
    return frames.with_rates(sums).withColumns({"false_alarm_s_per_h": F.round(F.col("false_alarm_s") / hours, 1), "blocks_per_audio_h": F.round(F.col("_blocks") / hours, 1)}).drop("_blocks")


def compared(curves: DataFrame, defaults: DataFrame, reference: str, points: Sequence[float] = (5.0, 10.0, 20.0)) -> DataFrame:
    """(arm, pick, most_pct, threshold, ...): each arm's setting with the least miss at no more false alarm than the reference arm has at its default, and than each point.

    defaults: (arm, threshold). One join of the curve with the picks; ties go to the lower false alarm, then to the lower threshold. An arm
    without a setting below a pick's rate has no row for it.
    """
    curves = held(curves, "curve")  # read for the reference's rate and for the settings
    at = defaults.where(F.col("arm") == reference).join(curves, ["arm", "threshold"]).select(F.lit("at_reference_fa").alias("pick"), F.col("false_alarm_rate_pct").alias("most_pct"))
    spark = curves.sparkSession
    rest = spark.createDataFrame([(f"at_fa_{p:g}pct", float(p)) for p in points], "pick string, most_pct double")
    picks = at.unionByName(rest)  # a row for each pick
    within = curves.join(F.broadcast(picks), F.col("false_alarm_rate_pct") <= F.col("most_pct") + 1e-9).where("missed_pct IS NOT NULL")
    shown = ("threshold", "missed_pct", "false_alarm_rate_pct", "false_alarm_s_per_h", "crosstalk_sent_pct", "sent_share_pct", "dense_track_share_pct", "blocks_per_audio_h")
    best = F.min_by(F.struct(*shown), F.struct("missed_pct", "false_alarm_rate_pct", "threshold"))
    return within.groupBy("arm", "pick", "most_pct").agg(best.alias("_b")).select("arm", "pick", "most_pct", "_b.*")


def cost(runs: DataFrame) -> DataFrame:
    """(arm, tracks, audio_h, cpu_s_per_audio_h) from runs (arm, track, duration_s, cpu_s); null where a run has no figure."""
    hours = F.sum("duration_s") / 3600
    return runs.groupBy("arm").agg(F.count("*").alias("tracks"), F.round(hours, 3).alias("audio_h"), F.when(F.count("cpu_s") == F.count("*"), F.round(F.sum("cpu_s") / F.nullif(hours, F.lit(0.0)), 2)).alias("cpu_s_per_audio_h"))
