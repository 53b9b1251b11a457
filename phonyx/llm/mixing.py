"""Mixing sources to token targets by entropy balancing.

The mix keeps every document's rate as close (in relative entropy, weighted
by tokens) to one as the token constraints allow. A constraint gives a target
for the tokens of one source, or of one value of another column; constraints
of different columns overlap. The dual of that problem is convex in one
multiplier for each constraint, and its solution gives a document the rate
exp(sum of the multipliers of the constraints it falls under): an exponential
tilt. Damped Newton steps find the multipliers: gradient and Hessian are sums
over the distinct constraint patterns of the documents, aggregated by Spark.
Sources exclude each other, so their part of the Hessian is diagonal and is
eliminated row by row however many there are; what is left is a small dense
system of the other columns' constraints, at most `MOST_SHARED` of them.

Rates are then rounded into whole copies. Within a pattern every document gets
the whole part of its rate; the fractional part decides how many words are
repeated once more, and those go to the documents first in a hashed order,
large documents first and small ones after them, so that the sum misses the
pattern's words by about half a small document at most.

Everything here is DataFrame expressions; the driver sees one small system and
two numbers a step. Null text has size 0 and is taken zero words of; null
sources form one source, last in order; a constraint with target zero, or
without words, takes nothing. Repeated rows are documents of their own (rows
equal in id and text are rounded in any order among themselves). Texts count
whole. Extra columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, global_rank, materialize, table, unused

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Of the hashed order in which documents are repeated once more.
SEED = 7
#: First bits of the hash that cut that order into coarse cells.
CELL_BITS = 12
#: Constraints of other columns than the source, all together.
MOST_SHARED = 128


def capped_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source_size, weight) with `target`: shares of `share` of all words by weight, none over `cap` times its source.

    A source at its cap is left out and the excess shared again among the
    others by weight, until no share is over its cap. What is at its cap
    depends on one number, the share per unit of weight, which is all that
    the driver sees.
    """
    s, w = F.col("source_size").cast("double"), F.col("weight").cast("double")
    total = sources.agg(F.sum(s)).first()[0] or 0.0
    level, before = 0.0, -1
    while True:
        over = (s * cap) < w * F.lit(level)
        capped, free, n = sources.agg(
            F.coalesce(F.sum(F.when(over, s * cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(over, 0.0).otherwise(w)), F.lit(0.0)),
            F.count_if(over),
        ).first()
        if n == before or not free:
            break
        level, before = (total * share - capped) / free, n
    return sources.withColumn("target", F.least(s * cap, w * F.lit(level)))


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system, by elimination; a direction in which the matrix is flat gets zero."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    flat = 1e-10 * max([1e-300, *(abs(matrix[i][i]) for i in range(n))])
    pivots: list[int] = []
    for c in range(n):
        pivot = max((i for i in range(n) if i not in pivots), key=lambda i: abs(rows[i][c]))
        if abs(rows[pivot][c]) <= flat:
            continue
        pivots.append(pivot)
        for i in range(n):
            if i != pivot and rows[i][c]:
                by = rows[i][c] / rows[pivot][c]
                rows[i] = [x - by * y for x, y in zip(rows[i], rows[pivot])]
        rows[pivot] = [*rows[pivot][:c], rows[pivot][c], *rows[pivot][c + 1 :]]
    out = [0.0] * n
    for i in pivots:
        c = next(k for k in range(n) if abs(rows[i][k]) > flat)
        out[c] = rows[i][n] / rows[i][c]
    return out


#: Steps without progress after which targets count as not to be met.
PATIENCE = 10
#: What a pattern at the cap counts in the Hessian: on 200 random problems 0.3 met all targets, 0.001 those of 180.
AT_CAP = 0.3


def balance(patterns: DataFrame, shared: list[float], cap: float = math.inf, steps: int = 200, tolerance: float = 1e-11) -> DataFrame:
    """patterns with `rate`, the exponential tilt that meets all targets, no rate above `cap`.

    patterns: (cell, mass, target, under), a row for each constraint pattern.
    `mass` counts its words, `target` is that of all patterns of its cell (the
    source), and `under` lists the numbers of the other constraints that it
    falls under, whose targets are `shared`. A Newton step of the dual solves
    H x = g with g = words under the tilt - targets. With D the diagonal
    of the cells, the step of the shared constraints is that of the Schur
    complement S = H22 - H21 D^-1 H12, and each cell's step follows from it.
    Steps are shortened to one unit of any multiplier. The cap is part of the
    problem: a rate is the lesser of its tilt and the cap, and a pattern at the
    cap counts three tenths in H, which keeps steps short. Targets that no rates
    meet together are met until the worst miss has not shrunk for some steps.
    """
    zero = [j for j, t in enumerate(shared) if not t > 0]
    none = F.exists("under", lambda j: j.isin(zero)) if zero else F.lit(False)
    possible = (F.col("target") > 0) & (F.col("mass") > 0) & ~none
    state = patterns.withColumn("mass", F.when(possible, F.col("mass")).otherwise(0).cast("double")).withColumn("own", F.lit(0.0)).withColumn("all", F.lit(0.0))
    live = [j for j in range(len(shared)) if j not in zero]
    multipliers = {j: 0.0 for j in live}
    # Targets of the sources alone are within the cap of themselves (`capped_targets`).
    cap = cap if live else math.inf
    cell, kept, lowest, stale = Window.partitionBy("cell"), None, math.inf, 0
    tilted = F.col("mass") * F.least(F.exp("all"), F.lit(cap))
    in_cell = F.sum(tilted).over(cell)
    in_h = F.sum("_h").over(cell)
    for _ in range(steps):
        move = {j: 0.0 for j in live}
        weighed = state.withColumn("_w", tilted).withColumn("_in_cell", in_cell)
        weighed = weighed.withColumn("_h", F.when(F.col("all") < math.log(cap), F.col("_w")).otherwise(AT_CAP * F.col("_w")))
        if live:
            seen = materialize(weighed.where("mass > 0").select("cell", F.col("_w").alias("w"), F.col("_h").alias("h"), in_h.alias("d"), (F.col("_in_cell") - F.col("target")).alias("g0"), "under"), "newton")
            by = seen.select("cell", "d", "g0", "w", "h", F.explode("under").alias("j")).groupBy("cell", "j").agg(F.sum("w").alias("w"), F.sum("h").alias("h"), F.nullif(F.first("d"), F.lit(0.0)).alias("d"), F.first("g0").alias("g0"))
            right = {r["j"]: r["g"] - shared[r["j"]] - r["less"] for r in by.groupBy("j").agg(F.sum("w").alias("g"), F.coalesce(F.sum(F.col("h") * F.col("g0") / F.col("d")), F.lit(0.0)).alias("less")).collect()}
            other = by.select("cell", F.col("j").alias("k"), F.col("h").alias("h2"))
            minus = by.join(other, "cell").groupBy("j", "k").agg(F.coalesce(F.sum(-F.col("h") * F.col("h2") / F.col("d")), F.lit(0.0)).alias("x"))
            plus = seen.select("h", "under", F.explode("under").alias("j")).select("h", "j", F.explode("under").alias("k")).groupBy("j", "k").agg(F.sum("h").alias("x"))
            system = {(r["j"], r["k"]): r["x"] for r in plus.unionByName(minus).groupBy("j", "k").agg(F.sum("x").alias("x")).collect()}
            use = sorted(right)
            move.update(zip(use, solved([[system.get((j, k), 0.0) for k in use] for j in use], [right[j] for j in use])))
            discard(seen)
        # What the shared multipliers' step does to a pattern, and the cell's own step beside it.
        lean = F.aggregate("under", F.lit(0.0), lambda acc, j: acc + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for j_ in live for x in (j_, move[j_])]), j), F.lit(0.0))) if live else F.lit(0.0)
        step = F.coalesce((F.col("_in_cell") - F.col("target") - F.sum(F.col("_h") * lean).over(cell)) / F.nullif(in_h, F.lit(0.0)), F.lit(0.0))
        off = F.when(F.col("_in_cell") > 0, F.abs(F.col("_in_cell") - F.col("target")) / F.col("target"))
        moved = materialize(weighed.withColumn("lean", lean).withColumn("step", step).withColumn("off", off).drop("_w", "_h", "_in_cell"), "dual")
        longest, off = moved.agg(F.max(F.abs("step")), F.max("off")).first()
        longest = max([longest or 0.0, *map(abs, move.values())])
        off = max([off or 0.0, *(abs(right.get(j, 0.0)) / shared[j] for j in live)])
        short = min(1.0, 1.0 / longest) if longest else 1.0
        multipliers = {j: multipliers[j] - short * move[j] for j in live}
        lowest, stale = (off, 0) if off < 0.999 * lowest else (lowest, stale + 1)
        old, kept = kept, moved
        state = moved.withColumn("own", F.col("own") - short * F.col("step")).withColumn("all", F.col("all") - short * (F.col("step") + F.col("lean"))).drop("lean", "step", "off")
        if old is not None:
            discard(old)
        if off < tolerance or short * longest < tolerance or stale >= PATIENCE:
            break
    return state.withColumn("rate", F.when(F.col("mass") > 0, F.least(F.exp("all"), F.lit(cap))).otherwise(0.0)).drop("own", "all")


def unmet(tilted: DataFrame, shared: list[float]) -> DataFrame:
    """tilted (cell, mass, target, under, rate) with `unmet`: by how many words the targets that a pattern counts for are missed at most; 0 for less than a millionth."""
    words = F.col("mass") * F.col("rate")
    met = {r["j"]: r["w"] for r in tilted.select(words.alias("w"), F.explode("under").alias("j")).groupBy("j").agg(F.sum("w").alias("w")).collect()} if shared else {}
    off = lambda t, w: F.when(F.abs(t - w) > 1e-6 * t, F.abs(t - w)).otherwise(0.0)
    own = off(F.col("target"), F.sum(words).over(Window.partitionBy("cell")))
    return tilted.withColumn("unmet", F.greatest(own, *[F.when(F.array_contains("under", j), off(F.lit(float(t)), F.lit(float(met.get(j, 0.0))))).otherwise(0.0) for j, t in enumerate(shared)]) if shared else own)


def running(df: DataFrame, group: list[str], amount: str, order: list[str], bucket: str, out: str) -> DataFrame:
    """df with the sum of `amount` over the rows of its group that come earlier, in two levels.

    `bucket` is a coarse prefix of the order, so that a group with a third of
    all rows is summed in many tasks: sums of whole buckets first, then
    within each bucket.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_in"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in (*group, bucket)], F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_base"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, bucket)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    based = df.join(offsets, on, "left").drop(*[f"_{c}" for c in (*group, bucket)])
    return based.withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_base")


def hashed_order(doc_id: Column, text_hash: Column, seed: int) -> list[Column]:
    """Coarse cell and place of a row in the hashed order; cells are ranges of it."""
    place = F.xxhash64(F.lit(seed), doc_id, text_hash)
    return [F.shiftright(place, 64 - CELL_BITS).cast("int").alias("_bucket"), place.alias("_hash")]


def copies(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """sized (doc_id, pattern, size, text_hash, pattern_size, pattern_rows, rate) with `copies`, the whole number of times it is taken."""
    large = F.col("size") * F.col("pattern_rows") > F.col("pattern_size")
    placed = sized.select("*", F.floor("rate").alias("_whole"), large.alias("_large"), *hashed_order(F.col("doc_id"), F.col("text_hash"), seed))
    upto = running(placed, ["pattern", "_large"], "size", ["_hash", "doc_id", "text_hash"], "_bucket", "_upto")
    upto = materialize(upto, "rounding")
    # Words to repeat once more: first from the large documents, in proportion; the small ones make up what is left.
    extra = (F.col("rate") - F.col("_whole")) * F.col("pattern_size")
    half = F.col("size") / F.lit(2.0)
    large_goal = extra * F.col("large_size") / F.col("pattern_size")
    goals = upto.groupBy("pattern").agg(F.sum(F.when(F.col("_large"), F.col("size")).otherwise(0)).alias("large_size"))
    # A row for each pattern: written out, so that Spark sees their size and need not deal the documents by pattern.
    goals = materialize(goals, "goals")
    with_goal = upto.join(goals, "pattern").withColumn("_large_goal", large_goal)
    took = with_goal.where("_large").groupBy("pattern").agg(
        F.sum(F.when(F.col("_upto") + half <= F.col("_large_goal"), F.col("size")).otherwise(0)).alias("large_taken")
    )
    settled = with_goal.join(materialize(took, "large-taken"), "pattern", "left").withColumn("_small_goal", extra - F.coalesce("large_taken", F.lit(0)))
    goal = F.when(F.col("_large"), F.col("_large_goal")).otherwise(F.col("_small_goal"))
    once_more = F.when((F.col("size") > 0) & (F.col("_upto") + half <= goal), 1).otherwise(0)
    return settled.withColumn("copies", (F.col("_whole") + once_more).cast("long"))


def same(keys: list[str], other: str = "_") -> Column:
    """Null-safe equality of columns with their namesakes under a prefix."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(other + c))
    return on


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, also: Mapping[str, Mapping[object, float]] | None = None) -> DataFrame:
    """Sizes, source targets, tilted rates and copies of every document (without its text).

    `also` gives constraints beside the sources': for a column, which share of
    the mix documents with a value shall have; values not named are free. No
    rate is above `cap`; `unmet` tells by how many words the targets that a
    document counts for are missed at most, where no rates meet them all.
    """
    also = also or {}
    others = [c for c in also if c != "source"]
    sizes = materialize(
        docs.select(
            "doc_id", "source", *[F.col(c).alias(f"also{i}") for i, c in enumerate(others)],
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ),
        "sizes",
    )
    keys = ["source", *(f"also{i}" for i in range(len(others)))]
    per_pattern = materialize(sizes.groupBy(*keys).agg(F.sum("size").alias("pattern_size"), F.count("*").alias("pattern_rows")), "patterns")
    per_source = per_pattern.groupBy("source").agg(F.sum("pattern_size").alias("source_size"))
    # Names by code point, null last.
    named = per_source.withColumn("_last", F.col("source").isNull().cast("int"))
    ranked = global_rank(named, ["_last", "source"], "_rank", "sources").drop("_last")
    table_of = F.array(*[F.lit(w) for w in weights])
    weighted = materialize(ranked.withColumn("weight", F.element_at(table_of, (F.col("_rank") % len(weights) + 1).cast("int"))), "weights")
    targets = capped_targets(weighted, share, cap).select(F.col("source").alias("_source"), F.col("_rank").alias("cell"), "source_size", "target")
    under, shared = [], []
    if others:
        total = targets.agg(F.sum("target")).first()[0] or 0.0
        for i, c in enumerate(others):
            number = F.lit(None).cast("int")
            for value, part in also[c].items():
                number = F.when(F.col(f"also{i}").eqNullSafe(F.lit(value)), len(shared)).otherwise(number)
                shared.append(part * total)
            under.append(number)
    if len(shared) > MOST_SHARED:
        raise ValueError(f"at most {MOST_SHARED} constraints beside those of the sources")
    placed = per_pattern.join(targets, same(["source"])).drop("_source").withColumn("mass", F.col("pattern_size"))
    placed = placed.withColumn("under", F.filter(F.array(*under), lambda j: j.isNotNull()) if under else F.array().cast("array<int>"))
    tilted = balance(placed.withColumn("pattern", F.xxhash64(*keys)), shared, cap)
    tilted = unmet(tilted, shared)
    rates = tilted.select(
        *[F.col(k).alias(f"_{k}") for k in keys], "pattern", "pattern_size", "pattern_rows", "source_size", "target", "rate", "unmet",
    )
    # Multipliers are found to about 1e-11; a rate that close to a whole number is that number.
    rates = materialize(rates.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))), "rates")
    return copies(sizes.join(rates, same(keys)).drop(*[f"_{k}" for k in keys]))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with every row as often as the mix takes it; rows taken zero times go.

    What `copies` repeats once more is a prefix of each source's hashed order,
    so one cut per source and size class is enough to decide on a row where
    its text stands, and no text is shuffled. Documents without words have no
    part in the mix and go. Rows equal to the one at a cut count like it.
    """
    decided = mix(docs, weights, share, cap)
    key = F.struct("_bucket", "_hash", F.coalesce("doc_id", F.lit(0)).alias("d"), "text_hash")
    cut_of = lambda large: F.max(F.when((F.col("_large") == large) & (F.col("copies") > F.col("_whole")), key))
    source, whole, size_of, rows_of, large_cut, small_cut, copy = unused(docs.columns, 7)
    cuts = materialize(decided.groupBy("source").agg(
        F.first("_whole").alias(whole), F.first("pattern_size").alias(size_of), F.first("pattern_rows").alias(rows_of), cut_of(True).alias(large_cut), cut_of(False).alias(small_cut),
    ).withColumnRenamed("source", source), "cuts")
    rows = docs.join(cuts, F.col("source").eqNullSafe(F.col(source)), "left")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    text_hash = F.xxhash64("text")
    own = F.struct(*hashed_order(F.col("doc_id"), text_hash, SEED), F.coalesce("doc_id", F.lit(0)).alias("d"), text_hash.alias("text_hash"))
    cut = F.when(size * F.col(rows_of) > F.col(size_of), F.col(large_cut)).otherwise(F.col(small_cut))
    times = F.when(size > 0, F.col(whole) + F.coalesce((own <= cut).cast("int"), F.lit(0))).otherwise(0).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).drop(source, whole, size_of, rows_of, large_cut, small_cut, copy)


def op7(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies",
    )
