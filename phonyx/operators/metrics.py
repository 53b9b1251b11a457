"""Word and character error rates, runaways, BLEU, numeric entities, leaks and regions over (id, reference, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ratio import nullable_pct, ratio_pct
from .runs import align
from .scan import held

RUNAWAY_RATIO = 3.0
LEAK_NGRAM, LEAK_MAX_SHARE_PCT, LEAK_MIN_FLAGGED = 6, 2.0, 5
#: Hashes of items that go to the documents as a list.
LEAK_HASHES = 50_000


def checked(rows: DataFrame) -> DataFrame:
    """rows, or an error that names the first failed request: a subset with failures is not scored."""
    failed = F.col("prediction").isNull() | F.col("error").isNotNull()
    return rows.withColumn("prediction", F.when(failed, F.raise_error(F.concat(F.lit("failed request: "), F.col("id").cast("string")))).otherwise(F.col("prediction")))


def word_units(rows: DataFrame, reference: Column | None = None, hypothesis: Column | None = None) -> DataFrame:
    """rows with `edits`, `ref_words`, `hyp_words`; without arguments under the canonical lens."""
    ref = T.tokens(F.col("reference")) if reference is None else reference
    hyp = T.tokens(F.col("prediction")) if hypothesis is None else hypothesis
    tokened = rows.withColumn("_ref", ref).withColumn("_hyp", hyp)
    return tokened.withColumn("edits", T.word_edits(F.col("_ref"), F.col("_hyp"))).withColumn("ref_words", F.size("_ref").cast("long")).withColumn("hyp_words", F.size("_hyp").cast("long")).drop("_ref", "_hyp")


def weighed(edits: str = "edits", ref_words: str = "ref_words", hyp_words: str = "hyp_words") -> Column:
    """An utterance's own rate times its length: without words in its hypothesis it is wholly wrong, without a reference it has no weight."""
    return F.when(F.col(ref_words) == 0, 0).when(F.col(hyp_words) == 0, F.col(ref_words)).otherwise(F.col(edits)).cast("long")


def corpus_wer(units: DataFrame, keys: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    """Word error rate of all utterances; `weighted` adds the length-weighted mean of their own rates (`strict_wer_pct`)."""
    more = [nullable_pct(weighed(), "ref_words").alias("strict_wer_pct")] if weighted else []
    return units.groupBy(*keys).agg(ratio_pct("edits", "ref_words").alias("wer_pct"), F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"), F.count("*").alias("utterances"), *more)


def strict_units(rows: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """word_units under the strict lens, with `num`, the utterance's rate times its length, and `den`: an utterance without words in its hypothesis is wholly wrong, one without a reference has no weight."""
    words = lambda c: T.words(T.strict(F.coalesce(c, F.lit("")), labels))
    units = word_units(rows, words("reference"), words("prediction"))
    return units.withColumn("num", weighed()).withColumn("den", F.col("ref_words"))


def corpus_strict_wer(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The length-weighted mean of the utterances' rates under the strict lens; null where no utterance has a reference."""
    return units.groupBy(*keys).agg(nullable_pct("num", "den").alias("strict_wer_pct"), F.sum("den").alias("ref_words"), F.count_if(F.col("den") > 0).alias("utterances"))


def corpus_cer(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Character error rate on the raw texts."""
    distance = F.levenshtein("reference", "prediction")
    return rows.groupBy(*keys).agg(ratio_pct(distance, F.length("reference")).alias("cer_pct"))


def runaways(units: DataFrame, keys: Sequence[str] = (), ratio: float = RUNAWAY_RATIO) -> DataFrame:
    """Utterances whose hypothesis is over `ratio` times the reference, their share, and their share of all edits (null without edits)."""
    away = F.col("hyp_words") > ratio * F.col("ref_words")
    return units.groupBy(*keys).agg(
        F.count_if(away).alias("n_runaway"), F.count("*").alias("utterances"),
        F.coalesce(100.0 * F.count_if(away) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("runaway_pct"),
        nullable_pct(F.when(away, F.col("edits")).otherwise(0), "edits").alias("runaway_edit_share_pct"),
    )


def filler_tolerant_units(rows: DataFrame, stoplist: Sequence[str] = T.FILLER_STOPLIST) -> DataFrame:
    """word_units under the canonical lens without fillers on either side."""
    return word_units(rows, T.fillers_out(T.tokens(F.col("reference")), stoplist), T.fillers_out(T.tokens(F.col("prediction")), stoplist))


def pair_stack(rows: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """rows with the error rates of each pair: words under the strict, permissive and verbatim lens, characters under the strict one,
    the operations of the strict alignment (`sub`, `ins`, `del`), and the insertion rate `ier`.

    A pair with one empty side is wholly wrong and has no operations; two empty sides agree.
    """
    lenses = {"strict": T.strict, "permissive": T.permissive, "verbatim": T.verbatim}
    out = rows
    for name, lens in lenses.items():
        out = out.withColumn(f"_r_{name}", lens(F.coalesce("reference", F.lit("")), labels)).withColumn(f"_h_{name}", lens(F.coalesce("prediction", F.lit("")), labels))
    one_empty = lambda name: (F.col(f"_r_{name}") == "") != (F.col(f"_h_{name}") == "")

    def rate(name: str, edits: Column, length: Column) -> Column:
        return F.when(one_empty(name), 1.0).when(F.col(f"_r_{name}") == "", 0.0).otherwise(edits / length)

    for name in lenses:
        r, h = T.words(F.col(f"_r_{name}")), T.words(F.col(f"_h_{name}"))
        out = out.withColumn(f"wer_{name}", rate(name, T.word_edits(r, h), F.size(r)))
    out = out.withColumn("cer", rate("strict", F.levenshtein("_r_strict", "_h_strict"), F.length("_r_strict")))
    both = (F.col("_r_strict") != "") & (F.col("_h_strict") != "")
    out = out.withColumn("_ops", align(F.when(both, T.words(F.col("_r_strict"))).otherwise(F.array().cast("array<string>")), F.when(both, T.words(F.col("_h_strict"))).otherwise(F.array().cast("array<string>"))))
    count = lambda kind: F.size(F.filter("_ops", lambda o: o["kind"] == kind)).cast("long")
    out = out.withColumns({"sub": count("substitute"), "ins": count("insert"), "del": count("delete"), "ref_words": F.size(T.words(F.col("_r_strict"))).cast("long")})
    out = out.withColumn("ier", F.when(F.col("ref_words") > 0, F.col("ins") / F.col("ref_words")).otherwise(0.0))
    return out.drop("_ops", *[f"_{side}_{name}" for side in "rh" for name in lenses])


def bleu_counts(rows: DataFrame, reference: Column | Sequence[Column], hypothesis: Column, order: int = 4) -> DataFrame:
    """rows with lengths and, for each n, the clipped matches and the number of hypothesis n-grams.

    With several references a match is clipped by the one that has most of it, and `ref_len` is
    the length nearest to the hypothesis, the shorter of two.
    """
    refs = [reference] if isinstance(reference, Column) else list(reference)
    out = rows.withColumn("_refs", F.array(*refs)).withColumn("_hyp", hypothesis).withColumn("hyp_len", F.size("_hyp").cast("long"))
    nearest = F.array_min(F.transform("_refs", lambda r: F.struct(F.abs(F.size(r) - F.col("hyp_len")).alias("far"), F.size(r).cast("long").alias("len"))))
    out = out.withColumn("ref_len", nearest["len"]).withColumn("_met", T.ngram_matches("_hyp", "_refs", F.lit(order)))
    for n in range(1, order + 1):
        out = out.withColumn(f"match_{n}", F.col("_met")[n - 1]).withColumn(f"total_{n}", F.greatest(F.size("_hyp") - (n - 1), F.lit(0)).cast("long"))
    return out.drop("_refs", "_hyp", "_met")


def bleu_of(order: int, effective: bool) -> Column:
    """BLEU of summed counts, with exponential smoothing of the orders without a match.

    `effective` (for single sentences): only orders that have n-grams count. Otherwise 0 where one has none.
    """
    smooth, logs, orders, possible = F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(True)
    for n in range(1, order + 1):
        match, total = F.col(f"match_{n}"), F.col(f"total_{n}")
        smooth = F.when((match == 0) & (total > 0), smooth * 2).otherwise(smooth)
        logs = logs + F.when(total > 0, F.log(F.when(match == 0, 100.0 / (smooth * total)).otherwise(100.0 * match / total))).otherwise(0.0)
        orders = orders + (total > 0).cast("int")
        possible = possible & (total > 0)
    brevity = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    # Without a single match of any order the score is zero.
    any_match = sum((F.col(f"match_{n}") for n in range(1, order + 1)), F.lit(0)) > 0
    return F.when(any_match & (F.lit(effective) | possible), brevity * F.exp(logs / (orders if effective else F.lit(order)))).otherwise(0.0)


def sentence_bleu(counts: DataFrame, order: int = 4) -> DataFrame:
    """counts with `sentence_bleu`, a diagnostic of single rows; never an average of them."""
    return counts.withColumn("sentence_bleu", bleu_of(order, True))


def corpus_bleu(counts: DataFrame, keys: Sequence[str] = (), order: int = 4) -> DataFrame:
    """Summed counts of each key with `bleu`; 0 where a whole order has no n-grams."""
    sums = counts.groupBy(*keys).agg(*[F.sum(f"{k}_{n}").alias(f"{k}_{n}") for n in range(1, order + 1) for k in ("match", "total")], F.sum("ref_len").alias("ref_len"), F.sum("hyp_len").alias("hyp_len"))
    return sums.withColumn("bleu", bleu_of(order, False))


def tokens_13a(text: Column) -> Column:
    """The mteval-13a tokens of a text: symbols apart, points and commas apart but between digits, dashes after digits apart."""
    plain = F.replace(F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(plain, "\n", " "), F.lit(" ")), r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"([^0-9])([\.,])", "$1 $2 "), r"([\.,])([^0-9])", " $1 $2")
    return T.words(F.regexp_replace(spaced, r"([0-9])(-)", "$1 $2 "))


def numbers(text: Column) -> Column:
    """The numeric entities of a text under the canonical lens; null for null."""
    return F.when(text.isNotNull(), T.entities(T.before_punctuation(text)))


def entity_units(rows: DataFrame) -> DataFrame:
    """rows whose reference has numbers, with how many (`den`) and how many of them the prediction has, with multiplicity (`num`)."""
    found = rows.withColumn("_r", numbers(F.coalesce("reference", F.lit("")))).withColumn("_h", numbers(F.coalesce("prediction", F.lit(""))))
    return numbers_met(found, "_r", "_h").drop("_r", "_h")


def numbers_met(rows: DataFrame, reference: str, prediction: str) -> DataFrame:
    """entity_units of rows whose numbers are found already."""
    return rows.withColumn("den", F.size(reference).cast("long")).where("den > 0").withColumn("num", T.bag_overlap(F.col(reference), F.col(prediction)))


def entity_rate(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return units.groupBy(*keys).agg(nullable_pct("num", "den").alias("entity_hit_rate_pct"), F.sum("den").alias("n_entities"), F.count("*").alias("n_utterances"))


def cross_leaks(rows: DataFrame, n: int = LEAK_NGRAM) -> DataFrame:
    """(id, source): predictions that hold an n-gram of another row's reference and not of their own.

    The first such n-gram decides; its source is the least id that has it. One
    equi-join on the n-gram: references are reduced to the two least ids for
    each n-gram first, so a phrase that everyone has stays one row.
    """
    tokened = rows.select("id", T.tokens(F.col("reference")).alias("r"), T.tokens(F.col("prediction")).alias("h"), F.col("prediction").isNotNull().alias("there"))
    grams = tokened.select("id", F.explode(F.array_distinct(T.ngrams(F.col("r"), n))).alias("gram"))
    least = grams.groupBy("gram").agg(F.min("id").alias("first_id"), F.max("id").alias("_last"))
    second = grams.join(least, "gram").where("id > first_id").groupBy("gram").agg(F.min("id").alias("second_id"))
    holders = least.where("first_id IS NOT NULL").join(second, "gram", "left").select("gram", "first_id", "second_id")
    said = tokened.where("there").select("id", F.posexplode(T.ngrams(F.col("h"), n)).alias("pos", "gram"), F.array_distinct(T.ngrams(F.col("r"), n)).alias("own"))
    foreign = said.where(~F.array_contains("own", F.col("gram"))).drop("own")
    met = foreign.join(holders, "gram").withColumn("source", F.when(F.col("first_id") != F.col("id"), F.col("first_id")).otherwise(F.col("second_id"))).where("source IS NOT NULL")
    return met.groupBy("id").agg(F.min_by("source", "pos").alias("source"))


def contained_ngrams(docs: DataFrame, items: DataFrame, n: int = LEAK_NGRAM, most: int = LEAK_HASHES) -> DataFrame:
    """(id, source, sources): documents that hold an n-gram of an item, the item of the first such n-gram, and how many items there are.

    docs: (id, t), items: (source, t), t: tokens. N-grams meet as hashes of eight bytes, and what meets is checked on the words themselves.
    While the items have at most `most` different hashes, they go to the documents as one sorted list, and only the places that meet are
    looked at further, where the words are; else all places are dealt by hash and the words are joined again.
    """
    grams = held(items.select("source", F.explode(F.array_distinct(F.arrays_zip(T.ngram_hashes(F.col("t"), n).alias("hash"), T.ngrams(F.col("t"), n).alias("gram")))).alias("g")).select("source", "g.hash", "g.gram"), "itemgrams")
    known = grams.select("hash").distinct().limit(most + 1)
    words = lambda t, pos: F.array_join(F.slice(t, pos + 1, n), " ")
    if known.count() <= most:
        wanted = known.agg(F.array_sort(F.collect_list("hash")).alias("_wanted"))  # one row, of at most that many hashes
        hashed = docs.withColumn("_h", T.ngram_hashes(F.col("t"), n)).join(F.broadcast(wanted)).withColumn("_met", F.array_intersect("_h", "_wanted")).where(F.size("_met") > 0)
        places = F.filter(F.transform("_h", lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))), lambda x: F.array_contains("_met", x["hash"]))
        said = hashed.select("id", F.explode(F.transform(places, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), words(F.col("t"), x["pos"]).alias("said")))).alias("p"))
        checked = said.select("id", "p.pos", "p.hash", "p.said").join(grams, "hash").where(F.col("said") == F.col("gram"))
    else:
        dealt = docs.select("id", F.posexplode(T.ngram_hashes(F.col("t"), n)).alias("pos", "hash"))
        texts = docs.withColumnRenamed("id", "_id")
        checked = dealt.join(grams, "hash").join(texts, F.col("id") == F.col("_id")).where(words(F.col("t"), F.col("pos")) == F.col("gram"))
    return checked.groupBy("id").agg(F.min_by("source", F.struct("pos", "source")).alias("source"), F.count_distinct("source").alias("sources"))


def leak_gate(flagged: Column, utterances: Column) -> Column:
    return (flagged > LEAK_MIN_FLAGGED) & (100.0 * flagged / utterances > LEAK_MAX_SHARE_PCT)


def by_region(units: DataFrame, region: str, min_n: int) -> DataFrame:
    """Rate of each region, null where it has under `min_n` units; most units first, then by name."""
    out = units.groupBy(region).agg(F.count("*").alias("n"), ratio_pct("num", "den").alias("pct"))
    suppressed = out.withColumn("pct", F.when(F.col("n") >= min_n, F.col("pct")))
    return suppressed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), region)).cast("long"))  # a row for each region
