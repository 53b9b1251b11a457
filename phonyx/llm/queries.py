"""The opN_* queries, every operator on its whole intended table, and the parts of them that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, extract, importance, mixing, negatives, ngramlm, repetition, sharding, simhash, tokenfiles, toxicity
from .common import table

#: One space or control character that parts words, and what is left of a text without them, in DuckDB's patterns.
SPACE, SYMBOL = r"[ \t\n\x0b\x0c\r]", r"[#*$%&|<>]"

REPETITION_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE length(regexp_replace(line, '{SPACE}', '', 'g')) > 0 GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""

#: The level at which shares by weight, none over twice its source, add up to 150 %: sources reach their cap in the order of 2 * size / weight.
MIXING_SQL = rf"""
WITH s AS (SELECT source, sum(len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')))::BIGINT AS size FROM documents GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, coalesce(sum(2 * size) OVER before, 0) AS capped, sum(weight) OVER after_ AS free, 1.5 * sum(size) OVER () AS total FROM w
  WINDOW before AS (ORDER BY 2.0 * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after_ AS (ORDER BY 2.0 * size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT arg_min((total - capped) / free, 2.0 * size / weight) FILTER ((total - capped) / free <= 2.0 * size / weight) AS level FROM o)
SELECT source, size AS source_size, round(least(2.0 * size, weight * level), 6) AS target FROM w, v"""

CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY conv_id"""

SHARD_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT (i * 8) // n AS shard FROM (SELECT n, unnest(range(n)) AS i FROM n))
SELECT shard::INT AS shard, count(*) AS n_rows, 0::BIGINT AS first_slot, count(*) - 1 AS last_slot, count(*) AS slots FROM r GROUP BY shard"""


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS own, c.id AS other, c.label, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.id <> c.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


def repetition_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that do not depend on its method."""
    return repetition.op6(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of op7 with their sizes and targets."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.groupBy("source").agg(F.first("source_size").cast("long").alias("source_size"), F.round(F.first("target"), 6).alias("target"))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that do not depend on how turns are packed."""
    return chat.op4(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of each shard of op8: its law."""
    placed = sharding.op8(spark, sf_dir)
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1,
    "op2_toxicity": toxicity.op2,
    "op3_importance_resampling": importance.op3,
    "op4_chat_windows": chat.op4,
    "op5_bm25_decontamination": decontaminate.op5,
    "op6_repetition_rules": repetition.op6,
    "op7_mixing": mixing.op7,
    "op8_hilbert_sharding": sharding.op8,
    "op9_elias_fano_lm": ngramlm.op9,
    "op10_block_labeller": extract.op10,
    "op11_alignment": alignment.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_wavelet_shards": tokenfiles.op13,
    "repetition_base": repetition_base,
    "mixing_targets": mixing_targets,
    "chat_digests": chat_digests,
    "shard_law": shard_law,
}

ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": NEGATIVES_SQL, "repetition_base": REPETITION_SQL, "mixing_targets": MIXING_SQL, "chat_digests": CHAT_SQL, "shard_law": SHARD_SQL}
