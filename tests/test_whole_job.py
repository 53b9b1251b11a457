"""Queries on inputs beyond the small tables: zero-length spans, large numbers, whole columns, long rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonyx.functions import numbers as N
from phonyx.llm import sharding
from phonyx.operators import intervals, metrics
from phonyx.plans import queries


def test_spans_without_length_are_turns_where_asked(spark):
    spans = spark.createDataFrame([("a", 0.0, 1.0), ("a", 5.0, 5.0), ("a", 20.0, 20.0), ("a", 21.0, 22.0)], "k string, start double, end double")
    for bucket in (None, 4.0):
        got = sorted(map(tuple, intervals.fold_turns(spans, ["k"], 2.0, bucket, lengthless=True).collect()))
        assert got == [("a", 0.0, 1.0), ("a", 5.0, 5.0), ("a", 20.0, 22.0)]
        assert len(intervals.fold_turns(spans, ["k"], 2.0, bucket).collect()) == 2


def test_events_of_no_value_are_folded_as_the_sql_does(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts, 7L AS user_id, 'view' AS event_type, 0.0D AS value FROM range(3)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert queries.QUERIES["turn_fold"](spark, str(tmp_path)).count() == 3
    assert queries.QUERIES["interval_union"](spark, str(tmp_path)).first()["islands"] == 3


def test_corpus_wer_has_the_weighted_rate(spark):
    rows = [(1, "eins zwei drei vier", "eins zwei drei"), (2, "ja nein", ""), (3, "", "zu viel"), (4, "a", "b c d e")]
    total = metrics.corpus_wer(metrics.word_units(spark.createDataFrame(rows, "id long, reference string, prediction string")), weighted=True).first()
    assert (total["wer_pct"], total["strict_wer_pct"]) == (pytest.approx(100 * 9 / 7), pytest.approx(100 * 7 / 7))
    assert "strict_wer_pct" in queries.ORACLE_SQL["corpus_wer"]


def test_numbers_from_a_million_on_are_read_back(spark):
    n = [999_999, 1_000_000, 1_000_001, 1_234_567, 2_000_000, 8_999_999, 21_000_021]
    got = spark.createDataFrame([(str(x),) for x in n], "n string").withColumn("w", N.digits_to_words(F.col("n"))).withColumn("b", N.words_to_digits(F.col("w"))).collect()
    assert [r["b"] for r in got] == [r["n"] for r in got] and got[1]["w"] == "eine Million" and got[4]["w"] == "zwei Millionen"


def test_cells_hold_equally_many_of_all_rows(spark):
    # More rows than any sample had: cells of all rows are equal to the row.
    rows = spark.range(0, 40_960, 1, 4).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    cells = Counter(r["cell"] for r in sharding.quantise_numbers(rows, ["x"], ["cell"], 6).collect())
    values = np.sort([r["x"] for r in rows.collect()])
    want = Counter(np.searchsorted(np.unique(values[np.arange(1, 64) * len(values) >> 6]), values, "right").tolist())
    assert cells == want and len(cells) == 64 and max(cells.values()) - min(cells.values()) < 10
    assert sharding.quantise_numbers(rows.limit(5), ["none"], ["cell"], 4).select("cell").distinct().collect()[0][0] == 0



def test_lists_of_sliced_columns():
    import pyarrow as pa

    from phonyx.functions.rows import lists

    every = [["a", "b"], None, [], ["c", None], ["d"]] * 9
    column = pa.array(every, pa.list_(pa.string()))
    assert list(lists(column)) == every and list(lists(column.slice(3, 30), 7)) == every[3:33]
