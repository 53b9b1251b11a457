"""Runs that are published as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from phonyx.sources import publish

FORM = "id long, subset string, prediction string"


def rows(spark, subsets, text, n=20):
    return spark.createDataFrame([(k, subsets[k % len(subsets)], f"{text} {k} größer") for k in range(n)], FORM).repartition(3)


def content(spark, path):
    return sorted((r["subset"], r["id"], r["prediction"]) for r in publish.published(spark, path, FORM).collect())


def test_a_run_is_published_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert publish.manifest(path) == [] and content(spark, path) == []
    first = rows(spark, ["a", "b"], "one")
    publish.publish(first, path)
    old = content(spark, path)
    assert old == sorted((r["subset"], r["id"], r["prediction"]) for r in first.collect())
    assert sum(f["rows"] for f in publish.manifest(path)) == 20
    # A failing task publishes nothing, and what it staged goes.
    staged = len(os.listdir(tmp_path / "out" / "runs"))
    broken = rows(spark, ["c"], "two").withColumn("prediction", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("prediction")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, path)
    assert content(spark, path) == old and len(os.listdir(tmp_path / "out" / "runs")) == staged
    # A subset that is published already is a conflict.
    with pytest.raises(Exception, match="already published: b"):
        publish.publish(rows(spark, ["b", "c"], "three"), path)
    assert content(spark, path) == old
    publish.publish(rows(spark, ["b", "c"], "four", 10), path, overwrite=True)
    now = content(spark, path)
    assert [x for x in now if x[0] == "a"] == [x for x in old if x[0] == "a"]
    assert len([x for x in now if x[0] in "bc"]) == 10 and all(x[2].startswith("four") for x in now if x[0] in "bc")
    with pytest.raises(Exception, match="not a name of a subset"):
        publish.publish(rows(spark, ["../x"], "five"), path)
    assert content(spark, path) == now
