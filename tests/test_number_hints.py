"""Only texts with a run of number words are searched for runs, and each text once."""

import random

from phonyx.functions import numbers as N
from phonyx.plans import tables


def searched(text):
    return N.RUN.sub(lambda m: m[0] if m[0].lower() in ("ein", "eine") else N.read_run(m[0]), text)


def test_a_text_without_a_run_is_not_searched():
    r = random.Random(5)
    pieces = ["ein", "Ein", "eine", "einen", "minus", "Plus", "komma", "Komma", "fünf", "FÜNF", "zwanzig", "einhundertdrei", "Million", "Beachtung", "Nullpunkt", "geizig", "eın", "hundert", "tausend", "Haus", "zwei"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) + r.choice([" ", " ", " ", ", ", "-", "\n"]) for _ in range(r.randint(1, 6)))
        assert N.has_run(text) or searched(text) == text
    assert not N.has_run("Beachtung ein Nullpunkt, eine geizige") and N.has_run("minus ein Haus") and N.has_run("Ein eine")


def test_number_words_are_read(spark):
    d = spark.createDataFrame([("Fünf Häuser",), ("dreißig acht",), (None,), ("Beachtung",)], "t string")
    assert [x[0] for x in d.select(N.words_to_digits(d.t)).collect()] == ["5 Häuser", "30 8", None, "Beachtung"]


def test_texts_are_looked_through_once(spark, tmp_path):
    rows = [(1, "Haus 7", "de", "web"), (2, "Haus 7 und 8", "de", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = tables.copied_numbers(spark, str(tmp_path))
    assert "read_words" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(x) for x in out.collect()] == [(2, ["7"], ["7", "8"])]
