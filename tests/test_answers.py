"""Hosted answers of unlike shapes."""

import json

from phonyx.sources import answers


def test_first_readable_shape_wins(spark):
    words = lambda *w: {"results": {"channels": [{"alternatives": [{"words": list(w)}]}]}}
    cases = {
        "channels": (words({"start": 0.5, "end": 1, "speaker": 0}, {"start": 1, "end": 2}, {"start": None, "end": 2, "speaker": 1}, {"start": 2, "end": 3.5, "speaker": 1}, "x"), [(0.5, 1.0, "speaker_0"), (2.0, 3.5, "speaker_1")], None),
        "silent": (words(), [], None),
        "unlabelled": (words({"start": 0, "end": 1}), None, "no word has a speaker"),
        "no alternatives": ({"results": {"channels": [{}]}}, None, "no alternatives"),
        "no words": ({"results": {"channels": [{"alternatives": [{"text": "x"}]}]}}, None, "no word list"),
        "empty channels": ({"results": {"channels": []}}, None, "no channels"),
        "utterances": ({"utterances": [{"speaker": "A", "start": 0, "end": 900, "words": [{"start": 0, "end": 400}, {"start": 500, "end": 900, "speaker": "B"}]}, {"speaker": "C", "start": 1000, "end": 2000}, {"start": 5, "end": 6}]},
                       [(0.0, 0.4, "A"), (0.5, 0.9, "B"), (1.0, 2.0, "C")], None),
        "own words": ({"utterances": [], "words": [{"start": 100, "end": 300, "speaker": "A"}, {"start": 300, "end": 400}]}, [(0.1, 0.3, "A")], None),
        "nobody": ({"words": [{"start": 100, "end": 300}]}, None, "no word or utterance has a speaker"),
    }
    rows = [(k, json.dumps(v[0])) for k, v in cases.items()] + [("broken", "{oops"), ("null", None)]
    got = {x["k"]: (x["spans"] and [tuple(s) for s in x["spans"]], x["refused"]) for x in answers.answer_spans(spark.createDataFrame(rows, "k string, raw string")).collect()}
    want = {k: (v[1], v[2]) for k, v in cases.items()} | {"broken": (None, "no JSON"), "null": (None, "no JSON")}
    assert {k: (v[0] if v[0] is None else list(v[0]), v[1]) for k, v in got.items()} == want
