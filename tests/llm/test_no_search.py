"""Tokens that no chosen feature can come from are not searched, and features stay those of the search."""

import random

from phonyx.llm import deobfuscate, toxicity


def some_model():
    words = [("idiot", 50), ("scum", 40), ("the", 90), ("trash", 20), ("assess", 9), ("loser", 30), ("on", 50)]
    return deobfuscate.CharacterModel(deobfuscate.character_counts(words))


def test_features_are_those_of_the_search():
    r, model = random.Random(4), some_model()
    chosen = {f: i for i, f in enumerate(["idiot$", "idi", "scum$", "tra", "trash$", "asse", "on$", "los", "a$", "été$", "été", "$$$$"])}
    bits = [*"idotscumrahelns", "ss", "ee", "1", "0", "$", "$$", "@", "!", "*", "é", "ï", "ss", "а", ",", ".", "%%%", "3", "A", "İ", "Σ", "ß", "漢", "\x1c", " ", "\t", "idi", "scu", "tra", "oon", "t"]
    tokens = ["".join(r.choice(bits) for _ in range(r.randint(1, 8))) for _ in range(6000)] + ["$$$", "sccum,", "!d!ot", "i d i o t", "x i d i", "t r a s h", "äss", "été,", "oonn", "a"]
    reader, every = toxicity.Reader(model, chosen), toxicity.Reader(model)
    for t in tokens:
        assert reader.token(t) == tuple(chosen[f] for f in every.token(t) if f in chosen), t
    assert sum(bool(reader.token(t)) for t in tokens) > 100


def test_no_search_where_no_feature_can_come_of_it(monkeypatch):
    searched, inner = [], toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda token, model: searched.append(token) or inner(token, model))
    reader = toxicity.Reader(some_model(), {"idiot$": 0, "scu": 1})
    assert reader.text("Theea,%%% thatonn. éèaux, id1ot sccum, thennd***")[0] == {0: 1, 1: 1}
    assert sorted(searched) == ["id1ot", "sccum,"]


def test_what_is_met_often_stays_in_memory(monkeypatch):
    reader, asked, inner = toxicity.Reader(some_model(), {"idi": 0}, most=8), [], toxicity.Reader.token
    monkeypatch.setattr(toxicity.Reader, "token", lambda self, t: asked.append(t) or inner(self, t))
    for k in range(30):
        reader.text(f"idiots w{k}")
    assert asked.count("idiots") == 1 and len(reader.seen) + len(reader.earlier) <= 8


def test_marks_after_plain_letters_stand_for_nothing():
    r, model = random.Random(6), some_model()
    tokens = ["".join(r.choice("abcdehs") for _ in range(r.randint(1, 5))) + "".join(r.choice(",.;:?&%'\")-*#!$|1(") for _ in range(r.randint(0, 4))) for _ in range(6000)]
    found = [(t, m[1]) for t in tokens if (m := deobfuscate.MARKED.match(t))]
    assert len(found) > 1500 and all(deobfuscate.restore(t, model) == word for t, word in found)
