"""The training-data operators' methods against brute force, and their rules for odd rows."""

import hashlib
import itertools
import math
import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonyx.llm import chat, decontaminate, deobfuscate, extract, importance, mixing, ngramlm, repetition, sharding, simhash, toxicity
from phonyx.llm.htmlblocks import Memory, Pages, blocks_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the input with names that operators use inside, or that need quoting.
ODD = ["_kept", "_rows", "_copy", "_whole", "_source", "_large_cut", "_own0", "_own1", "a.b", "key", "head", "rank", "size", "curve", "_hash", "text_key", "component_id"]


def frame(spark, texts, ids=None, sources=("a", "b", None), odd=()):
    rows = [(i if ids is None else ids[i], t, "en" if i % 3 else None, sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"v{k}") for k, c in enumerate(odd)}) if odd else spark.createDataFrame(rows, DOCS)


# -- 1: near-dedup stage ----------------------------------------------------------------------------------------------


def test_keep_one_tells_texts_of_one_id_apart(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "alpha beta gamma delta epsilon zeta", None, ""]
    kept = simhash.keep_one(frame(spark, texts, ids=[7, 7, 7, None, None], odd=ODD))
    assert kept.columns == frame(spark, texts, odd=ODD).columns
    rows = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([(7, texts[0]), (7, texts[1]), (None, "")], key=str)


def test_stage_in_small_cells_loses_no_link(spark):
    r = np.random.default_rng(3)
    base, texts = [f"b{x}" for x in range(120)], []
    for _ in range(60):
        words = list(base)
        for at in r.choice(24, 1 + int(r.integers(0, 3)), replace=False):
            words[5 * at] = f"z{r.integers(0, 1000)}"
        texts.append(" ".join(words))
    few, all_ = (simhash.similar_groups(frame(spark, texts), hot=h).select("doc_id", "component_id").collect() for h in (4, 8192))
    assert sorted(map(tuple, few)) == sorted(map(tuple, all_))


def test_links_of_crowded_parts_are_compared_in_blocks(spark):
    # Few different bits, so that keys and their parts stay crowded.
    prints = sorted({sum(1 << 3 * b for b in c) for k in range(4) for c in itertools.combinations(range(12), k)})
    nodes = spark.createDataFrame(list(zip(prints, range(len(prints)))), "fp long, node long")
    pairs = {(a["u"], a["v"]) for a in simhash.links(nodes, hot=8).collect()}
    label = list(range(len(prints)))
    for _ in range(4):
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    assert set(label) == {0}


# -- 2: toxicity ------------------------------------------------------------------------------------------------------


def test_viterbi_finds_the_cheapest_path():
    model = deobfuscate.CharacterModel(deobfuscate.character_counts([("idiot", 9), ("toilet", 5), ("all", 7), ("ill", 2), ("tall", 3)]))
    back = model.order - 1

    def price(path):
        total, c = sum(p for _, p in path), " "
        for letters, _ in path:
            for x in letters:
                if x == " " and c[-1] == " ":
                    continue
                c += "0" if x.isdigit() else x
                total += model.cost(c)
                c = c[-back:]
        return total + (model.cost(c + " ") if c[-1] != " " else 0)

    for token in ("1d10t", "t0!l3t", "a11", "t@ll", "i.d-1ot", "аll", "ïdïot", "i d i o t"):
        lattice = deobfuscate.columns(token)
        cheapest = min(itertools.product(*lattice), key=price)
        found = deobfuscate.viterbi(lattice, model)
        ways = [p for p in itertools.product(*lattice) if "".join(x for x, _ in p) == found]
        assert min(map(price, ways)) == pytest.approx(price(cheapest))


def test_character_counts_agree_with_a_plain_count():
    r = np.random.default_rng(12)
    words = [("".join(r.choice(list("abäßж𝄞"), int(r.integers(1, 9)))), int(r.integers(1, 5))) for _ in range(300)]
    for order in (1, 2, 4):
        assert deobfuscate.character_counts(words, order) == deobfuscate.plain_character_counts(words, order)
    assert deobfuscate.character_counts([]) == {} and deobfuscate.character_counts([("x", 2)], 4) == deobfuscate.plain_character_counts([("x", 2)], 4)


def test_letters_of_other_scripts_and_accents_are_restored():
    model = deobfuscate.CharacterModel(deobfuscate.character_counts([("idiot", 50), ("scum", 40), ("the", 90)]))
    assert deobfuscate.restore("іdіоt", model) == "idiot" and deobfuscate.restore("ïdïöt", model) == "idiot"
    assert not deobfuscate.suspect("été"[:2]) and deobfuscate.suspect("sсum")


def test_toxicity_of_empty_texts_and_of_what_workers_get(spark):
    texts = [f"fine words number {i}" if i % 4 else f"you scum {i}" for i in range(200)] + [None, "", " \n "]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = frame(spark, texts, odd=ODD)
    model = toxicity.fit(rows, labels)
    assert b"phonyx" not in pickle.dumps(model)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, labels).collect()}
    known = labels.where(~toxicity.held_out()).selectExpr("sum(toxic)", "count(*)").first()
    assert {got[i] for i in (200, 201, 202)} == {(known[0] + 1) / (known[1] + 3)}
    long = toxicity.score(frame(spark, ["word " * 300_000 + "scum", "x" * 200_000]), labels).collect()
    assert len(long) == 2 and all(0 <= r["score"] <= 1 for r in long)


# -- 3: importance resampling -----------------------------------------------------------------------------------------


def plain_weight(ratios, text):
    data, total = (text or "").encode(), 0.0
    for k, order in enumerate(importance.ORDERS):
        grams = [data[i : i + order] for i in range(len(data) - order + 1)]
        if grams:
            total += sum(ratios[k][importance.hashed_ngrams(np.frombuffer(g, np.uint8), order, ratios.shape[1])[0]] for g in grams) / len(grams)
    return importance.TEMPERATURE * total


@pytest.mark.parametrize("every", [2, 10])
def test_importance_weights_and_top_k_against_brute_force(spark, every):
    r = np.random.default_rng(every)
    texts = [" ".join(r.choice(["clean", "prose", "about", "things"] if i % every == 0 else ["###", "$$", "%&", "clean"], int(r.integers(40, 200)))) for i in range(120)] + [None, "", "a", "abc", "abcd", "prose " * 30_000]
    labels = spark.createDataFrame([(i, int(i % every == 0), 0) for i in range(0, 120, 3)] + [(0, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = frame(spark, texts)
    known = importance.labelled_sample(labels, 1000)
    ratios = importance.fit(rows.join(known, rows["doc_id"] == known["_id"], "left"))
    got = {x["doc_id"]: x for x in importance.resample(rows, labels).collect()}
    for i, t in enumerate(texts):
        assert got[i]["log_weight"] == pytest.approx(plain_weight(ratios, t), abs=1e-5)
    # The level with the fewest errors among labelled rows; k rows reach it; the k largest keys are taken.
    sample = [(got[i]["log_weight"], i % every == 0) for i in range(0, 120, 3)]
    errors = {c: sum((w > c) != good for w, good in sample) for c in [-math.inf, *(w for w, _ in sample)]}
    least = min(c for c in errors if errors[c] == min(errors.values()))
    k = sum(x["log_weight"] > least for x in got.values())
    cut = sorted((x["key"] for x in got.values()), reverse=True)[k - 1]
    assert {i for i, x in got.items() if x["selected"]} == {i for i, x in got.items() if x["key"] >= cut}
    good = {i for i in range(0, 120, every)}
    assert every > 2 or len(good & {i for i, x in got.items() if x["selected"]}) >= 0.9 * len(good)
    kept = importance.select_quality(frame(spark, texts, odd=ODD), labels)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["selected"]} and kept.columns == frame(spark, texts, odd=ODD).columns


def test_importance_without_good_or_bad_labels_keeps_everything(spark):
    rows = frame(spark, ["some text", "other text", None, "some text"])
    for quality in (0, 1):
        labels = spark.createDataFrame([(0, quality, 0)], "doc_id long, quality int, toxic int")
        assert importance.resample(rows, labels).where("selected").count() == (4 if quality else 4)
    assert importance.resample(rows, labels.limit(0)).where("selected").count() == 4


# -- 4: chat windows --------------------------------------------------------------------------------------------------


def plain_windows(turns, budget, history, block):
    """Windows of one conversation, as lists of (turn, again), from turns (role, text, tokens) in order."""
    start = [0, *itertools.accumulate(t[2] for t in turns)]
    system = next((i for i, t in enumerate(turns) if t[0] == "system"), None)
    left = lambda i: budget - (turns[system][2] if system is not None and i > system else 0)
    firsts, limit = [], 0
    for i in range(len(turns)):
        if i % block == 0 or start[i + 1] > limit:
            firsts.append(i)
            limit = start[i] + (budget if i == 0 else max(left(i) - history, left(i) // 2))
    out = []
    for a, b in zip(firsts, [*firsts[1:], len(turns)]):
        spare = min(history, left(a) - (start[b] - start[a]))
        again = [i for i in range(a) if start[i] >= start[a] - spare] if a else []
        lead = [system] if a and system is not None and system < min([a, *again]) else []
        out.append([(i, True) for i in lead + again] + [(i, False) for i in range(a, b)])
    return out


@pytest.mark.parametrize("kind", ["dense", "gapped", "equal", "null"])
def test_chat_windows_against_brute_force(spark, kind):
    r = np.random.default_rng(1)
    n = 150
    number = {"dense": lambda i: i, "gapped": lambda i: 1000 * i, "equal": lambda i: 5, "null": lambda i: None}[kind]
    rows = [(1, number(i), "system" if i == 3 else ["user", "assistant"][i % 2], "word " * int(r.integers(0, 60))) for i in range(n)] + [(2, 0, "user", "hello " * 3000), (2, 1, "assistant", None), (2, 1, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tokens = F.length(F.coalesce("text", F.lit(""))).cast("long") + 1
    got = defaultdict(list)
    for x in chat.read_back(chat.format_windows(table, 400, 60, 64, tokens)).collect():
        got[x["conv_id"]].append(x)
    if kind in ("dense", "gapped"):
        for conv in (1, 2):
            own = [(role, text or "", len(text or "") + 1) for c, _, role, text in rows if c == conv]
            found = sorted(got[conv], key=lambda x: x["window"])
            want = plain_windows(own, 400, 60, 64)
            assert len(found) == len(want)
            for x, members in zip(found, want):
                new = [i for i, again in members if not again]
                assert x["repeated"] == sum(again for _, again in members)
                assert [(t["role"], t["text"]) for t in x["turns"]] == [own[i][:2] for i in new]
                assert x["loss"] == "".join(own[i][1] for i in new if own[i][0] == "assistant")
                assert x["n_tokens"] == sum(own[i][2] for i, _ in members) and x["over_budget"] == (x["n_tokens"] > 400)
                lead = next((t[2] for t in own if t[0] == "system"), 0)
                assert x["n_tokens"] <= 400 or len(new) == 1 and lead + own[new[0]][2] > 400
            assert [i for w in want for i, again in w if not again] == list(range(len(own)))
    else:
        # Order among equal turns is by role, length and hash; budget, history and mask hold all the same.
        found = sorted(got[1], key=lambda x: x["window"])
        lead = max(len(text) + 1 for c, _, role, text in rows if c == 1 and role == "system")
        assert len(found) > 5 and all(x["n_tokens"] <= 400 or len(x["turns"]) == 1 and lead + len(x["turns"][0]["text"]) + 1 > 400 for x in found)
        assert any(x["repeated"] >= 1 for x in found[1:])
        assert Counter((t["role"], t["text"]) for x in found for t in x["turns"]) == Counter((role, text) for c, _, role, text in rows if c == 1)
        assert Counter("".join(x["loss"] for x in found)) == Counter("".join(text for c, _, role, text in rows if c == 1 and role == "assistant"))
    full = [x["n_tokens"] for x in sorted(got[1], key=lambda x: x["window"])[:-1]]
    assert sum(full) / len(full) > 280  # windows are filled, not half full


def test_chat_counts_formatted_text_and_ignores_other_columns(spark):
    rows = [(1, 0, "user", "a <s> b", 5), (1, 1, "assistant", "yes", 6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")
    windows = chat.format_windows(table).collect()
    assert [w["text"] for w in windows] == ["[INST]user\na <\\s> b[/INST]<s>assistant\nyes</s>"]
    assert chat.digests(chat.format_windows(table)).first()["formatted_chars"] == len(windows[0]["text"])
    assert chat.digests(chat.format_windows(table.limit(0))).count() == 0


# -- 5: decontamination -----------------------------------------------------------------------------------------------


def plain_leaks(texts, items, threshold, overlap):
    docs = [decontaminate.words_of(t) for _, t in items]
    n = sum(bool(d) for d in docs)
    df = Counter(w for d in docs for w in set(d))
    mean = sum(map(len, docs)) / n
    idf = {w: math.log1p((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    impact = lambda d, w: idf[w] * d.count(w) * (decontaminate.K1 + 1) / (d.count(w) + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(d) / mean))
    out = set()
    for t, text in enumerate(texts):
        words = decontaminate.words_of(text)
        for (item, _), d in zip(items, docs):
            if not d:
                continue
            stretch = decontaminate.LEAST_STRETCH
            while stretch < len(d):
                stretch *= 2
            q, a = decontaminate.shingles(d[: len(d) // 2] if len(d) > 1 else d), decontaminate.shingles(d[len(d) // 2 :] if len(d) > 1 else [])
            for p in range(0, max(1, len(words)), stretch):
                passage = words[p : p + 2 * stretch]
                score = sum(impact(d, w) for w in set(passage) & set(d)) / sum(impact(d, w) for w in set(d))
                seen = decontaminate.shingles(passage)
                if score >= threshold and len((q | a) & seen) >= overlap * len(q | a) and all(2 * len(x & seen) >= len(x) for x in (q, a)):
                    out.add((t, item))
    return out


@pytest.mark.parametrize("part_words", [10**6, 500, 120])
def test_decontamination_against_brute_force_in_any_number_of_parts(spark, part_words):
    r = np.random.default_rng(9)
    lexicon = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(lexicon, int(n)))) for i, n in enumerate(r.integers(1, 90, 25))] + [(90, " ".join(r.choice(lexicon, 400))), (91, None), (92, ""), (93, "w1 w2")]
    texts = [" ".join(r.choice(lexicon, int(n))) for n in r.integers(1, 300, 40)] + [None, "", "nothing of this is known", "  "]
    for i in range(20):  # items, whole or with some words changed, at random places
        words, own = texts[i].split(), items[i][1].split()
        for at in r.choice(len(own), len(own) // 40, replace=False):
            own[at] = "changed"
        at = int(r.integers(0, len(words) + 1))
        texts[i] = " ".join(words[:at] + own + words[at:])
    texts[30] = texts[30] + " " + items[25][1]
    texts.append("filler " * 50_000 + items[25][1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = frame(spark, texts, odd=ODD)
    found = decontaminate.leaks(rows, bench, part_words=part_words).collect()
    want = plain_leaks(texts, items, 0.6, 0.8)
    assert {(x["doc_id"], x["item_id"]) for x in found} == want and len(want) > 10
    kept = decontaminate.drop_leaks(rows, bench, part_words=part_words)
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == rows.columns


def test_decontamination_of_rows_without_known_words(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    for texts in ([None, ""], ["foreign line"], []):
        rows = frame(spark, texts) if texts else frame(spark, ["x"]).limit(0)
        assert decontaminate.leaks(rows, bench).count() == 0 and decontaminate.drop_leaks(rows, bench).count() == len(texts)
    assert decontaminate.leaks(frame(spark, ["a b"]), bench.limit(0)).count() == 0


def test_decontamination_verifies_question_and_answer(spark):
    bench = spark.createDataFrame([(1, "what is the first letter of the greek alphabet called", "it is called alpha and it comes before beta")], "item_id long, text string, answer string")
    q, a = bench.first()["text"], bench.first()["answer"]
    got = {x["doc_id"] for x in decontaminate.leaks(frame(spark, [f"{q} {a}", f"{q} and then something quite different follows here", a]), bench, threshold=0.3, overlap=0.4).collect()}
    assert got == {0}


# -- 6: repetition ----------------------------------------------------------------------------------------------------


def test_repetition_columns_against_brute_force(spark):
    r = np.random.default_rng(14)
    texts = [" ".join(r.choice(["a", "b#", "c|", "d"], int(n))) + "\nline one\n \nline one\n" for n in r.integers(1, 90, 25)] + [None, "", "p q r s t u v w x y " * 12, " ".join(f"x{i}" for i in range(80)), "ü " * 60_000]
    for x in repetition.repetition_rules(frame(spark, texts, odd=ODD)).collect():
        text = texts[x["doc_id"]] or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        lines = text.split("\n")
        assert x["word_chars"] == sum(map(len, words)) and x["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert x["n_dup_lines"] == sum(bool(line.strip(" \t\n\x0b\x0c\r")) and line in lines[:i] for i, line in enumerate(lines))
        if len(words) < 1000:
            covered = set()
            for n in range(10, len(words)):
                where = defaultdict(list)
                for i in range(len(words) - n + 1):
                    where[tuple(words[i : i + n])].append(i)
                covered |= {i + k for at in where.values() if len(at) > 1 for i in at for k in range(n)}
            assert x["covered_fraction"] == pytest.approx(len(covered) / max(1, len(words)))
        failed = len(words) < 50 or 100 * x["n_repeat_words"] > 50 * len(words)
        assert x["base_failed"] == failed and x["kept"] == (not failed and x["covered_fraction"] <= 0.5 and x["longest_repeat"] <= 100)


# -- 7: mixing --------------------------------------------------------------------------------------------------------


def test_entropy_balancing_against_a_plain_solver(spark):
    r = np.random.default_rng(2)
    patterns = [(s, lang, float(r.integers(50, 500))) for s in range(4) for lang in range(3)]
    sizes = np.array([m for *_, m in patterns])
    source, lang = (np.array([p[k] for p in patterns]) for k in (0, 1))
    tilt = np.exp(r.normal(0, 0.4, 4)[source] + r.normal(0, 0.4, 3)[lang])  # so that targets can be met together
    by_source = np.bincount(source, sizes * tilt)
    by_lang = np.bincount(lang, sizes * tilt)
    under = [[j] if j < 2 else [] for j in lang.tolist()]  # the third language is free
    rows = [(int(s), m, float(by_source[s]), u) for (s, _, m), u in zip(patterns, under)]
    got = mixing.balance(spark.createDataFrame(rows, "cell long, mass double, target double, under array<int>"), by_lang[:2].tolist()).collect()
    rate = {(x["cell"], x["mass"]): x["rate"] for x in got}
    # Plain solver: scale the constraints in turn until all hold.
    want = np.ones(len(sizes))
    for _ in range(5000):
        want *= (by_source / np.bincount(source, sizes * want))[source]
        for j in range(2):
            want[lang == j] *= by_lang[j] / (sizes * want)[lang == j].sum()
    for (s, _, m), w in zip(patterns, want):
        assert rate[s, m] == pytest.approx(w, rel=1e-6)


def test_mix_with_overlapping_targets_and_odd_columns(spark):
    texts = ["w " * int(n) for n in np.random.default_rng(6).integers(1, 60, 600)] + [None, "", "w " * 20_000]
    rows = frame(spark, texts, sources=("a", "b"))
    # So little English takes the other documents of the first source to the cap, which must be part of the problem.
    mixed = mixing.mix(rows, also={"lang": {"en": 0.6}}, cap=4.0).join(rows.select("doc_id", "lang"), "doc_id").collect()
    total = sum({x["source"]: x["target"] for x in mixed}.values())
    words = lambda k, v: sum(x["rate"] * x["size"] for x in mixed if x[k] == v)
    assert words("lang", "en") == pytest.approx(0.6 * total, rel=1e-6) and max(x["rate"] for x in mixed) == pytest.approx(4.0) and max(x["unmet"] for x in mixed) == 0.0
    for s in ("a", "b"):
        assert words("source", s) == pytest.approx(next(x["target"] for x in mixed if x["source"] == s), rel=1e-6)
    missed = spark.createDataFrame([(0, 10.0, 40.0, [0], 4.0), (0, 10.0, 40.0, [], 0.0), (1, 5.0, 5.0, [], 1.0)], "cell int, mass double, target double, under array<int>, rate double")
    assert [x["unmet"] for x in mixing.unmet(missed, [50.0]).orderBy("cell", F.size("under")).collect()] == [0.0, 10.0, 0.0]
    odd = frame(spark, texts, odd=ODD)
    out = mixing.repeat_documents(odd)
    assert out.columns == odd.columns and out.count() > 600
    assert mixing.repeat_documents(odd.limit(0)).count() == 0
    taken = mixing.mix(rows).collect()
    assert sorted(map(str, taken)) == sorted(map(str, mixing.mix(rows.repartition(7)).collect()))


# -- 8: sharding ------------------------------------------------------------------------------------------------------


def test_sharded_rows_are_whole_and_gapless(spark):
    texts = ["same text"] * 40 + [f"text {i} " * (i % 9) for i in range(160)] + [None, "", "long " * 50_000]
    rows = frame(spark, texts, ids=[0] * 20 + list(range(20, 203)), odd=ODD)
    out = sharding.shard_rows(rows)
    assert out.columns == [*rows.columns, "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in rows.collect())
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own))) and len(own) in (len(got) // 8, len(got) // 8 + 1)
    assert sharding.shard_rows(rows.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [0.0, 0.05])
def test_curve_prunes_better_than_hash_or_one_key(spark, copies):
    """With few copies: a group of equal texts takes the place of its least document, whatever the others' columns are."""
    r = np.random.default_rng(4)
    n = 4000
    table = spark.createDataFrame([(int(r.integers(0, 10**6)) if i else 10**15, f"l{r.integers(0, 6)}", f"s{r.integers(0, 16)}", ("copy " if r.random() < copies else f"{i} ") + "x" * int(2 ** r.uniform(0, 10))) for i in range(n)], "doc_id long, lang string, source string, text string")
    shards = 32
    placed = sharding.shard_documents(table, shards).collect()
    rows = [(x["doc_id"], x["lang"], x["source"], x["size"]) for x in placed]

    def touched(shard_of):
        """Mean share of shards whose ranges meet a filter, over filters on each of the four columns."""
        groups = defaultdict(list)
        for row, s in zip(rows, shard_of):
            groups[s].append(row)
        spans = [[(min(x), max(x)) for x in zip(*g)] for g in groups.values()]
        shares = []
        for c in range(4):
            for _ in range(100):
                v = rows[int(r.integers(0, n))][c]
                shares.append(sum(s[c][0] <= v <= s[c][1] for s in spans) / len(spans))
        return sum(shares) / len(shares)

    curve = touched([x["shard"] for x in placed])
    hashed = touched([int(hashlib.md5(str(x).encode()).hexdigest(), 16) % shards for x in rows])
    order = {row: k * shards // n for k, row in enumerate(sorted(rows))}
    one_key = touched([order[x] for x in rows])
    assert curve < (0.75 if not copies else 0.9) * one_key and curve < (0.6 if not copies else 0.7) * hashed


def test_one_far_value_does_not_fill_a_cell(spark):
    rows = spark.range(1000).select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).cast("double").alias("x"))
    cells = Counter(r["cell"] for r in sharding.quantise_numbers(rows, ["x"], ["cell"], 4).collect())
    assert len(cells) == 16 and max(cells.values()) < 80


def test_equal_texts_stand_together(spark):
    texts = [f"text {i % 50}" for i in range(400)]
    placed = sharding.shard_documents(frame(spark, texts)).collect()
    order = [x["text_crc32"] for x in sorted(placed, key=lambda x: (x["shard"], x["slot"]))]
    assert sum(a != b for a, b in zip(order, order[1:])) == 49


# -- 9: language model ------------------------------------------------------------------------------------------------


def test_documents_that_occur_twice_score_higher(spark):
    r = np.random.default_rng(21)
    lexicon = [f"w{i}" for i in range(800)]
    texts = [" ".join(r.choice(lexicon, 80)) for _ in range(300)]
    texts += texts[:40]
    rows = {x["doc_id"]: x for x in ngramlm.score(frame(spark, texts, odd=ODD)).collect()}
    per = {i: x["score"] / x["n_tokens"] for i, x in rows.items()}
    # Held-out texts are not learned, so a text occurs twice only where neither of its rows is held out.
    learned = lambda i: not rows[i]["held_out"]
    twice = [per[j] for i in range(40) if learned(i) and learned(300 + i) for j in (i, 300 + i)]
    once = [per[i] for i in range(40, 300) if learned(i)]
    cut = np.quantile(once, 0.95)
    assert len(twice) > 40 and np.mean(np.array(twice) > cut) > 0.95
    assert all(x["score"] > x["base_score"] for i, x in rows.items() if not x["held_out"])


def test_language_model_of_long_empty_and_no_texts(spark):
    texts = ["a b c " * 40_000, None, "", "x" * 100_000, "a b c"]
    rows = {x["doc_id"]: x for x in ngramlm.score(frame(spark, texts)).collect()}
    assert [rows[i]["n_tokens"] for i in range(5)] == [120_001, 1, 1, 2, 4]
    assert all(x["score"] <= 0 and x["base_score"] < 0 for x in rows.values())
    assert ngramlm.score(frame(spark, texts).limit(0)).count() == 0


# -- 10: block labeller -----------------------------------------------------------------------------------------------

NESTED = """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Index</a> | <a href=/map>Map</a> | <a href=/mail>Mail</a></td></tr>
<tr><td><table><tr><td><a href=1>Archive</a></td></tr><tr><td><a href=2>Links</a></td></tr><tr><td><a href=3>Guestbook</a></td></tr></table></td>
<td><h1>How we repaired the old harbour crane</h1><p>The crane had stood unused since the spring floods, and nobody in the town believed that it would ever lift a load again.</p>
<p>We began with the gears, which were full of sand, and then replaced every rope and wheel that showed signs of rust or wear.</p></td></tr></table>
<p><font size=1>Copyright 2003 Harbour Society. All rights reserved.</font></p></body></html>"""
RECIPE = """<html><body><header><nav><a href="/">Start</a><a href="/r">Recipes</a></nav></header><main><article><h1>Plain bread</h1><p>This loaf needs only flour, water, salt and some patience on a quiet day.</p>
<ul><li>500 g of strong flour</li><li>350 g of water</li><li>10 g of salt</li></ul><ol><li>Mix everything in a large bowl and let it rest for one hour.</li><li>Fold the dough, shape it and bake it until it is brown.</li></ol></article></main>
<aside class="related"><h3>More recipes</h3><ul><li><a href=1>Rye bread</a></li><li><a href=2>Rolls</a></li></ul></aside><div class="newsletter"><form><label>Your email</label><button>Subscribe</button></form></div><footer>© Kitchen notes</footer></body></html>"""
RTL = """<html dir="rtl"><body><div id="menu"><ul><li><a href=1>ראשי</a></li><li><a href=2>אודות</a></li></ul></div><div id="content"><h1>הספרייה החדשה נפתחה</h1><p>הספרייה החדשה של העיר נפתחה אתמול לקהל הרחב, לאחר שנים של עבודה ותכנון.</p>
<p>המבקרים הראשונים הגיעו כבר בשעות הבוקר, ורבים מהם נשארו עד הערב כדי לקרוא.</p></div><div id="footer"><p>© כל הזכויות שמורות</p></div></body></html>"""


@pytest.fixture(scope="module")
def weights(spark):
    return extract.trained(spark, 3600)


@pytest.mark.parametrize(
    "page,has,lacks",
    [
        (NESTED, ["crane had stood unused", "began with the gears"], ["Guestbook", "All rights reserved"]),
        (RECIPE, ["Plain bread", "This loaf needs", "350 g of water", "Fold the dough"], ["Subscribe", "Rye bread", "Kitchen notes"]),
        (RTL, ["נפתחה אתמול", "בשעות הבוקר"], ["אודות", "כל הזכויות"]),
    ],
)
def test_labeller_on_pages_of_other_makes(weights, page, has, lacks):
    text = extract.main_texts(weights, [page], Memory())[0]
    assert [x for x in has if x not in text] == [] and [x for x in lacks if x in text] == []


def test_reader_agrees_with_every_generated_page():
    maker, memory = Pages(99), Memory()
    for _ in range(400):
        html, truth = maker.page()
        assert [b[1] for b in blocks_of(html, memory)] == [t for t, _ in truth]


def test_extract_of_odd_pages(spark, weights):
    pages = spark.createDataFrame([(1, None, None, "v"), (2, "u", "", "v"), (None, "u", "<p>" * 5000 + "text " * 20_000, "v"), (2, "u", "", "v"), (5, "u", "<script>x", "v")], "page_id long, url string, html string, text string")
    got = extract.extract(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and extract.extract(pages.limit(0)).count() == 0
    assert {r["text"] for r in got if r["page_id"] in (1, 2, 5)} == {""}


# -- the pipeline -----------------------------------------------------------------------------------------------------


def plain_groups(texts):
    """The least index that each text reaches over pairs of five-word Jaccard similarity 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").split() for t in texts)]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(texts)), 2):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(31)
    lexicon = [f"word{i}" for i in range(400)]
    texts = [" ".join(r.choice(lexicon, int(r.integers(60, 160)))) for _ in range(60)]
    texts += [" ".join(r.choice(["###", "$$$", "%%", "&&"], 80)) for _ in range(15)]
    for i in range(0, 20, 2):  # near copies
        words = texts[i].split()
        words[7] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], None, ""]
    items = [(k, " ".join(r.choice(lexicon, 30))) for k in range(4)]
    texts[40] = f"{texts[40]} {items[0][1]} and on"
    texts[41] = f"before {items[1][1]} {texts[41]}"
    rows = frame(spark, texts)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 75, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Quality: the k largest of the keys, k being the rows that reach the level of the fewest errors.
    scored = {x["doc_id"]: x for x in importance.resample(rows, labels).collect()}
    sample = [(scored[i]["log_weight"], i < 60) for i in range(0, 75, 2)]
    errors = {c: sum((w > c) != good for w, good in sample) for c in [-math.inf, *(w for w, _ in sample)]}
    least = min(c for c in errors if errors[c] == min(errors.values()))
    k = sum(x["log_weight"] > least for x in scored.values())
    cut = sorted((x["key"] for x in scored.values()), reverse=True)[k - 1]
    good = sorted(i for i, x in scored.items() if x["key"] >= cut)
    # Near copies, benchmark items, and the mix of what is left.
    lone = [good[i] for i in sorted(set(plain_groups([texts[i] for i in good])))]
    leaked = {lone[t] for t, _ in plain_leaks([texts[i] for i in lone], items, 0.6, 0.8)}
    clean = [i for i in lone if i not in leaked]
    left = rows.where(F.col("doc_id").isin(clean))
    mixed = mixing.mix(left).collect()
    by_source = defaultdict(list)
    for x in mixed:
        by_source[x["source"]].append(x)
    for own in by_source.values():
        assert abs(sum(x["copies"] * x["size"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own)
    want = Counter({x["doc_id"]: x["copies"] for x in mixed if x["copies"] and x["size"]})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in got) == want and leaked == {40, 41} and len(lone) < len(good) < len(texts)
    assert all(x["text"] == texts[x["doc_id"]] for x in got)
    sizes = Counter(x["shard"] for x in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(n)) for s, n in sizes.items())
