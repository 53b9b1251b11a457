"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phonyx.llm import chat, decontaminate, deobfuscate, extract, htmlblocks, importance, mixing, ngramlm, repetition, sharding, simhash, toxicity
from phonyx.llm.eliasfano import EliasFano, Store

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


def some_texts(n=60, seed=3):
    r = np.random.default_rng(seed)
    lexicon = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(lexicon, int(r.integers(1, 40)))) for _ in range(n)]
    return [*texts, None, "", "  \n ", texts[0], texts[0] + " tail", "Hot " * 300]


def test_simhash_against_brute_force(spark):
    texts = some_texts()

    def fp(t):
        words = WORDS.findall((t or "").encode().translate(simhash.ASCII_LOWER))
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [fp(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (prints[i], root[i]) for i in range(len(texts))}


def test_simhash_links_within_crowded_keys(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(0, 62, (60, 3))})
    nodes = spark.createDataFrame(list(zip(prints, range(len(prints)))), "fp long, node long")
    for hot in (4, 4096):
        pairs = {(a["u"], a["v"]) for a in simhash.links(nodes, hot=hot).collect()}
        # Links are stars of a key's components, so they are compared by the components they make.
        near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
        assert components(len(prints), pairs) == components(len(prints), near)


def components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_keep_one_leaves_one_of_each_group(spark):
    kept = [r["doc_id"] for r in simhash.keep_one(docs(spark, ["a b c d e f", "a b c d e f", None, "", "q w e r t z"])).collect()]
    assert sorted(kept) == [0, 2, 4]


def near_copies(r, n=40):
    """Texts of 150 words and, after each, a copy with words replaced so that the five-word similarity is about 0.7 to 0.95."""
    texts = []
    for i in range(n):
        words = [f"w{x}" for x in r.integers(0, 5000, 150)]
        texts.append(" ".join(words))
        for at in r.choice(30, 1 + i % 5, replace=False):
            words[5 * at] = f"new{at}"
        texts.append(" ".join(words))
    return texts


def jaccard_components(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return components(len(texts), near), near


def test_stage_links_five_word_similarity(spark):
    r = np.random.default_rng(11)
    base = [f"b{x}" for x in r.integers(0, 5000, 200)]
    large = []
    for _ in range(30):  # one group of many near copies, of which some pairs are below the similarity
        words = list(base)
        for at in r.choice(40, 2, replace=False):
            words[5 * at] = f"z{at}"
        large.append(" ".join(words))
    texts = [*near_copies(r), *large, "one two", "one two", "one three", None, ""]
    want, near = jaccard_components(texts)
    far = sum((simhash.fingerprint_of(texts[i]) ^ simhash.fingerprint_of(texts[j])).bit_count() > 3 for i, j in near)
    assert far > len(near) / 2
    rows = docs(spark, texts)
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(rows).collect()} == dict(enumerate(want))
    assert sorted(x["doc_id"] for x in simhash.keep_one(rows).collect()) == sorted(set(want))
    assert simhash.keep_one(rows.limit(0)).count() == 0


def test_deobfuscation_restores_words():
    counts = deobfuscate.character_counts([("idiot", 50), ("stupid", 40), ("trash", 30), ("hello", 60), ("world", 60), ("the", 200)])
    model = deobfuscate.CharacterModel(counts)
    for disguised, plain in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("$tup1d", "stupid"), ("tr4sh", "trash"), ("hello", "hello"), ("2024", "2024"), ("i d i o t", "idiot"), ("---", "---")):
        assert deobfuscate.restore(disguised, model) == plain


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    r = np.random.default_rng(5)
    clean = [f"w{i}" for i in range(30)]
    texts, toxic = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = list(r.choice(clean, 20)) + (["m0ron" if i % 8 else "moron", "scum"] if bad else [])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    texts += [None, ""]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = {x["doc_id"]: x for x in toxicity.score(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= x["score"] <= 1 for x in rows.values())
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in rows.items())
    held = [(toxic[i], x["score"] >= 0.5) for i, x in rows.items() if x["held_out"] and i < 300]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert rows[300]["score"] == rows[301]["score"]
    none = toxicity.score(docs(spark, ["a", None]), labels.limit(0)).collect()
    assert all(x["score"] == pytest.approx(1 / 3) for x in none)


def test_importance_keeps_the_likelier_half(spark):
    texts = ["good clean prose about things and more of it " * 3 if i % 2 else "### $$$ %%% &&& *** ### " * 5 for i in range(200)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["selected"] for r in importance.resample(docs(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    assert sum(got[i] for i in range(1, 200, 2)) >= 95 and sum(got[i] for i in range(0, 200, 2)) <= 5
    kept = importance.select_quality(docs(spark, texts), labels)
    assert kept.columns == docs(spark, texts).columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s}
    assert importance.resample(docs(spark, texts).limit(0), labels).count() == 0


def test_chat_round_trip_and_loss(spark):
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "a <s> b"), (1, 2, "assistant", None), (1, 3, "user", "[\\INST] " * 50), (1, 4, "assistant", "yes </s>\\"), (2, 0, "user", ""), (None, 1, "assistant", "x"), (3, None, None, "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (64, 2048):
        got = {r["conv_id"]: r for r in chat.digests(chat.format_windows(turns, budget, 8, 16)).collect()}
        for conv in (1, 2, 3, None):
            own = sorted((x for x in rows if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])
            said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
            loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
            r = got[conv]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_decontamination_finds_contained_items(spark):
    r = np.random.default_rng(2)
    lexicon = [f"w{i}" for i in range(500)]
    items = [" ".join(r.choice(lexicon, 25)) for _ in range(30)]
    texts = [" ".join(r.choice(lexicon, 120)) for _ in range(40)]
    for i in range(10):
        words = texts[i].split()
        texts[i] = " ".join(words[:60] + items[i].split() + words[60:])
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs(spark, [*texts, None, ""]), bench).collect()}
    assert found == {(i, i) for i in range(10)}
    assert {x["doc_id"] for x in decontaminate.drop_leaks(docs(spark, texts), bench).collect()} == set(range(10, 40))


def test_repetition_against_brute_force(spark):
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["a", "b", "c"], int(n))) for n in r.integers(1, 70, 30)] + [None, "", "x\nx\ny " + "p q r s t u v w x y z " * 20]
    for row in repetition.repetition_rules(docs(spark, texts)).collect():
        words = (texts[row["doc_id"]] or "").split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (row["n_words"], row["n_repeat_words"]) == (len(words), len(inside))
        longest = max((n for n in range(1, len(words)) if max(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values()) > 1), default=0)
        assert row["longest_repeat"] == longest


def test_mix_meets_targets_and_caps(spark):
    texts = ["w " * int(n) for n in np.random.default_rng(6).integers(0, 60, 300)] + [None]
    rows = mixing.mix(docs(spark, texts)).collect()
    taken, target, size = Counter(), {}, Counter()
    for x in rows:
        taken[x["source"]] += x["copies"] * x["size"]
        size[x["source"]] += x["size"]
        target[x["source"]] = x["target"]
        assert x["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= 60 and target[s] <= 2 * size[s] + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    repeated = Counter(x["doc_id"] for x in mixing.repeat_documents(docs(spark, texts)).collect())
    assert repeated == Counter({x["doc_id"]: x["copies"] for x in rows if x["copies"] and x["size"]})
    assert mixing.mix(docs(spark, texts).limit(0)).count() == 0


def test_hilbert_neighbours_and_shards(spark):
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    order = np.argsort(sharding.hilbert_of(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()
    rows = sharding.shard_documents(docs(spark, some_texts())).collect()
    sizes = Counter(x["shard"] for x in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard_documents(docs(spark, some_texts()).limit(0)).count() == 0


@pytest.mark.parametrize("n,universe", [(0, 5), (1, 1 << 64), (1000, 1100), (3000, 1 << 40)])
def test_elias_fano_access_and_search(n, universe):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    store = Store()
    coded = EliasFano(values, universe, store).mapped(store.map())
    assert (coded.access(np.arange(n)) == values).all()
    asked = np.concatenate((values, r.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True)))
    at, there = coded.find(asked)
    assert (at == np.searchsorted(values, asked)).all() and (there == np.isin(asked, values)).all()


@pytest.mark.parametrize("partitions", ["4", "60"])
def test_language_model_against_brute_force(spark, partitions):
    texts = [*some_texts(80), "the the the the " * 10]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # many shards make frequent words too frequent for one
    try:
        rows = {x["doc_id"]: x for x in ngramlm.score(docs(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    tokens = {i: [*WORDS.findall((t or "").encode().translate(simhash.ASCII_LOWER)), "end"] for i, t in enumerate(texts)}
    c1, c2, c3, h1, h2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            s = ["begin2", "begin", *own]
            for a, b, c in zip(s, s[1:], s[2:]):
                c1[c] += 1
                c2[b, c] += 1
                c3[a, b, c] += 1
                h1[b] += 1
                h2[a, b] += 1
    k1, k2 = Counter(a for a, _ in c2), Counter((a, b) for a, b, _ in c3)
    n, v, d = sum(c1.values()), len(c1), ngramlm.DISCOUNT

    def log_p(a, b, c):
        if c3[a, b, c]:
            return math.log10((c3[a, b, c] - d) / h2[a, b])
        out = math.log10(d * k2[a, b] / h2[a, b]) if h2[a, b] else 0.0
        if c2[b, c]:
            return out + math.log10((c2[b, c] - d) / h1[b])
        out += math.log10(d * k1[b] / h1[b]) if h1[b] else 0.0
        return out + math.log10((c1[c] + 1) / (n + v + 1))

    assert len(rows) == len(texts)
    for i, own in tokens.items():
        s = ["begin2", "begin", *own]
        x = rows[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (len(own), sum(c1[t] > 0 for t in own), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert x["base_score"] == pytest.approx(sum(math.log10((c1[t] + 1) / (n + v + 1)) for t in own), abs=1e-6)
        assert x["score"] == pytest.approx(sum(map(log_p, s, s[1:], s[2:])), rel=0.02, abs=0.01)


PAGE = """<html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies.</p></div><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<article><h1>Head</h1><p>First &amp; more text of the article.<p>Second   one.</article><script>var t="</p>";</script><div class="comments"><p>I like it.</p></div><footer>&copy; Site</footer></body></html>"""


def test_block_labeller(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>cut <b")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert got[1]["text"] == "Head\nFirst & more text of the article.\nSecond one." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == ""
    maker, right, all_, memory = htmlblocks.Pages(77), 0, 0, htmlblocks.Memory()
    weights = extract.trained(spark, 3600)
    for _ in range(150):
        html, truth = maker.page()
        blocks = htmlblocks.blocks_of(html, memory)
        if [b[1] for b in blocks] == [t for t, _ in truth]:
            main = extract.scores(weights, blocks, np.array([len(blocks)]), memory) > 0
            right += sum(bool(m) == y for m, (_, y) in zip(main, truth))
            all_ += len(truth)
    assert right >= 0.95 * all_


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(8)
    lexicon = [f"word{i}" for i in range(300)]
    texts = [" ".join(r.choice(lexicon, 80)) for _ in range(60)]
    texts[7] = texts[3]
    items = [texts[5]]
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, items[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {x["doc_id"] for x in out.select("doc_id").collect()}
    assert 7 not in ids and 5 not in ids and len(ids) >= 40


def test_pipeline_run_drops_near_copies(spark, tmp_path):
    import corpus_pipeline

    texts = near_copies(np.random.default_rng(12))
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"w{x}" for x in np.random.default_rng(13).integers(0, 5000, 40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    entered = {x["doc_id"] for x in corpus_pipeline.quality_classifier(spark, d, str(tmp_path)).select("doc_id").collect()}
    own = sorted(entered)
    want, near = jaccard_components([texts[i] for i in own])
    left = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert near and left <= {own[i] for i in want}
