"""Operators 11 to 13 against plain versions of them."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from tokenizers import Tokenizer

from phonyx.llm import alignment, negatives, tokenfiles, tokens, wavelet

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "a▁ b ▁c", "x<|endoftext|> y <|endoftext|>", "<s> </s> <unk> [INST]", "\n\nline \n next\r\n\ttab", "naïve café \U0001f600 漢字 ال",
       "a b c 　d", "it's they'll 'tis ' s", "\x00 nul \x1f \x85 e", "9 99 999 9999 1,000.5", "́ combining é", "same text here", "same text here", "w" * 3000, "​ zero ﻿ width"]


def some_texts(n, seed=5):
    r = random.Random(seed)
    alphabet = "abcdeABC  äßé.,'\n\t0123 ▁漢\U0001f600-_  "
    lexicon = ["".join(r.choice("aeiourstnl") for _ in range(r.randint(1, 9))) for _ in range(200)]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) if k % 2 else " ".join(r.choice(lexicon) for _ in range(r.randint(1, 80))) for k in range(n)]


def test_parts_have_the_same_tokens_alone():
    texts = [t for t in ODD if t] + some_texts(400)
    for plain in (False, True):
        a = tokens.ByteTokens(BYTES, plain)
        assert a.cuts
        for memo in (50, 10**6):
            small = tokens.Encoder(a, memo)
            got = [x.tolist() for k in range(0, len(texts), 40) for x in small(texts[k : k + 40])]
            assert got == a.encode(texts) and [x.tolist() for x in small(texts[:60])] == a.encode(texts[:60])
    b = tokens.PieceTokens(PIECES)
    assert b.cuts
    for t in texts:
        assert [i for p in tokens.parts_of(t) for i in b.encode([p])[0]] == b.encode([t])[0], t
        assert " ".join(tokens.parts_of(t)) == t


def test_wavelet_matrix_answers():
    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (5, 1), (777, 40), (40_000, 50_257)):
        ids = np.minimum(r.zipf(1.3, n), top).astype(np.uint32) if n else np.zeros(0, np.uint32)
        cuts = np.diff([0, *sorted(r.integers(0, n + 1, 3)), n])
        shard = wavelet.Shard(wavelet.pack(ids, cuts, [4, None, -2, 2**40], {"part": 1}, block=64), remembered=5)
        assert shard.ids().tolist() == ids.tolist() and shard.doc_ids == [4, None, -2, 2**40] and shard.lengths.tolist() == cuts.tolist()
        for i in r.integers(0, max(n, 1), 30 if n else 0):
            assert shard.access(int(i)) == ids[i]
        for token in [*map(int, ids[:10]), top + 7, 2**31]:
            a, b = sorted(map(int, r.integers(0, n + 1, 2)))
            assert shard.count(token, a, b) == int((ids[a:b] == token).sum())
            where = np.flatnonzero(ids == token)
            assert [shard.select(token, k) for k in range(min(20, len(where)))] == where[:20].tolist()
            with pytest.raises(IndexError):
                shard.select(token, len(where))
        if n:
            assert shard.document(2).tolist() == ids[cuts[0] + cuts[1] : cuts[0] + cuts[1] + cuts[2]].tolist()
            assert list(shard.locate(int(ids[0])))[:3] == np.flatnonzero(ids == ids[0])[:3].tolist()


@pytest.mark.parametrize("limit", [40, 1 << 22])
def test_token_files_against_plain_encoding(spark, limit):
    texts = ODD + some_texts(200)
    rows = [(None if k == 7 else (k * 7919) % 211 - 5, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, ids int").repartition(3)
    files, folder = tokenfiles.write(docs, BYTES, shard_tokens=limit)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read(files, folder).collect()), key=lambda r: r[1])
    plain = Tokenizer.from_file(BYTES)
    coded = [(d, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t, _, _ in rows]
    assert [g[0] for g in got] == sorted((d for d, _ in coded), key=lambda d: -(10**9) if d is None else d)
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in coded)
    kept = files.orderBy("part", "seq").collect()
    assert sum(f["documents"] for f in kept) == len(rows) and (len(kept) > 50 if limit == 40 else len(kept) <= 4)
    shard = tokenfiles.opened(folder, kept[0]["name"])
    assert shard.access(shard.tokens - 1) == 2 and shard.count(2) >= kept[0]["documents"]
    assert spark.createDataFrame([], "doc_id long, text string").transform(lambda d: tokenfiles.read(*tokenfiles.write(d, BYTES))).count() == 0


def aligned(docs):
    """Plain alignment: whole texts, byte by byte, all pairs tried."""
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    bytes_a = tokens.ByteTokens(BYTES, True).token_bytes()
    done, pairs = [], Counter()
    for d, t in docs:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes_a[i] for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            done.append((d, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        both, groups = sorted(set(ends_a) & set(ends_b)), []
        low = 0
        for high in both:
            groups.append(([i for i, e in zip(ids_a, ends_a) if low < e <= high], [i for i, e in zip(ids_b, ends_b) if low < e <= high]))
            low = high
        links = [(i, j) for i, e, x in zip(ids_a, ends_a, raw_a) for j, f, y in zip(ids_b, ends_b, raw_b) if e - len(x) < f and f - len(y) < e]
        pairs.update(links)
        done.append((d, ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (_, j), n in pairs.items():
        most[j] = max(most[j], n)
    for d, ids_a, ids_b, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield d, len(ids_a), len(ids_b), len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""


@pytest.mark.parametrize("block", [200, 1 << 24])
def test_alignment_against_plain_version(spark, block):
    texts = ODD + some_texts(150, seed=9)
    rows = [(None if k == 3 else k % 140, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "x", [1]) for d, t in rows], "doc_id long, text string, block string, pair array<int>").repartition(3)
    found = Counter(tuple(r) for r in alignment.align(docs, BYTES, PIECES, block=block).collect())
    want = Counter(aligned(rows))
    assert found == want
    assert sum(w[1] == 0 for w in want) >= 3 and max(w[1] for w in want) > 100
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0


def test_components_are_the_least_reachable_node():
    r = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (400, 380), (300, 900)):
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(u, v):
                want[x] = want[y] = min(want[x], want[y])
        assert alignment.components(n, u, v).tolist() == want


def plain_negatives(rows):
    ready = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held = negatives.limit(max(len(r[1] or []) for r in rows))
        ready.append((i, [max(-held, min(held, math.floor(256 * float(np.float32(x))))) for x in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    out = []
    for i, v, label in ready:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in ready if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("wave,block,scale", [(1 << 20, 1024, 1.0), (200, 7, 1.0), (400, 16, 3e4), (400, 16, 1e30)])
def test_hard_negatives_against_plain_version(spark, wave, block, scale):
    r = np.random.default_rng(8)
    rows = [(int(k), (r.normal(0.1, 0.2, 12) * scale).astype(np.float32).tolist(), int(r.integers(0, 10))) for k in range(-200, 500)]
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(60)] + [(1100, rows[5][1], 1), (1200, [], 3), (1300, rows[9][1][:4], 2), (300, rows[3][1], 4), (7, rows[4][1], 1)]
    rows += [(600, None, 1), (None, rows[0][1], 1), (700, rows[0][1], None), (800, [float("nan")] * 12, 1), (801, [float("inf")] * 12, 2), (802, [None] * 12, 2)]
    frame = spark.createDataFrame([Row(vec_id=i, embedding=v, label=m, rank=1, anchor_id="x") for i, v, m in rows], "vec_id long, embedding array<float>, label int, rank int, anchor_id string").repartition(3)
    found = Counter(tuple(x) for x in negatives.mine(frame, block=block, wave_bytes=wave).collect())
    assert found == plain_negatives(rows) and (len(found) > 100 or scale > 1e20)
    assert negatives.mine(frame.limit(0)).count() == 0 and negatives.mine(frame.filter("vec_id = 3")).count() == 0


def test_products_beyond_floats_are_exact():
    r = np.random.default_rng(2)
    a, b = (r.integers(-(2**27), 2**27, (9, 64)).astype(float) for _ in range(2))
    assert negatives.products(a, b, 2.0**54).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
