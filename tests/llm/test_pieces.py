"""Texts cut at punctuation as well: the same ids, and a word is encoded once whatever follows it."""

import random

import public_tokenizers

from phonyx.llm import tokens


def test_pieces_have_the_tokens_of_whole_texts():
    r = random.Random(11)
    bits = ["the", "é", "Ö", "×", "÷", "ÿ", "'s", "'", "'ll", ",", ".", "|", "_", "*", "…", " ", " ", " ", "\n", "\t", "　", "\xa0", "▁", "9", "漢", "<|endoftext|>", "<|", "|>", "endoftext", "\U0001f600", "á"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for plain in (False, True):
        vocabulary = tokens.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"), plain)
        for memo in (30, 10**6):
            encode = tokens.Encoder(vocabulary, memo)
            assert [x.tolist() for k in range(0, 3000, 100) for x in encode(texts[k : k + 100])] == vocabulary.encode(texts)


def test_a_word_is_encoded_once_whatever_follows_it(monkeypatch):
    vocabulary = tokens.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"), False)
    sent, inner = [], vocabulary.encode
    monkeypatch.setattr(vocabulary, "encode", lambda texts: sent.extend(texts) or inner(texts))
    text = "so " + " ".join(f"heitzuä{x}" for x in (",", ".", ";", "&&&", "!", "?", ":", "%")) + " so"
    ids = tokens.Encoder(vocabulary)([text])[0].tolist()
    assert sum(t.count("heitzuä") for t in sent) == 1 and ids == inner([text])[0]
