"""Public tokenizers in tasks: loading them once a worker, and cutting texts where no token can cross."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: White space of any kind, controls, invisible spaces, and the mark that stands for a space in pieces: first and last code points.
OPEN = [(0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
SOLID = "[^" + "".join(f"{chr(a)}-{chr(z)}" for a, z in OPEN) + "]"
CUT = re.compile(f"(?<={SOLID}) (?={SOLID})")
NOT_A_CUT = re.compile(f" (?!{SOLID})|(?<!{SOLID}) ")

#: Parts that can stand side by side with a space between them, and be cut again there.
JOINABLE = re.compile(f"{SOLID}(?:.*{SOLID})?", re.DOTALL)
#: The same with the space before it.
SPACED = re.compile(f" {JOINABLE.pattern}", re.DOTALL)

#: How a piece writes a space.
MARK = "\u2581"

#: The open characters beyond ASCII. Without one in a text, all its bytes from 0x80 on are of solid characters.
OPEN_LETTERS = re.compile("[" + "".join(f"{chr(max(a, 0x80))}-{chr(z)}" for a, z in OPEN if z >= 0x80) + "]")
_byte = np.arange(256)
SOLID_BYTES = (_byte > 0x20) & (_byte != 0x7F)
#: Letters and digits; the second bytes of letters after 0xC3; punctuation but for the apostrophe, which starts endings of words.
WORD_BYTES = np.array([b < 128 and chr(b).isalnum() for b in _byte])
LATIN_BYTES = (_byte >= 0x80) & (_byte < 0xC0) & (_byte != 0x97) & (_byte != 0xB7)
MARK_BYTES = SOLID_BYTES & (_byte < 0x80) & ~WORD_BYTES & (_byte != ord("'"))

_loaded: dict[tuple, object] = {}


def parts_of(text: str) -> list[str]:
    """Parts whose join by single spaces is the text, cut at single spaces between solid characters.

    A byte-level vocabulary with the usual word pattern starts a token at each such space, and so does a piece vocabulary
    without pieces that hold a space after another character. So each part, with its space, has the same tokens alone.
    """
    lines = text.replace("\n", "") if "\n" in text else text
    # All of it printable but line feeds, and single spaces between other characters: no need to look at each space.
    plain = lines.isprintable() and not any(x in text for x in (MARK, "  ", " \n", "\n ")) and text[:1] != " " and text[-1:] != " "
    return text.split(" ") if plain or NOT_A_CUT.search(text) is None else CUT.split(text)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] places, then the same of the next."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Tokens:
    """What both libraries' vocabularies share: `encode` of texts, `token_bytes`, and what a part has before it when it is encoded."""

    before, cuts = "", False

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        found = self.encode(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def _together(self, groups: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each group as one text, cut again where its parts end; part by part where a token does not end there."""
        flats, counts = [], []
        for group, ids in zip(groups, self.encode([self.before + " ".join(g) for g in groups])):
            flat = np.array(ids, np.int64)
            ends = np.cumsum(self.lengths[flat])
            want = np.cumsum(np.fromiter((len(p.encode()) for p in group), np.int64, len(group)) + 1)
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                counts.append(np.diff(at + 1, prepend=0))
            else:
                flat, n = self.whole([self.before + p for p in group])
                counts.append(n)
            flats.append(flat)
        return flats, counts

    def flat(self, parts: list[str], group: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and how many each has; what can stand side by side is encoded many at a time."""
        self.lengths = np.array([len(x) for x in self.token_bytes()]) if not hasattr(self, "lengths") else self.lengths
        fits = np.fromiter((self.cuts and JOINABLE.fullmatch(p) is not None for p in parts), bool, len(parts))
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        plain = [parts[i] for i in order[: int(fits.sum())]]
        flats, counts = self._together([plain[i : i + group] for i in range(0, len(plain), group)])
        rest, n = self.whole([self.before + parts[i] for i in order[len(plain) :]])
        every, many = np.concatenate([*flats, rest]), np.concatenate([*counts, n])
        if not len(rest):
            return every, many
        place = np.empty(len(parts), np.int64)
        place[order] = np.arange(len(parts))
        starts = (np.cumsum(many) - many)[place]
        return every[ragged(starts, many[place])], many[place]


class ByteTokens(Tokens):
    """A byte-level vocabulary of the tokenizers library, without special tokens around a text."""

    def __init__(self, path: str, plain: bool) -> None:
        """With `plain`, the strings of special tokens inside texts are ordinary text."""
        self.before = " "
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        step = form.get("pre_tokenizer") or {}
        self.cuts = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not form.get("normalizer")
        self.added = [x["content"] for x in form.get("added_tokens", [])]
        self.cuts = self.cuts and not any(x.get("lstrip") or x.get("rstrip") or {" ", "\n"} & set(x["content"]) for x in form.get("added_tokens", []))
        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = plain
        self.size = self.inner.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        out = []
        for i in range(self.size):
            entry = self.inner.id_to_token(i) or ""
            out.append(bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode())
        return out


class PieceTokens(Tokens):
    """A piece vocabulary of the sentencepiece library, which puts a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.inner.get_piece_size()
        self.pieces = [self.inner.id_to_piece(i) for i in range(self.size)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.inner.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]


def byte_tokens(path: str, plain: bool) -> ByteTokens:
    """The vocabulary, loaded once a worker."""
    key = ("byte", path, plain)
    if key not in _loaded:
        _loaded[key] = ByteTokens(path, plain)
    return _loaded[key]


def piece_tokens(path: str) -> PieceTokens:
    key = ("piece", path)
    if key not in _loaded:
        _loaded[key] = PieceTokens(path)
    return _loaded[key]


class Encoder:
    """Ids of whole texts; pieces met before are remembered by number, about `memo` of them, those that came most often first.

    Texts are cut where the usual word pattern starts anew whatever stands around: before a single space and on both sides of a
    line feed between solid characters, and between a letter or digit and punctuation. So each piece, as it stands, has the same
    tokens alone. A slab's different pieces are found in Arrow; only they are looked up one by one.
    """

    def __init__(self, tokens: ByteTokens, memo: int = 500_000) -> None:
        self.tokens, self.memo = tokens, memo
        self.lengths = np.array([len(x) for x in tokens.token_bytes()])
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        #: Ids of all numbers one after another, where each one's begin, how many they are, how often it came.
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.counts, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Half of the memory stays at most: what came more than once, the most frequent first; long pieces go."""
        keys, pool, starts, counts, uses = list(self.known), self.pool, self.starts, self.counts, self.uses
        kept = np.flatnonzero((uses > 1) & (counts <= 64))
        kept = kept[np.argsort(-uses[kept], kind="stable")[: self.memo // 2]]
        self._reset()
        self.known = {keys[n]: k for k, n in enumerate(kept.tolist())}
        self._append(pool[ragged(starts[kept], counts[kept])], counts[kept])

    def _append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts, self.uses = np.concatenate([self.counts, counts]), np.concatenate([self.uses, np.zeros(len(counts), np.int64)])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def _numbers(self, kinds: list[str]) -> np.ndarray:
        """Numbers of different pieces; what is new is encoded."""
        found = list(map(self.known.get, kinds))
        new = [p for p, n in zip(kinds, found) if n is None]
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        for at in range(0, len(new), 50_000):
            self._append(*self._alone(new[at : at + 50_000]))
        fresh = iter(range(first, first + len(new)))
        return np.array([next(fresh) if n is None else n for n in found], np.int64)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        fits = np.fromiter((SPACED.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        n = int(fits.sum())
        ids, counts = self._joined([pieces[i] for i in order[:n].tolist()])
        rest, many = self.tokens.whole([pieces[i] for i in order[n:].tolist()])
        ids, counts = np.concatenate([ids, rest]), np.concatenate([counts, many])
        back = np.argsort(order)
        return ids[ragged((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def _joined(self, pieces: list[str], group: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that stand side by side as they are: many are one text, cut again where they end."""
        ids, _ = self.tokens.whole(["".join(pieces[i : i + group]) for i in range(0, len(pieces), group)])
        ends = np.cumsum(self.lengths[ids])
        want = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)))
        place = np.zeros(int(max(ends[-1:].sum(), want[-1:].sum())) + 1, np.int64)
        place[ends] = np.arange(1, len(ends) + 1)
        counts = np.diff(place[want], prepend=0)
        # A token across an end: none is known, but these are then encoded one by one.
        return (ids, counts) if place[want].all() and place[want[-1:]].sum() == len(ids) else self.tokens.whole(pieces)

    def _bounds(self, texts: list[str], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts one after another."""
        solid, word = SOLID_BYTES[data], WORD_BYTES[data]
        # The letters from U+00C0 to U+00FF, but for two signs, are two bytes.
        word[1:] |= (data[:-1] == 0xC3) & LATIN_BYTES[data[1:]]
        for text, a, z in zip(texts, starts.tolist(), ends.tolist()):
            if not text.isascii() and (MARK in text or not text.isprintable()) and OPEN_LETTERS.search(text):
                solid[a:z] &= data[a:z] < 0x80
            if any(x in text for x in self.tokens.added):
                word[a:z] = False
        some = ends > starts
        inside = np.zeros(len(data), bool)
        inside[1:-1] = solid[:-2] & solid[2:]
        inside[starts[some]] = inside[ends[some] - 1] = False
        feed = inside & (data == 10)
        cut = feed | (inside & (data == 32))
        cut[1:] |= feed[:-1] | (word[:-1] & MARK_BYTES[data[1:]])
        cut[starts[some]] = True
        return np.flatnonzero(cut)

    def slab(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has. The texts should be of bounded size together."""
        if len(self.known) > self.memo or len(self.pool) > 16 * self.memo:
            self._shrink()
        raw = [t.encode() for t in texts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        # Arrow counts the bytes of an array of strings in 31 bits.
        if not self.tokens.cuts or not len(ends) or not 0 < ends[-1] < 1 << 31:
            ids, counts = self.tokens.whole(texts)
            return ids.astype(np.uint32), counts
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = self._bounds(texts, data, starts, ends)
        offsets = np.append(bounds, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(bounds), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        # As numpy objects: several times as fast as Arrow's own list.
        number = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = pieces.indices.to_numpy()
        self.uses[number] += np.bincount(which, minlength=len(number))
        n = number[which]
        many = self.counts[n]
        before = np.concatenate([[0], np.cumsum(many)])
        return self.pool[ragged(self.starts[n], many)], before[np.searchsorted(bounds, ends)] - before[np.searchsorted(bounds, starts)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.slab(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def encoder(path: str) -> Encoder:
    """The worker's encoder of a byte-level vocabulary, whose memory serves all tasks of the worker."""
    key = ("encoder", path)
    if key not in _loaded:
        _loaded[key] = Encoder(byte_tokens(path, plain=False))
    return _loaded[key]
