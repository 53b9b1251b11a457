"""Noisy-channel restoration of disguised words: Viterbi over character lattices under a character language model.

A token is taken for the output of a channel that swaps letters for look-alike
characters (digits, symbols, letters of other scripts, accented letters),
doubles letters, puts symbols between them or spaces a word out.
Each character becomes a column of alternatives (what it may stand for and the
cost of that), and the cheapest path of channel and language model together is
the restored token. A token whose columns have one alternative each has only
one path and is passed on without a search.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np

#: Look-alikes, a fixed table: what a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
}
#: Look-alikes among the letters of other scripts, a fixed table.
FOREIGN = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
#: Masks: any vowel between two letters.
MASKS, VOWELS = "*#", "aeiou"
#: Costs in nats: of a look-alike, of a look-alike read as itself, of a dropped symbol, of a masked letter, of undoing a doubling, of joining two spaced-out characters.
SWAP, KEEP, DROP, MASK, UNDOUBLE, JOIN = 0.7, 3.0, 0.3, 2.5, 1.5, 0.0
EDGE_ONLY_DROP = frozenset("!*#|+(")

SUSPECT = re.compile(r"[\W\d_]|(.)\1", re.S)
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
LETTERS = re.compile(r"[^\W\d_]+\Z")
LETTER = re.compile(r"[^\W\d_]")
#: Letters without doublings and symbols after them that stand for nothing there: the lattice's one path is the letters.
MARKED = re.compile(r"((?:([a-z])(?!\2))+)[,.;:?&%'\")-]*(?:\*+|#+|!+)?\Z")
#: Letters that stand for themselves alone; three of them.
ALONE = re.compile(r"(?:([a-z])(?!\1))*")
HEAD = re.compile(r"([a-z])(?!\1)([a-z])(?!\2)([a-z])(?!\3)")
PLAIN, OTHER_SCRIPT = re.compile(r"[a-z]"), re.compile(f"[{''.join(FOREIGN)}]")


#: Letters with accents and their plain letters, by their Unicode decomposition.
ACCENTS = {c: base for c in map(chr, range(0xC0, 0x1F00)) if (base := unicodedata.normalize("NFD", c)[0]) != c and base.isascii() and base.isalpha()}


def lookalike_of(letter: str) -> str:
    """The plain letter that a letter of another script, or with an accent, may stand for; else nothing."""
    return FOREIGN.get(letter) or ACCENTS.get(letter, "")


def suspect(token: str) -> bool:
    """Whether a lower-cased token shows signs of the channel: a non-letter, a doubling, mixed scripts or several accents."""
    if SUSPECT.search(token):
        return True
    if token.isascii():
        return False
    return bool(OTHER_SCRIPT.search(token) and PLAIN.search(token)) or sum(c in ACCENTS for c in token) > 1


class CharacterModel:
    """Interpolated (Witten-Bell) character n-gram model of words; a word ends, and begins, with a space."""

    def __init__(self, counts: dict[str, int], order: int = 4):
        self.order = order
        self.counts = counts
        totals: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in counts.items():
            totals[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        self.totals, self.kinds = dict(totals), dict(kinds)
        self.alphabet = max(30, self.kinds.get("", 0)) + 1
        self.known: dict[str, float] = {}

    def probability(self, gram: str) -> float:
        if not gram:
            return 1 / self.alphabet
        context = gram[:-1]
        lower = self.probability(gram[1:]) if context else 1 / self.alphabet
        n = self.totals.get(context)
        if not n:
            return lower
        t = self.kinds[context]
        return (self.counts.get(gram, 0) + t * lower) / (n + t)

    def cost(self, gram: str) -> float:
        """Cost in nats of the last character after the ones before it."""
        found = self.known.get(gram)
        if found is None:
            found = -math.log(self.probability(gram))
            if len(self.known) < 1 << 20:
                self.known[gram] = found
        return found


def plain_character_counts(words: Iterable[tuple[str, int]], order: int = 4) -> Counter:
    """character_counts one n-gram at a time."""
    counts: Counter = Counter()
    for word, n in words:
        text = f" {word} "
        for i in range(1, len(text)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    counts[text[i - k + 1 : i + 1]] += n
    return counts


def character_counts(words: Iterable[tuple[str, int]], order: int = 4) -> Counter:
    """Counts of all n-grams up to `order` of words, each given with its count, in numpy over all words at once.

    A word begins and ends with a space, which neighbours share. N-grams are
    numbers made of their characters' places in the alphabet at hand; with an
    alphabet too large for that they are counted one at a time.
    """
    pairs = list(words)
    counts: Counter = Counter()
    if not pairs:
        return counts
    text = " " + " ".join(w for w, _ in pairs) + " "
    alphabet, ids = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    bits = len(alphabet).bit_length()
    if bits * order > 62:
        return plain_character_counts(pairs, order)
    ids, sizes = ids.astype(np.int64), np.array([len(w) + 1 for w, _ in pairs], np.int64)
    # Every character of a word and the space after it, with the distance from the space before the word.
    n = np.repeat(np.array([c for _, c in pairs], np.int64), sizes)
    far = np.arange(1, len(n) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.zeros(len(n), np.int64)
    for k in range(1, order + 1):
        key[k - 2 if k > 1 else 0 :] |= ids[: len(ids) - k + 1][(0 if k > 1 else 1) :] << (bits * (k - 1))
        inside = far >= k - 1
        kinds, which = np.unique(key[inside], return_inverse=True)
        total = np.bincount(which, n[inside])
        letters = [[chr(x) for x in alphabet[(kinds >> (bits * j)) & ((1 << bits) - 1)].tolist()] for j in range(k - 1, -1, -1)]
        for gram, c in zip(map("".join, zip(*letters)), total.tolist()):
            counts[gram] += int(c)
    return counts


def each_column(token: str, start: int = 0) -> Iterator[list[tuple[str, float]]]:
    """The lattice of a lower-cased token: alternatives (letters, cost) for each run of equal characters, from the run at `start` on."""
    i, n = start, len(token)
    while i < n:
        c = token[i]
        j = i + 1
        while j < n and token[j] == c:
            j += 1
        run = j - i
        edge = i == 0 or j == n
        if c.isalpha():
            kinds = {1: [(1, 0.0)], 2: [(2, 0.0), (1, UNDOUBLE)]}.get(run, [(1, 0.0), (2, 0.5)])
            found = [(c * k, price) for k, price in kinds]
            if other := "" if c.isascii() else lookalike_of(c):
                found += [(other * k, price + SWAP) for k, price in kinds]
            yield found
        elif c.isspace():
            yield [("", JOIN), (" ", 0.0)]
        else:
            found = [("", DROP * min(run, 4))]
            letters = LOOKALIKES.get(c)
            if letters and not (edge and c in EDGE_ONLY_DROP):
                found = [("", DROP + 3.0 if not edge or c.isdigit() else 1.5)]
                found += [(x, SWAP) for x in letters]
                if run > 1:
                    found += [(x + x, SWAP) for x in letters]
                if c.isdigit():
                    found.append((token[i:j], KEEP))
            elif c in MASKS and not edge:
                found += [(v, MASK) for v in VOWELS]
            elif c.isdigit():
                found = [(token[i:j], 0.0)]
            yield found
        i = j


def columns(token: str) -> list[list[tuple[str, float]]]:
    """The whole lattice."""
    return list(each_column(token))


def may_have(token: str, features: Collection[str], begun: Collection[str]) -> bool:
    """Whether any path through a lower-cased token's lattice, without blanks, begins with one of the features, or is one that ends in $.

    `begun` are the features' beginnings, themselves and the empty one included.
    A False needs no search: most tokens leave all features after a few columns.
    """
    # Letters that stand for themselves alone begin every path.
    plain = ALONE.match(token).end()
    for k in range(1, plain + 1):
        c = token[:k]
        if c in features:
            return True
        if c not in begun:
            return False
    at = {token[:plain]}
    for column in each_column(token, plain):
        after = set()
        for before in at:
            for letters, _ in column:
                c = before
                for x in letters:
                    c += x
                    if c in features:
                        return True
                    if c not in begun:
                        break
                else:
                    after.add(c)
        if not after:
            return False
        at = after
    return any(c + "$" in features for c in at)


def viterbi(lattice: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The cheapest string through the lattice; states are the last order - 1 characters, none is cut."""
    back = model.order - 1
    cost = model.cost
    states: dict[str, tuple[float, tuple]] = {" ": (0.0, ())}
    for column in lattice:
        after: dict[str, tuple[float, tuple]] = {}
        for context, (so_far, path) in states.items():
            for letters, price in column:
                total, c = so_far + price, context
                for x in letters:
                    if x == " " and c[-1] == " ":
                        continue
                    c += "0" if x.isdigit() else x
                    total += cost(c)
                    c = c[-back:]
                best = after.get(c)
                if best is None or total < best[0]:
                    after[c] = (total, (path, letters) if letters else path)
        states = after
    end = min((total + (cost(c + " ") if c[-1] != " " else 0.0), path) for c, (total, path) in states.items())
    pieces, path = [], end[1]
    while path:
        path, letters = path
        pieces.append(letters)
    return "".join(reversed(pieces))


def restore(token: str, model: CharacterModel) -> str:
    """A token, or characters spaced out by blanks, as the channel's likeliest input; may hold blanks.

    A token without any letter (a number, a rule of dashes) stands for itself.
    """
    token = token.lower()
    if not suspect(token) or not LETTER.search(token):
        return token
    lattice = columns(token)
    if all(len(c) == 1 for c in lattice):
        return "".join(c[0][0] for c in lattice)
    return viterbi(lattice, model)
