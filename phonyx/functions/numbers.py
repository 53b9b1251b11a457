"""German number words: digits spelled out, and words read as digits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The words of German numbers.
UNITS = ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn")
TENS = {20: "zwanzig", 30: "dreißig", 40: "vierzig", 50: "fünfzig", 60: "sechzig", 70: "siebzig", 80: "achtzig", 90: "neunzig"}
LARGE = {10**6: ("Million", "Millionen"), 10**9: ("Milliarde", "Milliarden"), 10**12: ("Billion", "Billionen"), 10**15: ("Billiarde", "Billiarden")}
POINT, SIGNS = "Komma", {"minus": "-", "plus": "+"}
#: Numbers up to this stay words where they stand alone.
WORDS_UP_TO = 2

DIGITS = re.compile(r"\b\d+(?:[.,]\d+)?\b")


def spelled(n: int) -> str:
    """A whole number from 0 up to below 10^18 in words."""
    if n < 20:
        return UNITS[n]
    if n < 100:
        tens, unit = n // 10 * 10, n % 10
        return (f"{'ein' if unit == 1 else UNITS[unit]}und" if unit else "") + TENS[tens]
    for size, word in ((1000, "tausend"), (100, "hundert")):
        if size <= n < 10**6:
            many, rest = divmod(n, size)
            return ("ein" if many == 1 else spelled(many)) + word + (spelled(rest) if rest else "")
    size = max(s for s in LARGE if s <= n)
    many, rest = divmod(n, size)
    head = f"eine {LARGE[size][0]}" if many == 1 else f"{spelled(many)} {LARGE[size][1]}"
    return head + (f" {spelled(rest)}" if rest else "")


def spelled_token(token: str) -> str:
    """Digits with or without a decimal point or comma in words; what is too large stays as it is."""
    whole, _, part = token.replace(",", ".").partition(".")
    if int(whole) >= 10**18:
        return token
    if not part:
        return spelled(int(whole))
    # Digits after the point one by one, without zeros at the end but for a single one.
    kept = part.rstrip("0") or "0"
    return f"{spelled(int(whole))} {POINT} {' '.join(UNITS[int(d)] for d in kept)}"


def grammar() -> tuple[re.Pattern, re.Pattern, dict[str, int]]:
    """Patterns of one written number word and of its parts below a thousand, and the values of the simple words."""
    values = {w: n for n, w in enumerate(UNITS)} | {w: n for n, w in TENS.items()} | {"ein": 1, "eine": 1, "einen": 1, "dreissig": 30}
    units = "|".join(["ein", *UNITS[2:10]])
    tens = "|".join([*TENS.values(), "dreissig"])
    simple = "|".join(sorted([*UNITS, *TENS.values(), "dreissig"], key=len, reverse=True))
    small = f"(?:(?:{units})und(?:{tens})|{simple})"
    hundreds = f"(?:(?:{units})?hundert(?:(?:und)?{small})?|{small})"
    word = f"(?:(?:{hundreds}|ein)?tausend(?:(?:und)?{hundreds})?|{hundreds})"
    return re.compile(word), re.compile(f"(?:(?P<many>{units})?(?P<hundert>hundert)(?:und)?)?(?:(?P<unit>{units})und(?P<tens>{tens})|(?P<simple>{simple}))?"), values


WORD, BELOW_1000, VALUES = grammar()
SCALES = {w.lower(): size for size, both in LARGE.items() for w in both}
TOKEN = f"(?:{WORD.pattern}|{'|'.join(sorted(SCALES, key=len, reverse=True))}|eine|ein)"
RUN = re.compile(rf"\b(?:(?:minus|plus) )?{TOKEN}(?: {TOKEN})*(?: komma(?: {TOKEN})+)?\b", re.IGNORECASE)
#: What a text must have for anything to be read as a number.
HINT = r"(?i)(null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|elf|zwölf|zwanzig|ßig|ssig|zig|hundert|tausend|million|milliarde|billi)"
#: What a word is to a run: nothing, an article, a sign, or a number.
PLAIN, ARTICLE, SIGN, NUMBER_WORD = range(4)
WORDS, NUMERIC, KINDS = re.compile(r"\w+"), re.compile(TOKEN, re.IGNORECASE), {}
#: Words whose kind a task remembers.
REMEMBERED = 200_000


def below_1000(word: str) -> int | None:
    m = BELOW_1000.fullmatch(word)
    if m is None or not word:
        return None
    small = VALUES[m["simple"]] if m["simple"] else VALUES[m["tens"]] + VALUES[m["unit"]] if m["tens"] else 0
    return (VALUES[m["many"]] if m["many"] else 1) * 100 + small if m["hundert"] else small


def value_of(word: str) -> int | None:
    """The value of one written number word below a million."""
    head, thousand, tail = word.partition("tausend")
    if not thousand:
        return below_1000(word)
    many = 1 if head in ("", "ein") else below_1000(head)
    rest = below_1000(tail.removeprefix("und")) if tail else 0
    return None if many is None or rest is None else many * 1000 + rest


def read_run(run: str) -> str:
    """A run of number words as digits; neighbours that do not make one number stay apart."""
    words = run.lower().split()
    sign = SIGNS.get(words[0], "")
    own, after = (words[1:] if sign else words), []
    if "komma" in own:
        at = own.index("komma")
        own, after = own[:at], own[at + 1 :]
    out: list[str] = []
    total, scale, pending, alone = 0, None, None, 0

    def close() -> None:
        nonlocal total, scale, pending, alone
        if pending is not None or scale is not None:
            n = total + (pending or 0)
            # A small number by itself stays a word, as does an article.
            out.append(words_alone if alone == 1 and n <= WORDS_UP_TO and not after and not sign else str(n))
        total, scale, pending, alone = 0, None, None, 0

    words_alone = ""
    for w in own:
        if w in SCALES:
            if pending is None or scale is not None and SCALES[w] >= scale:
                close()
                pending = 1
            total, scale, pending = total + pending * SCALES[w], SCALES[w], None
            alone += 1
            continue
        if w in ("hundert", "tausend") and pending is not None and pending < 10:
            pending *= 100 if w == "hundert" else 1000
            alone += 1
            continue
        n = VALUES[w] if w in ("ein", "eine") else value_of(w)
        if n is None:
            return run
        if pending is not None or scale is not None and n >= scale:
            close()
        pending, words_alone = n, w
        alone += 1
    close()
    if after:
        digits = [value_of(w) if w not in ("ein", "eine") else 1 for w in after]
        if any(d is None for d in digits) or not out:
            return run
        out[-1] += "," + "".join(map(str, digits))
    if sign and out and out[0][:1].isdigit():
        out[0] = sign + out[0]
    return " ".join(out)


@pandas_udf(StringType())
def spell_digits(text: pd.Series) -> pd.Series:
    """Digits of texts in words, where they stand."""
    return text.map(lambda t: None if t is None else DIGITS.sub(lambda m: spelled_token(m[0]), t))


def kind_of(word: str) -> int:
    """The word's kind, remembered: tokens of a run are whole words, so no other place of a text can begin one."""
    kind = KINDS.get(word)
    if kind is None:
        if len(KINDS) >= REMEMBERED:
            KINDS.clear()
        low = word.lower()
        kind = ARTICLE if low in ("ein", "eine") else SIGN if low in SIGNS else NUMBER_WORD if NUMERIC.fullmatch(word) else PLAIN
        KINDS[word] = kind
    return kind


def has_run(text: str) -> bool:
    """Whether RUN may find more in the text than an article alone: a number word, or articles beside each other or a sign."""
    kinds = set(map(kind_of, set(WORDS.findall(text))))
    if NUMBER_WORD in kinds or ARTICLE not in kinds:
        return NUMBER_WORD in kinds
    low = text.lower()
    return SIGN in kinds or "ein ein" in low or "eine ein" in low or "komma" in low


@pandas_udf(StringType())
def read_words(text: pd.Series) -> pd.Series:
    """Number words of texts as digits, where they stand."""
    return text.map(lambda t: t if t is None or not has_run(t) else RUN.sub(lambda m: m[0] if m[0].lower() in ("ein", "eine") else read_run(m[0]), t))


def digits_to_words(text: Column) -> Column:
    """spell_digits; only texts with digits go to Python."""
    return F.coalesce(spell_digits(F.when(text.rlike(r"[0-9]"), text)), text)


def words_to_digits(text: Column) -> Column:
    """read_words; only texts with something like a number word go to Python."""
    return F.coalesce(read_words(F.when(text.rlike(HINT), text)), text)
