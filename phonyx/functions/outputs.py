"""What a model's server returned, read as what was spoken and by whom."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

# The marks of turn markup (seconds, with or without a closing bracket where they have decimals; a speaker's number; a bracket
# that nothing closes), labels of sounds that are no words, and locale tags.
SECONDS = r"\[\s*(\d+[.,]\d+)\s*\]?|\[\s*(\d+)\s*\]"
SPEAKER = r"\[\s*[Ss](\d+)\s*\]"
LONE_BRACKET = r"(\[)(?=[^\]]*(?:\[|$))"
NO_WORDS = ("noise", "silence", "music", "lyric", "click", "speech", "environmental sounds", "unintelligible speech")
LOCALE = r"<[a-z]{2,3}-[A-Z]{2}>"

MARK = re.compile(f"{SECONDS}|{SPEAKER}|{LONE_BRACKET}")
SOUND = re.compile(rf"\[\s*(?:{'|'.join(NO_WORDS)})\s*\]", re.IGNORECASE)

#: A turn: speaker, start and end in seconds, words.
Turn = tuple[str | None, float | None, float | None, str]


def squeezed(text: str) -> str:
    return " ".join(text.split())


def events_of(raw: str) -> Iterator[tuple[str, object]]:
    """Marks and what stands between them, in order."""
    at = 0
    for m in MARK.finditer(raw):
        yield "words", raw[at : m.start()]
        decimal, whole, speaker, _ = m.groups()
        if speaker:
            yield "speaker", f"S{speaker}"
        elif decimal or whole:
            yield "time", float((decimal or whole).replace(",", "."))
        at = m.end()
    yield "words", raw[at:]


def marked_turns(raw: str) -> tuple[str, list[Turn]]:
    """Text with marks such as `[4.18][S01] words [10.96]`.

    A speaker mark opens a turn at the last time seen; words open one without a speaker where none is open; a time
    closes a turn that has words. A mark parts words. Turns without words are none.
    """
    turns: list[Turn] = []
    clock: float | None = None
    turn: tuple[str | None, float | None, list[str]] | None = None
    said: list[str] = []

    def closed(end: float | None) -> None:
        if turn and turn[2]:
            turns.append((turn[0], turn[1], end, squeezed(" ".join(turn[2]))))

    for kind, value in events_of(raw):
        if kind == "words" and value.strip():
            turn = turn or (None, clock, [])
            turn[2].append(value)
            said.append(value)
        elif kind == "speaker":
            closed(None)
            turn = (value, clock, [])
        elif kind == "time":
            if turn and turn[2]:
                closed(value)
                turn = None
            clock = value
    closed(None)
    return squeezed(" ".join(said)), turns


def seconds(value: object) -> float | None:
    """A number, also as text; null for anything else, true and false among it."""
    if value is None or isinstance(value, bool):
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def speaker_name(value: object) -> str | None:
    """Numbers as S00, S01, ...; other names as they are."""
    if value is None or isinstance(value, bool):
        return None
    number = isinstance(value, int) or isinstance(value, str) and value.isdigit()
    return f"S{int(value):02d}" if number else str(value)


def open_string(tail: str) -> str | None:
    """The words of the first `Content` whose string is still open where the answer ends."""
    for m in re.finditer(r'"Content"\s*:\s*"', tail):
        at, body = m.end(), tail[m.end() :]
        while at < len(tail) and tail[at] != '"':
            at += 2 if tail[at] == "\\" else 1
        if at == len(tail):
            try:
                return str(json.loads(f'"{body}"'))
            except ValueError:
                return body
    return None


def json_turns(raw: str) -> tuple[str, list[Turn]]:
    """A list of records with Start, End, Speaker and Content, read record by record.

    Records are flat: one reaches from an opening brace to the next brace, which closes it. What is no valid record is
    left out; of an answer that ends inside a record, the words of its open string are kept, as a turn without
    speaker and times. An answer without any record is plain text.
    """
    pieces = raw.split("}")
    turns: list[Turn] = []
    end, at, seen = 0, 0, raw.strip() == "[]"
    for piece in pieces[:-1]:
        at += len(piece) + 1
        _, brace, body = piece.rpartition("{")
        if not brace:
            continue
        seen, end = True, at
        try:
            record = json.loads("{" + body + "}")
        except ValueError:
            continue
        words = squeezed(SOUND.sub(" ", str(record.get("Content") or "")))
        if words:
            turns.append((speaker_name(record.get("Speaker")), seconds(record.get("Start")), seconds(record.get("End")), words))
    rest = open_string(raw[end:])
    if rest is not None:
        seen = True
        # A bracket still open at the very end began a label.
        words = squeezed(SOUND.sub(" ", re.sub(r"\[[^\[\]]*$", "", rest)))
        if words:
            turns.append((None, None, None, words))
    return (" ".join(t[3] for t in turns) if seen else squeezed(raw)), turns


def untagged(raw: str) -> tuple[str, list[Turn]]:
    """Text with locale tags between its sentences."""
    return squeezed(re.sub(LOCALE, " ", raw)), []


#: Parsers by the name of the format, which is a fixed value.
PARSERS: dict[str, Callable[[str], tuple[str, list[Turn]]]] = {"moss-timed-speakers": marked_turns, "vibevoice-json": json_turns, "nemotron-locale-tags": untagged}

TURNS = ArrayType(StructType([StructField("speaker", StringType()), StructField("start_s", DoubleType()), StructField("end_s", DoubleType()), StructField("text", StringType())]))


@pandas_udf(StructType([StructField("text", StringType()), StructField("turns", TURNS)]))
def parsed(raw: pd.Series, form: pd.Series) -> pd.DataFrame:
    """(text, turns) of outputs by the name of their format: plain text (as it is, no turns) where that is null; null for null; an unknown name is an error."""

    def one(text: str | None, name: str | None) -> tuple:
        if text is None or name is None:
            return text, None
        if name not in PARSERS:
            raise KeyError(f"unknown output format {name!r}; have {sorted(PARSERS)}")
        return PARSERS[name](text)

    rows = [one(a, b) for a, b in zip(raw, form)]
    return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "turns": pd.Series([r[1] for r in rows], dtype=object)})


_tokenizers: dict = {}


def capped(raw: Column, most: int, tokenizer: str) -> Column:
    """(text, cut): outputs cut to so many tokens of a tokenizers file.

    A token has a byte at least, so only texts of more bytes than that are looked at in Python.
    """

    @pandas_udf(StructType([StructField("text", StringType()), StructField("cut", BooleanType())]))
    def cut(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> tuple[str | None, bool]:
            if text is None:
                return None, False
            if tokenizer not in _tokenizers:
                from tokenizers import Tokenizer

                _tokenizers[tokenizer] = Tokenizer.from_file(tokenizer)
            ids = _tokenizers[tokenizer].encode(text, add_special_tokens=False).ids
            return (_tokenizers[tokenizer].decode(ids[:most]).strip(), True) if len(ids) > most else (text, False)

        return pd.DataFrame([one(t) for t in texts], columns=["text", "cut"])

    found = cut(F.when(F.octet_length(raw) > most, raw))
    return F.struct(F.when(F.octet_length(raw) > most, found["text"]).otherwise(raw).alias("text"), ((F.octet_length(raw) > most) & found["cut"]).alias("cut"))


def reparsed(lines: DataFrame, form: Column | None = None, most: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """lines (prediction, raw_prediction, error, ...) read again from the server's own output: `prediction`, `raw_prediction`, `segments`, `capped_post_hoc`.

    The output is cut to `most` tokens first, then parsed. Failed lines stay as they are, and so does a plain line under the cap, so a second run changes nothing.
    """
    have = set(lines.columns)
    raw = F.coalesce(F.col("raw_prediction"), F.col("prediction")) if "raw_prediction" in have else F.col("prediction")
    usable = F.col("error").isNull() & F.col("prediction").isNotNull()
    name = F.lit(None).cast("string") if form is None else form
    none = F.struct(F.col("_raw").alias("text"), F.lit(False).alias("cut"))
    out = lines.withColumn("_raw", F.when(usable, raw)).withColumn("_form", name)
    out = out.withColumn("_cap", none if most is None else capped(F.col("_raw"), most, tokenizer)).withColumn("_out", parsed(F.col("_cap.text"), F.col("_form")))
    cut = F.coalesce(F.col("_cap.cut"), F.lit(False))
    had = F.col("raw_prediction").isNotNull() if "raw_prediction" in have else F.lit(False)
    touched = usable & (F.col("_form").isNotNull() | cut | had)
    return out.withColumns({
        "prediction": F.when(touched, F.col("_out.text")).otherwise(F.col("prediction")), "raw_prediction": F.when(touched, F.col("_raw")).otherwise(F.col("raw_prediction") if "raw_prediction" in have else F.lit(None)),
        "segments": F.when(touched, F.col("_out.turns")), "capped_post_hoc": touched & cut,
    }).drop("_raw", "_form", "_cap", "_out")


def reparse_report(before: DataFrame, after: DataFrame, key: str, subset: str) -> DataFrame:
    """(subset, lines, changed, capped) of a run read again."""
    was = before.select(F.col(key).alias("_key"), F.col("prediction").alias("_was"))
    met = after.join(was, F.col(key) == F.col("_key"))
    return met.groupBy(subset).agg(F.count("*").alias("lines"), F.count_if(~F.col("prediction").eqNullSafe(F.col("_was"))).alias("changed"), F.count_if("capped_post_hoc").alias("capped"))
