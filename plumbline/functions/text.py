"""Text as columns: repair, cleaning, segments, words, and offsets. All of it runs inside the JVM.

Every function takes and returns columns; a null text counts as empty. Offsets count code points from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?^[ \t]*\1[ \t]*$"
#: Abbreviations whose full stop ends no sentence; RE2 and Java read the pattern alike.
ABBREVIATION = r"\b(Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|etc|No|Fig|Inc|Ltd|Co|cf|approx|[A-Z])\."
INNER_STOP = r"\.([^\s.!?\"')\]])"
PIECE = r"[^.!?\n]+[.!?]*[\"')\]]*\s*"
_LEADER = "․"
_MOJIBAKE = {"â€™": "'", "â€˜": "'", "â€œ": '"', "â€\u009d": '"', "â€“": "–", "â€”": "—", "â€¦": "…", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ã±": "ñ", "Â ": " "}
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
_TYPOGRAPHIC = "“”„‘’‚  "


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _when_has(text: Column, marks: tuple[str, ...], fixed: Callable[[Column], Column]) -> Column:
    """fixed where the text holds one of the marks; a byte search spares most texts the work."""

    def use(x: Column) -> Column:
        has = F.lit(False)
        for mark in marks:
            has = has | F.contains(x, F.lit(mark))
        return F.when(has, fixed(x)).otherwise(x)

    return let(text, use)


def _replaced(text: Column, by: dict[str, str]) -> Column:
    for old, new in by.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_fences(text: Column) -> Column:
    """Fenced code blocks become a line break each; an unclosed fence stays."""
    return _when_has(text, ("```", "~~~"), lambda x: F.regexp_replace(x, FENCE, "\n"))


def canonical(text: Column) -> Column:
    """Repaired text: common mis-decoded sequences, entities, ligatures, control characters, straight quotes, LF ends."""
    text = F.coalesce(text, F.lit(""))
    text = _when_has(text, ("â€", "Ã", "Â"), lambda x: _replaced(x, _MOJIBAKE))
    text = let(text, lambda x: F.when(F.contains(x, F.lit("&")) & ~F.contains(x, F.lit("<")), _replaced(x, _ENTITIES)).otherwise(x))
    text = _when_has(text, tuple(_LIGATURES), lambda x: _replaced(x, _LIGATURES))
    text = _when_has(text, tuple(_TYPOGRAPHIC), lambda x: F.translate(x, _TYPOGRAPHIC, "\"\"\"'''\n\n"))
    text = _when_has(text, ("\r",), lambda x: F.regexp_replace(x, "\r\n?", "\n"))
    control = r"[\x00-\x08\x0B\x0E-\x1F\x7F]"
    return let(text, lambda x: F.when(F.rlike(x, F.lit(control)), F.regexp_replace(x, control, "")).otherwise(x))


def clean(text: Column) -> Column:
    """Runs of spaces and tabs as one space, CR LF and CR as LF."""
    text = F.coalesce(text, F.lit(""))
    text = _when_has(text, ("\r",), lambda x: F.regexp_replace(x, "\r\n?", "\n"))
    return _when_has(text, ("  ", "\t"), lambda x: F.regexp_replace(x, "[ \t]+", " "))


def word_count(text: Column) -> Column:
    """Words between white space of any script."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def paragraphs(text: Column) -> Column:
    """Non-blank pieces between blank lines."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n", -1), lambda x: F.rlike(x, F.lit(r"(?U)\S")))


def sentences(text: Column) -> Column:
    """Non-blank sentences: they end at . ! ? before white space, and at line breaks.

    Known abbreviations, single capitals and stops inside a word or number end none.
    """
    text = F.coalesce(text, F.lit(""))
    guarded = F.regexp_replace(text, ABBREVIATION, f"$1{_LEADER}")
    guarded = F.regexp_replace(guarded, INNER_STOP, f"{_LEADER}$1")
    pieces = F.regexp_extract_all(guarded, F.lit(PIECE), F.lit(0))
    return F.filter(F.transform(pieces, lambda x: F.translate(x, _LEADER, ".")), lambda x: F.rlike(x, F.lit(r"(?U)\S")))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+", -1)


def spans(text: Column, regex: str) -> Column:
    """array<struct<start, end, found>> of all matches of an expression that never matches nothing.

    regexp_instr counts UTF-16 units; the lengths of what lies between matches give code points.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    parts = F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def collapsed(original: Column) -> Column:
    """array<struct<at, extra>>: where cleaning shortened the text (in cleaned offsets), and by how many characters."""
    found = spans(original, r"\r\n|[ \t]{2,}")
    none = F.array().cast("array<struct<at:int,extra:int>>")
    start = F.struct(F.lit(0).alias("gone"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        extra = x["end"] - x["start"] - 1
        return F.struct((acc["gone"] + extra).alias("gone"), F.array_append(acc["out"], F.struct((x["start"] - acc["gone"]).alias("at"), extra.alias("extra"))).alias("out"))

    shortened = F.contains(original, F.lit("  ")) | F.contains(original, F.lit("\t")) | F.contains(original, F.lit("\r\n"))
    return F.when(shortened, F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(none)


def to_original(offset: Column, gone: Column) -> Column:
    """The offset before cleaning of a cleaned offset, gone being collapsed(original)."""
    return F.when(F.size(gone) == 0, offset).otherwise(
        offset + F.aggregate(gone, F.lit(0), lambda acc, x: acc + F.when(x["at"] < offset, x["extra"]).otherwise(0))
    )


def line_and_column(text: Column, offset: Column) -> Column:
    """struct<line, col>, both from 1; null if the offset lies outside the text."""
    before = F.substring(text, F.lit(1), offset)
    last = F.substring_index(before, "\n", -1)
    inside = (offset >= 0) & (offset <= F.length(text))
    place = F.struct((F.regexp_count(before, F.lit("\n")) + 1).alias("line"), (F.length(last) + 1).alias("col"))
    return F.when(inside, place)


def per_hundred(count: Column, words: Column) -> Column:
    return F.when(words > 0, count * F.lit(100.0) / words).otherwise(F.lit(0.0))


def saturating(rate: Column, full: float) -> Column:
    return F.least(F.lit(1.0), rate / F.lit(float(full))) if full > 0 else F.lit(0.0)
