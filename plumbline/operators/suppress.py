"""Control comments in a text that silence findings, as an array of ranges of its own row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import spans
from plumbline.settings import DIMENSIONS

RANGE = "struct<start:int,end:int,names:array<string>>"


def _comment(prefix: str) -> str:
    return rf"(?i)<!--\s*{prefix}-(disable-file|disable-line|disable-next-line|disable|enable)\b([^>]*?)-->"


def comments(original: Column, prefix: str) -> Column:
    """array<struct<start, end, kind, names>>; texts without the prefix are only searched for it."""
    regex = _comment(prefix)

    def parsed(x: Column) -> Column:
        names = F.split(F.regexp_extract(x["found"], regex, 2), r"[,\s]+", -1)
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.lower(F.regexp_extract(x["found"], regex, 1)).alias("kind"),
            F.array_distinct(F.filter(names, lambda n: n != "")).alias("names"),
        )

    found = F.transform(spans(original, regex), parsed)
    return F.when(F.contains(F.lower(original), F.lit(f"{prefix}-".lower())), found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,names:array<string>>>"))


def _line_end(text: Column, at: Column) -> Column:
    return at + F.length(F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1))


def _range(start: Column, end: Column, names: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), names.alias("names"))


def ranges(original: Column, found: Column) -> Column:
    """Half-open ranges that comments() silences; no names: everything in it.

    Blocks close at an enabling comment without names or with one of their names; open ones run to the end. A
    comment for the next line on the last line silences nothing.
    """
    n = F.length(original)

    def single(c: Column) -> Column:
        before = F.substring(original, F.lit(1), c["start"])
        line = c["start"] - F.length(F.substring_index(before, "\n", -1))
        end = _line_end(original, c["start"])
        return (
            F.when(c["kind"] == "disable-file", _range(c["start"], n, c["names"]))
            .when(c["kind"] == "disable-line", _range(line, end, c["names"]))
            .otherwise(F.when(end < n, _range(end + 1, _line_end(original, end + 1), c["names"])).otherwise(_range(F.lit(0), F.lit(0), c["names"])))
        )

    lone = F.transform(F.filter(found, lambda c: ~c["kind"].isin("disable", "enable")), single)
    none = F.array().cast(f"array<{RANGE}>")
    start = F.struct(none.alias("open"), none.alias("closed"))

    def step(acc: Column, c: Column) -> Column:
        closes = lambda b: (F.size(c["names"]) == 0) | F.arrays_overlap(b["names"], c["names"])
        ended = F.transform(F.filter(acc["open"], closes), lambda b: _range(b["start"], c["start"], b["names"]))
        opened = F.struct(F.array_append(acc["open"], _range(c["end"], n, c["names"])).alias("open"), acc["closed"].alias("closed"))
        closed = F.struct(F.filter(acc["open"], lambda b: ~closes(b)).alias("open"), F.concat(acc["closed"], ended).alias("closed"))
        return F.when(c["kind"] == "disable", opened).otherwise(closed)

    blocks = F.aggregate(F.filter(found, lambda c: c["kind"].isin("disable", "enable")), start, step, lambda acc: F.concat(acc["closed"], acc["open"]))
    return F.when(F.size(found) == 0, none).otherwise(F.concat(lone, blocks))


def silenced(silent: Column, start: Column, rule_id: Column, dimension: Column) -> Column:
    """Whether a finding that starts there lies in a range for its rule or dimension."""
    return F.exists(
        silent,
        lambda r: (r["start"] <= start) & (start < r["end"]) & ((F.size(r["names"]) == 0) | F.array_contains(r["names"], rule_id) | F.array_contains(r["names"], dimension)),
    )


def unknown_names(found: Column, fired: Column) -> Column:
    """Sorted names in comments that are neither a dimension nor a rule that fired in the text (an array of rule ids)."""
    named = F.array_distinct(F.flatten(F.transform(found, lambda c: c["names"])))
    return F.array_sort(F.array_except(named, F.array_union(F.array(*map(F.lit, DIMENSIONS)), fired)))
