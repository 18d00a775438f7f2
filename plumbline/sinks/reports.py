"""Reports of scored documents with evidence, as columns of JSON, Markdown, HTML and SARIF, and their writing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import line_and_column
from plumbline.settings import DIMENSIONS, Settings

VERSION = "0.1.0"
LEVELS = {"high": "error", "medium": "warning", "low": "note"}
GLYPHS = {"high": "▲", "medium": "●", "low": "○"}
MOST_LINES = 50


def report(settings: Settings, source: str = "source", source_type: str | None = None, extra: tuple[str, ...] = ()) -> Column:
    """The whole report of a row that score() and with_evidence() made; extra columns (deviations, authorship) stand at its end."""
    return F.struct(
        F.lit(VERSION).alias("version"),
        F.struct((F.col(source_type) if source_type else F.lit("text")).alias("source_type"), F.col(source).cast("string").alias("source"), F.lit(settings.profile).alias("profile"), "language", F.col("w").alias("word_count")).alias("input"),
        F.struct("slop_score", "label", "confidence", F.lit(settings.strictness).alias("strictness"), "abstained", "abstention_reason").alias("score"),
        F.struct(*DIMENSIONS).alias("dimensions"),
        F.transform("evidence", lambda e: e.dropFields("ord", "n", "dimension")).alias("evidence"),
        "warnings",
        *extra,
    )


def to_json(settings: Settings, source: str = "source", source_type: str | None = None, extra: tuple[str, ...] = ()) -> Column:
    return F.to_json(report(settings, source, source_type, extra))


def to_markdown(source: str = "source") -> Column:
    """Heading, dimensions with two decimals, at most fifty findings, warnings."""
    dims = F.concat_ws("\n", *(F.format_string(f"| {d} | %.2f |", d) for d in DIMENSIONS))
    lines = F.transform(F.slice("evidence", 1, MOST_LINES), lambda e: F.concat(F.lit("- **"), e["rule_id"], F.lit("** ("), e["severity"], F.lit("): “"), e["span"], F.lit("” "), e["explanation"]))
    more = F.when(F.size("evidence") > MOST_LINES, F.format_string("\n- … and %d more", F.size("evidence") - MOST_LINES)).otherwise("")
    head = F.format_string("# %s\n\n**Score: %.1f** (%s), confidence %.3f%s\n\n| dimension | value |\n| --- | --- |\n", F.col(source).cast("string"), "slop_score", "label", "confidence", F.when(F.col("abstained"), ", abstained").otherwise(""))
    return F.concat(head, dims, F.lit("\n\n## Findings\n\n"), F.array_join(lines, "\n"), more, F.lit("\n\n## Warnings\n\n"), F.array_join(F.transform("warnings", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))


def disjoint(evidence: Column) -> Column:
    """Of overlapping findings the one that starts first, the longest of those that start together."""
    key = lambda e: F.struct(e["start_char"].alias("start"), (-e["end_char"]).alias("minus_end"), e["severity"].alias("severity"), e["rule_id"].alias("rule_id"), e["explanation"].alias("explanation"))
    ordered = F.array_sort(F.transform(evidence, key))
    none = F.array().cast("array<struct<start:int,minus_end:int,severity:string,rule_id:string,explanation:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda acc, e: F.when((e["start"] >= acc["at"]) & (-e["minus_end"] > e["start"]), F.struct((-e["minus_end"]).alias("at"), F.array_append(acc["out"], e).alias("out"))).otherwise(acc)
    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def to_html(source: str = "source") -> Column:
    """A page of the original text with its disjoint findings marked."""
    text = F.col("original")
    glyph = F.create_map(*(F.lit(x) for pair in GLYPHS.items() for x in pair))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        before = escape(F.substring(text, acc["at"] + 1, e["start"] - acc["at"]))
        marked = escape(F.substring(text, e["start"] + 1, -e["minus_end"] - e["start"]))
        tag = F.concat(F.lit('<mark class="'), e["severity"], F.lit('" title="'), escape(F.concat(e["rule_id"], F.lit(": "), e["explanation"])), F.lit('">'), glyph[e["severity"]], F.lit(" "), marked, F.lit("</mark>"))
        return F.struct((-e["minus_end"]).alias("at"), F.concat(acc["out"], before, tag).alias("out"))

    body = F.aggregate(disjoint(F.col("evidence")), start, step, lambda acc: F.concat(acc["out"], escape(F.substring(text, acc["at"] + 1, F.length(text)))))
    head = F.format_string("%.1f (%s)", "slop_score", "label")
    return F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), escape(F.col(source).cast("string")), F.lit("</title><h1>"), head, F.lit('</h1><pre style="white-space: pre-wrap">'), body, F.lit("</pre>"))


def to_sarif(source: str = "source") -> Column:
    """A SARIF run of one document: rules as first seen, results with regions, fixes where there is a rewrite."""
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    rules = F.transform(
        F.array_distinct(F.transform("evidence", lambda e: e["rule_id"])),
        lambda r: F.struct(r.alias("id"), F.struct(F.get(F.filter("evidence", lambda e: e["rule_id"] == r), 0)["explanation"].alias("text")).alias("shortDescription")),
    )

    def result(e: Column) -> Column:
        a, b = line_and_column(F.col("original"), e["start_char"]), line_and_column(F.col("original"), e["end_char"])
        region = F.struct(a["line"].alias("startLine"), a["col"].alias("startColumn"), b["line"].alias("endLine"), b["col"].alias("endColumn"))
        place = F.struct(F.col(source).cast("string").alias("uri")).alias("artifactLocation")
        replaced = F.struct(region.alias("deletedRegion"), F.struct(e["suggestion"]["text"].alias("text")).alias("insertedContent"))
        fix = F.struct(F.struct(e["suggestion"]["reasoning"].alias("text")).alias("description"), F.array(F.struct(place, F.array(replaced).alias("replacements"))).alias("artifactChanges"))
        return F.struct(
            e["rule_id"].alias("ruleId"), level[e["severity"]].alias("level"), F.struct(F.concat(e["explanation"], F.lit(": “"), e["span"], F.lit("”")).alias("text")).alias("message"),
            F.array(F.struct(F.struct(place, region.alias("region")).alias("physicalLocation"))).alias("locations"), F.when(e["suggestion"].isNotNull(), F.array(fix)).alias("fixes"),
        )

    driver = F.struct(F.struct(F.lit("plumbline").alias("name"), F.lit(VERSION).alias("version"), rules.alias("rules")).alias("driver"))
    return F.to_json(F.struct(driver.alias("tool"), F.transform("evidence", result).alias("results")))


def sarif_log(runs: list[str]) -> str:
    """A log file of several runs."""
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [json.loads(r) for r in runs]}, ensure_ascii=False)


def write_text(df: DataFrame, column: Column, path: str) -> None:
    """One line of JSON for each row, written by the executors."""
    df.select(column.alias("value")).write.mode("overwrite").text(path)
