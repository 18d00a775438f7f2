"""Summaries of many scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scoring import score
from plumbline.functions.text import canonical, paragraphs
from plumbline.operators.baseline import rank
from plumbline.settings import Settings


def by_label(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def worst(scored: DataFrame, k: int = 5, source: str = "doc_id") -> DataFrame:
    """The k highest scores; ties by source."""
    return scored.orderBy(F.desc("slop_score"), source).limit(k).select(source, "slop_score", "label")


def totals(scored: DataFrame, findings: DataFrame) -> DataFrame:
    files = scored.agg(F.count(F.lit(1)).alias("n_files"), F.round(F.avg("slop_score"), 4).alias("mean_score"))
    found = findings.agg(F.count(F.lit(1)).alias("n_findings"), F.coalesce(F.max(rank(F.col("severity"))), F.lit(0)).alias("max_rank"))
    return files.crossJoin(found)


def rule_metadata(findings: DataFrame) -> DataFrame:
    """Each rule as its first finding shows it (by document, then position)."""
    first = F.min_by(F.struct("severity", "explanation"), F.struct("doc_id", "ordinal")).alias("m")
    return findings.groupBy("rule_id").agg(first, F.count(F.lit(1)).alias("n")).select("rule_id", "m.severity", "m.explanation", "n")


def summary(scored: DataFrame, findings: DataFrame, source: str = "doc_id") -> DataFrame:
    """One row: totals, maps by label and severity, and the five worst documents."""
    labels = by_label(scored).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label"))
    severities = by_severity(findings).agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("by_severity"))
    top = worst(scored, 5, source).agg(F.array_sort(F.collect_list(F.struct((-F.col("slop_score")).alias("order"), source, "slop_score", "label"))).alias("worst"))
    return totals(scored, findings).crossJoin(labels).crossJoin(severities).crossJoin(top)


def by_paragraph(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each paragraph of the documents that have two at least, scored by itself: (key, paragraph, slop_score, label, w, text), paragraphs counted from 0."""
    parts = docs.select(key, F.transform(paragraphs(canonical(F.col(text))), F.trim).alias("_p")).where(F.size("_p") >= 2)
    rows = parts.select(key, F.posexplode("_p").alias("paragraph", "text"))
    return score(rows, settings).select(key, "paragraph", "slop_score", "label", "w", "text")


def composition(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys, by each prefix of them, and in total."""
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(rows: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each text, by a map-side reduction rather than a sort of all repetitions; digests stand for the texts."""
    columns = rows.columns
    first = F.min_by(F.struct(*columns), F.col(order)).alias("r")
    return rows.groupBy(F.sha2(text, 256).alias("_key")).agg(first).select(*(F.col(f"r.`{c}`").alias(c) for c in columns))
