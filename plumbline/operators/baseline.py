"""Fingerprints of findings and what is new against a kept set of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.rules import RANKS


def fingerprint(source: Column, rule_id: Column, span: Column) -> Column:
    """SHA-256 of the three with zero bytes between; nulls count as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\0", part(source), part(rule_id), part(span)), 256)


def fingerprinted(findings: DataFrame, source: str = "doc_id") -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col(source), F.col("rule_id"), F.col("span")))


def build(findings: DataFrame, source: str = "doc_id") -> DataFrame:
    """The distinct fingerprints, one column."""
    return fingerprinted(findings, source).select("fingerprint").distinct()


def write(baseline: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A baseline that write() left; any other table is refused."""
    df = spark.read.parquet(path)
    if df.columns != ["fingerprint"]:
        raise ValueError(f"{path} isn't a baseline")
    return df


def new(findings: DataFrame, known: DataFrame, source: str = "doc_id") -> DataFrame:
    """Findings that the baseline hasn't, each repetition by itself."""
    return fingerprinted(findings, source).join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")


def rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, k in RANKS.items():
        out = F.when(severity == name, k).otherwise(out)
    return out


def threshold_rank(fail_on: str) -> int:
    """99, which nothing reaches, for none."""
    return RANKS.get(fail_on, 99)


def max_severity(findings: DataFrame) -> DataFrame:
    """One row: the highest rank among findings that aren't rewrites, 0 without any."""
    worst = findings.where(~F.col("rule_id").startswith("SUGGEST_")).agg(F.max(rank(F.col("severity"))).alias("r"))
    return worst.select(F.coalesce("r", F.lit(0)).alias("max_rank"))
