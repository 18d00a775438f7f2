"""Files and labelled rows as document tables."""

from __future__ import annotations

import os
import subprocess
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import strip_fences
from plumbline.sources import prose

SUFFIXES = (".txt", ".rst", ".json", *prose.MARKDOWN, *prose.PYTHON, *prose.SCRIPT)


def from_strings(spark: SparkSession, texts: list[str], source: str = "<string>") -> DataFrame:
    return spark.createDataFrame([(i, t, "text", source) for i, t in enumerate(texts)], "doc_id long, text string, source_type string, source string")


def listing(root: str, recursive: bool = False) -> list[str]:
    """Files below a local folder that can be scanned, sorted."""
    path = Path(root)
    files = [path] if path.is_file() else path.rglob("*") if recursive else path.glob("*")
    return sorted(str(p) for p in files if p.is_file() and (p == path or p.suffix.lower() in SUFFIXES))


def changed(paths: list[str], ref: str) -> list[str]:
    """Files below these paths that can be scanned and differ from a git ref, sorted; ValueError where git says no."""
    out: set[str] = set()
    for p in paths:
        folder = p if os.path.isdir(p) else os.path.dirname(p) or "."
        run = subprocess.run(["git", "-C", folder, "diff", "--name-only", "--relative", "--diff-filter=d", ref, "--", os.path.abspath(p)], capture_output=True, text=True)
        if run.returncode:
            raise ValueError(run.stderr.strip() or f"git can't compare with {ref}")
        out |= {os.path.join(folder, x) for x in run.stdout.splitlines() if Path(x).suffix.lower() in SUFFIXES}
    return sorted(out)


def read_files(spark: SparkSession, paths: list[str], recursive: bool = False, json_path: str | None = None, prefix: str = "plumbline") -> DataFrame:
    """(source, source_type, text, valid) of files in any storage; those that aren't UTF-8 have valid false and no text.

    Each kind of file goes through its own extractor, and Python starts only for the kinds that need it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    raw = raw.select(F.col("path").alias("source"), prose.source_type(F.col("path")).alias("source_type"), prose.suffix(F.col("path")).alias("_s"), F.expr("try_validate_utf8(cast(content as string))").alias("_t"))
    raw = raw.where(F.col("_s").isin(*SUFFIXES, ".htm", ".html", ""))
    t = F.col("_t")
    parts = [
        raw.where("source_type = 'text'").withColumn("text", strip_fences(t)),
        raw.where("source_type = 'markdown'").withColumn("text", prose.markdown(t, prefix)),
        raw.where("source_type = 'website'").withColumn("text", prose.html(t)),
        raw.where("source_type = 'json'").withColumn("text", prose.json_path(t, json_path) if json_path else prose.json_strings(t)),
        raw.where(F.col("_s").isin(*prose.SCRIPT)).withColumn("text", prose.script(t)),
        raw.where(F.col("_s").isin(*prose.PYTHON)).withColumn("text", prose.python_code(t)),
    ]
    return reduce(DataFrame.unionByName, parts).select("source", "source_type", F.when(t.isNotNull(), F.col("text")).alias("text"), t.isNotNull().alias("valid"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (text, label, bucket, subgroup); blank lines don't count, the last two have defaults."""
    rows = spark.read.schema("text string, label int, bucket string, subgroup string").json(path)
    return rows.where(F.col("text").isNotNull()).withColumns({"bucket": F.coalesce("bucket", F.lit("unknown")), "subgroup": F.coalesce("subgroup", F.lit("general"))})
