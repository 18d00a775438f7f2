"""One call for a text, files or a table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.scoring import score
from plumbline.operators import calibrate, evidence
from plumbline.settings import Settings
from plumbline.sinks import reports
from plumbline.sources import readers


class Scanner:
    """Settings and, if given, a calibration profile; scans one text at once, or any number as a table."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, baseline: DataFrame | None = None) -> None:
        self.spark, self.settings, self.baseline = spark, settings or Settings(), baseline

    def table(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with scores, evidence and, with a profile, deviations."""
        out = evidence.with_evidence(score(docs, self.settings, text, places=True), self.settings)
        return calibrate.beside(out, self.baseline) if self.baseline is not None else out

    def files(self, paths: list[str], recursive: bool = False, json_path: str | None = None) -> DataFrame:
        """The readable ones of these files."""
        docs = readers.read_files(self.spark, paths, recursive, json_path, self.settings.comment_prefix)
        return self.table(docs.where("valid").drop("valid"))

    def text(self, text: str, source: str = "<string>") -> dict[str, Any]:
        """The report of one text."""
        row = self.table(readers.from_strings(self.spark, [text], source)).select(reports.to_json(self.settings, "source", "source_type")).first()
        return json.loads(row[0])


def scan_text(spark: SparkSession, text: str, settings: Settings | None = None) -> dict[str, Any]:
    return Scanner(spark, settings).text(text)


def scan_files(spark: SparkSession, paths: list[str], settings: Settings | None = None) -> DataFrame:
    return Scanner(spark, settings).files(paths)
