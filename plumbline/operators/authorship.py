"""Estimates of authorship by a model of the caller's, beside the score and never in it."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Detector(Protocol):
    """Something with a name that gives a number from 0 to 1 for each text of a batch."""

    name: str

    def detect(self, texts: pd.Series) -> pd.Series: ...


class Undecided:
    """Knows nothing: 0.5 for every text."""

    name = "undecided"

    def detect(self, texts: pd.Series) -> pd.Series:
        return pd.Series(0.5, index=texts.index)


def attach(scored: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """scored with ``authorship``, a struct of the detector's name and its number within 0 and 1; null for a null text. Nothing else changes."""

    def run(texts: pd.Series) -> pd.Series:
        return detector.detect(texts.fillna("")).astype("float64").clip(0, 1)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    value = F.when(F.col(text).isNotNull(), F.pandas_udf(run, DoubleType())(F.col(text)))
    return scored.withColumn("authorship", F.struct(F.lit(detector.name).alias("name"), value.alias("probability")))
