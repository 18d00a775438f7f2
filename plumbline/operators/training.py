"""Corpus building and training of the logistic scorer."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.settings import HUMAN, MODEL


def by_threshold(value: Column, good: float, bad: float) -> Column:
    """Label 0 from good on, 1 up to bad, null between: such rows are left out."""
    return F.when(value >= good, 0).when(value <= bad, 1)


def long_enough(text: Column, words: int = 40, characters: int = 80) -> Column:
    return (F.regexp_count(text, F.lit(r"(?U)\S+")) >= words) & (F.length(F.trim(text)) >= characters)


def quota(rows: DataFrame, n: int, label: str = "label", order: str = "doc_id") -> DataFrame:
    """The first n rows of each label. Spark ranks within partitions first, so that only n of each travel."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def fold(key: Column, folds: int = 5, seed: int = 13) -> Column:
    """A fold that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))


def split(rows: DataFrame, share: float = 0.7, label: str = "label", key: str = "doc_id", seed: int = 13) -> DataFrame:
    """rows with ``part``, train or test, the share being kept within each label."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("part", F.when(rank <= F.round(share * F.count(F.lit(1)).over(w)), "train").otherwise("test"))


def fit(rows: DataFrame, label: str = "label") -> LogisticRegressionModel:
    """Logistic regression whose weights can't be negative, but for the human signals', which can't be positive."""
    names = list(MODEL)
    x = VectorAssembler(inputCols=names, outputCol="_x").transform(rows.select(*names, F.col(label).cast("double").alias("_y")))
    low = [-1e9 if d == HUMAN else 0.0 for d in names]
    high = [0.0 if d == HUMAN else 1e9 for d in names]
    n = max(1, rows.count())
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", standardization=False, regParam=1.0 / n, lowerBoundsOnCoefficients=Matrices.dense(1, len(names), low), upperBoundsOnCoefficients=Matrices.dense(1, len(names), high))
    return lr.fit(x)
