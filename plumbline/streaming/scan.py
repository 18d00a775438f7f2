"""Scoring of streams: the same expressions over files that arrive, new findings, and rates by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.features import prepare
from plumbline.functions.scoring import score
from plumbline.operators import baseline, evidence
from plumbline.settings import Settings

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def scored(stream: DataFrame, settings: Settings | None = None) -> DataFrame:
    """score() without state: append output, any trigger."""
    return score(stream, settings)


def new_findings(stream: DataFrame, known: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Findings of the stream that a static baseline hasn't."""
    return baseline.new(evidence.findings(prepare(stream, settings), settings), known)


def flagged_by_window(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours", at: float = 50.0) -> DataFrame:
    """Share of scored rows at or over a score by event-time window; later rows than the watermark are dropped."""
    flag = F.avg((F.col("slop_score") >= at).cast("double"))
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.round(flag, 6).alias("flagged"))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is now, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
