"""Screening of a stream: all row operators are stateless, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.features import with_features
from ..functions.sequence import normalize_sequence
from ..operators.audits import interpretation


def screen_stream(stream: DataFrame, score: Column, threshold: float, sequence: str = "sequence") -> DataFrame:
    """Valid sequences of a stream with features, score and interpretation; ``score`` is an expression over features."""
    valid = stream.withColumn("sequence", normalize_sequence(F.col(sequence))["sequence"]).filter("sequence is not null")
    return with_features(valid).withColumn("score", score).withColumn("interpretation", interpretation(F.col("score"), threshold))


def screening_counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, interpretation, n) of a screened stream, rows later than the watermark left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "interpretation").agg(F.count(F.lit(1)).alias("n"))


def run_available(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now to Parquet, exactly once, and ends."""
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
