"""What is known of each sequence of a stream, kept up to date: its first row, its rows and its labels.

The state is that of a streaming aggregation, so it lives in the state store beside the stream's checkpoint and a restart goes on
from it. Each batch's changed sequences are written under the batch's number; a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sequence_states(stream: DataFrame, order: str = "source_id") -> DataFrame:
    """Per sequence: ``first`` (least order), ``n``, ``duplicates`` and ``n_labels`` so far. Null labels count as none.

    Sequences, labels 0 and 1 and orders may come in any batch; what results is that of all rows together.
    """
    each = stream.groupBy("sequence").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("label") == 0, 1).otherwise(0)).alias("zeros"), F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("ones"))
    return each.select("sequence", "first", "n", (F.col("n") - 1).alias("duplicates"), (F.col("zeros") + F.col("ones")).alias("n_labels"))


def run_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there now and ends; later runs with the same checkpoint go on from the state."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each sequence."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c not in ("sequence", "batch")]
    return rows.groupBy("sequence").agg(F.max_by(F.struct(*kept), "batch").alias("s")).select("sequence", "s.*")


def conflicting(states: DataFrame) -> DataFrame:
    """Sequences with both labels."""
    return states.filter("n_labels > 1")
