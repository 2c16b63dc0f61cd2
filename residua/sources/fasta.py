"""FASTA files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, description, sequence, ordinal) of a file or folder, split at record heads by Spark's reader.

    Sequences are upper-cased, white space and ``-`` deleted. ordinal rises in file order within a
    file. What stands before a file's first head is no record. Raises if there is no record.
    """
    parts = spark.read.option("lineSep", "\n>").text(path)
    rows = parts.select("value", F.monotonically_increasing_id().alias("ordinal"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # The reader takes the head's mark from every record but a file's first, which lies in the file's first block.
    first = rows.filter("block = 0").groupBy("file").agg(F.min(F.struct("ordinal", "value")).alias("x"))
    preambles = first.filter(~F.col("x.value").startswith(">")).select("x.ordinal")
    text = F.regexp_replace("value", r"^>", "")
    head = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "")
    body = F.regexp_replace(F.expr("substring(t, length(substring_index(t, '\n', 1)) + 1)"), r"[\s\-]+", "")
    records = rows.join(preambles, "ordinal", "left_anti").withColumns({"t": text, "head": head})
    out = records.select(F.regexp_extract("head", r"^(\S*)", 1).alias("record_id"), F.col("head").alias("description"), F.upper(body).alias("sequence"), "ordinal").filter("record_id <> ''")
    if out.isEmpty():
        raise ValueError(f"no FASTA records in {path}")
    return out


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """(record_id, description, sequence) as FASTA text."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.coalesce("description", F.col("record_id").cast("string")), F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)
