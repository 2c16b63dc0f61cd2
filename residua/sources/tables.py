"""Other sources and sinks: CSV with guards, bundles of embeddings, JSON, checksums, discovery."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import limited, require_columns

#: The prepared dataset.
DATASET_SCHEMA = "sequence string, label int, class_name string, source string, source_id string, parent_id string, fragment_index int, sequence_sha256 string, length int, split_group string, split string"


def read_csv(spark: SparkSession, path: str, schema: str = DATASET_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_batch_csv(spark: SparkSession, path: str, rows: int = 500) -> DataFrame:
    """An uploaded table: all columns as text, ``sequence`` among them, at most so many rows."""
    df = spark.read.csv(path, header=True)
    require_columns(df, ("sequence",))
    return limited(df, rows)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    """A dict as JSON with sorted keys and an indent of two."""
    text = json.dumps(data, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_bundle(df: DataFrame, path: str, model_name: str) -> None:
    """Embeddings with their sequence, label, split and group; the model's name in every row."""
    require_columns(df, ("sequence", "label", "split", "split_group", "embedding"))
    df.select("sequence", "label", "split", "split_group", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(model_name).alias("model_name")).write.mode("overwrite").parquet(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, in their order, each asked of its own file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, in order of precedence."""
    return next(iter(existing(spark, paths)), None)


def discover_models(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, dict]]:
    """Display name to (path, metadata) of every saved model that exists; a later one of the same name wins.

    A model fitted on synthetic data is named as a toy, any other by its own name or else its folder's.
    """
    out = {}
    for p in existing(spark, paths):
        metadata = json.loads(spark.read.text(f"{p}/metadata").first()[0])
        toy = metadata.get("scientific_status") == "synthetic_ui_demo_only"
        # Fixed value: the toy's name.
        out["Toy UI model — synthetic data" if toy else metadata.get("model_name", p.rstrip("/").rsplit("/", 1)[-1])] = (p, metadata)
    return out


def write_downloaded_fasta(spark: SparkSession, lines, path: str, source: str, url: str, query: str, max_records: int = 5000) -> dict:
    """Writes the records of a download (an iterable of lines) and, beside them, their provenance as JSON; returns it.

    The folder ``path`` gets one text file, ``path.metadata.json`` another. Raises if there is no record.
    """
    if max_records < 1:
        raise ValueError("at least one record must be asked for")
    kept = [line.rstrip() for line in parse_downloaded_fasta(lines, max_records)]  # max_records bounds it
    if not kept:
        raise RuntimeError("the response has no FASTA records")
    spark.createDataFrame([("\n".join(kept),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    text = "\n".join(kept) + "\n"
    # Fixed value: the caveat.
    data = {
        "source": source,
        "url": url,
        "query": query,
        "downloaded_at_utc": datetime.now(timezone.utc).replace(microsecond=0).isoformat(),
        "records": sum(line.startswith(">") for line in kept),
        "sha256": hashlib.sha256(text.encode()).hexdigest(),
        "label_caveat": "These proteins are used only to create putative-negative fragments. Lack of an antimicrobial annotation is not experimental proof of inactivity.",
    }
    write_json(spark, data, f"{path}.metadata.json")
    return data


def parse_downloaded_fasta(lines, max_records: int = 5000):
    """Lines of a download up to max_records records; what stands before the first head is dropped."""
    n = 0
    for line in lines:
        if line.startswith(">"):
            n += 1
            if n > max_records:
                return
        if n:
            yield line
