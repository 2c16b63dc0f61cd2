"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of docs as they came. Verdicts belong to rows, not to ids: a null or repeated id changes no other row's verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.common import Scratch, small_batches, unused
from residua.llm.decontamination import find_contamination
from residua.llm.line_dedup import dedup_lines
from residua.llm.near_duplicates import near_duplicate_groups
from residua.llm.packing import pack_documents
from residua.llm.quality import fit_quality, score_quality
from residua.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects: a score below 0.5."""
    small_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "quality_score")
    return score_quality(docs, model, score_col=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts a source's boilerplate lines from its documents; a changed text gets its new n_chars."""
    counts = dict(zip(("n_lines", "n_removed"), unused(docs, "n_lines", "n_removed")))
    out = dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(counts["n_removed"]) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def numbered(spark: SparkSession, docs: DataFrame, number: str, scratch: Scratch) -> DataFrame:
    """docs with a number of each row: its id where it is the only row of that id, else one below all ids.

    Rows whose id is null or repeated are written with their numbers, others are left where they are.
    """
    repeated = scratch.table(docs.groupBy(F.col("doc_id").alias(number)).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col(number).isNotNull()).select(number))
    shared = docs.join(repeated, F.col("doc_id") == F.col(number), "left_semi").unionByName(docs.filter("doc_id is null"))
    least = F.least(docs.agg(F.min("doc_id")).scalar(), F.lit(0).cast("long"))
    shared = scratch.table(shared.withColumn(number, least - 1 - F.monotonically_increasing_id()))
    alone = docs.filter("doc_id is not null").join(repeated, F.col("doc_id") == F.col(number), "left_anti")
    return alone.withColumn(number, F.col("doc_id").cast("long")).unionByName(shared)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked by a five-word Jaccard similarity of 0.8 or more only the one with the smallest id stays.

    Null and empty texts are copies of each other. Null ids come last; of rows of one id in a group any one stays, and rows that
    share an id with a near copy but are none stay.
    """
    small_batches(spark)
    number, group, gone = unused(docs, "number", "group", "gone")
    scratch = Scratch(spark)
    rows = numbered(spark, docs, number, scratch)
    groups = scratch.table(near_duplicate_groups(rows, number).select(F.col(number).alias(gone), F.col("component_id").alias(group)))
    # Numbers below all ids stand for rows of shared ids, whose own ids decide which row is the first.
    low = scratch.table(rows.select(number, "doc_id").filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col(number))).withColumn("known", F.lit(True)))
    named = groups.join(low.withColumnsRenamed({number: "low", "doc_id": "own"}), F.col(gone) == F.col("low"), "left")
    own = F.when(F.col("known"), F.col("own")).otherwise(F.col(gone))
    first = named.groupBy(group).agg(F.min_by(gone, F.struct(own.isNull(), own, -F.col(gone))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(group).alias("of"), "first")
    lost = scratch.table(groups.join(first, F.col(group) == F.col("of")).filter(F.col(gone) != F.col("first")).select(gone))  # written, so that a join knows its size
    return rows.join(lost, F.col(number) == F.col(gone), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. A text's verdict is found and joined by its SHA-256, whatever its row's id."""
    small_batches(spark)
    digest, gone = unused(docs, "digest", "gone")
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=digest).select(F.col(digest).alias(gone)).distinct()
    found = Scratch(spark).table(found)  # written, so that the join knows how large it is
    return rows.join(found, F.col(digest) == F.col(gone), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document with its place in the sequences."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: A classifier and a tokenizer have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
