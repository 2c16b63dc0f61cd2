"""What the operators of this subpackage share: small column helpers, and the core's scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch  # noqa: F401

#: The ASCII white space of all contracts: space, tab, LF, VT, FF, CR. It is what bytes.split() splits at.
SPACES = r"[\x20\x09-\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_text(df: DataFrame, name: str = "id") -> DataFrame:
    """df with the column as text: pandas would make floats of whole numbers among which there is a null."""
    return df.withColumn(name, F.col(name).cast("string"))


def text_of(c: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def id_crc32(c: Column) -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))



#: Bytes of a batch that goes to Python, where whole texts go.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is sent at once, unless the session is set to less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
