"""Written tables that cut lineage, in the folder that the session's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A local session without one (tests) gets a temporary folder; a cluster without one is an error, since
    a machine's own folder would lose files with the machine.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="residua-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on its own file system, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this session has written here. Results that are still to be read need them."""
    for path in Scratch.roots.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


class Scratch:
    """Written tables that cut lineage; a lost executor rereads them instead of recomputing."""

    #: Folders by application, for clean().
    roots: dict[str, list[str]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        self.roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df and returns the table as read again."""
        schema = df.schema
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            for file in df.inputFiles()[:1]:
                delete(self.spark, file.rsplit("/", 1)[0])


def stored(df: DataFrame) -> DataFrame:
    """Writes df and returns the table as read again."""
    return Scratch(df.sparkSession).table(df)
