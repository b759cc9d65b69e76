"""Tables kept in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir`` (or the context's checkpoint folder); only where that is unset and Spark runs in
this process alone (``local``: tests, a single machine) is a temporary folder of this machine used; on a cluster it is an error. Everything is written by Spark's own committers, so a lost executor costs
a retried task and no data, and reading a table back cuts the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core that write a table in few files.
WAVES = 4
_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='bindery-')}")
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call, each under a path never used before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _written.setdefault(spark.sparkContext.applicationId, set()).add(self.path)

    def at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def save(self, df: DataFrame, table: str, few: bool = False) -> DataFrame:
        """Write a table and read it back; with ``few``, in as many files as keep all cores busy a few times over, however many partitions there are.

        That is for tables whose rows don't hang on the task that writes them.
        """
        if few:
            df = df.coalesce(WAVES * self.spark.sparkContext.defaultParallelism)
        df.write.parquet(self.at(table))
        return self.spark.read.schema(df.schema).parquet(self.at(table))

    def drop(self, table: str) -> None:
        """Remove a table that no pending plan reads."""
        _delete(self.spark, self.at(table))


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear(spark: SparkSession) -> None:
    """Remove every table that this application's operators have written here; results not yet written elsewhere go with them."""
    for path in _written.pop(spark.sparkContext.applicationId, ()):
        _delete(spark, path)
