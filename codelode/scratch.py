"""Tables that a query writes for itself, in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of the files that one task takes apart; a longer file is a task of its own.
TASK_BYTES = 8 << 20
#: Rows that one task sorts or hashes where a stated number of tasks shares them.
TASK_ROWS = 250_000

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder the cluster names; in a temporary one only where tasks run beside the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _LOCAL.setdefault("dir", tempfile.mkdtemp())
    return f"{named.rstrip('/')}/scratch/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet, read again: an index table that several steps read, and that outlives executors."""
    path = folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(files: DataFrame) -> DataFrame:
    """files (path, content) dealt by path to tasks of bounded text, so that windows over what a file holds need no further shuffle."""
    size = files.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    # a stated number: adaptive execution would join partitions by their compressed bytes
    return files.repartition(max(1, -(-size // TASK_BYTES)), "path")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by keys to tasks of a bounded number of rows; both sides of a join take the rows of the larger one.

    A stated number, as in :func:`together`; what sorts or joins by these keys behind it shuffles no more.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)
