"""Shared scratch space: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which :func:`small` lets a table be broadcast; beyond, Spark shuffles.
BROADCAST_BYTES = 32 << 20

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the session is local, so that all
    tasks share the driver's disk, a temporary folder is made, once a process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="codelode-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    group_bytes: bytes of a row group, looked at after every row. Otherwise the
    writer first looks after 100 rows, and holds them all, as the reader does.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    bounds = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
    df.write.options(compression="zstd", **bounds).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, marked for broadcast if its rows, each of about ``row_bytes``, stay within BROADCAST_BYTES."""
    total = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def one_of_each(df: DataFrame, *keys: str, listed: DataFrame | None = None) -> DataFrame:
    """``df`` with one row of those that are equal in ``keys``; only such rows are shuffled, all others stay where they are.

    listed: a table that has the same keys, as often, and is cheaper to read.
    """
    met = [F.col(k).eqNullSafe(F.col(f"{k}_again")) for k in keys]
    again = (df if listed is None else listed).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"{k}_again") for k in keys])
    if again.isEmpty():
        return df
    again = small(materialize(again, "again"), F.lit(64))
    return df.join(again, met, "left_anti").unionByName(df.join(again, met, "left_semi").dropDuplicates(list(keys)))


def free_name(df: DataFrame, wish: str = "_n") -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wish in taken:
        wish += "_"
    return wish


def plainly_named(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``df`` under names that every Spark call takes (no dots), and the new name of ``column``; ``toDF(*df.columns)`` names them back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), f"c{df.columns.index(column)}"
