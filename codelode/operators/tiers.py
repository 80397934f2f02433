"""Cascades: a later, looser answer counts only where the earlier ones are empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tagged(frames: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.withColumn("tier", F.lit(k)) for k, f in enumerate(frames, 1)])


def first_answer(*frames: DataFrame) -> DataFrame:
    """Rows of the first frame that has any, with its number as ``tier``; one lazy plan, no action."""
    rows = _tagged(frames)
    # one row: the aggregate has no keys
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("tier"))), "tier")


def first_answer_by(keys: list[str], *frames: DataFrame) -> DataFrame:
    """The same for each key on its own."""
    rows = _tagged(frames).withColumn("_least", F.min("tier").over(Window.partitionBy(*keys)))
    return rows.where("tier = _least").drop("_least")
