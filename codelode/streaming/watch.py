"""Watching files: events of one file that follow each other closely make one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import extension

#: The pause that ends a burst of events.
PAUSE = "500 milliseconds"


def runs(events: DataFrame, extensions: list[str] | None = None, pause: str = PAUSE, late: str | None = None) -> DataFrame:
    """(path, first, last, events): a run for each burst of events (path, at) of a file, once nothing came for longer than the pause.

    Works on tables, and with ``late`` (how long events may be late) on streams,
    in append mode: each burst is a session window, so none is lost or run twice.
    """
    own = events if extensions is None else events.where(extension(F.col("path")).isin(*extensions))
    if late is not None:
        own = own.withWatermark("at", late)
    bursts = own.groupBy("path", F.session_window("at", pause).alias("_w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("events"))
    return bursts.drop("_w")
