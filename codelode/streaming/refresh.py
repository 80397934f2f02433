"""Change-driven refresh: a stream of file events keeps a table of latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.plans import upkeep


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in others])


def follow(events: DataFrame, path: str, checkpoint: str, key: str = "path", order: str = "mtime", interval: str = "500 milliseconds", once: bool = False, buckets: int = 64):
    """Start a query that merges each micro-batch into Parquet at ``path``, in folders by bucket of the key.

    A batch rewrites the buckets of its own keys only; as the latest event of a
    key wins, a repeated batch changes nothing. Events that arrive within an
    interval are merged, not dropped. Returns the query.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        fresh = latest(batch, key, order).select(*batch.columns)
        if not _there(spark, f"{path}/state"):
            upkeep.write_index({"state": fresh}, path, buckets, key=key)
            return
        touched = fresh.select(key)
        held = spark.read.parquet(f"{path}/state").join(touched, key, "left_semi").select(*batch.columns)
        upkeep.refresh(spark, path, "state", latest(held.unionByName(fresh), key, order).select(*batch.columns), touched, key, buckets)

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The latest event of every key so far."""
    return spark.read.parquet(f"{path}/state").drop("bucket")


def deduplicated(events: DataFrame, keys: list[str], time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key's first event; a key is remembered until the watermark has passed it."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time_col: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones up to the watermark."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
