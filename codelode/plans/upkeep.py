"""Index upkeep on plain Parquet: differences, upserts, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def changes(index: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): added, modified (another mtime) or deleted, by a full outer join on path."""
    both = index.select("path", F.col("mtime").alias("_old")).join(found.select("path", F.col("mtime").alias("_new")), "path", "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("path", kind.alias("change")).where("change is not null")


def upsert(index: DataFrame, fresh: DataFrame, key: str = "path", gone: DataFrame | None = None) -> DataFrame:
    """The index with fresh rows in place of those of the same key, and without ``gone`` keys."""
    kept = index.join(fresh.select(key).distinct(), key, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(key).distinct(), key, "left_anti")
    return kept.select(*index.columns).unionByName(fresh.select(*index.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key is not yet there, one a key: the least by the other columns in their order."""
    others = [c for c in table.columns if c not in keys]
    fresh = rows.select(*table.columns).join(table.select(*keys).distinct(), keys, "left_anti")
    if others:
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, *[F.col("_r").getField(c).alias(c) for c in others])
    else:
        fresh = fresh.distinct()
    return table.unionByName(fresh)


def bucket_of(column: str = "file", buckets: int = 256):
    """The partition a file's rows are stored in."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def write_index(tables: dict[str, DataFrame], path: str, buckets: int = 256, include: set[str] | None = None, key: str | None = None) -> None:
    """Each table in folders by file bucket, so that a refresh rewrites the buckets it touches."""
    for name, df in tables.items():
        if include is None or name in include:
            by = key or ("file" if "file" in df.columns else "caller_file" if "caller_file" in df.columns else "path")
            df.withColumn("bucket", bucket_of(by, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    first = next(iter(tables.values()))
    spark = first.sparkSession
    spark.createDataFrame([("schema_version", str(SCHEMA_VERSION))], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def refresh(spark: SparkSession, path: str, name: str, fresh: DataFrame, touched: DataFrame, key: str = "file", buckets: int = 256) -> None:
    """Replace all rows of the touched files in one table; buckets without a touched file stay as they are.

    The new state of the touched buckets is written beside them first, then
    moved in by a dynamic partition overwrite, which Spark commits as one job.
    That leaves alone what the new state doesn't name, so folders of buckets
    that lost their last row are deleted after it; until then, and if the
    deletion fails, such a bucket has its old rows, and a repeated call mends it.
    """
    held = spark.read.parquet(f"{path}/{name}")
    hit = touched.select(bucket_of(key, buckets).alias("bucket")).distinct()
    kept = held.join(F.broadcast(hit), "bucket", "left_semi").join(touched.select(key).distinct(), key, "left_anti")
    after = kept.select(*held.columns).unionByName(fresh.withColumn("bucket", bucket_of(key, buckets)).select(*held.columns))
    beside = f"{path}/_next/{name}"
    after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(beside)
    ready = spark.read.schema(held.schema).parquet(beside)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
    # at most ``buckets`` rows
    for row in hit.join(ready.select("bucket").distinct(), "bucket", "left_anti").collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/bucket={row['bucket']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_current(spark: SparkSession, path: str) -> bool:
    """Whether an index is there and has this version."""
    try:
        meta = spark.read.parquet(f"{path}/meta")
    except Exception:  # noqa: BLE001  a broken index is rebuilt
        return False
    return meta.where((F.col("key") == "schema_version") & (F.col("value") == str(SCHEMA_VERSION))).limit(1).count() == 1


def stale_sample(index: DataFrame, now: int, last_indexed: int, grace: int = 60, n: int = 100, seed: int = 0) -> DataFrame:
    """Rows to compare with the file system: none within the grace time, else a random sample."""
    return index.limit(0) if now - last_indexed < grace else index.orderBy(F.rand(seed)).limit(n)
