"""Sharding by proportional stratified interleaving.

Within each stratum (a source, say) the rows are shuffled by a seeded digest of
the columns that tell them apart, and numbered. A row's fractional rank is its
number, and a half, over its stratum's size; ordered by it, all strata advance
in step, so every stretch of the order has the mixture of the whole. Cut into
stretches of equal length (row counts of shards differ by one at most), every
shard holds of each stratum its share, to within one row and what the rounding
of the other strata moves; so does every stretch inside a shard.

Numbers come from two sorts of bounded parts: digests, and then fractional
ranks, fall evenly into buckets, whose counts, summed up in order, give each
bucket's first number; rows are only ordered inside a bucket. So no stratum,
however large, meets in one task. Rows alike in stratum and identity are told
apart by a copy number, dealt by input partition, and spread like all others:
which of them gets which number doesn't matter, the order of all others doesn't
depend on how the input is partitioned.

Edge cases: null and empty strata are two strata; null identities are equal to
each other; rows that repeat get places of their own; an empty table gives an
empty table; with fewer rows than shards some shards stay empty; columns of any
name are carried along, but for the two that are added, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.workspace import materialize, small

SHARDS, SEED = 16, 20240229
#: Rows of a bucket, about, and buckets at least.
BUCKET_ROWS, BUCKETS = 50_000, 1024


def _or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _first_numbers(rows: DataFrame, bucket: str, stratum: str | None) -> DataFrame:
    """Of each bucket: the rows in earlier ones (``_first``), and those of the whole stratum (``_all``)."""
    keys = [bucket] if stratum is None else [stratum, bucket]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*keys[:-1])
    before = within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(within).alias("_all"))


def _copies(rows: DataFrame) -> DataFrame:
    """Adds ``_copy``, from 0, among the rows alike in stratum and identity."""
    alike = ["_stratum", "_same", "_part"]
    numbered = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*alike).orderBy("_m")) - 1)
    counted = numbered.groupBy(*alike).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_stratum", "_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select(*alike, F.sum("_n").over(before).alias("_earlier")).where("_earlier > 0")
    return numbered.join(small(earlier, F.lit(64)), alike, "left").withColumn("_copy", F.col("_copy") + F.coalesce("_earlier", F.lit(0))).drop("_earlier", "_part")


def interleave(rows: DataFrame, stratum: str, by: list[str], shards: int = SHARDS, seed: int = SEED, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``rows`` with a shard (0 to ``shards`` - 1) and a slot in it, gapless from 0.

    by: the columns that tell rows apart. The rows are written once, so that
    their numbers stay; what is sorted are digests, not the rows.
    """
    held = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (shard_col, slot_col)])
    names = held.columns
    plain = {c: f"c{k}" for k, c in enumerate(names)}
    kept = materialize(held.toDF(*plain.values()).withColumn("_m", F.monotonically_increasing_id()), "shard-rows")
    n = kept.count()
    buckets = max(BUCKETS, n // BUCKET_ROWS)
    source = F.col(plain[stratum])
    same = F.md5(F.concat_ws(":", F.lit(str(seed)), *[_or_empty(F.col(plain[c])) for c in by]).cast("binary"))
    narrow = kept.select("_m", F.concat(F.when(source.isNull(), "0").otherwise("1"), _or_empty(source)).alias("_stratum"), same.alias("_same"), F.shiftright("_m", 33).alias("_part"))
    digest = F.md5(F.concat_ws(":", "_same", F.col("_copy").cast("string")).cast("binary"))
    shuffled = _copies(narrow).select("_m", "_stratum", digest.alias("_digest"))
    # the digest's first 32 bits, as a share of the buckets
    shuffled = materialize(shuffled.withColumn("_b", F.shiftright(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * buckets, 32)), "shard-digests")
    own = F.row_number().over(Window.partitionBy("_stratum", "_b").orderBy("_digest", "_m"))
    ranked = shuffled.join(small(_first_numbers(shuffled, "_b", "_stratum"), F.lit(48)), ["_stratum", "_b"]).select("_m", "_stratum", (F.col("_first") + own).alias("_rank"), "_all")
    ranked = materialize(ranked.select("_m", "_stratum", ((2 * F.col("_rank") - 1) / (2 * F.col("_all"))).alias("_at")), "shard-ranks")
    ranked = ranked.withColumn("_b", F.least(F.floor(F.col("_at") * buckets), F.lit(buckets - 1)))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_at", "_stratum"))
    placed = ranked.join(small(_first_numbers(ranked, "_b", None), F.lit(32)), "_b").select("_m", (F.col("_first") + place).alias("_place"))
    # the stretch of shard i: places i * n div shards to (i + 1) * n div shards, from 0
    shard = F.expr(f"(_place * {shards} - 1) div {max(n, 1)}")
    placed = placed.withColumn("_shard", shard).withColumn("_slot", F.expr(f"_place - 1 - (_shard * {n}) div {shards}"))
    found = kept.join(placed, "_m").select(*plain.values(), F.col("_shard").cast("int"), "_slot")
    return found.toDF(*names, shard_col, slot_col)


def write_shards(assigned: DataFrame, path: str, files: int, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Writes the rows as Parquet, a folder a shard, in the order of their slots, in about ``files`` files."""
    ordered = assigned.repartitionByRange(files, shard_col, slot_col).sortWithinPartitions(shard_col, slot_col)
    ordered.write.partitionBy(shard_col).parquet(path)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source") -> DataFrame:
    """What :func:`interleave` needs of documents: id, stratum, the size (bytes and one) and the checksum of the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{stratum}`").alias(stratum), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
