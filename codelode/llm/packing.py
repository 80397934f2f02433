"""Packing into optimal length buckets.

A dynamic program over the global histogram of document lengths chooses at
most ``buckets`` boundaries such that padding every document to its bucket's
boundary wastes the fewest tokens; inside each bucket, documents form batches
of at most ``budget`` padded tokens (one document at least).

The program runs on the driver over the exact histogram, one entry a distinct
length; distinct lengths are few, as n of them take n * n / 2 tokens at least.
Numbering inside a bucket is done in blocks
(hashes of the id, their number follows the corpus), whose counts give the
blocks' offsets; no bucket is gathered in one task.

Edge cases: null and empty texts have the end id alone (length 1); a document
longer than the budget is a batch of its own; repeated rows are placed one by
one; an empty table gives no rows; ties in length share a bucket; only the
named columns are read, so further ones, of whatever name, do not matter.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.arrowtext import slices
from codelode.llm.tokens import encoder
from codelode.llm.workspace import materialize

BUCKETS = 16
BUDGET = 16_384
#: Documents a numbering block holds on average.
BLOCK_DOCS = 2_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least padding.

    cost(i, j) = length_j * (C_j - C_i) - (S_j - S_i) with prefix counts C and
    sums S, so each layer of the program is a lower envelope of lines with
    falling slopes -C_i, asked at rising lengths.
    """
    n = len(lengths)
    if n == 0:
        return []
    c, s = [0], [0]
    for length, count in zip(lengths, counts):
        c.append(c[-1] + count)
        s.append(s[-1] + length * count)
    best = [0] + [lengths[j - 1] * c[j] - s[j] for j in range(1, n + 1)]
    choices = [[0] * (n + 1)]
    for _ in range(min(buckets, n) - 1):
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, i
        now, choice = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            slope, cut = -c[j - 1], best[j - 1] + s[j - 1]
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - slope) >= (cut - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((slope, cut, j - 1))
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            now[j] = lengths[j - 1] * c[j] - s[j] + hull[0][0] * x + hull[0][1]
            choice[j] = hull[0][2]
        choices.append(choice)
        best = now
    out, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = choice[j]
    return out[::-1]


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id and n_tokens, the end id included, of every row."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        for part in slices(batches, "_text"):
            n = [len(ids) // 2 + 1 for ids in encoder(tokenizer).encode(part.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n, pa.int64())], names=["_id", "n_tokens"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("_id", id_col)


def pack(lengths: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of (id, n_tokens) with bucket, bucket_len, batch, slot and padding."""
    histogram = sorted(map(tuple, lengths.groupBy("n_tokens").count().collect()))
    tops = boundaries([x for x, _ in histogram], [k for _, k in histogram], buckets)
    if not tops:
        tops = [1]
    array = F.array(*[F.lit(int(x)).cast("long") for x in tops])
    blocks = max(64, sum(k for _, k in histogram) // block_docs)
    placed = lengths.select(
        F.col(id_col),
        "n_tokens",
        F.aggregate(array, F.lit(0).cast("long"), lambda k, x: k + (x < F.col("n_tokens")).cast("long")).alias("bucket"),
        F.pmod(F.xxhash64(F.col(id_col), F.col("n_tokens")), F.lit(blocks)).alias("block"),
    )
    counts = placed.groupBy("bucket", "block").agg(F.count("*").alias("n_block"))
    # at most buckets x blocks rows
    offset = F.coalesce(F.sum("n_block").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bucket", "block", offset.alias("offset"))
    within = F.row_number().over(Window.partitionBy("bucket", "block").orderBy(id_col, "n_tokens")) - 1
    ranked = placed.withColumn("within", within).join(offsets, ["bucket", "block"])
    bucket_len = F.element_at(array, (F.col("bucket") + 1).cast("int"))
    capacity = F.greatest(F.lit(1), F.lit(budget) / bucket_len).cast("long")
    rank = F.col("offset") + F.col("within")
    return ranked.select(
        F.col(id_col),
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        bucket_len.alias("bucket_len"),
        F.floor(rank / capacity).cast("long").alias("batch"),
        F.pmod(rank, capacity).cast("long").alias("slot"),
        (bucket_len - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Lengths by the tokenizer, cut from lineage (three jobs read them), then :func:`pack`."""
    return pack(materialize(token_lengths(docs, tokenizer, id_col, text_col), "lengths"), id_col, buckets, budget)


def padding(lengths: np.ndarray, tops: list[int]) -> int:
    """Wasted tokens under given boundaries."""
    tops = np.array(tops)
    return int((tops[np.searchsorted(tops, lengths)] - lengths).sum())
