"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

A shard holds the postings (document, occurrences) of all terms of a stretch of
documents of bounded size, as one row of a written table. Document counts of
terms, and thereby weights, come from all shards. The search goes shard by
shard: with the exact contributions of a query's terms their upper bounds in
this shard are known; the terms of the least bounds whose sum stays below the
score to beat are non-essential: documents that only they name are never looked
at. The lists of the other, essential, terms are added up; non-essential lists
are then probed, from the highest bound down, for those documents alone whose
score may still qualify. The score to beat is the ``top``-th best so far: of the
shards the task had before, and of this one's partial scores. The best of all
tasks are ranked in Spark.

The weight of a term in a score is floor(1000 ln((2N + 2) / (2 df + 1))); the
rest is integer arithmetic (see :func:`contributions`). Terms are told apart
by 64-bit hashes inside a shard, and by their bytes among shards.

Edge cases: null or empty texts, and texts without terms, are no documents (not
counted in N); an item without terms has no rows; repeated document rows are
documents of their own, repeated items are ranked each; equal scores are ranked
by ascending id, documents without an id last; a very long document is a shard
of its own; an empty table, of documents or of items, gives no rows; only the
named columns are read, so further ones, of whatever name, do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codelode.llm.arrowtext import LOWER, gathered, slices, text_bytes, words
from codelode.llm.workspace import materialize, small

TOP = 10
#: Text bytes of a shard; one longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of the index rows that a task holds to write or read them.
GROUP_BYTES = 8 << 20
#: Text bytes of the items that are searched in one scan of the index.
BLOCK_BYTES = 4 << 20
#: Terms: bytes of digits, letters, and non-ASCII characters; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_INTS = pa.list_(pa.int32())


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def postings(part: pa.RecordBatch) -> pa.RecordBatch | None:
    """One index row: of the documents with terms, ids and numbers of terms; of each term, its documents and occurrences."""
    data, offsets = text_bytes(part.column("_text"))
    hashed, row, start, end = words(data, offsets)
    if len(hashed) == 0:
        return None
    lengths = np.bincount(row, minlength=part.num_rows)
    held = np.flatnonzero(lengths)
    number = np.cumsum(lengths > 0) - 1
    # rows ascend, so a stable order by hash is one by hash and row
    order = np.argsort(hashed, kind="stable")
    hashed, docs = hashed[order], number[row[order]]
    new_term = np.append(True, hashed[1:] != hashed[:-1])
    at = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]) | new_term)
    first = np.flatnonzero(new_term[at])
    some = order[new_term]
    columns = {
        "ids": _one(part.column("_id").take(pa.array(held))),
        "lengths": _one(pa.array(lengths[held], pa.int32())),
        "terms": _one(gathered(LOWER[data], start[some], end[some])),
        "counts": _one(pa.array(np.diff(np.append(first, len(at))), pa.int32())),
        "docs": _one(pa.array(docs[at], pa.int32())),
        "tfs": _one(pa.array(np.diff(np.append(at, len(hashed))), pa.int32())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: a row a shard (ids, lengths, terms, counts, docs, tfs)."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where(F.length("_text") > 0)
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "_text", SHARD_BYTES):
            made = postings(part)
            if made is not None:
                yield made

    schema = f"ids array<{kind}>, lengths array<int>, terms array<string>, counts array<int>, docs array<int>, tfs array<int>"
    return materialize(source.mapInArrow(run, schema), "lexical-index", GROUP_BYTES)


def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence list adds to scores: weight * (10^9 tf div (1000 tf + 8 m)), in 64-bit integers."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """An index row, with the contributions of those terms that some query has."""

    def __init__(self, row: dict[str, pa.Array], vocabulary: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        m = 10 + (90 * row["lengths"].to_numpy().astype(np.int64) * n_docs) // n_terms
        place = pc.index_in(vocabulary, value_set=row["terms"])
        #: of each term of the vocabulary: its place among the lists, or -1
        self.known = np.full(len(vocabulary), -1, np.int64)
        met = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        counts = row["counts"].to_numpy().astype(np.int64)
        begin = np.cumsum(counts) - counts
        docs, tfs = row["docs"].to_numpy(), row["tfs"].to_numpy().astype(np.int64)
        self.lists = []
        for v, k in zip(met.tolist(), place.take(pa.array(met)).to_pylist()):
            at = slice(begin[k], begin[k] + counts[k])
            self.known[v] = len(self.lists)
            self.lists.append((docs[at], contributions(weights[v], tfs[at], m[docs[at]])))
        self.bounds = np.array([added.max() for _, added in self.lists], np.int64)

    def search(self, query: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least ``least`` that may be among the ``top``; query: its terms' numbers."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = self.known[query]
        held = held[held >= 0]
        held = held[np.argsort(self.bounds[held], kind="stable")]
        sums = np.cumsum(self.bounds[held])
        if len(held) == 0 or sums[-1] < least:
            return none
        score = np.zeros(len(self.ids), np.int64)
        j, added_up, look = len(held) - 1, 0, top
        # the lists up to j name no document that qualifies by them alone, once their bounds' sum stays below
        while j >= 0 and sums[j] >= least:
            docs, added = self.lists[held[j]]
            score[docs] += added
            added_up += len(docs)
            j -= 1
            if added_up >= look:
                least = max(least, _nth(score[np.flatnonzero(score)], top))
                look = 2 * added_up
        live = np.flatnonzero(score)
        for j in range(j, -1, -1):
            least = max(least, _nth(score[live], top))
            live = live[score[live] + sums[j] >= least]
            docs, added = self.lists[held[j]]
            at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
            score[live] += np.where(docs[at] == live, added[at], 0)
        live = live[score[live] >= max(least, _nth(score[live], top))]
        return live, score[live]


def _nth(scores: np.ndarray, n: int) -> int:
    """The n-th best, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - n)[len(scores) - n]) if len(scores) >= n else 0


def _best(found: list[tuple], top: int) -> list[tuple]:
    """found: (score, id); the first by score descending, id ascending, none last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:top]


def _queries(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """(id, distinct terms) of the items, streamed to the driver in blocks of bounded size."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))
    block, size = [], 0
    for item, said in items.select(F.col(f"`{id_col}`"), terms).where(F.size(terms) > 0).toLocalIterator():
        length = sum(map(len, said))
        if block and size + length > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, said))
        size += length
    if block:
        yield block


def weights_of(index: DataFrame, vocabulary: list[str], n_docs: int) -> np.ndarray:
    """Of each term of a bounded vocabulary: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    wanted = index.sparkSession.createDataFrame([(k, t) for k, t in enumerate(vocabulary)], "k int, term string")
    lists = index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))))
    found = lists.join(small(wanted, F.length("term") + 24), "term").groupBy("k").agg(F.sum("n").alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for k, df in found:
        weights[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return weights


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = TOP, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of each item: the item's id, rank (from 1), the document's id, score.

    The items come in blocks of bounded size; the index is scanned once a block.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    kind = index.schema["ids"].dataType.elementType
    item_field = StructField("_item", items.schema[item_col].dataType)
    out = spark.createDataFrame([], StructType([item_field, StructField("rank", LongType()), StructField("_id", kind), StructField("score", LongType())]))

    def scan(searcher):
        def run(batches):
            vocabulary, weights, queries = searcher.value
            terms = pa.array(vocabulary, pa.string())
            best: list[list[tuple]] = [[] for _ in queries]
            id_type = None
            for batch in batches:
                id_type = batch.column("ids").type.value_type
                for r in range(batch.num_rows):
                    shard = Shard({c: batch.column(c)[r].values for c in ("ids", "lengths", "terms", "counts", "docs", "tfs")}, terms, weights, n_docs, n_terms)
                    for q, query in enumerate(queries):
                        least = best[q][-1][0] if len(best[q]) == top else 1
                        docs, scores = shard.search(query, max(least, 1), top)
                        if len(docs):
                            best[q] = _best([*best[q], *zip(scores.tolist(), shard.ids.take(pa.array(docs)).to_pylist())], top)
            if id_type is not None:
                rows = [(q, *x) for q, found in enumerate(best) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], id_type)], names=["_q", "score", "_id"])

        return run

    for block in _queries(items, item_col, text_col, block_bytes):
        vocabulary = sorted({t for _, said in block for t in said})
        number = {t: k for k, t in enumerate(vocabulary)}
        queries = [np.array([number[t] for t in said], np.int64) for _, said in block]
        searcher = spark.sparkContext.broadcast((vocabulary, weights_of(index, vocabulary, n_docs), queries))
        found = index.mapInArrow(scan(searcher), f"_q long, score long, _id {kind.simpleString()}")
        order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
        ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        named = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], StructType([StructField("_q", LongType()), item_field]))
        out = out.unionByName(ranked.join(F.broadcast(named), "_q").select("_item", "rank", "_id", "score"))
    return out.select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
