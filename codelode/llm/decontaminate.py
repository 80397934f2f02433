"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of the benchmark
items (an item of fewer words, but not none, is one window). Per pattern
length m the searcher holds a shift table indexed by a block of two words
(how far the search may jump when that block ends at the current word), and
suffix buckets that map the last block of a window to the windows ending in
it. The scan jumps through every text with the shift table, looks windows up
in their bucket where the shift is 0, and confirms each by comparing words.
All segments of a slice of documents are scanned in lock step with numpy.

Edge cases: null or empty text, or text without words, has 0 words and no hit;
items that are null or have no word give no window; windows that several items
share count for each of those items; repeated document rows are judged row by
row; an item without an id is searched, and what it hits is hit, but it isn't
listed or counted; an empty benchmark leaves every document clean. Only the
named columns are read, so further columns, of whatever name, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.arrowtext import LOWER, mix, slices, text_bytes, words
from codelode.llm.workspace import materialize, plainly_named

WINDOW = 10
#: Words of a segment; segments overlap by the window length less one.
SEGMENT = 512
#: Slots of the shift table for each window, as a power of two: few slots, and so few places, have shift 0.
SPARE_BITS = 4
#: Text bytes of the benchmark that one block (one broadcast searcher) may hold. A searcher takes some 36 bytes a word
#: and 16 to 32 slots of a byte: about 10 times the text for words of 5 letters, 26 times at the very worst.
BLOCK_BYTES = 16 << 20

_SALT = np.uint64(0x2545F4914F6CDD1D)


def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _SALT + right)


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return (block >> np.uint64(64 - bits)).astype(np.int64)


class Windows:
    """All windows of one length, as numbers of their first words: ordered by suffix block, then by a hash of all words."""

    def __init__(self, size: int, hashed: np.ndarray, first: np.ndarray):
        self.size, self.wide = size, min(2, size)
        suffix = self._blocks(hashed, first, size - self.wide)
        whole = self.whole(hashed, first)
        order = np.lexsort((whole, suffix))
        self.first, self.suffix, self.hash = first[order], suffix[order], whole[order]
        self.bits = max(10, int(len(first) - 1).bit_length() + SPARE_BITS)
        last = size - self.wide
        self.shift = np.full(1 << self.bits, last + 1, np.int8 if size < 127 else np.int32)
        for at in range(last + 1):  # later blocks allow smaller jumps
            self.shift[_slot(self._blocks(hashed, first, at), self.bits)] = last - at

    def _blocks(self, hashed: np.ndarray, first: np.ndarray, at: int) -> np.ndarray:
        return _block(hashed[first + at], hashed[first + at + 1]) if self.wide == 2 else mix(hashed[first + at])

    def whole(self, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros(len(first), np.uint64)
        for j in range(self.size):
            total = total * _SALT + hashed[first + j]
        return mix(total)

    def bucket(self, suffix: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges, of the suffixes' buckets, of those windows that have the same hash."""
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        return self._within(low, high, whole, False), self._within(low, high, whole, True)

    def _within(self, low: np.ndarray, high: np.ndarray, whole: np.ndarray, after: bool) -> np.ndarray:
        """Binary search for all places at once."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            there = self.hash[np.minimum(middle, len(self.hash) - 1)]
            right = open_ & ((there <= whole) if after else (there < whole))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low


class Searcher:
    """Windows of a block of benchmark items, by window length; words are byte ranges of one buffer."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        """items: (item id as string, or none, text)."""
        self.ids = [i for i, _ in items]
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        hashed, row, start, end = words(data, offsets)
        self.data, self.start, self.end = LOWER[data], start, end
        counts = np.bincount(row, minlength=len(items))
        heads = np.cumsum(counts) - counts
        #: of each item, its first word's number
        self.heads = heads
        sizes = np.minimum(counts, window)
        self.groups = []
        for size in sorted(set(sizes[sizes > 0].tolist())):
            own = np.flatnonzero(sizes == size)
            n = counts[own] - size + 1
            first = np.repeat(heads[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.groups.append(Windows(size, hashed, first))

    def _owners(self, group: Windows, places: range, said: bytes) -> list[int]:
        """The items whose windows are word for word what is said."""
        own = []
        for first in group.first[places.start : places.stop].tolist():
            if b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + group.size)) == said:
                own.append(int(np.searchsorted(self.heads, first, "right")) - 1)
        return own

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """Occurrences: (first word, words, owners) by index into the slice's words, and the words' rows."""
        hashed, row, start, end = words(data, offsets)
        found: list[tuple[int, int, list[int]]] = []
        if len(hashed) == 0 or not self.groups:
            return found, row
        blocks = mix(hashed)
        pairs = np.zeros(len(hashed), np.uint64)
        pairs[1:] = _block(hashed[:-1], hashed[1:])
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        tails = np.append(heads[1:], len(row))
        # segments of each row by the index of their first and last word
        n = -(-(tails - heads) // SEGMENT)
        first = np.repeat(heads, n) + SEGMENT * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stop = np.repeat(tails, n)
        lowered = None
        for group in self.groups:
            size, key_of = group.size, pairs if group.wide == 2 else blocks
            at = first + size - 1
            limit = np.minimum(first + SEGMENT + size - 1, stop)
            live = at < limit
            at, limit = at[live], limit[live]
            while len(at):
                jump = group.shift[_slot(key_of[at], group.bits)].astype(np.int64)
                zero = np.flatnonzero(jump == 0)
                if len(zero):
                    begins = at[zero] - size + 1
                    low, high = group.bucket(key_of[at[zero]], group.whole(hashed, begins))
                    for k in np.flatnonzero(low < high).tolist():
                        lowered = LOWER[data] if lowered is None else lowered
                        begin = int(begins[k])
                        said = b" ".join(lowered[start[i] : end[i]].tobytes() for i in range(begin, begin + size))
                        owners = self._owners(group, range(int(low[k]), int(high[k])), said)
                        if owners:
                            found.append((begin, size, owners))
                    jump[zero] = 1
                at = at + jump
                live = at < limit
                at, limit = at[live], limit[live]
        return found, row

    def judge(self, arr: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Words of each row; of each row with hits, the merged word ranges and the items."""
        data, offsets = text_bytes(arr)
        found, row = self.search(data, offsets)
        n_words = np.bincount(row, minlength=len(arr))
        first_word = np.cumsum(n_words) - n_words
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for begin, size, owners in sorted(found, key=lambda x: x[0]):
            r = int(row[begin])
            spans, items = hits.setdefault(r, ([], set()))
            items.update(self.ids[o] for o in owners if self.ids[o] is not None)
            a, b = begin - int(first_word[r]), begin - int(first_word[r]) + size
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], b))
            else:
                spans.append((a, b))
        return n_words, hits


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items, streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        if block and size + len(text.encode()) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text.encode())
    if block:
        yield block


_RANGES = "array<struct<a:bigint,b:bigint>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: n_words, ranges (merged, of hit words), items (sorted ids).

    A benchmark beyond ``block_bytes`` is searched block by block, each in a
    scan of its own with one searcher in memory; what the later scans hit is
    written, and merged into the first scan's rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _th bigint, n_words bigint, ranges {_RANGES}, items array<string>"

    def scan(searcher, hits_only):
        def run(batches):
            for part in slices(batches, "_text"):
                n_words, hits = searcher.value.judge(part.column("_text"))
                found = [hits.get(r, ((), ())) for r in range(part.num_rows)]
                out = pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_th"), pa.array(n_words, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in spans] for spans, _ in found], _SPANS), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))],
                    names=["_id", "_th", "n_words", "ranges", "items"],
                )
                yield out.filter(pa.array([bool(spans) for spans, _ in found], pa.bool_())) if hits_only else out

        return run

    blocks = benchmark_blocks(benchmark, "item_id", "text", block_bytes)
    first = spark.sparkContext.broadcast(Searcher(next(blocks, []), window))
    out = source.mapInArrow(scan(first, False), schema)
    later = None
    for block in blocks:
        searcher = spark.sparkContext.broadcast(Searcher(block, window))
        part = materialize(source.mapInArrow(scan(searcher, True), schema).distinct(), "leak-hits")
        searcher.destroy()
        later = part if later is None else later.unionByName(part)
    if later is not None:
        more = later.groupBy(F.col("_id").alias("_lid"), F.col("_th").alias("_lth")).agg(F.flatten(F.collect_list("ranges")).alias("_r"), F.flatten(F.collect_list("items")).alias("_i"))
        both = out.join(more, F.col("_id").eqNullSafe(F.col("_lid")) & (F.col("_th") == F.col("_lth")), "left")
        items = F.array_sort(F.array_union("items", F.coalesce("_i", F.array().cast("array<string>"))))
        both = both.select("_id", "_th", "n_words", F.concat("ranges", F.coalesce("_r", F.array().cast(_RANGES))).alias("ranges"), items.alias("items"))
        out = both.mapInArrow(_merged, schema)
    return out.drop("_th").withColumnRenamed("_id", id_col)


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _merged(batches):
    for batch in batches:
        ranges = [[{"a": a, "b": b} for a, b in merge([(x["a"], x["b"]) for x in spans])] for spans in batch.column("ranges").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("ranges"), "ranges", pa.array(ranges, _SPANS))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`contamination`'s rows."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Document rows without any occurrence; all columns stay as they are.

    One scan a block; between blocks the rows that are left are written.
    """

    def without(searcher):
        def run(batches):
            for part in slices(batches, text):
                keep = np.ones(part.num_rows, bool)
                _, hits = searcher.value.judge(part.column(text))
                keep[list(hits)] = False
                yield part.filter(pa.array(keep))

        return run

    plain, text = plainly_named(docs, text_col)
    out, before = plain, None
    for block in benchmark_blocks(benchmark, block_bytes=block_bytes):
        if before is not None:
            out = materialize(out, "leak-left")
            before.destroy()
        before = docs.sparkSession.sparkContext.broadcast(Searcher(block, window))
        out = out.mapInArrow(without(before), plain.schema)
    return out.toDF(*docs.columns)
