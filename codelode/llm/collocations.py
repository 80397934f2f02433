"""Phrase collocation mining: sketches propose, automata count, thresholds decide.

Texts are lower-cased (A-Z), split into pieces at sentence signs and line ends,
and pieces into words at blanks and tabs. A sketch counts hashed words, pairs
and longer phrases in two rows of cells; a phrase's true count can't exceed the
lesser of its two cells. Cells are summed over all tasks, and only whether a
sum reaches the least count is kept, a bit a cell. First come words and pairs,
then phrases of three words and more, but only those whose pairs all pass.

Each task then compiles those phrases of its own slice of text that pass into
one automaton a language, as strings guarded by a delimiter on both sides, and
scans the slice: the automaton reports all matches, overlapping ones too, so
every count is exact. Slices hold every phrase they count, so what is compiled
is bounded by the slice, not by the corpus. Counts are summed in Spark; since a
part of a phrase is at least as frequent as the phrase, everything that the
scores need is among the counts that reach the threshold.

The sketch has ``CELLS`` cells a row, and there is one for each task; tasks are
as many as the cluster's cores ask for, not as the input has splits, so what is
sent of sketches doesn't grow with the corpus. In a corpus that fills all cells
more phrases pass and are counted for nothing; results don't depend on it.

Edge cases: null text is empty, and has no words; null languages count as
``und``; repeated rows count each; equal scores are ranked by count, then by
the phrase's bytes; an empty table gives no rows; very long texts are slices of
their own; only the named columns are read, so further ones, of whatever name,
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.arrowtext import LOWER, gathered, mix, slices, text_bytes, words
from codelode.llm.workspace import materialize, small

WORDS, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Cells of each of a sketch's two rows, a power of two.
CELLS = 1 << 23
#: Tasks for each core of the cluster: as many sketches and partial counts there are, however large the corpus is.
TASKS_PER_CORE = 2
#: Cells that one row of a written sketch holds.
BLOCK = 1 << 18
SLICE_BYTES = 4 << 20
#: Counts that a task holds before it hands them on.
HELD = 1_000_000

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?"]] = _ENDS[0x0A:0x0E] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Slice:
    """The words of a slice of rows: their hashes by language, and which follow each other in a piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = text_bytes(text)
        self.data = LOWER[data]
        hashed, self.row, self.start, self.end = words(data, offsets, _WORD)
        self.langs = lang.dictionary_encode()
        salts = np.array([_salt(x) for x in self.langs.dictionary.to_pylist()], np.uint64)
        self.lang = self.langs.indices.to_numpy()[self.row] if len(self.row) else np.zeros(0, np.int32)
        self.words = mix(hashed + salts[self.lang]) if len(self.row) else hashed
        piece = np.cumsum(_ENDS[data])[self.start] if len(self.row) else self.row
        #: whether a word's successor stands in the same piece
        self.on = np.append((self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1]), False)[: len(self.row)]

    def phrases(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: where phrases begin, and their hashes."""
        at, hashed = np.arange(len(self.words)), self.words
        for k in range(1, most + 1):
            if k > 1:
                on = self.on[at + k - 2]
                at, hashed = at[on], mix(hashed[on] * _STEP + self.words[at[on] + k - 1])
            yield at, hashed


def _salt(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
    return mix(np.array([len(raw)], np.uint64) + (raw * _STEP ** np.arange(len(raw), dtype=np.uint64)).sum(dtype=np.uint64))[0]


def _cells(hashed: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (hashed & mask).astype(np.int64), ((hashed >> np.uint64(32)) & mask).astype(np.int64)


class Bits:
    """Which cells of a sketch reach the least count."""

    def __init__(self, cells: int, packed: list[np.ndarray]):
        self.cells, self.packed = cells, packed

    def passes(self, hashed: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashed), bool)
        for bits, at in zip(self.packed, _cells(hashed, self.cells)):
            ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def _starts_passing(at: np.ndarray, k: int, last: np.ndarray) -> np.ndarray:
    """Of phrases of k words that begin ``at``: whether both their parts of k - 1 words are in the mask ``last``."""
    return last[at] & last[at + 1] if k > 1 else np.ones(len(at), bool)


def _sketch_rows(**columns: list) -> pa.RecordBatch:
    kinds = {"block": pa.int32(), "cells": pa.binary(), "lang": pa.string(), "n": pa.int64()}
    return pa.RecordBatch.from_pydict({c: pa.array(columns[c], kind) for c, kind in kinds.items()})


def sketch(docs: DataFrame, text_col: str, lang_col: str, cells: int, least: int, most: int, pairs: Bits | None = None) -> tuple[Bits, DataFrame]:
    """The sketch's bits, and (lang, n): all words of each language.

    Without ``pairs``: of words and pairs. With them: of phrases of three to
    ``most`` words whose pairs all pass. Cells are clipped at ``least``, which
    loses nothing that the bits tell.
    """
    spark = docs.sparkSession
    known = None if pairs is None else spark.sparkContext.broadcast(pairs)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if least <= np.iinfo(t).max)

    width = min(BLOCK, cells)

    def count(batches):
        table = np.zeros((2, cells), np.uint32)
        n: dict[str, int] = {}
        for part in slices(batches, "_text", SLICE_BYTES):
            said = Slice(part.column("_text"), part.column("_lang"))
            for lang, some in zip(said.langs.dictionary.to_pylist(), np.bincount(said.lang, minlength=len(said.langs.dictionary)).tolist()):
                n[lang] = n.get(lang, 0) + some
            linked = None
            for k, (at, hashed) in enumerate(said.phrases(2 if known is None else most), 1):
                if known is not None and k == 2:
                    linked = np.zeros(len(said.words) + 1, bool)
                    linked[at] = known.value.passes(hashed)
                if known is not None and k < 3:
                    continue
                if known is not None:
                    whole = linked[at]
                    for j in range(1, k - 1):
                        whole &= linked[at + j]
                    hashed = hashed[whole]
                for own, cell in zip(table, _cells(hashed, cells)):
                    np.add.at(own, cell, np.uint32(1))
            np.minimum(table, np.uint32(least), out=table)
        pack = zstandard.ZstdCompressor(level=1)
        blocks = table.astype(kind).reshape(-1, width)
        used = np.flatnonzero(blocks.any(axis=1)).tolist()
        for b in used:
            yield _sketch_rows(block=[b], cells=[pack.compress(blocks[b].tobytes())], lang=[None], n=[None])
        if n:
            yield _sketch_rows(block=[None] * len(n), cells=[None] * len(n), lang=list(n), n=list(n.values()))

    def add(batches):
        # all tasks' versions of a block meet here, one at a time; the sums are no more than the sketch
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("cells")):
                values = np.frombuffer(unpack.decompress(raw.as_py()), kind)
                sums[block] = np.minimum(sums[block] + values, least) if block in sums else values.astype(np.uint32)
        for block, total in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    made = materialize(docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).mapInArrow(count, "block int, cells binary, lang string, n bigint"), "phrase-sketch")
    packed = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    # a bit a cell: bounded by MAX_CELLS
    for block, bits in made.where("block is not null").select("block", "cells").repartition("block").mapInArrow(add, "block int, bits binary").toLocalIterator():
        r, b = divmod(block, cells // width)
        packed[r][b * width // 8 : (b + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    totals = made.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    if known is not None:
        known.destroy()
    return Bits(cells, packed), totals


def proposed(said: Slice, pairs: Bits, longer: Bits, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(first words, number of words) of one occurrence of each phrase that passes."""
    last = None
    for k, (at, hashed) in enumerate(said.phrases(most), 1):
        ok = (pairs if k < 3 else longer).passes(hashed) & _starts_passing(at, k, last)
        last = np.zeros(len(said.words) + 1, bool)
        last[at[ok]] = True
        yield at[ok][np.unique(hashed[ok], return_index=True)[1]], k


def guarded(said: Slice, lang: int) -> str:
    """The language's words, each between blanks, pieces parted by line feeds."""
    own = np.flatnonzero(said.lang == lang)
    start, end, last = said.start[own], said.end[own], ~said.on[own]
    length = end - start + 1 + 2 * last
    first = np.cumsum(length) - length
    out = np.full(int(length.sum()), 0x20, np.uint8)
    size = end - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(first + 1, size) + place] = said.data[np.repeat(start, size) + place]
    out[(first + length - 1)[last]] = 0x0A
    return out.tobytes().decode()


def _matches(said: Slice, found: list[tuple[np.ndarray, int]], lang: int) -> tuple[list[str], list[int]]:
    """The phrases of one language, and how often each stands in the slice."""
    # a phrase is told by its text; two of one hash or more occurrences are one
    named: dict[str, None] = {}
    for at, k in found:
        own = at[said.lang[at] == lang]
        if k == 1:
            named |= dict.fromkeys(gathered(said.data, said.start[own], said.end[own]).to_pylist())
        else:
            # words of a piece may be parted by several blanks
            parts = [gathered(said.data, said.start[own + j], said.end[own + j]).to_pylist() for j in range(k)]
            named |= dict.fromkeys(map(" ".join, zip(*parts)))
    phrases = list(named)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", k)
    if not phrases:
        return phrases, []
    automaton.make_automaton()
    hits = np.fromiter(map(itemgetter(1), automaton.iter(guarded(said, lang))), np.int64)
    return phrases, np.bincount(hits, minlength=len(phrases)).tolist()


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``most`` words that occur ``least`` times, and (lang, n): all words."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("_lang"))
    source = source.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    pairs, totals = sketch(source, "_text", "_lang", CELLS, least, most)
    longer, _ = sketch(source, "_text", "_lang", CELLS, least, most, pairs)
    known = spark.sparkContext.broadcast((pairs, longer))

    def told(counts: dict[tuple[str, str], int]):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "phrase", "f"])

    def scan(batches):
        held: dict[tuple[str, str], int] = {}
        for part in slices(batches, "_text", SLICE_BYTES):
            said = Slice(part.column("_text"), part.column("_lang"))
            found = list(proposed(said, *known.value, most))
            for number, lang in enumerate(said.langs.dictionary.to_pylist()):
                for phrase, n in zip(*_matches(said, found, number)):
                    held[lang, phrase] = held.get((lang, phrase), 0) + n
            if len(held) >= HELD:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    counted = source.mapInArrow(scan, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialize(counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f"), "phrase-counts"), totals


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = WORDS, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    The score is floor(1000 a n / (l r)) at the cut into two parts, of counts l
    and r, that scores least (of equal ones the first). Phrases inside a longer
    one with at least ``share`` percent of their count are left out.
    """
    counts, totals = frequent(docs, text_col, lang_col, least, most)
    phrases = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("_w"))
    part = lambda first, n: F.array_join(F.slice("_w", first, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "k", "_w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    known = counts.select("lang", "phrase", "f")
    heads, tails = known.toDF("lang", "head", "l"), known.toDF("lang", "tail", "r")
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(small(totals, F.length("lang") + 16), "lang")
    cuts = cuts.withColumns({"_x": F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n"), "_y": _exact("l") * _exact("r")}).withColumn("score", F.expr("_x div _y"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("_s")).select("lang", "phrase", "_s.*")
    # every phrase of two words or more inside a longer one
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m"))))), lambda s: s["m"] > 1)
    inner = phrases.where("k > 2").select("lang", "_w", F.col("a").alias("_longer"), F.explode(spans).alias("_p"))
    covered = inner.groupBy("lang", part(F.col("_p.i"), F.col("_p.m")).alias("phrase")).agg(F.max("_longer").alias("_longer"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
