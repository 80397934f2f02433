"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text is lower-cased; every run of bytes that are not letters becomes one
space; n-grams are the 1 to 3 byte long substrings of the UTF-8 form. A
language's profile is its ``profile`` most frequent n-grams over all training
documents, in rank order. A document's own ``profile`` most frequent n-grams,
of all that it has, are compared with each language's by the sum of rank
differences; an n-gram that a profile lacks costs the full profile length. The
language with the least distance wins; the score is one less its distance by
the farthest possible.

Edge cases: null text and text without a letter give ``und`` with score 0;
training ignores rows whose language is null; with no training rows at all
every text is ``und``; ties between n-gram counts go to the n-gram that is more
frequent among the languages' ``candidates`` most frequent ones, then to the
smaller code; ties between languages to the alphabetically first; texts of any
length are read whole, in pieces; repeated rows are judged row by row; only
the named columns are read, ``keep_known`` carries columns of any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.arrowtext import slices, text_bytes
from codelode.llm.workspace import plainly_named

PROFILE = 300
CANDIDATES = 1500
UNKNOWN = "und"

#: 0: separator; 1..26: a-z; 27..: bytes of non-ASCII characters.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:] = np.arange(27, 155)
_N = 155
_CODES = _N**3 + _N**2 + _N
#: Bytes of text whose n-grams a worker holds at once.
PIECE = 512 << 10
#: (language, n-gram) counts that a training task keeps before it passes them on.
_HELD = 1 << 20


def _pieces(arr: pa.Array):
    """(codes, rows) of all n-grams, for PIECE symbols at a time; an n-gram lies within one row."""
    data, offsets = text_bytes(pc.utf8_lower(arr))
    symbols = _SYMBOL[data]
    # of a run of separators, the first; a row's first symbol anyway
    kept = symbols > 0
    kept[1:] |= symbols[:-1] > 0
    kept[offsets[:-1][offsets[:-1] < len(data)]] = True
    offsets = np.append(np.int32(0), np.cumsum(kept, dtype=np.int32))[offsets]
    symbols = symbols[kept]
    for begin in range(0, len(symbols), PIECE):
        some = symbols[begin : begin + PIECE + 2].astype(np.int32)
        own = min(PIECE, len(symbols) - begin)
        row = np.searchsorted(offsets, np.arange(begin, begin + len(some)), side="right").astype(np.int32) - 1
        two = some[:-1] * _N + some[1:]
        three = two[:-1] * _N + some[2:]
        letters = some[:own] > 0
        same2 = (row[:-1] == row[1:])[:own]
        same3 = (row[:-2] == row[2:])[:own]
        codes = np.concatenate([_N**3 + _N**2 + some[:own][letters], _N**3 + two[:own][same2], three[:own][same3]])
        yield codes, np.concatenate([row[:own][letters], row[:-1][:own][same2], row[:-2][:own][same3]])


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often they are there."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    return keys[first], counts.astype(np.int64)


def _grams(arr: pa.Array, of_row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (row, or what it stands for, times _CODES, plus code) in order, with their counts."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for codes, rows in _pieces(arr):
        more, k = _summed((rows if of_row is None else of_row[rows]).astype(np.int64) * _CODES + codes)
        keys, n = _summed(np.concatenate([keys, more]), np.concatenate([n, k])) if len(keys) else (more, k)
    return keys, n


def _has_letter(arr: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(arr, r"\pL"), False).to_numpy(zero_copy_only=False)


def _count(batches):
    names: dict[str, int] = {}
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told():
        langs = np.array(list(names), object)[keys // _CODES] if len(keys) else []
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys % _CODES, pa.int32()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    for part in slices(batches, "text", PIECE):
        of_row = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()])
        more, k = _grams(part.column("text"), of_row)
        keys, n = _summed(np.concatenate([keys, more]), np.concatenate([n, k]))
        if len(keys) > _HELD:
            yield told()
            keys, n = keys[:0], n[:0]
    yield told()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", profile: int = PROFILE, candidates: int = CANDIDATES) -> dict:
    """Profiles from all rows with a language: a dict of bounded size (languages x candidates)."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(_count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # at most 155 + 155^2 + 155^3 n-grams a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= candidates).collect()
    langs = sorted({r["lang"] for r in top})
    total: dict[int, int] = {}
    for r in top:
        total[r["code"]] = total.get(r["code"], 0) + r["n"]
    codes = sorted(total, key=lambda c: (-total[c], c))
    place = {c: i for i, c in enumerate(codes)}
    ranks = np.full((len(langs), len(codes)), profile, np.int32)
    for r in top:
        if r["rank"] <= profile:
            ranks[langs.index(r["lang"]), place[r["code"]]] = r["rank"] - 1
    return {"langs": langs, "codes": np.array(codes, np.int64), "ranks": ranks, "profile": profile}


class Identifier:
    def __init__(self, model: dict):
        self.langs, self.ranks, self.profile = model["langs"], model["ranks"], model["profile"]
        self.n = len(model["codes"])
        # candidates by their frequency, then all others by code
        self.place = np.arange(self.n, self.n + _CODES, dtype=np.int32)
        self.place[model["codes"]] = np.arange(self.n)
        # what no profile has
        self.beyond = np.full((len(self.langs), 1), self.profile, np.int32)

    def judge(self, arr: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        found = _has_letter(arr)
        if not self.langs:
            return [UNKNOWN] * len(arr), np.zeros(len(arr))
        keys, n = _grams(arr)
        row, place = keys // _CODES, self.place[keys % _CODES].astype(np.int64)
        order = np.lexsort((place, -n, row))
        row, place = row[order], place[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.profile
        row, place, rank = row[top], place[top], rank[top]
        there = np.concatenate([self.ranks, self.beyond], 1)[:, np.minimum(place, self.n)]
        off = np.where(there < self.profile, np.abs(there - rank), self.profile)
        used = np.maximum(np.bincount(row, minlength=len(arr)), 1)
        apart = np.stack([np.bincount(row, o, minlength=len(arr)) for o in off]) / used
        best = apart.argmin(0)
        score = np.clip(1 - apart[best, np.arange(len(arr))] / self.profile, 0, 1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, found)], np.where(found, score, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        identifier = Identifier(shared.value)
        for part in slices(batches, "_text", PIECE):
            lang, score = identifier.judge(part.column("_text"))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_known(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """Rows whose text has a language (not ``und``) and a score over ``least``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, text = plainly_named(docs, text_col)

    def run(batches):
        identifier = Identifier(shared.value)
        for part in slices(batches, text, PIECE):
            lang, score = identifier.judge(part.column(text))
            yield part.filter(pa.array((np.array(lang) != UNKNOWN) & (score > least)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
