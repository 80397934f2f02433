"""Token-id files with directly addressable codes (DACs).

An id is cut into chunks of 8 bits, the lowest first. Level k of a file holds
the k-th chunk of every id that has one, in order; a bitmap beside it tells
which of them go on at level k + 1, and a rank directory (ones before each
block of 512 bits) finds the place there. So any id is read by following its
chunks, without decoding a block.

``write_tokens`` range-partitions the documents by id, encodes them in the
task that writes them, and starts a new file after ``file_ids`` ids, which
bounds a task's memory. File names are unique to a task attempt; the manifest,
which Spark commits, names the files that count, so lost or repeated tasks
leave at most orphans. ``read_tokens`` opens the named files by themselves.

Edge cases: null and empty texts have the end id alone; repeated document ids
are all written, ordered by text; null ids come first; an empty table gives an
empty manifest; texts of any length are encoded whole (a document never spans
files, so one longer than ``file_ids`` makes a file of its own);
only the named columns are read, so further ones, of whatever name, do not
matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.arrowtext import slices
from codelode.llm.tokens import encoder
from codelode.llm.workspace import fresh_path, materialize

END_ID = 2
FILE_IDS = 8_000_000
#: Ids decoded at once when documents are read in order.
READ_IDS = 500_000
MAGIC = b"DAC1"
_BLOCK = 512


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, document directory, levels."""
    parts = [_pad(np.asarray(doc_ids, "<i8").tobytes()), _pad(np.asarray(lengths, "<i8").tobytes())]
    rest, levels = ids.astype("<u4"), []
    while True:
        more = rest > 0xFF
        chunk = (rest & np.uint32(0xFF)).astype(np.uint8)
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % (_BLOCK // 8))
        ones = np.bitwise_count(np.frombuffer(bits, "<u8")).reshape(-1, 8).sum(1, dtype=np.uint64)
        ranks = (np.cumsum(ones) - ones).astype("<u8")
        levels.append((len(chunk), len(ranks)))
        parts += [_pad(chunk.tobytes()), bits, ranks.tobytes()]
        rest = rest[more] >> np.uint32(8)
        if len(rest) == 0:
            break
    head = MAGIC + struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)) + b"".join(struct.pack("<QQ", *x) for x in levels)
    return _pad(head) + b"".join(parts)


class Codes:
    """A file's bytes as an addressable sequence of ids."""

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a DAC file")
        n_levels, n_docs, self.n = struct.unpack_from("<IQQ", raw, 4)
        sizes = [struct.unpack_from("<QQ", raw, 24 + 16 * k) for k in range(n_levels)]
        at = -(-(24 + 16 * n_levels) // 8) * 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.doc_ids, self.lengths = take("<i8", n_docs), take("<i8", n_docs)
        self.levels = [(take("u1", n), take("<u8", blocks * 8), take("<u8", blocks)) for n, blocks in sizes]

    @staticmethod
    def _rank(level, at: np.ndarray) -> np.ndarray:
        """Ones of the level's bitmap before each position."""
        _, words, ranks = level
        at = np.asarray(at, np.int64)
        out = np.append(ranks, ranks[-1:] + np.bitwise_count(words[-8:]).sum(dtype=np.uint64) if len(ranks) else [0]).astype(np.int64)[at // _BLOCK]
        word = at >> 6
        begin = word & ~7
        for k in range(8):
            here = begin + k
            whole = here < word
            out += np.where(whole, np.bitwise_count(words[np.minimum(here, len(words) - 1)]), 0) if len(words) else 0
        if len(words):
            part = words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            out += np.where(word < len(words), np.bitwise_count(part), 0)
        return out

    def access(self, at) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for k, level in enumerate(self.levels):
            if len(live) == 0:
                break
            chunk, words, _ = level
            out[live] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
            goes_on = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            at = self._rank(level, at[goes_on])
            live = live[goes_on]
        return out

    def range(self, start: int, n: int) -> np.ndarray:
        """The n ids from ``start``: one rank a level, then runs."""
        out = np.zeros(n, np.uint32)
        live = np.arange(n)
        for k, level in enumerate(self.levels):
            if len(live) == 0:
                break
            chunk, words, _ = level
            out[live] |= chunk[start : start + len(live)].astype(np.uint32) << np.uint32(8 * k)
            lo, hi = start >> 6, (start + len(live) + 63) >> 6
            bits = np.unpackbits(words[lo:hi].view(np.uint8), bitorder="little")[start - (lo << 6) :][: len(live)].astype(bool)
            start = int(self._rank(level, np.array([start]))[0])
            live = live[bits]
        return out


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS, path: str | None = None) -> DataFrame:
    """Write the files in ascending document order; returns the manifest (shard, part, file, n_docs, n_ids, start)."""
    path = path or fresh_path(docs.sparkSession, "dac")
    ordered = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).repartitionByRange("_id").sortWithinPartitions("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]):
        system, folder = pafs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        shard, part, held, coded = TaskContext.get().partitionId(), 0, [], 0
        tail = np.array([end_id], np.uint16).tobytes()

        def flush():
            nonlocal part, held, coded
            ids = np.frombuffer(b"".join(x + tail for _, x in held), np.uint16)
            name = f"{shard:06d}-{part:06d}-{uuid.uuid4().hex}.dac"
            raw = pack(np.array([i for i, _ in held]), np.array([len(x) // 2 + 1 for _, x in held]), ids)
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(raw)
            row = pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "file": f"{path}/{name}", "n_docs": len(held), "n_ids": len(ids)}], schema=_MANIFEST)
            part, held, coded = part + 1, [], 0
            return row

        for batch in slices(batches, "_text"):
            for doc, ids in zip(batch.column("_id").to_pylist(), encoder(tokenizer).encode(batch.column("_text").to_pylist())):
                if held and coded + len(ids) // 2 + 1 > file_ids:
                    yield flush()
                held.append((NULL_ID if doc is None else doc, ids))
                coded += len(ids) // 2 + 1
        if held:
            yield flush()

    manifest = materialize(ordered.mapInArrow(run, "shard long, part long, file string, n_docs long, n_ids long"), "dac-manifest")
    # a row for each file of file_ids ids
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


#: Stands for a null document id inside a file.
NULL_ID = -(1 << 63)
_MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def open_codes(file: str) -> Codes:
    system, name = pafs.FileSystem.from_uri(file)
    with system.open_input_file(name) as source:
        return Codes(source.read_buffer())


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the manifest's files: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = open_codes(row["file"])
                begins = np.cumsum(codes.lengths) - codes.lengths
                crcs, ids, k = [], [], 0
                while k < len(begins):
                    # documents that together have about READ_IDS ids
                    end = max(k + 1, int(np.searchsorted(begins, begins[k] + READ_IDS)))
                    some = codes.range(int(begins[k]), int(codes.lengths[k:end].sum())).astype("<u4")
                    for a, n in zip((begins[k:end] - begins[k]).tolist(), codes.lengths[k:end].tolist()):
                        crcs.append(zlib.crc32(some[a : a + n]))
                        if with_ids:
                            ids.append(some[a : a + n].astype(np.int64))
                    k = end
                columns = [pa.array(codes.doc_ids, mask=codes.doc_ids == NULL_ID), pa.array(begins + row["start"]), pa.array(codes.lengths), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return manifest.select("file", "start").repartition(files).mapInArrow(run, schema)
