"""Byte-level views of Arrow string columns.

``mapInArrow`` hands over record batches; these helpers expose the UTF-8 bytes
of a text column to numpy without making Python strings, in slices of bounded
size so that memory does not depend on the batch or on the longest group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer row forms a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows handled at once.
SLICE_ROWS = 8192


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of ``column`` or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


_POWER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(4096, _POWER, np.uint64))

#: Word bytes: digits, letters, and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _coefficients(longest: int) -> np.ndarray:
    if longest <= len(_powers):
        return _powers
    return np.cumprod(np.full(longest, _POWER, np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD):
    """Words of each row, A-Z lower-cased; ``is_word``: which bytes they are made of.

    Returns (hash, row, start, end): a 64-bit hash of every word's lower-cased
    bytes, its row, and its byte range in ``data``. A word is a maximal run of
    word bytes within one row.
    """
    empty = np.zeros(0, np.int64)
    if len(data) == 0:
        return np.zeros(0, np.uint64), empty, empty, empty
    inside = is_word[data]
    begins = np.zeros(len(data), bool)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:]
    start = np.flatnonzero(first)
    if len(start) == 0:
        return np.zeros(0, np.uint64), empty, empty, empty
    count = np.cumsum(inside)
    at = count[start] - 1
    length = np.diff(np.append(at, count[-1]))
    body = LOWER[data[inside]].astype(np.uint64)
    body += np.uint64(1)
    place = np.arange(len(body), dtype=np.int64) - np.repeat(at, length)
    body *= _coefficients(int(length.max()))[place]
    hashed = mix(np.add.reduceat(body, at) ^ length.astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return hashed, row, start, start + length


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The byte ranges of ``data``, each of whole characters, as strings."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    picked = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(picked)))
