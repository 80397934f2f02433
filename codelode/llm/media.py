"""Media payloads in a deduplicated store of content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its low
bits clear (``MIN``, ``MASK`` and ``MAX`` rule the sizes), so equal stretches
give equal chunks wherever they stand. Chunks are known by SHA-256. Spark
joins find, for each distinct chunk, the payload that owns it (the first by
digest and position); only owners store bytes. A payload's stored form is a
manifest, the ordered list of its chunks, followed by those chunks' bytes; it
is put together from the store, and every chunk and the whole payload are
verified against their digests before features are computed.

Equal payloads are one from the start (a document refers to its payload's
digest), so a text with millions of copies is stored and rebuilt once.

Edge cases: null text is an empty payload of 64 zero bytes, as is empty text;
very long payloads have longer chunk lists, nothing else; repeated document
rows give repeated rows; rows of one id, or of none, may have different texts
(what a row stores is planned by id and text); an empty table gives an empty
store; only the named columns are read, so further ones, of whatever name, do
not matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.arrowtext import slices, text_bytes
from codelode.llm.workspace import materialize, one_of_each, small

UNIT = 64
MIN, MASK, MAX = 512, (1 << 11) - 1, 16_384
MAGIC = b"CDC1"
_rng = np.random.Generator(np.random.PCG64(20240229))
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[b[i - j]] << j for j < 32, by doubling."""
    h = GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(hashes: np.ndarray, start: int, end: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of data[start:end]; marks: positions where the hash allows a cut."""
    out, at = [], start
    k = int(np.searchsorted(marks, start))
    while end - at > MIN:
        k = int(np.searchsorted(marks, at + MIN - 1, side="left"))
        stop = min(int(marks[k]) + 1 if k < len(marks) else end, at + MAX, end)
        out.append(stop)
        at = stop
    if at < end:
        out.append(end)
    return out


def chunk(payload: bytes) -> list[bytes]:
    data = np.frombuffer(payload, np.uint8)
    marks = np.flatnonzero((gear_hash(data) & np.uint32(MASK)) == 0)
    ends = cuts(data, 0, len(data), marks)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def manifest_of(n_bytes: int, chunks: list[tuple[bytes, int]]) -> bytes:
    """chunks: (digest, size), in order."""
    return MAGIC + struct.pack("<QI", n_bytes, len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


def read_manifest(raw: bytes) -> tuple[int, list[tuple[bytes, int]]]:
    if raw[:4] != MAGIC:
        raise ValueError("not a manifest")
    n_bytes, n = struct.unpack_from("<QI", raw, 4)
    return n_bytes, [(raw[16 + 36 * k : 48 + 36 * k], struct.unpack_from("<I", raw, 48 + 36 * k)[0]) for k in range(n)]


_OWN = pa.struct([("at", pa.int32()), ("shared", pa.bool_()), ("data", pa.binary())])
#: Descriptions that are handed on at once.
REBUILT = 256


def _payloads(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("_text"))
    raw = data.tobytes()
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        payload = payload_of(raw[a:b])
        # zero bytes at a text's end are told from padding by the size
        yield b - a, payload, hashlib.sha256(payload).digest() + struct.pack(">Q", b - a)


def _list(batches):
    for part in slices(batches, "_text"):
        sizes, keys, digests = [], [], []
        for n, payload, key in _payloads(part):
            sizes.append(n)
            keys.append(key)
            digests.append([hashlib.sha256(c).digest() for c in chunk(payload)])
        yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_sha"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], names=["_id", "_sha", "n_bytes", "key", "digests"])


def _keep(batches):
    for part in slices(batches, "_text"):
        rows = []
        for (n, payload, key), away, shared in zip(_payloads(part), part.column("_away").to_pylist(), part.column("_shared").to_pylist()):
            away, shared = set(away or ()), set(shared or ())
            if -1 in away:
                continue
            listed = chunk(payload)
            own = [{"at": k, "shared": k in shared, "data": c} for k, c in enumerate(listed) if k not in away]
            rows.append({"key": key, "manifest": manifest_of(n, [(hashlib.sha256(c).digest(), len(c)) for c in listed]), "whole": not away, "any_shared": bool(shared), "own": own})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.binary()), ("manifest", pa.binary()), ("whole", pa.bool_()), ("any_shared", pa.bool_()), ("own", pa.list_(_OWN))]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the chunk store; returns (references, objects, foreign).

    references: _id, n_bytes and the payload's key, a row per document row.
    objects: key, manifest and the chunks that this payload owns, with bytes.
    foreign: (key, at, owner, owner_at) of every chunk owned elsewhere.
    """
    # of a text, as its key is: tells rows with one id apart
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), sha.alias("_sha"))
    kind = source.schema["_id"].dataType.simpleString()
    listed = materialize(source.mapInArrow(_list, f"_id {kind}, _sha binary, n_bytes long, key binary, digests array<binary>"), "media-list")
    references = listed.drop("digests", "_sha")
    # one document stands for each payload
    chosen = listed.groupBy("key").agg(F.min(F.struct(F.col("_id").isNull(), "_id"))["_id"].alias("_id"), F.first("_sha").alias("_sha"), F.first("digests").alias("digests"))
    places = materialize(chosen.select("key", "_id", "_sha", F.posexplode("digests").alias("at", "digest")), "media-places")
    owners = places.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    linked = materialize(places.join(owners, "digest").select("key", "_id", "_sha", "at", F.col("owner.key").alias("owner"), F.col("owner.at").alias("owner_at")), "media-links")
    mine = (F.col("owner") == F.col("key")) & (F.col("owner_at") == F.col("at"))
    foreign = linked.where(~mine).select("key", "at", "owner", "owner_at")
    plan = linked.groupBy("_id", "_sha").agg(F.collect_list(F.when(~mine, F.col("at"))).alias("_away"), F.collect_list(F.when(mine, F.col("at"))).alias("_shared"))
    spare = listed.select("_id", "_sha", "key").join(chosen.select("key", F.col("_id").alias("_first")), "key").where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_sha").distinct()
    plan = materialize(plan.unionByName(spare.select("_id", "_sha", F.array(F.lit(-1)).alias("_away"), F.array().cast("array<int>").alias("_shared"))).groupBy("_id", "_sha").agg(F.flatten(F.collect_list("_away")).alias("_away"), F.flatten(F.collect_list("_shared")).alias("_shared")), "media-plan")
    side = small(plan, F.lit(80) + 4 * (F.size("_away") + F.size("_shared")))
    side = side.withColumnsRenamed({"_id": "_p", "_sha": "_psha"})
    # rows that repeat in id and text are stored once
    todo = one_of_each(source, "_id", "_sha", listed=listed).join(side, F.col("_id").eqNullSafe(F.col("_p")) & (F.col("_sha") == F.col("_psha")), "left").drop("_p", "_sha", "_psha")
    objects = materialize(todo.mapInArrow(_keep, "key binary, manifest binary, whole boolean, any_shared boolean, own array<struct<at:int,shared:boolean,data:binary>>"), "media-store")
    return references, objects, foreign


def feature_of(payload: bytes) -> str:
    """Of the samples: mean, standard deviation, zero share and entropy in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    levels = np.arange(256)
    mean = float((share * levels).sum())
    spread = float(np.sqrt((share * (levels - mean) ** 2).sum()))
    some = share[share > 0]
    return f"mean={mean:.4f};std={spread:.4f};zero={share[0]:.4f};entropy={-float((some * np.log2(some)).sum()):.4f}"


_FEATURES = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rebuild(batches):
    for batch in (b.slice(at, REBUILT) for b in batches for at in range(0, b.num_rows, REBUILT)):
        rows = []
        # one payload at a time
        for key, raw, own, borrowed in (tuple(batch.column(c)[r].as_py() for c in ("key", "manifest", "own", "borrowed")) for r in range(batch.num_rows)):
            n_bytes, listed = read_manifest(raw)
            found = {c["at"]: c["data"] for c in [*own, *(borrowed or ())]}
            for k, (digest, size) in enumerate(listed):
                if len(found[k]) != size or hashlib.sha256(found[k]).digest() != digest:
                    raise ValueError("a chunk doesn't match its digest")
            payload = b"".join(found[k] for k in range(len(listed)))
            if hashlib.sha256(payload).digest() != key[:32]:
                raise ValueError("a payload doesn't match its digest")
            rows.append({
                "key": key, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
                "media_bytes": len(raw) + len(payload), "media_sha256": hashlib.sha256(raw + payload).hexdigest(), "feature": feature_of(payload),
            })
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))


def rebuild(references: DataFrame, objects: DataFrame, foreign: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Put every payload together from the store, verify it, and describe it; a row per document row.

    Only chunks that several payloads share, and the payloads that borrow
    some, are shuffled; the rest is rebuilt where it is read.
    """
    none = F.lit(None).cast("array<struct<at:int,data:binary>>")
    whole = objects.where("whole").select("key", "manifest", F.transform("own", lambda c: F.struct(c["at"].alias("at"), c["data"].alias("data"))).alias("own"), none.alias("borrowed"))
    lent = objects.where("any_shared").select(F.col("key").alias("owner"), F.explode(F.filter("own", lambda c: c["shared"])).alias("c")).select("owner", F.col("c.at").alias("owner_at"), F.col("c.data").alias("data"))
    got = foreign.join(lent, ["owner", "owner_at"]).groupBy("key").agg(F.collect_list(F.struct("at", "data")).alias("borrowed"))
    mixed = objects.where("not whole").select("key", "manifest", F.transform("own", lambda c: F.struct(c["at"].alias("at"), c["data"].alias("data"))).alias("own")).join(got, "key")
    described = whole.mapInArrow(_rebuild, _FEATURES).unionByName(mixed.select("key", "manifest", "own", "borrowed").mapInArrow(_rebuild, _FEATURES)).groupBy("key").agg(*[F.first(c).alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
    # a reference without its payload is an error, not a row less
    there = F.coalesce("payload_bytes", F.raise_error(F.lit("a payload isn't in the store")).cast("long"))
    return references.join(described, "key", "left").withColumn("payload_bytes", there).withColumnRenamed("_id", id_col).drop("key")
