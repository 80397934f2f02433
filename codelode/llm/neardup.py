"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the multiset of its shingles of five words (A-Z lower-cased; a text
of one to four words is one shingle). Each shingle sends the events of a
Poisson process, whose rate is the shingle's count, to random slots of a
signature; a slot keeps the shingle whose event came first. Events later than
the latest slot of a document can't change it, so a shingle stops there (early
termination). Two signatures agree in a slot with the probability Jaccard
similarity of the two texts.

Signatures are cut into bands; documents that share a band's hash are
candidates. A bucket's leader is compared with its members: candidates must
pass an estimate from the signatures, then the exact probability Jaccard
similarity of their shingles. A second round takes another leader in every
bucket that still holds several classes. What is left of such a bucket is dealt
in blocks of bounded size: a task meets two blocks, counts common shingles of
all their texts at once by matrix products (no pair is listed), and gives out
only links between texts that it can't yet tell to be of one class, so fewer
than it has texts. Members of a bucket's largest class are met with the others,
not with each other. So a link between different texts is lost only if banding
misses it (1 - (1 - s^5)^20: 0.04 % at a similarity of 0.8) or if a leader's
estimate falls short of it by SLACK standard errors.

Exact copies (equal SHA-256) are one node from the start.

Edge cases: a null text is its document's own class; empty texts, and texts
without words, are only exact copies of each other; rows that share a document
id are one document (``drop_near_duplicates`` keeps the one whose text is the
least); rows without an id have no class (null) and are kept by
``drop_near_duplicates``; the class is the smallest document id in it; texts
are shingled whole; an empty table has no classes; ``near_classes`` reads the
named columns only, ``drop_near_duplicates`` carries columns of any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codelode.llm.arrowtext import SLICE_BYTES, mix, slices, text_bytes, words
from codelode.llm.workspace import free_name, materialize, small

SHINGLE = 5
SLOTS = 100
ROWS = 5
SIMILARITY = 0.8
#: Rounds of leaders before the rest is compared in blocks.
ROUNDS = 2
#: Standard errors that the estimate may fall short of the similarity.
SLACK = 4.5
#: Bytes of a block of a bucket; a text counts for at least the second number.
BLOCK_BYTES, BLOCK_TEXT = 1 << 20, 1 << 10
#: Shingles that one matrix product takes at once.
COLUMNS = 2048

_HORNER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ELEMENT = np.uint64((1 << 40) - 1)


def shingles(arr: pa.Array, size: int = SHINGLE):
    """(row, element, count), sorted: the distinct shingles of each text; elements are 40-bit hashes."""
    data, offsets = text_bytes(arr)
    hashed, row, _, _ = words(data, offsets)
    n = np.bincount(row, minlength=len(arr))
    begin = np.cumsum(n) - n
    rows, values = [], []
    if len(hashed) >= size:
        value = hashed[: len(hashed) - size + 1].copy()
        for k in range(1, size):
            value = value * _HORNER + hashed[k : len(hashed) - size + 1 + k]
        whole = row[: len(value)] == row[size - 1 :]
        rows.append(row[: len(value)][whole])
        values.append(mix(value[whole]))
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        value = np.full(len(short), k, np.uint64)
        for j in range(k):
            value = value * _HORNER + hashed[begin[short] + j]
        rows.append(short)
        values.append(mix(value))
    rows, values = np.concatenate(rows), np.concatenate(values)
    keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (values & _ELEMENT))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(40)).astype(np.int64), keys & _ELEMENT, count


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: for each row and slot the element whose event comes first; rows without elements keep zeros."""
    times = np.full(n_rows * slots, np.inf)
    chosen = np.zeros(n_rows * slots, np.uint64)
    latest = np.full(n_rows, np.inf)
    t = np.zeros(len(element))
    event = 1
    while len(element):
        draw = mix(element + np.uint64(event * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        live = t < latest[row]
        row, element, weight, t, draw = row[live], element[live], weight[live], t[live], draw[live]
        place = row * slots + (mix(draw ^ _HORNER) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(times, place, t)
        won = times[place] == t
        chosen[place[won]] = element[won]
        held = np.unique(row)
        latest[held] = times.reshape(n_rows, slots)[held].max(1)
        live = t < latest[row]
        row, element, weight, t = row[live], element[live], weight[live], t[live]
        event += 1
    return chosen.reshape(n_rows, slots)


def band_hashes(chosen: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = chosen.shape[1] // rows
    out = np.empty((len(chosen), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(chosen), b + 1, np.uint64)
        for k in range(rows):
            value = mix(value * _HORNER + chosen[:, b * rows + k])
        out[:, b] = value
    return out.view(np.int64)


def _describe(batches):
    for part in slices(batches, "_text"):
        text = part.column("_text")
        data, offsets = text_bytes(text)
        raw = data.tobytes()
        null = text.is_null().to_numpy(zero_copy_only=False)
        row, element, count = shingles(text)
        chosen = signatures(row, element, count.astype(np.float64), len(text))
        distinct = np.bincount(row, minlength=len(text))
        hashes = band_hashes(chosen)
        some = distinct > 0
        yield pa.RecordBatch.from_arrays(
            [
                part.column("_id"),
                pa.array([None if gone else hashlib.sha256(raw[a:b]).digest() for gone, a, b in zip(null, offsets.tolist(), offsets[1:].tolist())], pa.binary()),
                pa.array([s.tobytes() if ok else None for s, ok in zip((chosen & np.uint64(0xFFFF)).astype(np.uint16), some)], pa.binary()),
                pa.array([h if ok else None for h, ok in zip(hashes, some)], pa.list_(pa.int64())),
            ],
            names=["_id", "key", "sig", "bands"],
        )


def _promising(floor: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= floor))

    return run


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets, given as (sorted elements, counts).

    sum over common d of 1 / sum_i max(x_i / x_d, y_i / y_d); the inner sum
    depends on d through (x_d, y_d) alone.
    """
    every = np.union1d(left[0], right[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, left[0])] = left[1]
    y[np.searchsorted(every, right[0])] = right[1]
    both = (x > 0) & (y > 0)
    kinds, n = np.unique(np.stack([x[both], y[both]], 1), axis=0, return_counts=True)
    return float(sum(k / np.maximum(x / p, y / q).sum() for (p, q), k in zip(kinds, n)))


def _set_of(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted elements and their counts; no stored counts: each occurs once."""
    found = np.frombuffer(elements, np.uint64)
    return found, np.frombuffer(counts, np.uint32) if counts else np.ones(len(found), np.uint32)


def _sets(batches):
    """node, elements, counts and bands of texts whose SHA-256 is the node's."""
    for part in slices(batches, "_text"):
        row, element, count = shingles(part.column("_text"))
        stops = np.searchsorted(row, np.arange(part.num_rows + 1))
        spans = [slice(x, y) for x, y in zip(stops, stops[1:])]
        elements = pa.array([element[s].tobytes() for s in spans], pa.binary())
        counts = pa.array([count[s].astype(np.uint32).tobytes() if (count[s] > 1).any() else b"" for s in spans], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("node"), elements, counts, part.column("bands")], names=["node", "elements", "counts", "bands"])


def _verified(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size = sum(np.diff(text_bytes(batch.column(c))[1]) for c in ("elements_a", "elements_b"))
            # pairs of bounded size together
            group = np.cumsum(size) // SLICE_BYTES
            for g in np.unique(group):
                part = batch.filter(pa.array(group == g))
                sides = [[_set_of(e, c) for e, c in zip(part.column(f"elements_{k}").to_pylist(), part.column(f"counts_{k}").to_pylist())] for k in "ab"]
                keep = [_alike(x, y) >= least - 1e-12 for x, y in zip(*sides)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    if x[1].max(initial=1) == 1 and y[1].max(initial=1) == 1:
        common = len(np.intersect1d(x[0], y[0], assume_unique=True))
        return common / max(1, len(x[0]) + len(y[0]) - common)
    return similarity(x, y)


class Blocks:
    """Texts of two blocks (or of one) of a bucket, and their classes so far."""

    def __init__(self, rows: list[dict], least: float):
        self.least = least
        self.nodes, self.sets = [r["node"] for r in rows], [_set_of(r["elements"], r["counts"]) for r in rows]
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        self.own = int(np.flatnonzero(self.bands[0] == rows[0]["band"])[0])
        side = np.array([r["side"] for r in rows])
        self.left = np.flatnonzero(side == 0)
        self.right = np.flatnonzero(side == 1) if side.any() else self.left
        names = {c: k for k, c in enumerate(dict.fromkeys(r["l"] for r in rows))}
        self.label = np.array([names[r["l"]] for r in rows])
        self.total = np.array([c.sum() for _, c in self.sets], np.float64)
        self.plain = np.array([c.max(initial=1) == 1 for _, c in self.sets])

    def _common(self, values: list[np.ndarray]) -> np.ndarray:
        """How many values each text of the left has in common with each of the right."""
        row = np.repeat(np.arange(len(values)), [len(v) for v in values])
        _, column, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        out = np.zeros((len(self.left), len(self.right)), np.float32)
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
            held = np.zeros((len(values), COLUMNS), np.float32)
            held[row[lo:hi], column[lo:hi] - begin] = 1
            out += held[self.left] @ held[self.right].T
        return out

    def bound(self) -> np.ndarray:
        """Upper bound of the similarity, which is the similarity where no shingle repeats.

        Common shingles that occur once in both texts add 1 / sum of maxima
        each; any other adds at most its lesser count by the lesser total.
        """
        ones = self._common([e[c == 1] for e, c in self.sets])
        if self.plain.all():
            least = ones
        else:
            layers = [mix(np.repeat(e, c) ^ mix(np.arange(c.sum(), dtype=np.uint64) - np.repeat(np.cumsum(c, dtype=np.uint64) - c, c))) for e, c in self.sets]
            least = self._common(layers)
        x, y = self.total[self.left][:, None], self.total[self.right][None, :]
        return ones / np.maximum(x + y - least, 1) + (least - ones) / np.maximum(np.minimum(x, y), 1)

    def links(self) -> list[tuple]:
        """Links that join classes."""
        likely = self.bound() >= self.least - 1e-6
        for k in range(self.own):  # met there
            likely &= self.bands[self.left, k][:, None] != self.bands[self.right, k][None, :]
        out = []
        for i in np.flatnonzero(likely.any(1)):
            a = self.left[i]
            others = self.right[likely[i]]
            for b in others[self.label[others] != self.label[a]]:
                if self.label[a] != self.label[b] and _alike(self.sets[a], self.sets[b]) >= self.least - 1e-12:
                    self.label[self.label == self.label[b]] = self.label[a]
                    out.append((self.nodes[a], self.nodes[b]))
        return out


def _met(least: float, schema: pa.Schema):
    def run(batches):
        key, rows = None, []

        def told():
            lonely = key[1] != key[2] and len({r["side"] for r in rows}) == 1
            links = Blocks(rows, least).links() if len({r["l"] for r in rows}) > 1 and not lonely else []
            return [pa.RecordBatch.from_pylist([{"a": min(x), "b": max(x)} for x in links], schema=schema)] if links else []

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["band"], row["i"], row["j"])
                if now != key:
                    if rows:
                        yield from told()
                    key, rows = now, []
                rows.append(row)
        if rows:
            yield from told()

    return run


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(v, l): the smallest node of each node's connected component, for nodes with an edge (columns a, b).

    Labels spread to neighbours and jump to their label's label each step;
    every step is written to shared storage.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), f"{label}-edges")
    now = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), label)
    while True:
        # few labels are sent round, many are shuffled
        known = small(now, F.lit(32))
        heard = both.join(known.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        spread = heard.join(known, "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jumped = spread.join(known.select(F.col("v").alias("l"), F.col("l").alias("further")), "l").select("v", "was", F.least("l", "further").alias("l"))
        after = materialize(jumped, label)
        if after.where("l <> was").limit(1).count() == 0:
            return after.select("v", "l")
        now = after.select("v", "l")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: its id, class_id (the smallest id of its class) and kept (whether it is that one)."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    described = materialize(source.mapInArrow(_describe, f"_id {kind}, key binary, sig binary, bands array<bigint>"), "near-described")
    nodes = materialize(described.where("key is not null and _id is not null").groupBy("key").agg(F.min("_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "near-nodes")
    entries = nodes.select("node", "key", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("key").alias("_a"), F.max("key").alias("_b"), F.min("node").alias("leader")).where("_a <> _b").select("band", "leader")
    members = materialize(entries.select("node", "band").join(shared, "band"), "near-members")
    sigs = nodes.select("node", "sig")
    sets = _fetched(source, nodes, members, kind)
    floor = least - SLACK * (least * (1 - least) / SLOTS) ** 0.5
    pair = f"a {kind}, b {kind}"

    def linked(pairs: DataFrame) -> DataFrame:
        signed = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        likely = signed.mapInArrow(_promising(floor), pair)
        held = sets.select("node", "elements", "counts")
        # a leader may meet very many: a skewed join that Spark can split
        told = likely.join(held.toDF("b", "elements_b", "counts_b"), "b").join(held.toDF("a", "elements_a", "counts_a"), "a")
        return materialize(told.select("a", "b", "elements_a", "counts_a", "elements_b", "counts_b").mapInArrow(_verified(least), pair), "near-edges")

    def pairs_of(left: str, right: str):
        return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")

    def named() -> DataFrame:
        return members.select("band", "node").join(small(labels, F.lit(32)), F.col("node") == F.col("v"), "left").select("band", "node", F.coalesce("l", "node").alias("l"))

    tested = pairs = materialize(members.where("node <> leader").select(*pairs_of("leader", "node")).distinct(), "near-pairs")
    labels = _joined(None, linked(pairs))
    for turn in range(1, rounds):
        # buckets that still hold several classes, and untold pairs
        head = F.min_by(F.struct("node", "l"), F.xxhash64("node", F.lit(turn))).alias("head")
        held = materialize(named(), "near-named")
        open_bands = held.groupBy("band").agg(F.min("l").alias("_a"), F.max("l").alias("_b"), F.count("*").alias("_n"), head).where("_a <> _b and _n > 2").select("band", "head")
        fresh = held.join(open_bands, "band").where(F.col("l") != F.col("head.l")).select(*pairs_of("head.node", "node"))
        pairs = materialize(fresh.distinct().join(small(tested, F.lit(32)), ["a", "b"], "left_anti"), "near-pairs")
        tested = tested.unionByName(pairs)
        if pairs.limit(1).count():
            labels = _joined(labels, linked(pairs))
    dealt = _dealt(materialize(named(), "near-named"), sets)
    if dealt is not None:
        labels = _joined(labels, materialize(dealt.mapInArrow(_met(least, to_arrow_schema(members.selectExpr("node as a", "node as b").schema)), pair), "near-edges"))
    classes = described.select("_id", "key").join(nodes.select("key", "node"), "key", "left").join(small(labels, F.lit(32)), F.col("node") == F.col("v"), "left")
    class_id = F.when(F.col("_id").isNotNull(), F.coalesce("l", "node", "_id"))
    return classes.select(F.col("_id").alias(id_col), class_id.alias("class_id"), F.coalesce(F.col("_id") == class_id, F.lit(True)).alias("kept"))


def _fetched(source: DataFrame, nodes: DataFrame, members: DataFrame, kind: str) -> DataFrame:
    """node, elements, counts, bands of the nodes that share a bucket."""
    wanted = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.lower(F.hex("key")).alias("_sha"), "bands"), "near-wanted")
    same = (F.col("_id") == F.col("node")) & (F.sha2(F.col("_text").cast("binary"), 256) == F.col("_sha"))
    texts = source.where("_text is not null").join(small(wanted, F.lit(300)), same).select("node", "_text", "bands")
    out = materialize(texts.mapInArrow(_sets, f"node {kind}, elements binary, counts binary, bands array<bigint>"), "near-sets")
    # rows that repeat an id and its text
    return materialize(out.dropDuplicates(["node"]), "near-sets") if out.groupBy("node").count().where("count > 1").limit(1).count() else out


def _dealt(named: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Rows of open buckets, dealt to tasks (band, i, j) that meet blocks i and j, by task; None if there are none."""
    by_class = named.groupBy("band", "l").agg(F.count("*").alias("n"))
    heads = by_class.groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max_by("l", F.struct("n", "l")).alias("head")).where("classes > 1 and n > 2")
    size = F.greatest(F.length("elements") + F.length("counts"), F.lit(BLOCK_TEXT)).alias("size")
    rows = named.join(small(heads.select("band", "head"), F.lit(32)), "band").join(sets.select("node", size), "node").select("band", "node", "l", "size", (F.col("l") == F.col("head")).alias("main"))
    rows = materialize(rows, "near-open")
    if rows.limit(1).count() == 0:
        return None
    blocks = lambda main: F.ceil(F.sum(F.when(F.col("main") == main, F.col("size")).otherwise(0)) / BLOCK_BYTES).cast("int")
    numbers = rows.groupBy("band").agg(F.greatest(blocks(True), F.lit(1)).alias("mains"), F.greatest(blocks(False), F.lit(1)).alias("others"))
    # blocks of the largest class are numbered before the others
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    own = F.when(F.col("main"), spread(F.col("mains"))).otherwise(F.col("mains") + spread(F.col("others")))
    rows = rows.join(small(materialize(numbers, "near-blocks"), F.lit(32)), "band").withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1)
    partners = F.filter(every, lambda k: ~F.col("main") | (k >= F.col("mains")))
    tasks = rows.select("band", "node", "l", "own", F.explode(partners).alias("_k"))
    tasks = tasks.select("band", "node", "l", F.least("own", "_k").alias("i"), F.greatest("own", "_k").alias("j"), (F.col("own") > F.col("_k")).cast("int").alias("side"))
    return tasks.join(sets, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side", "node")


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after further edges: components of the graph whose nodes are the classes so far."""
    if labels is None:
        return components(edges)
    lifted = edges.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    lifted = lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    merged = components(lifted)
    moved = labels.join(merged.toDF("l", "to"), "l", "left").select("v", F.coalesce("to", "l").alias("l"))
    added = merged.join(labels.select("v"), "v", "left_anti")
    return materialize(moved.unionByName(added), "near-labels")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Documents that stand for their class, one row each; all columns stay."""
    classes = materialize(near_classes(docs, id_col, text_col, least), "near-classes")
    name = free_name(docs)
    dropped = classes.where("not kept").select(F.col(id_col).alias(name)).distinct()
    left = docs.join(small(dropped, F.lit(16)), F.col(id_col) == F.col(name), "left_anti")
    repeated = classes.where("kept").where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name)).count().where("count > 1").select(name)
    if repeated.limit(1).count() == 0:
        return left
    side = small(repeated, F.lit(16))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = left.join(side, F.col(id_col) == F.col(name), "left_semi").groupBy(F.col(id_col)).agg(F.min_by(row, F.coalesce(F.col(text_col), F.lit(""))).alias(name))
    return left.join(side, F.col(id_col) == F.col(name), "left_anti").unionByName(several.select(f"{name}.*"))
