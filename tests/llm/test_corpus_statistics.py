"""Sharding, phrases and lexical search against brute force, on small odd tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from codelode.llm import collocations, interleave, lexsearch, workspace
from pyspark.sql import functions as F

import __spark_entry__
from tests.parity import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string"
SF = "/root/testdata/sf0.001"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def oddly_named(spark, rows, schema):
    """With columns that clash with those that operators make."""
    return frame(spark, rows, schema).withColumns({c: F.lit("x") for c in ("_m", "_id", "_text", "_lang", "shard", "slot", "rank", "term", "a.b", "n", "phrase", "score", "c0")})


@pytest.mark.parametrize("name", ["op11_interleaved_shards", "op12_collocations", "op13_lexical_search"])
def test_query_equals_its_sql(spark, name):
    assert compare(__spark_entry__.queries()[name](spark, SF), connect(SF), __spark_entry__.oracle_sql()[name]) is None


# ---- interleaved shards ----------------------------------------------------------------------


def shard_documents():
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, "copy", "en", "hot") for i in range(40)] + [(7, "same", "en", "s1")] * 300 + [(None, None, "en", None)] * 50 + [(None, "", None, "")] * 9
    return rows


def test_shards_match_the_mixture(spark):
    rows = shard_documents()
    got = interleave.interleave(oddly_named(spark, rows, SCHEMA), "source", ["doc_id", "text"], shards=7).collect()
    assert len(got) == len(rows) and sorted((r.doc_id is None, r.doc_id, r.text is None, r.text, r.source) for r in got if r.doc_id) == sorted((d is None, d, t is None, t, s) for d, t, _, s in rows if d)
    slots = collections.defaultdict(list)
    mixture = collections.Counter((r.shard, r.source) for r in got)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    whole = collections.Counter(s for *_, s in rows)
    for shard in range(7):
        for source, n in whole.items():
            # its share to one row, and what the strata's rounding moves
            assert abs(mixture[shard, source] - n / 7) <= 1 + len(whole) * n / len(rows)


def test_shards_do_not_depend_on_partitions_or_broadcasts(spark, monkeypatch):
    rows = [r for r in shard_documents() if r[0] is not None]
    docs = frame(spark, rows)
    place = lambda df: sorted(tuple(r) for r in interleave.interleave(df, "source", ["doc_id", "text"], shards=5).select("doc_id", "shard", "slot").collect())
    one = place(docs.repartition(1))
    assert place(docs.repartition(9)) == one
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(interleave, "BUCKETS", 3)
    assert place(docs.repartition(4)) == one


def test_shards_equal_brute_force(spark):
    import hashlib

    rows = [(i, f"t{i}", "en", f"s{i % 4}" if i % 11 else None) for i in range(300)]
    key = lambda d, t, k: hashlib.md5((hashlib.md5(f"{interleave.SEED}:{d}:{t}".encode()).hexdigest() + f":{k}").encode()).hexdigest()
    strata = collections.defaultdict(list)
    for d, t, _, s in rows:
        strata["0" if s is None else "1" + s].append((key(d, t, 0), d))
    order = sorted((((2 * k + 1) / (2 * len(v))), s, d) for s, v in strata.items() for k, (_, d) in enumerate(sorted(v)))
    starts = [i * 300 // 16 for i in range(17)]
    want = {d: (i, p - starts[i]) for p, (_, _, d) in enumerate(order) for i in range(16) if starts[i] <= p < starts[i + 1]}
    got = interleave.interleave(frame(spark, rows), "source", ["doc_id", "text"]).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_shards_of_empty_and_tiny_tables_and_files(spark, tmp_path):
    assert interleave.interleave(frame(spark, []), "source", ["doc_id"]).collect() == []
    few = interleave.interleave(frame(spark, [(1, "a", "en", "s"), (2, "b", "en", None)]), "source", ["doc_id"])
    assert len({r.shard for r in few.collect()}) == 2 and few.columns == ["doc_id", "text", "lang", "source", "shard", "slot"]
    done = interleave.interleave(frame(spark, shard_documents()), "source", ["doc_id", "text"], shards=4)
    interleave.write_shards(done, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(shard_documents()) and sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={k}" for k in range(4)]


def test_sizes(spark):
    got = interleave.sizes(frame(spark, [(1, "né", "en", "s"), (2, None, "en", "s"), (3, "", None, None)])).collect()
    assert [(r.size, r.text_crc32) for r in got] == [(4, zlib.crc32("né".encode())), (1, 0), (1, 0)]


# ---- collocations ----------------------------------------------------------------------------


def brute_collocations(rows, least, most=5, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_UPPER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    often = {p: n for p, n in counts.items() if n >= least}
    out = collections.defaultdict(list)
    for (lang, words), a in often.items():
        inside = any(lang == other and len(w) > len(words) and 100 * n >= 100 * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (other, w), n in often.items())
        if len(words) > 1 and not inside:
            score, _, l, r = min((1000 * a * totals[lang] // (often[lang, words[:k]] * often[lang, words[k:]]), k, often[lang, words[:k]], often[lang, words[k:]]) for k in range(1, len(words)))  # noqa: E741
            out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))  # noqa: E741


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "köln", "new", "york", "a-b", "x'", "é", "'", "~"]
    rows = []
    for i in range(120):
        said = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n ", "; "]) for _ in range(rng.randrange(60)))
        rows.append((i, said, rng.choice(["en", "de", None]), "s"))
    return rows + [(200, None, "en", "s"), (201, "", None, "s"), (202, "... ,, \n", "en", "s"), (203, "the " * 3000, "en", "s"), (204, "new york city " * 50, "fr", "s")] + [(205, "of the new york times, really", "und", "s")] * 40


@pytest.mark.parametrize("slice_bytes", [1, 2000, 8 << 20])
def test_collocations_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    rows = phrase_rows(slice_bytes)
    got = collocations.collocations(oddly_named(spark, rows, SCHEMA), least=12, top=25).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations([(t, la) for _, t, la, _ in rows], 12, top=25) != []


def test_collocations_do_not_depend_on_the_sketch(spark, monkeypatch):
    rows = phrase_rows(5)
    want = brute_collocations([(t, la) for _, t, la, _ in rows], 12)
    monkeypatch.setattr(collocations, "CELLS", 8)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=12).collect()) == want
    monkeypatch.setattr(collocations, "CELLS", 1 << 12)
    monkeypatch.setattr(collocations, "BLOCK", 64)
    monkeypatch.setattr(collocations, "HELD", 20)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(7), least=12).collect()) == want
    assert collocations.collocations(frame(spark, [])).collect() == []


def test_sketch_never_counts_less(spark):
    rows = phrase_rows(9)
    docs = frame(spark, rows).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    bits, totals = collocations.sketch(docs, "text", "lang", 1 << 16, 12, 5)
    assert {r.lang: r.n for r in totals.collect()}["fr"] == 150
    import pyarrow as pa

    said = collocations.Slice(pa.array([t or "" for _, t, _, _ in rows]), pa.array([la or "und" for *_, la, _ in rows]))
    for k, (at, hashed) in enumerate(said.phrases(2), 1):
        seen = collections.Counter(hashed.tolist())
        assert all(bits.passes(np.array([h], np.uint64))[0] for h, n in seen.items() if n >= 12)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**15
    counts = frame(spark, [("en", "a b", 2, big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big)], "lang string, phrase string, k int, f long")
    totals = frame(spark, [("en", 9 * 10**17)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent", lambda *_: (counts, totals))
    (row,) = collocations.collocations(None).collect()
    assert row.score == 1000 * big * 9 * 10**17 // (6 * big * big)


# ---- lexical search --------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [x.translate(_UPPER) for x in TERM.findall(text or "")]


def brute_search(docs, items, top=10):
    held = [(d, collections.Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            found += [(-score, d is None, d or 0)] if score > 0 else []
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def search_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(400)] + ["Straße", "É", "x1"]
    docs = [(i, "- ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))), "en", "s") for i in range(150)]
    docs += [(500, None, "en", "s"), (501, "", "en", "s"), (502, ".,;", "en", "s"), (503, "w1 " * 5000 + "w2", "en", "s"), (None, "w3 w4", "en", "s")] + [(600 + k, "w5 w6 w7", "en", "s") for k in range(30)] + [(700, "w8 w9 Straße", "en", "s")] * 14
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(8))) for k in range(30)] + [(90, None), (91, ""), (92, "nowhere at all"), (93, "w5, W6 w5"), (94, "STRAßE w8"), (95, "w1 w2 w3"), (95, "w1 w2 w3"), (None, "w3 w4 x1")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1, 300, 4 << 20])
@pytest.mark.parametrize("block_bytes", [40, 4 << 20])
def test_search_equals_brute_force(spark, monkeypatch, shard_bytes, block_bytes):
    monkeypatch.setattr(lexsearch, "SHARD_BYTES", shard_bytes)
    docs, items = search_rows(shard_bytes)
    if block_bytes == 40:
        items = items[20:]
    index = lexsearch.build_index(oddly_named(spark, docs, SCHEMA))
    got = lexsearch.search(index, oddly_named(spark, items, "item_id long, text string"), block_bytes=block_bytes if block_bytes > 40 else 200)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search([(d, t) for d, t, *_ in docs], items)


def test_search_of_empty_tables(spark):
    docs, items = search_rows(3)
    none = lexsearch.build_index(frame(spark, []))
    assert lexsearch.search(none, frame(spark, items, "item_id long, text string")).collect() == []
    empty = lexsearch.search(lexsearch.build_index(frame(spark, docs)), frame(spark, [], "item_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_probes_few_documents():
    """Non-essential lists are only probed where the score may still qualify."""
    import pyarrow as pa

    n = 4000
    rng = random.Random(4)
    texts = [" ".join(["common"] + (["rare"] * 3 if i in (7, 900) else []) + [f"x{rng.randrange(50)}" for _ in range(5)]) for i in range(n)]
    made = lexsearch.postings(pa.RecordBatch.from_pydict({"_id": pa.array(range(n), pa.int64()), "_text": pa.array(texts)}))
    vocabulary = pa.array(["common", "rare"])
    shard = lexsearch.Shard({c: made.column(c)[0].values for c in made.schema.names}, vocabulary, np.array([3, 7000], np.int64), n, 6 * n)
    docs, scores = shard.search(np.array([0, 1]), 1, 2)
    assert set(docs.tolist()) == {7, 900}
    least = int(scores.min())
    again, _ = shard.search(np.array([0, 1]), least, 2)
    assert set(again.tolist()) <= {7, 900}
    assert len(shard.search(np.array([0]), least, 2)[0]) == 0
