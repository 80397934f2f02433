"""Small-fixture tests of operators 4, 6, 7, 8, 9 and 10 against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from codelode.llm import dac, decontaminate, langid, media, packing, tokens, urlrules, workspace

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


def odd_documents():
    rng = random.Random(5)
    vocabulary = ["alpha", "Béta", "gamma", "naïve", "x1", "Straße", "the", "of"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    texts = [None, "", "   \n\t", "one", "One, one. ONE!", "a\x1cb don't 12.5%", "ß" * 900, long, long, "日本語 テスト", "<|endoftext|> x", "\0\0", "été" * 50]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) + rng.choice([".", "\n", ""]) for _ in range(120)]
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


def brute_contamination(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if size else ():
            patterns.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hit, found = set(), set()
        for size in {len(p) for p in patterns}:
            for k in range(len(w) - size + 1):
                owners = patterns.get(tuple(w[k : k + size]))
                if owners:
                    found |= owners
                    hit.update(range(k, k + size))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14, 30])] + [(9, None), (10, "W1  w2--W3"), (11, "w1 w2 w3")]
    docs = odd_documents() + [(1000 + i, " ".join(rng.choice(vocabulary).upper() for _ in range(rng.randrange(0, 1500))), "en", "s") for i in range(20)]
    docs += [(2000 + i, f"x. {t}! y", "en", "s") for i, (_, t) in enumerate(items)] + docs[:3]
    got = decontaminate.report(decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_bytes=block_bytes)).collect()
    want = brute_contamination([d[:2] for d in docs], items)
    assert len(got) == len(docs)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)


def test_searcher_of_a_large_block_is_small_and_skips():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ka", "to", "mi", "re", "so", "la", "nu", "pe") for b in range(2000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(3000)]
    searcher = decontaminate.Searcher(items)
    n_bytes = sum(len(t) for _, t in items)
    held = sum(a.nbytes for g in searcher.groups for a in (g.first, g.suffix, g.hash, g.shift)) + sum(a.nbytes for a in (searcher.data, searcher.start, searcher.end))
    (group,) = searcher.groups
    assert held < 16 * n_bytes and (group.shift == 0).mean() < 0.1 and len(group.first) == 3000 * 51
    # a window that many items share, and one that differs in a middle word
    shared = " ".join(vocabulary[:10])
    many = decontaminate.Searcher([(str(i), f"{shared} tail{i}") for i in range(300)] + [("odd", " ".join([*vocabulary[:4], "other", *vocabulary[5:10]]))])
    _, hits = many.judge(pa.array([f"before {shared} after", shared.upper().replace(vocabulary[4].upper(), "OTHER"), shared[:-1]]))
    assert hits[0] == ([(1, 11)], {str(i) for i in range(300)}) and hits[1] == ([(0, 10)], {"odd"}) and 2 not in hits


def test_decontamination_keeps_clean_documents_and_columns(spark):
    docs = frame(spark, odd_documents())
    items = frame(spark, [(1, "gamma the of x1 alpha the of gamma x1 of the")], "item_id long, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    flags = {r.doc_id: r.contaminated for r in decontaminate.report(decontaminate.contamination(docs, items)).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, bad in flags.items() if not bad}
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def test_decontamination_with_an_item_without_id(spark):
    items = frame(spark, [(None, "a b c"), ("None", "d e f")], "item_id string, text string")
    for block_bytes in (1 << 20, 1):
        rows = decontaminate.contamination(frame(spark, [(1, "x a b c", "e", "s"), (2, "d e f x", "e", "s"), (3, "x", "e", "s")]), items, block_bytes=block_bytes).collect()
        assert {r.doc_id: (len(r.ranges), r["items"]) for r in rows} == {1: (1, []), 2: (1, ["None"]), 3: (0, [])}
        kept = decontaminate.clean(frame(spark, [(1, "x a b c", "e", "s"), (2, "d e f x", "e", "s"), (3, "x", "e", "s")]), items, block_bytes=block_bytes)
        assert [r.doc_id for r in kept.collect()] == [3]


def test_columns_of_any_name_are_not_read(spark):
    names = ["_id", "_text", "_th", "_sha", "n_words", "items", "key", "n_bytes", "n_tokens", "bucket", "lang_pred", "score", "start", "host", "short"]
    docs = spark.createDataFrame([(k, f"some words of text {k}", "en", *names) for k in range(6)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    items = frame(spark, [(1, "other words", "x")], "item_id long, text string, _id string")
    assert decontaminate.report(decontaminate.contamination(docs, items)).count() == 6
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert packing.pack_documents(docs, TOKENIZER).count() == 6
    assert dac.read_tokens(dac.write_tokens(docs, TOKENIZER)).count() == 6
    model = langid.train(docs)
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"en"} and langid.keep_known(docs, model).columns == docs.columns
    assert media.rebuild(*media.store(docs)).count() == 6
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")
    assert urlrules.judge(pages, urlrules.rules_frame(spark, urlrules.RULES)).count() == 6


def test_url_rules_of_a_long_host(spark):
    url = "http://" + "a." * 50_000 + "example.net/en/" + "x/" * 50_000
    row = urlrules.judge(frame(spark, [(1, url)], "page_id long, url string"), urlrules.rules_frame(spark, urlrules.RULES)).first()
    assert row.rule == "example.net/en/" and row.verdict == "allow"


def test_url_rules(spark):
    urls = ["http://net/", "https://A.NET/x?y", "http://www.example.net/en/1#z", "http://example.net/enx", "http://example.com/de/", "ftp://x.example.com/de/a/b", "http://example.org/fr/", "nourl", None, "", "http://net", "http://notnet.com/", "a://b://net/", "http://.net/", "http://net/" * 2]
    pages = frame(spark, [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = urlrules.judge(pages, urlrules.rules_frame(spark, urlrules.RULES)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = urls[r.page_id] or ""
        m = re.match(r"(?s)(?:.*?)://([^/?#]*)([^?#]*)", url)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h), len(p), h + p, v) for v, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3])
    assert urlrules.judge(pages.limit(0), urlrules.rules_frame(spark, urlrules.RULES)).count() == 0


def test_token_ids_equal_the_library():
    encoder = tokens.ChunkEncoder(TOKENIZER)
    texts = [t for _, t, *_ in odd_documents()] + ["it's 5 o'clock, don't!", "ǅ Σας İstanbul cafe\u0301", "...wow,, ok.", "ªº x² 3½ ǆ.", "a\u0085b"]
    for got, text in zip(encoder.encode(texts), texts):
        assert np.frombuffer(got, np.uint16).tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 32, 900), rng.integers(0, 70_000, 3000), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    codes = dac.Codes(dac.pack(np.array([7]), np.array([len(ids)]), ids))
    assert (codes.access(np.arange(len(ids))) == ids).all()
    some = rng.integers(0, len(ids), 200)
    assert (codes.access(some) == ids[some]).all()
    for start, n in [(0, len(ids)), (1, 1), (511, 3), (513, 900), (len(ids), 0)]:
        assert (codes.range(start, n) == ids[start : start + n]).all()
    assert len(dac.Codes(dac.pack(np.array([], int), np.array([], int), np.array([], np.uint32))).access([])) == 0


def test_token_files_round_trip(spark):
    docs = odd_documents()
    random.Random(1).shuffle(docs)
    plain = tokens.ChunkEncoder(TOKENIZER).tokenizer
    got = {r.doc_id: r for r in dac.read_tokens(dac.write_tokens(frame(spark, docs), TOKENIZER, file_ids=500), with_ids=True).collect()}
    start = 0
    for doc, text, *_ in sorted(docs):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        row = got[doc]
        assert (row.start, row.n_tokens, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert dac.read_tokens(dac.write_tokens(frame(spark, []), TOKENIZER)).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        every = np.repeat(lengths, counts)
        for buckets in (1, 2, 3, 10):
            got = packing.boundaries(lengths, counts, buckets)
            assert len(got) <= buckets
            best = min(packing.padding(every, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
            assert packing.padding(every, got) == best


def test_packing_fills_batches(spark):
    docs = odd_documents() + odd_documents()[:2]
    rows = packing.pack_documents(frame(spark, docs), TOKENIZER, buckets=4, budget=300).collect()
    assert len(rows) == len(docs)
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        room = max(1, 300 // held[0].bucket_len)
        assert sorted(r.slot for r in held) == list(range(len(held)))
        last = max(b for k, b in batches if k == bucket)
        assert len(held) == room or batch == last and len(held) <= room
    assert packing.pack_documents(frame(spark, []), TOKENIZER).count() == 0


def test_packing_is_optimal_beside_one_long_document(spark):
    rng = random.Random(8)
    every = [rng.randrange(1, 400) for _ in range(300)] + [1_000_003]
    rows = packing.pack(spark.createDataFrame(list(enumerate(every)), "doc_id long, n_tokens long"), buckets=8).collect()
    lengths = sorted(set(every))
    best = packing.padding(np.array(every), packing.boundaries(lengths, [every.count(x) for x in lengths], 8))
    assert sum(r.padding for r in rows) == best
    assert {r.bucket_len for r in rows} <= set(lengths)


def brute_grams(text):
    raw = [langid._SYMBOL[b] for b in (text or "").lower().encode()]
    symbols = [int(x) for k, x in enumerate(raw) if x or k == 0 or raw[k - 1]]
    return collections.Counter([(x,) for x in symbols if x] + [tuple(symbols[k : k + n]) for n in (2, 3) for k in range(len(symbols) - n + 1)])


def code_of(gram):
    n = langid._N
    return {1: n**3 + n**2 + gram[0], 2: n**3 + gram[0] * n + gram[-1], 3: (gram[0] * n + gram[len(gram) // 2]) * n + gram[-1]}[len(gram)]


def brute_language(train, text, profile):
    """Out-of-place distances by the definition."""
    counts, total = {}, collections.Counter()
    for t, lang in train:
        counts.setdefault(lang, collections.Counter()).update(brute_grams(t))
    ranked = {x: [g for g, _ in sorted(c.items(), key=lambda y: (-y[1], code_of(y[0])))] for x, c in counts.items()}
    for x, grams in ranked.items():
        total.update({g: counts[x][g] for g in grams[: langid.CANDIDATES]})
    order = {g: k for k, g in enumerate(sorted(total, key=lambda g: (-total[g], code_of(g))))}
    own = sorted(brute_grams(text).items(), key=lambda x: (-x[1], order.get(x[0], len(order) + code_of(x[0]))))[:profile]
    away = {}
    for x in sorted(ranked):
        ranks = {g: k for k, g in enumerate(ranked[x][:profile])}
        away[x] = sum(abs(ranks[g] - k) if g in ranks else profile for k, (g, _) in enumerate(own)) / max(1, len(own))
    best = min(away, key=lambda x: (away[x], x))
    return best, 1 - away[best] / profile


@pytest.mark.parametrize("piece", [64, 512 << 10])
def test_language_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(3)
    letters = {"a": "abcdeé ", "b": "defghß ", "c": "ghijkñ ."}
    train = [("".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 90))), x) for x in "abc" * 12]
    model = langid.train(frame(spark, [(k, t, x, "s") for k, (t, x) in enumerate(train)]), profile=40)
    texts = ["".join(rng.choice("abcdefghijk éßñ.z") for _ in range(rng.randrange(1, 120))) + "q" for _ in range(80)]
    lang, score = langid.Identifier(model).judge(pa.array(texts))
    for text, x, y in zip(texts, lang, score):
        want = brute_language(train, text, 40)
        assert x == want[0] and abs(y - want[1]) < 1e-9


def test_language(spark):
    rng = random.Random(4)
    vocabulary = {"en": "the house and water is where they think of this".split(), "de": "der die und nicht straße schön für einen haus".split(), "fr": "le la où été garçon maison avec pour dans".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(60)), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !! \n", "de", "s"), (903, "the house", None, "s"), (904, "The House " * 9000, "en", "s"), (904, "The House " * 9000, "en", "s")]
    docs = frame(spark, rows)
    model = langid.train(docs.where(~langid.held_out()))
    got = langid.predict(docs, model).select("doc_id", "lang_pred", "score", langid.held_out().alias("held_out")).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == ("und" if r.doc_id in (900, 901, 902) else truth[r.doc_id] or "en")
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_gear_hash_is_rolling():
    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    got = media.gear_hash(data)
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        assert h == got[i]


def test_media_round_trip(spark):
    rng = random.Random(9)
    body = "".join(chr(rng.randrange(97, 123)) for _ in range(60_000))
    docs = odd_documents() + [(500, body, "x", "s"), (501, "shift " + body, "x", "s"), (502, body[:30_000] + "edit" + body[30_000:], "x", "s"), (503, body, "x", "s"), (504, "tail\0\0", "x", "s"), (505, "tail", "x", "s")]
    docs += docs[-3:]
    references, objects, foreign = media.store(frame(spark, docs))
    rows = media.rebuild(references, objects, foreign).collect()
    assert len(rows) == len(docs)
    stored = sum(len(c.data) for r in objects.collect() for c in r.own)
    assert stored < sum(len(media.payload_of((t or "").encode())) for t in {d[1] for d in docs}) - 80_000
    texts = {d[0]: (d[1] or "").encode() for d in docs}
    values = {}
    for r in rows:
        payload = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert values.setdefault(texts[r.doc_id], tuple(r)[1:]) == tuple(r)[1:]
    assert media.rebuild(*media.store(frame(spark, []))).count() == 0


@pytest.mark.parametrize("bound", [-1, 1 << 40])
def test_media_rows_of_one_id(spark, monkeypatch, bound):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", bound)
    rng = random.Random(10)
    body = "".join(chr(rng.randrange(97, 123)) for _ in range(20_000))
    docs = [(7, "A", "x", "s"), (7, "B", "x", "s"), (3, "A", "x", "s"), (None, "A", "x", "s"), (None, "C", "x", "s"), (None, None, "x", "s"), (8, "", "x", "s")]
    docs += [(9, body, "x", "s"), (9, "shift " + body, "x", "s"), (9, body[:9000] + "edit" + body[9000:], "x", "s"), (None, "other " + body, "x", "s"), (None, body, "x", "s")]
    rows = media.rebuild(*media.store(frame(spark, docs))).collect()
    want = [(d, hashlib.sha256(media.payload_of((t or "").encode())).hexdigest()) for d, t, *_ in docs]
    assert sorted(map(repr, ((r.doc_id, r.payload_sha256) for r in rows))) == sorted(map(repr, want))


@pytest.mark.parametrize("bound", [-1, 1 << 40])
def test_media_stores_repeated_rows_once(spark, monkeypatch, bound):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", bound)
    rng = random.Random(11)
    body = "".join(chr(rng.randrange(97, 123)) for _ in range(40_000))
    one = [(1, body, "x", "s"), (2, "ahead " + body, "x", "s"), (3, "alone", "x", "s")]
    stored = lambda docs: sorted((r.key, len(c.data)) for r in media.store(frame(spark, docs))[1].collect() for c in r.own)
    assert stored(one[:2] * 1000 + one[2:]) == stored(one)
    assert media.rebuild(*media.store(frame(spark, one[:2] * 1000 + one[2:]))).count() == 2001


def test_media_cuts_equal_brute_force():
    rng = random.Random(12)
    for n in (1, 64, media.MIN, media.MIN + 1, 5000, 70_000):
        for payload in (bytes(rng.randrange(256) for _ in range(n)), bytes(n), b"ab" * (n // 2)):
            h, ends, last = 0, [], 0
            for i, b in enumerate(payload):
                h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
                size = i + 1 - last
                if (h & media.MASK == 0 and size >= media.MIN) or size == media.MAX or i + 1 == len(payload):
                    ends.append(i + 1)
                    last = i + 1
            assert [len(c) for c in media.chunk(payload)] == [b - a for a, b in zip([0, *ends], ends)]


def test_media_missing_payload_is_an_error(spark):
    references, objects, foreign = media.store(frame(spark, [(1, "A", "x", "s"), (2, "B", "x", "s")]))
    with pytest.raises(Exception, match="isn't in the store"):
        media.rebuild(references, objects.limit(1), foreign).collect()
