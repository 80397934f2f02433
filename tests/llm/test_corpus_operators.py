"""Small-fixture tests of operators 1, 2, 3 and 5 and of the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from codelode.llm import linededup, neardup, pii, toxicity, workspace
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def sentence(rng, n=8):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "büro", "tempor", "magna"]) + str(rng.randrange(100)) for _ in range(n)) + rng.choice([". ", ".\n", "\n", "! "])


# ---- line dedup ------------------------------------------------------------------------------


def line_documents():
    rng = random.Random(11)
    passage = "".join(sentence(rng) for _ in range(14))
    docs = []
    for i in range(25):
        own = [sentence(rng) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), passage)
        docs.append((i, "".join(own), "en", "s"))
    docs += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "one line", "en", "s"), (103, docs[0][1], "en", "s"), (103, docs[0][1], "en", "s"), (104, "A. " * 4000, "en", "s"), (105, passage * 40, "en", "s"), (None, docs[1][1], "en", "s")]
    return docs


def repeated_windows(texts, n=50):
    """(id, place) of every window of n words that stands in a text of a smaller id, or before."""
    seen, out = set(), []
    for doc in sorted(texts):
        words = texts[doc].split()
        for at in range(len(words) - n + 1):
            window = tuple(words[at : at + n])
            out += [(doc, at)] if window in seen else []
            seen.add(window)
    return out


def test_line_dedup_leaves_no_repeat_of_50_words_and_takes_only_repeats(spark):
    docs = line_documents()
    got = linededup.remove_repeats(frame(spark, docs))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_removed"]
    rows = got.collect()
    assert len(rows) == len(docs) and {(r.doc_id, r.text) for r in rows if r.doc_id in (100, 101, 102)} == {(100, None), (101, ""), (102, "one line")}
    left = {r.doc_id: r.text for r in rows if r.doc_id is not None and r.text is not None}
    before = {d: t for d, t, *_ in docs if d is not None and t is not None}
    assert len(repeated_windows(before)) > 500 and not repeated_windows(left)
    # what went stands elsewhere, LEAST words at a time
    for doc, text in before.items():
        words, kept = text.split(), left[doc].split()
        if len(kept) < len(words) and doc < 100:
            others = {tuple(w[i : i + linededup.LEAST]) for d, t in before.items() if d < doc for w in [t.split()] for i in range(len(w) - linededup.LEAST + 1)}
            held = {k for i in range(len(words) - linededup.LEAST + 1) if tuple(words[i : i + linededup.LEAST]) in others for k in range(i, i + linededup.LEAST)}
            assert len(words) - len(kept) <= len(held)
    assert [r.text for r in rows if r.doc_id == 103] == ["", ""]
    assert not repeated_windows({0: docs[1][1], 1: next(r.text for r in rows if r.doc_id is None)})
    assert sum(r.n_removed for r in rows) > 10
    assert linededup.remove_repeats(frame(spark, [])).count() == 0


def test_line_dedup_resists_shifts_and_leaves_unique_texts(spark):
    rng = random.Random(7)
    passage = "".join(sentence(rng) for _ in range(60))
    docs = frame(spark, [(0, "Start. " + passage, "en", "s"), (1, "Some. Other words here. Longer! " + passage + "End.", "en", "s"), (2, "".join(sentence(rng) for _ in range(30)), "en", "s")])
    rows = {r.doc_id: r for r in linededup.remove_repeats(docs).collect()}
    assert rows[0].n_removed == 0 and rows[2].n_removed == 0
    assert rows[1].text == "Some. Other words here. Longer! End."


def test_line_dedup_of_very_often_repeated_rows(spark):
    rng = random.Random(8)
    passage = "".join(sentence(rng) for _ in range(12))
    first, second = "One. " + passage, "Another start. " + passage + "And its end."
    docs = [(1, first, "en", "s"), (2, second, "en", "s")] * 1000 + [(3, "short", "en", "s")]
    rows = linededup.remove_repeats(frame(spark, docs)).collect()
    texts = {i: {r.text for r in rows if r.doc_id == i} for i in (1, 2, 3)}
    assert len(rows) == 2001 and texts[1] == {first} and texts[3] == {"short"}
    assert len(texts[2]) == 1 and len(texts[2].pop().split()) < 20


def test_line_dedup_broadcast_or_not(spark, monkeypatch):
    both = []
    for bound in (0, 1 << 40):
        monkeypatch.setattr(workspace, "BROADCAST_BYTES", bound)
        both.append(sorted(map(repr, linededup.remove_repeats(frame(spark, line_documents())).collect())))
    assert both[0] == both[1]


def passage_documents(passages):
    rng = random.Random(5)

    def own():
        return " ".join(f"u{rng.randrange(10**9)}" + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randrange(5, 90))).strip()

    docs, outer = [], {}
    for passage in passages:
        for k in range(2):
            outer[len(docs)] = (own(), own())
            docs.append((len(docs), f"{outer[len(docs)][0]} {passage} {outer[len(docs)][1]}", "en", "s"))
    return docs, outer


def test_line_dedup_removes_every_passage_of_50_words(spark):
    rng = random.Random(4)

    def words(n):
        return [f"p{rng.randrange(10**9)}" for _ in range(n)]

    passages = [". ".join(" ".join(words(k)) for _ in range(55 // k + 1)) + "." for k in (11, 18, 55) for _ in range(30)] + [" ".join(words(50)) for _ in range(60)]
    # lines of one to three words; a period of few words
    passages += ["\n".join(" ".join(words(k)) for _ in range(60 // k)) for k in (1, 2, 3) for _ in range(8)]
    docs, outer = passage_documents(passages)
    docs += [(9001, " " + docs[0][1], "en", "s"), (9011, "\t  " + docs[0][1].replace(" ", "  ") + " ", "en", "s"), (9002, passages[1].replace(" ", "\n"), "en", "s"), (9003, "a b " * 300, "en", "s"), (9004, "z " + "a b " * 200, "en", "s"), (None, docs[5][1], "en", "s")]
    rows = {r.doc_id: r for r in linededup.remove_repeats(frame(spark, docs)).collect()}
    for k in range(len(passages)):
        assert rows[2 * k].n_removed == 0 and rows[2 * k].text == docs[2 * k][1]
        # the words before, with the white space behind them, and the words behind the passage
        assert rows[2 * k + 1].text == f"{outer[2 * k + 1][0]} {outer[2 * k + 1][1]}"
    assert rows[9002].text == "" and rows[9001].text == " " and rows[9011].text == "\t  " and len(rows[9003].text.split()) < 40 and len(rows[9004].text.split()) < 40 and rows[None].text == ""


def test_line_dedup_with_chunks_of_one_source_in_another_order(spark):
    rng = random.Random(3)
    a, b, c = ([f"w{rng.randrange(10**9)}" for _ in range(60)] for _ in range(3))
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = {r.doc_id: r.text for r in linededup.remove_repeats(frame(spark, [(0, text(a, b, c, b, a), "en", "s"), (1, text(c, a, b, a), "en", "s"), (2, text(b, c), "en", "s")])).collect()}
    assert rows[0] in (text(a, b, c) + " ", text(a, b, c))
    # words beside a seam may stay; no passage does
    assert len(rows[1].split()) < 50 and rows[2] == ""


def test_line_dedup_keeps_columns_of_any_name(spark):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))
    names = ["_id", "_th", "_text", "_row", "_w", "_at", "_pair", "_runs", "_gid", "_pieces", "from", "to", "n_removed", "x.y"]
    docs = spark.createDataFrame([(k, passage, *[f"{n}{k}" for n in names]) for k in range(2)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    rows = linededup.remove_repeats(docs).orderBy("doc_id").collect()
    assert rows[1].asDict() == {"doc_id": 1, "text": "", **{n: f"{n}1" for n in names}, "n_removed": 1}


def test_line_dedup_finds_lines_in_generated_code(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for k, n in ((10**9, 400), (40, 300), (3, 200), (1, 60), (10**9, 33), (10**9, 17), (10**9, 16), (10**9, 3))] + ["", "a\tb\r\n" * 40]
    lines = linededup.with_lines(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), F.col("text"))
    # hashing the words is the one step that interprets an expression for every word
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") == 1
    got = collections.defaultdict(list)
    for r in lines.collect():
        got[r.k].append((r.at, r.mid, r.to, r.pair))
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for t in texts for w in set(t.split())], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = collections.defaultdict(set)
    for k, text in enumerate(texts):
        words = text.split()
        h = [hashes[w] & linededup._HASH for w in words]
        firsts = sorted({min(range(s, s + linededup.REACH), key=lambda i: (h[i], i)) for s in range(len(h) - linededup.REACH + 1)})
        assert sorted(p[:3] for p in got[k]) == list(zip(firsts, firsts[1:], firsts[2:]))
        for at, mid, to, pair in got[k]:
            pairs[pair].add((tuple(words[at:mid]), tuple(words[mid:to])))
    assert len(got[0]) > 20 and len(got[3]) == 43 and all(len(p) == 1 for p in pairs.values())
    assert len(set().union(*pairs.values())) == len(pairs)


# ---- near duplicates -------------------------------------------------------------------------


def weights(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else collections.Counter()


def probability_jaccard(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x[i] / x[d], y[i] / y[d]) for i in x.keys() | y.keys())
    return total


def near_documents():
    rng = random.Random(2)
    docs = []

    def text(n):
        return [f"w{rng.randrange(500)}" for _ in range(n)]

    for _ in range(12):
        base = text(rng.randrange(30, 160))
        docs.append(" ".join(base))
        at = list(base)
        for _ in range(rng.randrange(0, 6)):  # a chain: each is near the one before
            at[rng.randrange(len(at))] = "changed"
            docs.append(" ".join(at))
    hub = text(120)
    for _ in range(40):
        own = list(hub)
        own[rng.randrange(120)] = f"own{rng.randrange(10**6)}"
        own[rng.randrange(120)] = f"own{rng.randrange(10**6)}"
        docs.append(" ".join(own))
    docs += [docs[0], docs[0].upper() + " !", "", "", "?!", "? !", "two words", "Two, words", "a b c d", "rep rep rep " * 40, "rep rep rep " * 41]
    return [(i, t, "en", "s") for i, t in enumerate(docs)] + [(900, None, "en", "s"), (901, None, "en", "s"), (902, " ".join(text(20_000)), "en", "s")]


def brute_classes(docs):
    own = {d: t for d, t, *_ in docs}
    up = {d: d for d in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    shingles = {d: weights(t) for d, t in own.items()}
    for a in own:
        for b in own:
            if a < b and own[a] is not None and own[b] is not None and (own[a] == own[b] or (shingles[a] and len(shingles[a].keys() & shingles[b].keys()) and probability_jaccard(shingles[a], shingles[b]) >= 0.8)):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in own}


def test_similarity_is_exact():
    rng = random.Random(0)
    for _ in range(50):
        a, b = (collections.Counter(rng.choices(range(12), k=rng.randrange(1, 25))) for _ in range(2))
        side = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        assert abs(neardup.similarity(side(a), side(b)) - probability_jaccard(a, b)) < 1e-9


def test_signatures_estimate_the_similarity():
    x = collections.Counter({k: 1 + k % 4 for k in range(60)})
    y = collections.Counter({k: 1 + k % 3 for k in range(15, 75)})
    slots = 20_000
    both = [neardup.signatures(np.zeros(len(c), np.int64), neardup.mix(np.array(list(c), np.uint64)), np.array(list(c.values()), float), 1, slots)[0] for c in (x, y)]
    assert abs((both[0] == both[1]).mean() - probability_jaccard(x, y)) < 0.02


def test_shingles_are_counted():
    texts = ["A b c d e f", "a B, c d e f", "x", None, "", "r r r r r r r"]
    row, element, count = neardup.shingles(pa.array(texts))
    assert list(np.bincount(row, minlength=6)) == [2, 2, 1, 0, 0, 1]
    assert list(element[row == 0]) == list(element[row == 1]) and list(count[row == 5]) == [3]


def test_near_classes_equal_brute_force(spark):
    docs = near_documents()
    rows = neardup.near_classes(frame(spark, docs)).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_near_duplicates_dropped(spark):
    docs = near_documents()
    source = frame(spark, docs + docs[:3] + [(None, docs[0][1], "en", "s")]).withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    kept = neardup.drop_near_duplicates(source)
    assert kept.columns == source.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(brute_classes(docs).values()))
    assert kept.where("doc_id is null").count() == 1
    assert neardup.near_classes(frame(spark, [])).count() == 0


def block_rows(texts, sides=None, classes=None):
    row, element, count = neardup.shingles(pa.array(texts))
    bands = neardup.band_hashes(neardup.signatures(row, element, count.astype(float), len(texts)))
    return [
        {"node": k, "l": classes[k] if classes else k, "side": sides[k] if sides else 0, "band": 7, "bands": [7, *map(int, bands[k][1:])], "elements": element[row == k].tobytes(), "counts": count[row == k].astype(np.uint32).tobytes()}
        for k in range(len(texts))
    ]


def test_blocks_give_the_links_between_classes():
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(60)] + ["rep", "eat"] * 12
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    shingled = [weights(t) for t in texts]
    exact = np.array([[probability_jaccard(x, y) for y in shingled] for x in shingled])
    whole = neardup.Blocks(block_rows(texts), 0.8)
    apart = ~np.eye(60, dtype=bool)
    assert (whole.bound() >= exact - 1e-5)[apart].all() and (whole.bound() < exact + 0.2)[apart].all()

    def classes(n, links):
        label = list(range(n))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return sorted(sorted(k for k in range(n) if label[k] == x) for x in set(label))

    links = whole.links()
    assert len(links) < 60 and classes(60, links) == classes(60, [(a, b) for a in range(60) for b in range(a) if exact[a, b] >= 0.8])
    sides = [k % 2 for k in range(60)]
    links = neardup.Blocks(block_rows(texts, sides), 0.8).links()
    assert classes(60, links) == classes(60, [(a, b) for a in range(0, 60, 2) for b in range(1, 60, 2) if exact[a, b] >= 0.8])
    assert neardup.Blocks(block_rows(texts, classes=[0] * 60), 0.8).links() == []


def test_near_classes_of_a_dense_bucket(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    docs = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(own), "en", "s"))
    # several blocks, so that workers must be told too: a small block means many tasks
    monkeypatch.setattr(neardup, "BLOCK_TEXT", 1 << 15)
    assert {r.doc_id: r.class_id for r in neardup.near_classes(frame(spark, docs)).collect()} == brute_classes(docs)


def test_near_duplicates_keep_columns_of_any_name(spark):
    names = ["_id", "_text", "_n", "node", "key", "band", "l", "v", "a", "b", "count", "x.y"]
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, text, *[f"{n}{k}" for n in names]) for k in (1, 2, 2)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert [r.asDict() for r in neardup.drop_near_duplicates(docs).collect()] == [{"doc_id": 1, "text": text, **{n: f"{n}1" for n in names}}]
    alone = docs.where("doc_id = 2")
    assert neardup.drop_near_duplicates(alone).count() == 1 and neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(50, 60), (60, 70), (70, 50), (30, 55)]
    got = {r.v: r.l for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in [*range(31), 55]) and all(got[k] == 100 for k in range(100, 140)) and got[50] == got[60] == got[70] == 50


# ---- personal data ---------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    def ok(kind, said):
        digits = re.sub("[^0-9]", "", said)
        if kind == "ip":
            return all(int(p) <= 255 for p in said.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(kind, m.group()))


def pii_texts():
    rng = random.Random(8)
    pieces = ["a@b.c", "a@b", "x@y@z.de", "a@b.c_d@e.f", "jane.doe%1@mail-1.example.co.uk", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "1234567890123452", "+1 (319) 555-5132", "+1", "+49 30 1234567", "++44 20 7946 0958.", "(319) 555-5132", 'token = "24be64439e3e49cf46b2"', "call", "💥", "é", " ", ".", "\n", "-", "0", "7"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(250)]
    return [None, "", "1 " * 20_000, "9" * 50_000, "1." * 20_000, "a" * 80_000, "a." * 20_000 + "@b.c", "+" + "1-" * 20_000, "mail me at a@b.c " * 800, *texts, *texts[:3]]


def test_base_spans_equal_python(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(pii_texts())]
    rows = {r.doc_id: r for r in pii.report(pii.find(frame(spark, docs))).collect()}
    assert len(rows) == len(docs)
    for doc, text, *_ in docs:
        spans = base_spans(text)
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        r = rows[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in PATTERNS], (doc, text)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert pii.report(pii.find(frame(spark, []))).count() == 0


def test_weak_supervision_adds_what_labelers_agree_on(spark):
    docs = [(i, f"Please call my phone (319) 555-{1000 + i} today, or mail a{i}@mail.com.", "en", "s") for i in range(60)]
    docs += [(100 + i, f'config: token = "{i:032x}" end', "en", "s") for i in range(60)] + [(300, "nothing here, 12 apples", "en", "s")]
    rows = {r.doc_id: r.spans for r in pii.report(pii.find(frame(spark, docs))).collect()}
    assert "phone:21:35" in rows[0] and "secret:" in rows[100] and rows[300] == ""


def test_em_finds_reliable_labelers():
    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = [(1 if (rng.random() < right) == y else -1) if rng.random() < 0.9 else 0 for right in (0.95, 0.7, 0.85)]
        counts[("phone", *votes, "middle", "plain", "free")] += 1
    model = pii.fit([(*k, n) for k, n in counts.items()])
    told = lambda *votes: model["phone", *votes, "middle", "plain", "free"]
    assert told(1, 1, 1) > 0.9 and told(-1, -1, -1) < 0.1
    assert told(1, -1, 1) > told(-1, 1, -1)


def test_personal_data_of_many_spans(spark):
    # positions are sums over the gaps, whatever their number
    text = "".join(f"mail{k}@host.org or +1 555 010 {1000 + k}; " for k in range(3000))
    row = pii.report(pii.find(frame(spark, [(1, text, "en", "s")]))).first()
    assert (row.n_email, row.n_phone) == (3000, 3000)
    spans = [tuple(x.split(":")) for x in row.spans.split(",")]
    assert all(text[int(a) : int(b)] == f"mail{k}@host.org" for k, (kind, a, b) in enumerate(x for x in spans if x[0] == "email"))
    odd = spark.createDataFrame([(1, "a@b.co", "x", "y")], "doc_id long, text string, _text string, spans string")
    assert pii.report(pii.find(odd)).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


# ---- toxicity --------------------------------------------------------------------------------


def toxic_documents():
    rng = random.Random(6)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    insults = ["blork", "zimpel", "gromwa", "gromwi", "gromwu", "gromwe"]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(insults))
        docs.append((i, " ".join(text) + ".", "en", "s"))
        labels.append((i, int(toxic)))
    docs += [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "clean words " * 30_000, "en", "s"), (0, docs[0][1], "en", "s")]
    return docs, labels + [(1, None)]


def test_toxicity_learns_and_scores(spark):
    docs, labels = toxic_documents()
    source, marks = frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.train(source.where("doc_id % 3 <> 1"), marks)
    rows = toxicity.scored(source, model).collect()
    assert len(rows) == len(docs)
    truth = dict((d, y) for d, y in labels if y is not None)
    held = [r for r in rows if r.doc_id % 3 == 1 and r.doc_id < 900]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert not any(r.predicted for r in rows if r.doc_id >= 2000)
    none = toxicity.scored(source, toxicity.train(source, marks.limit(0))).collect()
    assert {r.score for r in none} == {0.0}


def brute_clause(tokens, insults):
    """What each match weighs, and at which token it is told, by looking at the whole clause."""
    insult = [k for k, t in enumerate(tokens) if t in insults]
    target = [k for k, t in enumerate(tokens) if t in toxicity.TARGET and t not in insults]
    told = []
    for k in insult:
        before = any(0 < k - t <= toxicity.TARGET_REACH for t in target) or insult[0] < k
        rest = min([t for t in target if 0 < t - k <= toxicity.TARGET_REACH] + [i for i in insult if i > k], default=None)
        told += [(k, insults[tokens[k]])] if before else [(k, insults[tokens[k]] * toxicity.ALONE)]
        told += [(rest, insults[tokens[k]] * (1 - toxicity.ALONE))] if not before and rest is not None else []
    for k, t in enumerate(tokens):
        if t in toxicity.THREAT and t not in insults:
            before = any(0 < k - x <= toxicity.TARGET_REACH for x in target)
            after = min((x for x in target if 0 < x - k <= toxicity.TARGET_REACH), default=None)
            told += [(k if before else after, toxicity.THREAT_WEIGHT)] if before or after is not None else []
    total = 0.0
    for k, weight in told:
        weight *= toxicity.NEGATION_LOSS if any(0 < k - x <= toxicity.NEGATION_REACH for x, t in enumerate(tokens) if t in toxicity.NEGATION) else 1
        weight *= toxicity.REPORT_LOSS if sum(t in toxicity.QUOTES for t in tokens[:k]) % 2 or any(t in toxicity.REPORT for t in tokens[:k]) else 1
        total += weight
    return total


def test_grammar_equals_brute_force():
    rng = random.Random(1)
    insults = {"blork": 4.0, "zimpel": 2.5}
    g = toxicity.Grammar(insults, 0.1)
    for _ in range(3000):
        tokens = rng.choices(["blork", "zimpel", "you", "kill", "not", "said", '"', "a", "walk", "tree", "red"], [2, 1, 2, 2, 1, 1, 1, 4, 4, 4, 4], k=rng.randrange(0, 16))
        assert abs(g.clause(tokens) - brute_clause(tokens, insults)) < 1e-9, tokens


def test_toxicity_terms_held_or_passed_on(spark, monkeypatch):
    docs, labels = toxic_documents()
    both = []
    for bound in (10, 1 << 30):
        monkeypatch.setattr(toxicity, "HELD", bound)
        both.append(toxicity.train(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")))
    assert both[0] == both[1] and both[0]["weights"]
    odd = frame(spark, [(1, "blork you", "en", "s")]).withColumnRenamed("lang", "_id").withColumnRenamed("source", "score")
    assert toxicity.scored(odd, both[0]).columns == ["doc_id", "score", "predicted"] and toxicity.scored(odd.limit(0), both[0]).count() == 0


def test_grammar_composes():
    g = toxicity.Grammar({"fool": 4.0, "grom*": 3.0}, 0.1)
    plain, addressed, denied, reported = (g.clause(t.split()) for t in ("the fool walks", "you fool walk", "not fool", "someone said fool"))
    assert addressed > plain > reported > 0 and plain > denied > 0
    assert g.clause("i will kill you".split()) > 0 == g.clause("kill the process".split())
    assert g.clause(['"', "fool", '"', "fool"]) < 2 * 4.0
    assert g.lexicon.insult("gromwald") == 3.0 and g.lexicon.insult("grom") == 0.0
    assert g.score("A fool. You fool!") > g.score("A fool.") > g.score("Nothing.") == g.score(None)


# ---- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    passage = "".join(sentence(rng) for _ in range(30))
    docs = [(i, "".join(sentence(rng) for _ in range(rng.randrange(3, 20))), rng.choice(["en", "de"]), "s", 1) for i in range(60)]
    bench = sentence(rng, 14)
    docs += [(100, docs[0][1], "en", "s", 1), (101, docs[1][1].replace("lorem", "changed", 1), "en", "s", 1), (102, passage, "en", "s", 1), (103, docs[2][1] + passage, "en", "s", 1), (104, docs[3][1] + bench + docs[4][1], "en", "s", 1), (105, "1234 !!", "en", "s", 1), (106, None, "en", "s", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, str(tmp_path))
        if name != "pack":
            assert after.columns == now.columns
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert set(seen["language"]) == {d[0] for d in docs} - {105, 106}
    assert set(seen["line_dedup"]) == set(seen["language"]) and len(seen["line_dedup"][103].text) < len(docs[2][1]) + 0.4 * len(passage)
    near = [(d, r.text, r.lang, r.source) for d, r in seen["line_dedup"].items()]
    assert set(seen["near_dedup"]) == set(brute_classes(near).values())
    assert set(seen["near_dedup"]) - set(seen["decontaminate"]) == {104}
    assert set(seen["pack"]) == set(seen["decontaminate"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["pack"])


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    names = ["n_removed", "_n", "_id", "_row", "_text", "key", "node", "x.y"]
    frame(spark, [(1, "lorem ipsum dolor sit amet")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"wort{k}" for k in range(90))
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(None, text, "en", *names), (1, text, None, *names), (2, "other words here", "en", *names), (2, "other words here", "en", *names), (3, None, "en", *names), (4, "", None, *names)], schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, table, str(tmp_path))
            rows = after.collect()
            assert name == "pack" or after.columns == table.columns and all(r[n] == n for r in rows for n in names)
            assert bool(rows) == (table is docs)
