"""Fuzzy alignment against brute force, bursts in a stream, nearest contexts, ways between versions."""

import itertools
import random

from codelode.operators import edits, fuzzy, rules, search
from codelode.streaming import watch


def brute(text, query):
    said = fuzzy.letters(query)
    starts = [i == 0 or text[i - 1] in fuzzy._SEPARATORS or (text[i].isupper() and text[i - 1].islower()) for i in range(len(text))]
    best = None
    for places in itertools.combinations(range(len(text)), len(said)):
        if any(text[p].lower() != c for p, c in zip(places, said)):
            continue
        score = sum(fuzzy.MATCH + fuzzy.START * starts[p] for p in places)
        for a, b in zip(places, places[1:]):
            score += fuzzy.NEXT if b == a + 1 else -fuzzy.GAP - (b - a - 2)
        best = score if best is None else max(best, score)
    return best


def test_alignment_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcAB/_.") for _ in range(rng.randrange(13))) for _ in range(150)] + ["src/path_resolve.rs", "PathResolve", "p", "", "pr(a)*.b"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "path string")
    for query in ("abc", "b-a", "aa", "a", "pr", "r(*."):
        got = sorted((r.path, r.score) for r in fuzzy.aligned(frame, "path", query).collect())
        assert got == sorted((t, brute(t, query)) for t in texts if brute(t, query) is not None)
    assert fuzzy.ranked(frame, "path", "pr", 2).count() == 2


def test_lookup_falls_back_to_the_best_alignment(spark):
    files = spark.createDataFrame([("src/path_resolve.rs",), ("src/parse.rs",), ("docs/a.md",)], "path string")
    assert [r.path for r in search.resolve_path(files, "pathres").collect()] == ["src/path_resolve.rs"]
    assert {r.tier for r in search.resolve_path(files, "prs").collect()} == {5}


def test_bursts_of_a_stream_are_none_lost(spark, tmp_path):
    rows = [("a.rs", "2024-01-01 00:00:00.0"), ("a.rs", "2024-01-01 00:00:00.4"), ("a.rs", "2024-01-01 00:00:00.8"), ("a.rs", "2024-01-01 00:00:02.0"), ("b.rs", "2024-01-01 00:00:00.1"), ("c.md", "2024-01-01 00:00:00.2"), ("a.rs", "2024-01-01 00:00:02.5")]
    later = [("z.rs", "2024-01-01 00:01:00.0")]
    frame = lambda r: spark.createDataFrame(r, "path string, at string").selectExpr("path", "cast(at as timestamp) as at")
    want = [("a.rs", 2), ("a.rs", 3), ("b.rs", 1)]
    assert sorted((r.path, r.events) for r in watch.runs(frame(rows), ["rs"]).collect()) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(rows[:4]).coalesce(1).write.parquet(source)
    stream = lambda: watch.runs(spark.readStream.schema("path string, at timestamp").parquet(source), ["rs"], late="5 seconds").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination(120)
    stream()
    frame(rows[4:]).coalesce(1).write.mode("append").parquet(source)
    stream()
    frame(later).coalesce(1).write.mode("append").parquet(source)
    stream()
    got = sorted((r.path, r.events) for r in spark.read.parquet(out).collect())
    assert got == want


def test_nearest_contexts(spark):
    files = spark.createDataFrame([("a/b/c.rs",), ("a/d.rs",), ("e.rs",), ("ab/x.rs",)], "path string")
    manifests = spark.createDataFrame([("a", {"edition": "2018"}), ("a/b", {"edition": "2021"})], "folder string, context map<string,string>")
    assert {r.path: r.context for r in rules.nearest_contexts(files, manifests).collect()} == {"a/b/c.rs": {"edition": "2021"}, "a/d.rs": {"edition": "2018"}, "e.rs": {}, "ab/x.rs": {}}


def test_ways_between_versions(spark):
    tree = {1: None, 2: 1, 3: 2, 4: 1, 5: 4, 6: 4}
    versions = spark.createDataFrame([("f", v, p, f"c{v}") for v, p in tree.items()], "file string, version long, parent long, content string")
    way = lambda a, b: [(r.operation, r.version, r.content) for r in edits.goto(versions, spark.createDataFrame([("f", a, b)], "file string, source long, target long")).orderBy("step").collect()]
    assert [(o, v) for o, v, _ in way(3, 5)] == [("undo", 2), ("undo", 1), ("redo", 4), ("redo", 5)]
    assert [(o, v) for o, v, _ in way(5, 6)] == [("undo", 4), ("redo", 6)] and way(3, 3) == [] and [(o, v) for o, v, _ in way(3, 1)] == [("undo", 2), ("undo", 1)] and [(o, v) for o, v, _ in way(1, 3)] == [("redo", 2), ("redo", 3)]


def test_conflicts_by_lines(spark):
    lines = lambda *texts: spark.createDataFrame([("f", k, t) for k, t in enumerate(texts, 1)], "file string, line int, text string")
    got = edits.line_conflicts(lines("a", "b", "c"), lines("x", "b", "d", "n"), lines("y", "z", "d", "m")).collect()
    assert sorted(r.line for r in got) == [1, 4]
