"""What queries shuffle, sort and hold: plans, and rows between steps."""

import re
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from codelode import scratch
from codelode.llm import lexsearch
from codelode.operators import context, edits, graphs, nested, outline, quality, refs, symbol_edits, syntax, tree, treepattern
from codelode.plans import registered_code, registered_more
from pyspark.sql import functions as F


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def places(lines: list[str], word: str) -> list[int]:
    return [k for k, line in enumerate(lines) if re.search(rf"\b{word}[ (]", line)]


def joined(df) -> int:
    """Most rows that came out of a join of a query that ran."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame([("a.rs", "Rust", "fn f() { g(); }\n"), ("b.py", "Python", "from a import b as c\ndef f():\n    g()\n")], "path string, language string, content string")


def test_files_are_shuffled_not_their_tokens(code):
    lines = plan(syntax.tokens(code))
    assert places(lines, "Exchange") and all(k > max(places(lines, "Generate")) for k in places(lines, "Exchange"))


def test_rows_around_points_stay_with_their_group(spark):
    spans = spark.createDataFrame([("a", 1, 9, "f")], "path string, start int, end int, name string")
    points = spark.createDataFrame([("a", 3, "x")], "path string, at int, token string")
    found = nested.around(spans, points).groupBy("path", F.col("around.start")).agg(F.collect_list("token").alias("t"))
    assert len(places(plan(found), "Exchange")) == 1
    assert [(r.path, r.t) for r in found.collect()] == [("a", ["x"])]


def test_receivers_are_not_called(spark):
    go = spark.createDataFrame([("a.go", "Go", "func (t T) M(x int) {\n\tgo(x)\n\tN(x)\n}\n")], "path string, language string, content string")
    found = syntax.tokens(go)
    symbols = syntax.definitions(found)
    assert [(r.name, r.start_line, r.end_line) for r in symbols.collect()] == [("M", 1, 4)]
    assert [(r.caller_symbol, r.callee_name) for r in syntax.calls(found, symbols).collect()] == [("M", "N")]


def test_scopes_of_headings_take_two_sorts(spark):
    heads = spark.createDataFrame([("a", n, k, f"t{n}", 99) for n, k in ((1, 1), (3, 2), (5, 3), (7, 2), (9, 1))], "file string, line long, level int, title string, n_lines long")
    found = tree.heading_scopes(heads)
    assert len(places(plan(found), "Sort")) == 2
    assert [(r.line, r.end_line, r.parent) for r in found.orderBy("line").collect()] == [(1, 8, None), (3, 6, "t1"), (5, 6, "t3"), (7, 8, "t1"), (9, 99, None)]


def test_references_meet_files_not_definitions(spark):
    refs_of = spark.createDataFrame([("a", "T"), ("b", "T")], "file string, identifier string")
    defined = spark.createDataFrame([("b", "T", n) for n in (9, 4, 7)] + [("c", "T", n) for n in (2, None)], "file string, name string, start_line long")
    found = context.type_references(refs_of, defined)
    lines = plan(found)
    assert any(k > min(places(lines, w)[0] for w in ("SortMergeJoin", "BroadcastHashJoin") if places(lines, w)) for k in places(lines, "HashAggregate"))
    assert {(r.file, r.def_file, r.start_line) for r in found.collect()} == {("a", "b", 4), ("b", "b", 4)}


def test_spans_hold_each_name_once(spark, monkeypatch):
    monkeypatch.setattr(registered_more.context, "identifiers", lambda spans: spans)
    for row in registered_more._spans(spark, "/root/testdata/sf0.01").collect():
        names = row.source.split("(1); ")
        assert len(names) == len(set(names))


def test_notes_go_to_the_files(spark):
    notes = spark.createDataFrame([(f"d{n}", n, "h/*" if n % 2 else "h/p1") for n in range(6)], "doc string, doc_mtime long, pattern string")
    files = spark.createDataFrame([(f"h/p{n}", n) for n in range(12)], "path string, mtime long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = refs.cover_links(notes, files)
        assert places(plan(found), "BroadcastHashJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count() == 3 * 12 + 3 * 3


def test_pages_are_shuffled_not_their_nodes(spark):
    pages = spark.createDataFrame([("a", "<ul><li><a>x</a></li></ul>")], "path string, content string")
    lines = plan(treepattern.markup_nodes(pages))
    assert len(places(lines, "Exchange")) == 1


def test_unshown_lines_carry_no_text(spark):
    lines = spark.createDataFrame([("a", 1, "fn f() {"), ("a", 2, "  // " + "x" * 99), ("a", 3, "}")], "file string, line int, text string")
    spans = spark.createDataFrame([("a", "f", "Rust", 1, 3)], "file string, name string, language string, start_line int, end_line int")
    held = outline._spans(lines, spans, outline.is_signature(F.col("text"), F.col("language"))).first()
    assert [x.text for x in held.l] == ["fn f() {", "  ", "}"]


def test_index_rows_are_written_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "SHARD_BYTES", 4 << 10)
    monkeypatch.setattr(lexsearch, "GROUP_BYTES", 64 << 10, raising=False)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.hex(k * 7919 * (F.col("id") + 1)))).alias("text")).coalesce(1)
    index = lexsearch.build_index(docs)
    groups = [g for f in index.inputFiles() for m in [pq.ParquetFile(unquote(urlparse(f).path)).metadata] for g in [m.row_group(k).num_rows for k in range(m.num_row_groups)]]
    assert sum(groups) == index.count() > 100 and max(groups) < 60


def test_types_meet_by_two_names_at_once(spark):
    """One common name makes no candidate where two are needed; neither wide types nor those that need one name are lost."""
    sets = {f"t{k:02d}": {"id", f"a{k}", f"b{k}"} for k in range(40)}
    sets |= {"pair": {"a1", "b1", "x"}, "wide": {f"w{k}" for k in range(60)}, "wider": {f"w{k}" for k in range(50)} | {"a2", "b2", "id"}, "few": {"a3", "b3"}, "one": {"b5"}}
    fields = spark.createDataFrame([(t, n) for t, names in sets.items() for n in sorted(names)] + [("few", None), ("few", "a3"), (None, "a3")], "type string, name string")
    size = {t: len(names) + 2 * (t == "few") for t, names in sets.items()}

    def brute(threshold, least):
        pairs = [(a, b) for a in sets for b in sets if a < b and min(size[a], size[b]) >= least]
        told = [(a, b, len(sets[a] & sets[b]), 100 * len(sets[a] & sets[b]) // min(size[a], size[b])) for a, b in pairs]
        return sorted(r for r in told if r[3] >= threshold and r[2])

    for threshold, least in ((70, 2), (50, 2), (60, 1), (20, 1)):
        assert sorted(map(tuple, quality.similar_types(fields, threshold, least=least).collect())) == brute(threshold, least)
    # any two of these have one name in common at most
    square = quality.similar_types(spark.range(64).selectExpr("id as type", "explode(array(id % 8, 8 + id div 8, 16 + (id + id div 8) % 8)) as name"), 60)
    assert square.collect() == [] and joined(square) == 0


def test_edits_meet_their_file_once(spark):
    """No line is shuffled or sorted by a window; odd batches: lines that aren't there, files without text, without edits, unknown files."""
    files = spark.createDataFrame([("a", "x\n\ny\n\n\nz"), ("b", None), ("c", None), ("d", "k")], "path string, content string")
    asked = [("1", "a", "delete", 3, 3, None), ("2", "a", "after", 6, 6, "n"), ("3", "b", "append", None, None, "t"), ("4", "d", "replace", 8, 9, "u"), ("5", "none", "delete", 1, 1, None), ("6", "d", "before", 1, 1, "v")]
    done = symbol_edits.edit_symbols(files, spark.createDataFrame(asked, "edit_id string, path string, action string, start_line long, end_line long, text string"))
    assert {r.path: r.content for r in done.collect()} == {"a": "x\n\nz\nn\n", "b": "\nt\n", "c": None, "d": "v\n\nk\nu\n"}
    assert not places(plan(done), "Window")


def test_rounds_of_graphs_deal_bounded_rows(spark, monkeypatch):
    """What a task gets is stated by rows, however few partitions the session names; broadcast or dealt, the ways are the same."""
    versions = spark.range(64 * 40).selectExpr("id div 64 as file", "id % 64 + 1 as version", "if(id % 64 = 0, null, (id % 64 + 1) div 2) as parent", "cast(id as string) as content")
    wanted = spark.range(40).selectExpr("id as file", "64 as source", "63 as target")
    monkeypatch.setattr(scratch, "TASK_ROWS", 100, raising=False)
    ways = []
    for most in (300_000, 0):
        monkeypatch.setattr(graphs, "BROADCAST_ROWS", most, raising=False)
        ways.append(edits.goto(versions, wanted))
    told = [sorted(tuple(r) for r in w.where("file = 7").select("step", "version", "operation").collect()) for w in ways]
    assert told[0] == told[1] == [(k, 64 >> k, "undo") for k in range(1, 7)] + [(6 + k, v, "redo") for k, v in enumerate((3, 7, 15, 31, 63), 1)]
    assert all("REPARTITION_BY_NUM" in "".join(plan(w)) for w in ways)


def test_tokens_are_neither_sorted_nor_windowed(spark, code):
    """What a file's tokens say of each other are numbers in its row; imports of Python need nothing else, and symbols and calls sort only what defines, ends or calls."""
    lines = plan(registered_code.python_imports(spark, "/root/testdata/sf0.001"))
    assert not places(lines, "Window") and not places(lines, "Sort")
    lines = plan(syntax.tokens(code))
    assert not places(lines, "Window") and not places(lines, "Sort")
    # filters that ask for tokens stay behind the files' deal, else tokens are made twice
    asked = plan(syntax.imports(syntax.tokens(code)).where("alias is not null"))
    assert all(k < max(places(asked, "Exchange")) for k in places(asked, "ArrowEvalPython"))


def test_numbers_of_tokens_are_those_of_a_loop(spark, monkeypatch):
    """Brackets that don't match, comments and strings over lines, letters beyond ASCII, empty and null files, and few tokens at a time."""
    texts = {"a": ")f(a(b) {\n\t/* x\n{ */ \"y\n\" é é1 ٣ ;\n  }}]\n", "b": "(((\n x", "c": "", "d": None, "e": "\n\n//\n", "f": "// only", "g": "g() { h(); }\n" * 9}
    files = spark.createDataFrame(list(texts.items()), "path string, content string").withColumn("language", F.lit("Java")).coalesce(1)
    monkeypatch.setattr(syntax, "_CHUNK", 7)
    got = {r.path: r.told for r in syntax.tokens(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "kind", "line", "depth", "match", "match_line", F.col("held.token").alias("held"), "next", "first", "indent", F.col("prev.token").alias("before")))).alias("told")).collect()}
    assert set(got) == {"a", "b", "g"}
    for path, told in got.items():
        depth, held = 0, []
        for k, t in enumerate(told):
            opens, closes = t.token in "{([", t.token in "})]"
            depth -= closes
            assert (t.pos, t.depth, t.next, t.before) == (k, depth, told[k + 1].token if k + 1 < len(told) else None, told[k - 1].token if k else None)
            if opens or closes:
                near = [x for x in (told[k + 1 :] if opens else told[:k][::-1]) if x.token in "{([})]" and x.depth == depth][:1]
                assert (t.match, t.match_line) == ((near[0].pos if near else None), (near[0].line if near and opens else None))
            depth += opens
            behind = k and told[k - 1].token == ")" and told[k - 1].match
            assert t.held == (told[behind - 1].token if behind else None)
    assert [(t.token, t.kind, t.line) for t in got["a"]] == [(")", "sign", 1), ("f", "name", 1), ("(", "sign", 1), ("a", "name", 1), ("(", "sign", 1), ("b", "name", 1), (")", "sign", 1), ("{", "sign", 1), ('"y\n"', "string", 3), ("é", "name", 4), ("é1", "name", 4), ("٣", "number", 4), (";", "sign", 4), ("}", "sign", 5), ("}", "sign", 5), ("]", "sign", 5)]
    assert [t.token for t in got["a"] if t.first] == [")", "}"] and [t.indent for t in got["a"] if t.first] == [0, 2]
    assert len(got["g"]) == 81


def test_clones_read_their_stretch_of_a_file(spark):
    """No token is shuffled or sorted; placed files and token rows give the same digests, nested functions, comments and strings included."""
    files = spark.createDataFrame([("a.rs", "Rust", "fn f(x: i32) { // no\n g(1, \"s\"); fn h() { f(2); } }\nfn k(y: i32) { g(3, \"t\"); fn h() { k(4); } }\n"), ("b.rs", "Rust", None)], "path string, language string, content string")
    placed = syntax.placed(files).cache()
    symbols = syntax.definitions(syntax.rows(placed))
    symbols = spark.createDataFrame(symbols.collect(), symbols.schema)
    for told in ({}, {"elide_names": True}, {"elide_literals": True}, {"elide_names": True, "elide_literals": True}):
        found = syntax.clone_hashes(placed, symbols, **told)
        assert not places(plan(found), "Window")
        rows = sorted(map(tuple, found.collect()))
        assert rows == sorted(map(tuple, syntax.clone_hashes(syntax.rows(placed), symbols, **told).collect()))
        hashes = {(r[1], r[2]): r[4] for r in rows}
        assert len(rows) == 4 and (hashes["f", 1] == hashes["k", 3]) == (len(told) == 2)


def test_steps_over_tokens_are_compiled(spark, code):
    """The JVM interprets methods of more than 8,000 bytes, for every token."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    placed = syntax.placed(code)
    placed = spark.createDataFrame(placed.collect(), placed.schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = syntax.definitions(syntax.rows(placed))._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000


def test_calls_meet_no_other_tokens(spark):
    """A definition's own name is told by its tokens, not by joins; shaped functions, receivers and keywords."""
    texts = [("a.go", "Go", "func (t T) M(x int) {\n\tgo(x)\n\tN(x)\n}\n"), ("A.java", "Java", "class A { int f(int x) { g(x); if (x) { h.k(f(x)); } } }"), ("a.js", "JavaScript", "function a(x) { b(c(x)); }\nclass C { m(y) { n(y) } }")]
    found = syntax.tokens(spark.createDataFrame(texts, "path string, language string, content string"))
    symbols = syntax.definitions(found)
    symbols = spark.createDataFrame(symbols.collect(), symbols.schema)
    called = syntax.calls(found, symbols)
    assert not any("Join" in line for line in plan(called))
    assert sorted((r.caller_symbol, r.callee_qualifier or "", r.callee_name) for r in called.collect()) == [("M", "", "N"), ("a", "", "b"), ("a", "", "c"), ("f", "", "f"), ("f", "", "g"), ("f", "h", "k"), ("m", "", "n")]


def test_branches_are_told_without_a_table(spark, code):
    found = syntax.tokens(code)
    symbols = spark.createDataFrame([("a.rs", "f", "function", 0, 8, 1, 1, None)], "path string, name string, kind string, start int, end int, start_line long, end_line long, parent string")
    counted = syntax.complexity(found, symbols)
    assert sum("Join" in line for line in plan(counted)) == 1 and counted.first().complexity == 1
