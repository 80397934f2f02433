"""Golden tests of operators and sources on literal fixtures."""

import json

import pytest
from codelode.functions import globs, text
from codelode.operators import callgraph, edits, packages, quality, refs, rules, search, sessions, tiers, tree
from codelode.plans import upkeep
from codelode.sources import logs, manifests, python_code
from codelode.sources import tree as trees
from codelode.streaming import refresh
from pyspark.sql import functions as F

CALLS = "caller_file string, caller_symbol string, callee_name string, callee_qualifier string, line long"
SYMBOLS = "file string, name string, kind string, start_line long, end_line long, parent string"
IMPORTS = "file string, module string, name string, alias string, line long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\ny\r\nz\n"), ("b", ""), ("c", None), ("d", "\n"), ("e", "one")], "file string, content string")
    assert rows(text.explode_lines(df)) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("d", 1, ""), ("e", 1, "one")]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.rs", "foo.rs", True), ("*.rs", "a/b/foo.rs", True), ("*.rs", "foo.go", False), ("*.test.js", "foo.js", False), ("docs/**", "docs/a/b.md", True), ("docs/", "docs", False), ("docs/", "docs/x", True), ("/a/*.c", "a/b/x.c", False), ("a?[bc].x", "azb.x", True), ("!x", "x", True)],
)
def test_ignore_globs(pattern, path, hit):
    import re

    assert bool(re.search(globs.any_of([pattern]), path)) == hit


def test_ignore_file_order():
    assert globs.ignored("a/x.log", ["*.log", "!a/x.log"]) is False
    assert globs.ignored("b/x.log", ["# c", "", "*.log", "!a/x.log"]) is True
    assert globs.plain_glob("src/*.py") == r"^src/.*\.py$"


def test_only_exclude_and_aliases(spark):
    files = spark.createDataFrame([("foo_test.go",), ("foo.go",), ("a/tests/x.py",)], "path string")
    assert rows(search.only_exclude(files, exclude=["@tests"], languages=["go"])) == [("foo.go",)]
    assert len(rows(search.only_exclude(files, exclude=["@tests"]))) == 2
    assert rows(search.only_exclude(files, only=["*.py"])) == [("a/tests/x.py",)]
    assert rows(search.only_exclude(files, exclude=["@tests"], custom={"tests": []})) == rows(files)
    with pytest.raises(ValueError, match="unknown"):
        search.only_exclude(files, exclude=["@nothing"])
    status = {r.name: r.status for r in search.alias_status(spark, {"tests": [], "docs": ["x"], "mine": ["y"]}).collect()}
    assert (status["tests"], status["docs"], status["mine"], status["build"]) == ("disabled", "overridden", "custom", "builtin")


def test_text_search(spark):
    lines = text.explode_lines(spark.createDataFrame([("t", "  hello world\nfoo bar\nHello again")], "file string, content string"))
    assert rows(search.text_search(lines, "hello")) == [("t", 1, "hello world", 0, 5)]
    assert rows(search.search_total(lines, "hello", ignore_case=True)) == [(2, 1)]
    assert search.text_search(lines, "o", limit=1).count() == 1


def test_enclosing_takes_the_smallest(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 300), ("f", "inner", 100, 200), ("f", "late", 150, 250)], "file string, name string, start_line long, end_line long")
    hits = spark.createDataFrame([("f", 150), ("f", 5), ("f", 999)], "file string, line long")
    assert rows(search.enclosing(hits, spans, ["file", "line"])) == [("f", 150, "late", 150, 250), ("f", 5, "outer", 1, 300), ("f", 999, None, None, None)]


def test_tiers(spark):
    a, b = spark.createDataFrame([(1,)], "x int").where("x > 1"), spark.createDataFrame([(2,)], "x int")
    assert rows(tiers.first_answer(a, b, b)) == [(2, 2)]
    assert rows(tiers.first_answer(a, a)) == []


def test_paths(spark):
    files = spark.createDataFrame([("docs/prior-art.md",), ("src/pkg/cli.py",), ("src/pkg/dwim.py",), ("src/test.py",), ("src/test.rs",)], "path string")
    assert search.resolve_path(files, "prior_art").first().path == "docs/prior-art.md"
    assert search.resolve_path(files, "docs/prior_art.md").first().tier == 2
    assert search.resolve_path(files, "dwm").first().path == "src/pkg/dwim.py"
    assert search.find_by_name(files, "cli.py").count() == 1 and search.find_by_stem(files, "test").count() == 2
    asked = spark.createDataFrame([(f"src/pkg/cli.py{s}Sym",) for s in ("/", "::", "#", ":")] + [("none/x",)], "query string")
    got = {r.query: (r.file, r.symbol_path) for r in search.split_unified(asked, files).collect()}
    assert got.pop("none/x") == (None, None) and set(map(str, got.values())) == {str(("src/pkg/cli.py", ["Sym"]))}
    assert rows(search.find_like(files, "pkg_cli")) == [("src/pkg/cli.py",)] and search.find_like(files, ".py").count() == 3


PYTHON = {
    "src/mylib/exports.py": "class MyClass:\n    def method_a(self):\n        self.method_b()\n    def method_b(self):\n        '''Says b.'''\n    def method_c(self):\n        return self.method_b()\n",
    "src/mylib/other.py": "def OtherThing():\n    pass\n",
    "src/consumer.py": "from mylib.exports import *\nfrom mylib.other import *\nimport os.path as p\n# allow: x\ndef go(a, b):\n    p.join(a, b)\n    return MyClass()\n",
    "src/c.py": "def simple():\n    return 1\ndef with_if(x):\n    if x:\n        return 1\n    else:\n        return 2\ndef with_loop(xs):\n    for x in xs:\n        if x and x:\n            pass\n        elif x:\n            pass\n",
    "src/broken.py": "def (",
}


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame(list(PYTHON.items()), "path string, content string")
    out = python_code.extract(files).cache()
    return {n: python_code.relation(out, n) for n in ("symbols", "calls", "imports", "comments")} | {"files": files}


def test_python_symbols(code):
    found = {r.name: r for r in code["symbols"].collect()}
    assert (found["method_b"].kind, found["method_b"].parent, found["method_b"].docstring) == ("method", "MyClass", "Says b.")
    assert (found["simple"].complexity, found["with_if"].complexity, found["with_loop"].complexity) == (1, 2, 4)
    assert found["go"].signature == "def go(a, b)" and "broken" not in str(found)
    assert [r.text for r in code["comments"].collect()] == ["# allow: x"]


def test_callers_of_methods(code):
    args = (code["calls"], code["symbols"], code["imports"])
    assert {r.caller_symbol for r in callgraph.find_callers(*args, "method_b").collect()} == {"method_a", "method_c"}
    assert callgraph.find_callers(*args, "MyClass.method_b").count() == 2
    assert {r.tier for r in callgraph.find_callers(*args, "METHOD_B").collect()} == {2}
    assert {r.tier for r in callgraph.find_callers(*args, "ethod_").collect()} == {3}
    assert callgraph.find_callees(code["calls"], "src/consumer.py", "go").count() == 2


def test_wildcard_imports(spark, code):
    asked = spark.createDataFrame([("src/consumer.py", n) for n in ("MyClass", "OtherThing", "Unknown", "p")] + [("src/c.py", "x")], "file string, name string")
    got = {r.name: (r.module, r.original, r.tier) for r in callgraph.resolve_imports(asked, code["imports"], code["symbols"], code["files"]).collect()}
    assert got == {"MyClass": ("mylib.exports", "MyClass", 2), "OtherThing": ("mylib.other", "OtherThing", 2), "Unknown": ("mylib.exports", "Unknown", 3), "p": ("os.path", "os.path", 1)}
    assert callgraph.find_importers(code["imports"], "mylib").count() == 2


def test_interface_methods(spark):
    symbols = spark.createDataFrame([("a.ts", "bar", "method", 1, 1, "Impl"), ("a.ts", "other", "method", 2, 2, "Impl")], SYMBOLS)
    implements = spark.createDataFrame([("a.ts", "Impl", "I")], "file string, name string, interface string")
    methods = spark.createDataFrame([("b.ts", "I", "bar")], "file string, type_name string, method_name string")
    assert {r.name: r.is_interface_impl for r in callgraph.mark_interface_methods(symbols, implements, methods).collect()} == {"bar": True, "other": False}


def test_health_and_grades(spark):
    files = spark.createDataFrame([("a.py", "Python", 2500), ("package-lock.json", "JSON", 9000), ("b.py", "Python", 600)], "path string, language string, lines long")
    functions = spark.createDataFrame([(c,) for c in (1, 4, 12, 30)], "complexity int")
    r = quality.health(files, functions).first()
    assert (r.large_files, r.massive, r.risky, r.total_max) == (2, 1, 2, 30)
    assert r.score == pytest.approx(0.3 * 0.5 + 0.3 * 0.3 + 0.4 * 0.4)
    s = quality.metric_stats(functions, "complexity").first()
    assert (s.critical_count, s.high_count, s.score, s.score_strict) == (1, 1, 75.0, 50.0)
    assert quality.metric_stats(functions.limit(0), "complexity").first().score == 100.0


def test_hotspots_clones_types(spark):
    stat = spark.createDataFrame([("a", 3, 1), ("a", 5, 0), ("b", 100, 0)], "path string, added long, deleted long")
    assert [tuple(r) for r in quality.hotspots(stat).collect()] == [("b", 1, 100, 0, 10.0), ("a", 2, 8, 1, 6.0)]
    functions = spark.createDataFrame([("f", "x", 1, 9, "h"), ("g", "y", 1, 9, "h"), ("g", "z", 1, 3, "k"), ("h", "u", 1, 2, "m"), ("h", "v", 1, 2, "m")], "file string, name string, start_line long, line_count long, hash string")
    allowed = spark.createDataFrame([("h", "u"), ("h", "v"), ("f", "x")], "file string, name string")
    groups = quality.clone_groups(functions, allowed)
    assert rows(groups) == [("h", 2, 9, "f", "x")] and rows(quality.clone_totals(groups)) == [(1, 2, 18)]
    fields = [("A", n) for n in "abcd"] + [("B", n) for n in "abcx"] + [("C", n) for n in "xy"] + [("D", "a")]
    got = quality.similar_types(spark.createDataFrame(fields, "type string, name string"), 70)
    assert rows(got) == [("A", "B", 3, 75)]


def test_references(spark):
    lines = text.explode_lines(spark.createDataFrame([("d.md", "See `Known` and `Lost::part`.\n```\n{{example: a#x}}\n```\n{{example: a#x}} {{example: a#y}} `{{example: a#z}}`\n`TODO` `True`")], "file string, content string"))
    known = spark.createDataFrame([("Known",)], "name string")
    assert [r.reference for r in refs.broken_references(refs.doc_references(lines), known).collect()] == ["Lost::part"]
    markers = refs.example_markers(spark.createDataFrame([("a", "// [example: x]")], "file string, text string"))
    assert [r.reference for r in refs.missing_examples(lines, markers).collect()] == ["a#y"]
    docs = spark.createDataFrame([("d.md", 100_000, "<!-- covers: src/*.py, lib/a -->")], "path string, mtime long, content string")
    files = spark.createDataFrame([("src/x.py", 300_000), ("lib/abc", 1), ("other", 9 << 30)], "path string, mtime long")
    assert rows(refs.stale_docs(refs.cover_links(refs.covered(docs), files))) == [("d.md", 1, 2)]


SESSION = [
    {"type": "user", "message": {"role": "user", "content": "hi"}},
    {"type": "assistant", "requestId": "r1", "message": {"content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"a": 1}}], "usage": {"input_tokens": 5, "output_tokens": 1}}},
    {"type": "assistant", "requestId": "r1", "message": {"content": [{"type": "text", "text": "x"}], "usage": {"input_tokens": 5, "output_tokens": 9, "cache_read_input_tokens": 2}}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "No such file", "is_error": True}]}},
    {"type": "summary"},
]


def test_session_logs(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, SESSION)) + "\nnot json\n")
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"type": "x", "payload": p}) for p in [{"type": "user_message", "message": "m"}, {"type": "function_call", "call_id": "c", "name": "sh", "arguments": "{}"}, {"type": "function_call_output", "call_id": "c", "output": "Exit code: 1"}, {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 3, "output_tokens": 4}}}, {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 7, "output_tokens": 8}}}]))
    lines = logs.jsonl(spark, str(tmp_path))
    assert {r.path.rpartition("/")[2]: r.format for r in logs.detect(lines).collect()} == {"s.jsonl": "turns", "p.jsonl": "payload"}
    entries = logs.turn_entries(lines.where("path like '%s.jsonl'"))
    blocks = logs.entry_blocks(entries)
    assert [tuple(r) for r in sessions.tool_stats(blocks).collect()] == [("Bash", 1, 1, 0.0)]
    usage = sessions.usage_by_request(logs.entry_usage(entries))
    assert [tuple(r)[2:] for r in usage.collect()] == [(1, 5, 9, 2, 0)]
    stats = sessions.token_stats(usage).first()
    assert (stats.avg_context, stats.min_context, stats.total_tokens) == (7, 7, 16)
    other = lines.where("path like '%p.jsonl'")
    assert [tuple(r) for r in sessions.tool_stats(logs.payload_blocks(other)).collect()] == [("sh", 1, 1, 0.0)]
    assert [(r.input, r.output) for r in logs.payload_usage(other).collect()] == [(7, 8)]
    errors = blocks.where("is_error").select("path", "line", "text")
    assert [(r.category, r["count"]) for r in sessions.error_patterns(errors).collect()] == [("Other", 1)]


def test_sarif_round_trip(spark):
    rows_in = [("ruff", "E1", "bad", "error", "a.py", 3, 1), ("ruff", "W1", "hm", "warning", "b.py", 1, 2)]
    found = spark.createDataFrame(rows_in, "tool string, rule_id string, message string, severity string, file string, line int, column int")
    report = logs.to_sarif(found)
    back = logs.sarif(report.select(F.col("sarif").alias("value")))
    assert rows(back.select("tool", "rule_id", "message", "severity", "file", "line", "column")) == sorted(rows_in, key=repr)
    given = {"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "R", "helpUri": "u"}]}}, "results": [{"ruleId": "R", "level": "note", "message": {"text": "m"}}]}]}
    r = logs.sarif(spark.createDataFrame([(json.dumps(given),)], "value string")).first()
    assert (r.severity, r.help_url, r.file) == ("info", "u", None)


def test_git_logs(spark):
    lines = spark.createDataFrame([("3\t1\tsrc/a.py",), ("-\t-\tx.png",), ("",)], "value string")
    assert rows(logs.numstat(lines)) == [("src/a.py", 3, 1)]
    record = "h\x1fsubj\x1fOperation: delete\nTarget: a/B\nFiles: x, y\nGit-HEAD: g\x1f2024-01-01"
    r = logs.edit_history(spark.createDataFrame([(record,)], "value string")).first()
    assert (r.operation, r.files, r.message, r.git_head) == ("delete", ["x", "y"], None, "g")


LOCKS = {
    "a/package-lock.json": json.dumps({"name": "my-app", "packages": {"": {"name": "my-app", "version": "1.0.0", "dependencies": {"react": "^18"}}, "node_modules/react": {"version": "18.2.0", "dependencies": {"loose-envify": "^1"}}, "node_modules/loose-envify": {"version": "1.0.0"}, "node_modules/react/node_modules/loose-envify": {"version": "1.4.0"}}}),
    "b/yarn.lock": '# yarn lockfile v1\n\nreact@^18.0.0:\n  version "18.2.0"\n  dependencies:\n    loose-envify "^1.1.0"\n\n"@s/x@^1", "@s/x@^2":\n  version "1.2.0"\n\nloose-envify@^1.1.0:\n  version "1.4.0"\n',
    "c/pnpm-lock.yaml": "lockfileVersion: '9.0'\nsnapshots:\n  react@18.2.0:\n    dependencies:\n      loose-envify: 1.4.0\n  loose-envify@1.4.0:\n    dependencies:\n      js-tokens: 4.0.0\n  '@s/x@1.0.0': {}\n",
    "d/bun.lock": '{"workspaces": {"": {"name": "my-app", "dependencies": {"react": "^18"},},}, "packages": {"react": ["react@18.2.0", "", {"dependencies": {"loose-envify": "^1"}}], "loose-envify": ["loose-envify@1.4.0", "", {}],},}',
    "e/Cargo.lock": '[[package]]\nname = "a"\nversion = "0.1.0"\ndependencies = ["b", "c 2.0.0"]\n[[package]]\nname = "b"\nversion = "1.0.0"\n',
    "f/Gemfile.lock": "GEM\n  specs:\n    rails (7.0)\n      rack (>= 2)\n    rack (2.2)\n\nDEPENDENCIES\n  rails\n",
    "g/go.sum": "x.org/m v1.0.0 h1:a\nx.org/m v1.0.0/go.mod h1:b\n",
    "h/Cargo.lock": "not [ toml",
}


def test_lock_files(spark):
    edges = manifests.read(spark.createDataFrame(list(LOCKS.items()), "path string, content string"))
    got = {(r.project[0], r.parent, r.child, r.child_version) for r in edges.collect()}
    assert {("a", "my-app", "react", "18.2.0"), ("a", "react", "loose-envify", "1.4.0"), ("b", "react", "loose-envify", "1.4.0"), ("c", "react", "loose-envify", "1.4.0"), ("c", "loose-envify", "js-tokens", "4.0.0"), ("d", "my-app", "react", "18.2.0"), ("d", "react", "loose-envify", "1.4.0"), ("e", "a", "b", "1.0.0"), ("e", "a", "c", "2.0.0"), ("f", "rails", "rack", "2.2"), ("f", ".", "rails", "7.0"), ("g", ".", "x.org/m", "v1.0.0")} == got
    assert [manifests.requirement(t) for t in ("requests>=2.0", "pytest ; extra == 'dev'", "numpy")] == [("requests", ">=2.0", False), ("pytest", None, True), ("numpy", None, False)]


def test_dependency_tree_and_paths(spark):
    edges = spark.createDataFrame([("p", "r", "a", 0), ("p", "r", "b", 1), ("p", "a", "c", 2), ("p", "b", "c", 3), ("p", "c", "d", 4), ("p", "d", "a", 5)], "project string, parent string, child string, ordinal long")
    tree_rows = packages.dependency_tree(edges).orderBy("position").collect()
    assert [(r.depth, r.name, r.expanded) for r in tree_rows] == [(0, "r", True), (1, "a", True), (2, "c", True), (3, "d", True), (4, "a", False), (1, "b", True), (2, "c", False)]
    paths = packages.dependency_paths(edges, spark.createDataFrame([("r",)], "name string"), "d")
    assert rows(paths) == [("r > a > c > d", 3), ("r > b > c > d", 3)]


def test_versions(spark):
    held = spark.createDataFrame([(1, "requests", 3, 8, None, None), (2, "old", 3, 10, 3, 11)], "id int, name string, min_major int, min_minor int, max_major int, max_minor int")
    symbols = spark.createDataFrame([(1, "get", 10), (2, "x", 1)], "package_id int, name string, line int")
    assert packages.package_symbols(held, symbols, (3, 10)).count() == 2 and packages.package_symbols(held, symbols, (4, 0)).count() == 1
    df = spark.createDataFrame([("v3.10", "3.9")], "a string, b string").select(packages.version_pair(F.col("a")) > packages.version_pair(F.col("b")), packages.version_numbers(F.col("a")))
    assert tuple(df.first()) == (True, [3, 10])


def test_rules(spark):
    captures = F.create_map(F.lit("f"), F.lit("unwrap"))
    one = spark.range(1)
    assert one.select(rules.predicate("eq?", captures, ["@f", "unwrap"]), rules.predicate("not-match?", captures, ["@f", "^un"]), rules.predicate("any-of?", captures, ["@f", "a", "unwrap"]), rules.predicate("match?", captures, ["@f", "["]), rules.predicate("new?", captures, [])).first()[:] == (True, False, True, True, True)
    need = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    have = need({"rust.edition": "2021", "v": "10"})
    checks = [({"rust.edition": ">=2018"}, False), ({"rust.edition": ">=2024"}, False), ({"missing": "1"}, False), ({"v": ">=9"}, False), ({"v": ">=9"}, True), ({"v": "!9"}, False)]
    assert [one.select(rules.meets(need(r), have, numeric)).first()[0] for r, numeric in checks] == [True, False, False, False, True, True]
    parsed = rules.parse_rule('# ---\n# id = "a/b"\n# severity = "info"\n# allow = ["tests/**"]\n# ---\n(call)\n')
    assert (parsed["id"], parsed["severity"], parsed["pattern"], parsed["enabled"]) == ("a/b", "info", "(call)", True)
    layers = spark.createDataFrame([("a", "builtin", "info", True), ("a", "project", "error", True), ("b", "user", "info", True)], "id string, layer string, severity string, enabled boolean")
    over = spark.createDataFrame([("b", None, False)], "id string, severity string, enabled boolean")
    assert [(r.id, r.severity) for r in rules.effective_rules(layers, over).collect()] == [("a", "error")]
    assert rules.expand_fix("$name($nameArg)", {"name": "f", "nameArg": "x"}) == "f(x)"


def test_edits(spark):
    files = spark.createDataFrame([("a", "def f():\n    x = 1\n    y = 2\n"), ("b", "z\n")], "file string, content string")
    schema = "edit_id int, file string, action string, start_line int, end_line int, content string, position string"
    batch = spark.createDataFrame([(1, "a", "replace", 2, 2, "q = 5", None), (2, "a", "insert", 3, 3, "w\nv", "after"), (3, "b", "delete", 1, 1, None, None)], schema)
    assert rows(edits.apply_batch(files, batch)) == [("a", "def f():\n    q = 5\n    y = 2\n    w\n    v\n"), ("b", "\n")]
    bad = batch.union(spark.createDataFrame([(4, "a", "delete", 1, 2, None, None), (5, "a", "insert", 1, 1, "x", "append"), (6, "c", "delete", 1, 1, None, None), (7, "a", "delete", 3, 9, None, None)], schema))
    assert {r.edit_id: r.reason for r in edits.problems(bad, files).where("reason <> 'overlap'").collect()} == {5: "insert before or after only", 6: "no such file", 7: "no such lines"}
    assert rows(edits.apply_batch(files, bad)) == rows(files)


def test_history(spark):
    schema = "file string, version int, operation string, content string, git_head string"
    log = [("f", k, "edit", c, "g") for k, c in enumerate("abc", 1)]
    once = edits.undo(spark.createDataFrame(log, schema))
    assert rows(once) == [("f", 4, "undo", "b", "g")]
    log += [tuple(once.first())]
    twice = edits.undo(spark.createDataFrame(log, schema))
    assert rows(twice) == [("f", 5, "undo", "a", "g")]
    again = edits.redo(spark.createDataFrame(log, schema))
    assert rows(again) == [("f", 5, "redo", "c", "g")]
    assert edits.redo(spark.createDataFrame(log[:3], schema)).count() == 0
    assert edits.undo(spark.createDataFrame(log, schema), git_head="other").count() == 0
    assert edits.prune(spark.createDataFrame(log, schema), 2).count() == 2 and edits.current(spark.createDataFrame(log, schema)).first().content == "b"


def test_markdown_headings(spark):
    lines = text.explode_lines(spark.createDataFrame([("d", "# Title\n\n## One\n```\n# comment\n```\n## Two\n### Sub\nx")], "file string, content string"))
    got = [tuple(r)[1:] for r in tree.heading_scopes(tree.markdown_headings(lines)).orderBy("line").collect()]
    assert got == [(1, 1, "Title", 9, None), (3, 2, "One", 6, "Title"), (7, 2, "Two", 9, "Title"), (8, 3, "Sub", 9, "Two")]


def test_tree_source_and_index(spark, tmp_path):
    root = tmp_path / "p"
    for name, content in {"a.py": b"x\n", "sub/b.py": b"1\n2\n", "sub/skip.log": b"l", ".gitignore": b"*.log\n", ".git/config": b"c", "bin": b"\xff\xfe"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    found = trees.tree(spark, str(root))
    assert {r.path: r.lines for r in found.collect()} == {"a.py": 1, "sub/b.py": 2, ".gitignore": 1, "bin": 0}
    assert {r.path for r in trees.tree(spark, str(root), hidden=False).collect()} == {"a.py", "sub/b.py", "bin"}
    named = trees.with_language(found, trees.languages(spark))
    assert {r.path: r.language for r in named.collect()}["a.py"] == "Python"
    symbols = python_code.relation(python_code.extract(spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "def g(): pass")], "path string, content string")), "symbols").drop("signature")
    upkeep.write_index({"symbols": symbols}, str(tmp_path / "index"), buckets=4)
    assert upkeep.is_current(spark, str(tmp_path / "index")) and not upkeep.is_current(spark, str(tmp_path / "none"))
    fresh = python_code.relation(python_code.extract(spark.createDataFrame([("a.py", "def h(): pass")], "path string, content string")), "symbols").drop("signature")
    upkeep.refresh(spark, str(tmp_path / "index"), "symbols", fresh, spark.createDataFrame([("a.py",)], "file string"), buckets=4)
    assert {r.name for r in spark.read.parquet(str(tmp_path / "index/symbols")).collect()} == {"g", "h"}
    # the last file of a bucket goes
    upkeep.refresh(spark, str(tmp_path / "index"), "symbols", fresh.limit(0), spark.createDataFrame([("a.py",)], "file string"), buckets=4)
    assert {r.name for r in spark.read.parquet(str(tmp_path / "index/symbols")).collect()} == {"g"}


def test_stream_refresh(spark, tmp_path):
    schema = "path string, mtime long, lines long"
    for k, part in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 5)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = refresh.follow(events, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        query.awaitTermination(60)
    assert rows(refresh.state(spark, str(tmp_path / "out"))) == [("a", 2, 5), ("b", 1, 1)]


HELP = "Usage: tool [OPTIONS] <COMMAND>\n\nCommands:\n  build  Make it\n  help   Print this message\n\nOptions:\n  -v, --verbose        Say more\n      --level <LEVEL>  How much\n  -h, --help           Print help\n"


def test_help_texts(spark):
    from codelode.sources import helptext

    texts = helptext.detect(spark.createDataFrame([("tool", HELP), ("none", "x")], "program string, value string"))
    assert {r.program: r.format for r in texts.collect()} == {"tool": "clap", "none": None}
    assert rows(helptext.options(texts)) == [("tool", "-v", "--verbose", None, "Say more"), ("tool", None, "--level", "<LEVEL>", "How much")]
    assert rows(helptext.commands(texts)) == [("tool", "build", "Make it")]


def test_jq(spark):
    from codelode.functions import jq

    df = spark.createDataFrame([('{"name":"test","count":42,"a":[{"k":"x","n":1},{"k":"y","n":2}]}',)], "j string")
    run = lambda p: [r.value for r in jq.apply(df, "j", p).collect()]
    assert (run(".name"), run(".count"), run(".a[1].n"), run(".a[] | .k")) == (['"test"'], ["42"], ["2"], ['"x"', '"y"'])
    assert run('.a[] | select(.k == "y") | .n') == ["2"] and run('.a[] | select(.k | test("^x")) | .n') == ["1"]
    with pytest.raises(ValueError, match="unsupported"):
        run("map(.x)")


def test_registries(spark):
    from codelode.sources import registries

    one = lambda value: spark.createDataFrame([(value,)], "value string")
    pip = registries.read(one(json.dumps({"info": {"name": "p", "version": "1", "summary": "s", "license": "MIT", "home_page": ""}})), "pip").first()
    assert (pip.name, pip.version, pip.description, pip.homepage, pip.license) == ("p", "1", "s", None, "MIT")
    apt = registries.read(one("Package: a\nVersion: 1\nHomepage: h\n\nPackage: b\nVersion: 2\n"), "apt")
    assert [(r.name, r.version, r.homepage) for r in apt.collect()] == [("a", "1", "h"), ("b", "2", None)]
    pacman = registries.read(one("%NAME%\nx\n\n%VERSION%\n3-1\n\n%DESC%\nd\n"), "pacman").first()
    assert (pacman.name, pacman.version) == ("x", "3-1")
    many = registries.read(one(json.dumps([{"name": "n", "version": "1"}, {"name": "m"}])), "nimble")
    assert [r.name for r in many.collect()] == ["n"]
    assert len(registries.REGISTRIES) >= 55
    cache = spark.createDataFrame([("a", 100, "old"), ("b", 10, "old"), ("c", 10, "old")], "name string, fetched_at long, value string")
    got = registries.fresh_or_stale(cache, spark.createDataFrame([("a", "new"), ("b", "new"), ("d", "new")], "name string, value string"), now=110, ttl=50)
    assert rows(got.select("name", "value")) == [("a", "old"), ("b", "new"), ("c", "old"), ("d", "new")]


def test_context_and_layers(spark):
    from codelode.operators import context

    files = spark.createDataFrame([(".context.md", "root"), ("a/CONTEXT.md", "second"), ("a/.context.md", "first"), ("a/b/x.py", "")], "path string, content string")
    assert rows(context.merged_context(files, files.where("path like '%.py'").select("path"))) == [("a/b/x.py", "root\n\nfirst")]
    assert context.merge_layers({"a": 1, "d": {"x": 1, "y": 2}, "s": {1}}, {"a": None, "d": {"y": 3}, "s": {2}, "l": [1]}) == {"a": 1, "d": {"x": 1, "y": 3}, "s": {1, 2}, "l": [1]}
    types = spark.createDataFrame([("T", "struct T {\n  pub a: u8,\n  b: u8,\n}")], "type string, source string")
    assert rows(context.field_names(types)) == [("T", "a"), ("T", "b")]
    build = spark.createDataFrame([("x/Cargo.toml", '[package]\nname = "my-mod"\n[dependencies]\npyo3 = "1"')], "path string, content string")
    imports = spark.createDataFrame([("u.py", "my_mod.sub", "f", None, 3)], IMPORTS)
    assert rows(context.foreign_references(imports, context.foreign_modules(build))) == [("my_mod", "u.py", 3, "pyo3", "Python")]


def test_python_queries(spark):
    from codelode.sources import python_trace

    source = "def f(x):\n    y = x + g(1)\n    if x:\n        y = 2\n    print(y)\n    breakpoint()\n    return y\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", "def (")], "path string, content string")
    got = python_trace.query(files, '(Call func: (Name) @fn (#any-of? @fn "print" "breakpoint")) @call')
    assert [(r.start_line, r.captures["fn"], r.text) for r in got.orderBy("start_line").collect()] == [(5, "print", "print(y)"), (6, "breakpoint", "breakpoint()")]
    with pytest.raises(NotImplementedError):
        python_trace.query(files, "(x)", "rust")
    trace = python_trace.assignments(files).orderBy("line").collect()
    assert [(r.variable, r.value, r.flows_from, r.terminal, r.calls, r.branch) for r in trace] == [("y", "x + g(1)", ["g", "x"], False, ["g"], None), ("y", "2", [], True, [], "if x")]
    assert [(r.function, r.value) for r in python_trace.returns(files).collect()] == [("f", "y")]
    assert python_trace.nodes(files).where("depth = 0").first().kind == "Module"


def test_python_symbols_in_every_branch():
    source = "try:\n    from x import f\nexcept ImportError:\n    def a(): return g()\nelse:\n    def b(): pass\nfinally:\n    class C:\n        def m(self): pass\nif x:\n    pass\nelif y:\n    def d(): pass\nelse:\n    def e(): pass\nmatch x:\n    case 1:\n        def h(): pass\nfor i in x:\n    pass\nelse:\n    def k(): pass\n"
    rows = list(python_code.rows_of("a.py", source))
    assert [r["name"] for r in rows if r["relation"] == "symbols"] == ["a", "b", "C", "m", "d", "e", "h", "k"]
    assert [(r["caller_symbol"], r["callee_name"]) for r in rows if r["relation"] == "calls"] == [("a", "g")]


def test_index_files_are_read_by_many_tasks(spark, tmp_path):
    from codelode.sources import registries

    stanzas = [f"Package: p{i}\nVersion: {i}.0\nDescription: said {i}\n more of it\nHomepage: h{i}" for i in range(4000)]
    (tmp_path / "Packages").write_text("\n\n".join(stanzas) + "\n")
    packages = [f'<package type="rpm"><name>r{i}</name><version epoch="0" ver="{i}" rel="1"/><summary>s &amp; {i}</summary><url>u{i}</url><format><rpm:license>MIT</rpm:license></format></package>' for i in range(2000)]
    (tmp_path / "primary.xml").write_text('<?xml version="1.0"?>\n<metadata xmlns="c" xmlns:rpm="r">\n' + "\n".join(packages) + "\n</metadata>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        apt = registries.read_index(spark, str(tmp_path / "Packages"), "apt")
        assert apt.rdd.getNumPartitions() > 3
        assert sorted((r.name, r.version, r.description, r.homepage) for r in apt.collect()) == sorted((f"p{i}", f"{i}.0", f"said {i}", f"h{i}") for i in range(4000))
        rpm = registries.read_index(spark, str(tmp_path / "primary.xml"), "dnf")
        assert rpm.rdd.getNumPartitions() > 3
        assert sorted((r.name, r.version, r.description, r.homepage, r.license) for r in rpm.collect()) == sorted((f"r{i}", f"{i}-1", f"s & {i}", f"u{i}", "MIT") for i in range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
