import pytest
from codelode.operators import symbol_edits as E
from codelode.operators import views

CODE = "import os\n\n\nclass A:\n    x = 1\n\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\n\ndef h():\n    pass\n"


@pytest.fixture(scope="module")
def edited(spark):
    """Contents after one edit each, all in one batch: (name, path, content, action, first, last, text)."""
    asked: list[tuple] = []

    def run():
        files = spark.createDataFrame([(f"{i}{p}", c) for i, (p, c, *_) in enumerate(asked)], "path string, content string")
        edits = spark.createDataFrame([(str(i), f"{i}{p}", a, b, e, t) for i, (p, _, a, b, e, t) in enumerate(asked)], "edit_id string, path string, action string, start_line long, end_line long, text string")
        got = {r.path: r.content for r in E.edit_symbols(files, edits).collect()}
        return [got[f"{i}{p}"] for i, (p, *_) in enumerate(asked)]

    return asked, run


def test_edits_of_symbols(edited):
    asked, run = edited
    want = []

    def case(content, action, first, last, text, result, path=".py"):
        asked.append((path, content, action, first, last, text))
        want.append(result)

    case("a\nb\nc", "delete", 2, 2, None, "a\nc")
    # behind a blank line all that are empty go; else none
    case("a\n\nf\n\n\nb\n", "delete", 3, 3, None, "a\n\nb\n")
    case("a\n\nf\n\n\n\nb", "delete", 3, 3, None, "a\n\nb")
    case("a\nf\n\n\nb\n", "delete", 2, 2, None, "a\n\n\nb\n")
    case("\nf\n\nb\n", "delete", 2, 2, None, "\n\nb\n")
    case("a\n\nf\n\n\n", "delete", 3, 3, None, "a\n\n")
    case("f", "delete", 1, 1, None, "")
    case(CODE, "delete", 7, 8, None, CODE.replace("    def f(self):\n        return 1\n\n", ""))
    case(CODE, "replace", 7, 8, "def z():\n\n    pass\n", CODE.replace("    def f(self):\n        return 1\n", "    def z():\n\n        pass\n"))
    case("x", "replace", 1, 1, "y", "y\n")
    case(CODE, "before", 7, 8, "def e(): ...", CODE.replace("    def f", "    def e(): ...\n\n    def f"))
    case(CODE, "before", 14, 15, "def e(): ...", CODE.replace("def h", "def e(): ...\n\n\ndef h"))
    case("a\nb\n", "before", 2, 2, "n", "a\nn\n\nb\n")
    case(CODE, "after", 7, 8, "y = 2", CODE.replace("    def g", "    y = 2\n\n    def g"))
    case(CODE, "after", 14, 15, "n", CODE + "\nn\n")
    case("a\n\n\nb", "after", 1, 1, "n", "a\n\n\nn\n\n\nb")
    case("a", "after", 1, 1, "n", "a\nn\n")
    case("a\nb", "after", 1, 1, "n", "a\n\nn\n\nb")
    case("a", "prepend", None, None, "b", "b\na")
    case("a", "append", None, None, "b\n", "a\nb\n")
    case("", "append", None, None, "b", "\nb\n")
    case("", "prepend", None, None, "b", "b\n")
    case(CODE, "prepend", 4, 11, "y = 0", CODE.replace("    x = 1", "    y = 0\n\n    x = 1"))
    case(CODE, "append", 4, 11, "def k(self): ...", CODE.replace("return 2\n", "return 2\n\n    def k(self): ...\n"))
    case('class D:\n    """Doc\n    more"""\n    x = 1\n', "prepend", 1, 4, "y", 'class D:\n    """Doc\n    more"""\n    y\n\n    x = 1\n')
    case('class D:\n    """Doc"""\n', "prepend", 1, 2, "y", 'class D:\n    """Doc"""\n    y\n')
    case("class D:\n    pass\n", "append", 1, 2, "y", "class D:\n    pass\n    y\n")
    case("impl A {\n}\n", "prepend", 1, 2, "fn f() {}", "impl A {\n    fn f() {}\n}\n", ".rs")
    case("impl A {\n    x;\n\n\n}", "append", 1, 5, "y;", "impl A {\n    x;\n\n    y;\n}", ".rs")
    case("impl A {\n}", "append", 1, 2, "y;", "impl A {\n    y;\n}", ".rs")
    assert run() == want


def test_batches_globs_and_overlaps(spark):
    files = spark.createDataFrame([("a.py", CODE), ("b.py", "b\n")], "path string, content string")
    symbols = spark.createDataFrame([("a.py", "A", None, 4, 11), ("a.py", "f", "A", 7, 8), ("a.py", "g", "A", 10, 11), ("a.py", "h", None, 14, 15)], "file string, name string, parent string, start_line long, end_line long")
    made = lambda requests: {r.path: r.content for r in E.edit_symbols(files, E.glob_edits(symbols, requests)).collect()}
    assert made([("A/*", "delete", None)]) == {"a.py": "import os\n\n\nclass A:\n    x = 1\n\ndef h():\n    pass\n", "b.py": "b\n"}
    both = made([("A/g", "replace", "def g(self): ..."), ("h", "before", "i = 1")])["a.py"]
    assert both == CODE.replace("    def g(self):\n        return 2\n", "    def g(self): ...\n").replace("def h", "i = 1\n\n\ndef h")
    # a class and its method overlap: nothing is done
    assert made([("A*", "delete", None)])["a.py"] == CODE
    with pytest.raises(Exception, match="unknown action"):
        made([("h", "explode", None)])


def test_moves_copies_swaps(spark):
    def done(action, span, target, place, content=CODE):
        files = spark.createDataFrame([("a.py", content)], "path string, content string")
        wanted = spark.createDataFrame([("1", "a.py", action, *span, *target, place)], "edit_id string, path string, action string, start_line long, end_line long, to_start long, to_end long, place string")
        return E.edit_symbols(files, E.moves(files, wanted)).first().content

    assert done("swap", (1, 1), (3, 4), None, "a\nb\nc\nd\n") == "c\nd\nb\na\n"
    moved = done("move", (14, 15), (7, 8), "before")
    assert "    def h():\n        pass\n\n    def f" in moved and moved.count("def h") == 1
    back = done("move", (7, 8), (10, 11), "after")
    assert back.index("def g") < back.index("def f") and back.count("def f") == 1
    copied = done("copy", (14, 15), (4, 11), "append")
    assert copied.count("def h") == 2 and "        return 2\n\n    def h():\n        pass\n" in copied



def test_edits_of_files(spark):
    files = spark.createDataFrame([("a.py", CODE), ("b.py", ""), ("c.py", None)], "path string, content string")
    edits = spark.createDataFrame([("a.py", "delete", 14, 15, None), ("a.py", "replace", 5, 5, "x = 2"), ("a.py", "append", None, None, "end"), ("b.py", "prepend", None, None, "top")], "path string, action string, start_line long, end_line long, text string")
    got = {r.path: r.content for r in E.edit_symbols(files, edits).collect()}
    assert got["b.py"] == "top\n" and got["c.py"] is None and "x = 2" in got["a.py"] and "def h" not in got["a.py"] and got["a.py"].endswith("end\n")


def test_targets_and_sigils():
    assert views.split_target("a/b.py#f") == ("a/b.py", "f") and views.split_target("b.py::f") == ("b.py", "f") and views.split_target("b.py:f") == ("b.py", "f") and views.split_target("f") == (None, "f")
    aliases = {"todo": ["TODO.md"], "config": ["a.toml", "b.toml"]}
    assert views.expand_sigil("@todo", aliases) == [("TODO.md", "")] and views.expand_sigil("@config/x/y", aliases) == [("a.toml", "x/y"), ("b.toml", "x/y")]
    assert views.expand_sigil("@todo::S", aliases) == views.expand_sigil("@todo#S", aliases) == [("TODO.md", "S")]
    assert views.expand_sigil("todo", aliases) is None and views.expand_sigil("@none", aliases) is None


def test_symbol_views(spark):
    symbols = spark.createDataFrame([("a", "Parser", "class", 1, 9, None), ("a", "parse_all", "method", 2, 4, "Parser"), ("b", "push", "function", 1, 2, None)], "file string, name string, kind string, start_line long, end_line long, parent string")
    assert [r.name for r in views.fuzzy_symbols(symbols, "pa").collect()] == ["Parser", "parse_all"]
    assert [r.name for r in views.fuzzy_symbols(symbols, "psl").collect()] == ["parse_all"]
    calls = spark.createDataFrame([("a", "push"), ("b", "push"), ("a", "none")], "file string, name string")
    signed = symbols.selectExpr("file", "name", "start_line", "concat(name, '()') as signature")
    assert {(r.file, r.name): r.signature for r in views.signatures_of(calls, signed).collect()} == {("a", "push"): "push()", ("b", "push"): "push()", ("a", "none"): None}
    rust = spark.createDataFrame([("r", "S", "struct", 1, 2, None), ("r", "S", "impl", 3, 9, None), ("r", "m", "method", 4, 5, "S"), ("r", "T", "impl", 10, 12, None)], symbols.schema)
    assert sorted((r.name, r.kind) for r in views.merge_impls(rust).collect()) == [("S", "struct"), ("T", "module"), ("m", "method")]
    found = spark.createDataFrame([("E1", "low", "a", 1), ("E2", "critical", "b", 1)], "rule_id string, severity string, file string, line long")
    assert [r.rule_id for r in views.ordered_findings(found).collect()] == ["E2", "E1"]
    helped = views.with_help(found, spark.createDataFrame([("E1", "http://x")], "rule_id string, help_uri string"))
    assert {r.rule_id: r.help_uri for r in helped.collect()} == {"E1": "http://x", "E2": None}
