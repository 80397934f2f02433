import pytest
from codelode.sources import lexical, python_code

CASES = {
    "a.rs": (
        "use std::collections::{HashMap, BTreeMap as B};\nuse crate::x;\n\n/// Doc { not a brace\npub struct Point { x: i32 }\n\nimpl Point {\n    pub fn new(x: i32) -> Self {\n        if x > 0 && x < 9 { helper(x); }\n        Point { x }\n    }\n}\n\nfn helper(x: i32) -> i32 {\n    let s = \"}{ fn no()\";\n    Point::new(x).x\n}\n",
        [("Point", "struct", 5, 5, None, None), ("Point", "impl", 7, 12, None, None), ("new", "method", 8, 11, "Point", 3), ("helper", "function", 14, 17, None, 1)],
        [("new", "helper", None, 9), ("helper", "new", "Point", 16)],
        [("std::collections", "HashMap", None), ("std::collections", "BTreeMap", "B"), ("crate", "x", None)],
    ),
    "b.ts": (
        "import def, { a, b as c } from './m';\nimport * as all from \"n\";\nexport { q } from './r';\n\nexport interface Shape { area(): number }\n\nexport class Circle implements Shape {\n  constructor(private r: number) {\n    this.init();\n  }\n  area(): number {\n    return this.r ? Math.sqrt(2) : 0; // if (x) {\n  }\n}\n\nexport const make = (r: number) => {\n  return new Circle(r);\n};\n\nfunction run() { make(1); }\n",
        [("Shape", "interface", 5, 5, None, None), ("Circle", "class", 7, 14, None, None), ("area", "method", 11, 13, "Circle", 2), ("make", "function", 16, 18, None, 1), ("run", "function", 20, 20, None, 1)],
        [("area", "sqrt", "Math", 12), ("make", "Circle", None, 17), ("run", "make", None, 20)],
        [("./m", "a", None), ("./m", "b", "c"), ("./m", "default", "def"), ("n", "*", "all"), ("./r", "q", None)],
    ),
    "c.go": (
        'package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Do(n int) int {\n\tfor i := 0; i < n; i++ {\n\t\tfmt.Println(i)\n\t}\n\treturn t.x\n}\n\nfunc main() { t := T{}; t.Do(1) }\n',
        [("T", "struct", 8, 10, None, None), ("Do", "method", 12, 17, "T", 2), ("main", "function", 19, 19, None, 1)],
        [("Do", "Println", "fmt", 14), ("main", "Do", "t", 19)],
        [(None, "fmt", None), (None, "math", "m")],
    ),
    "D.java": (
        "import java.util.List;\nimport java.io.*;\n\npublic class D {\n    private int f(List<String> a) throws Exception {\n        try { g(); } catch (Exception e) { return 1; }\n        return 0;\n    }\n    void g() {\n        /* if */ System.out.println(\"if (x) {\");\n    }\n}\n",
        [("D", "class", 4, 12, None, None), ("f", "method", 5, 8, "D", 2), ("g", "method", 9, 11, "D", 1)],
        [("f", "g", None, 6), ("g", "println", "System.out", 10)],
        [("java.util", "List", None), ("java.io", "*", None)],
    ),
    "e.c": (
        "#include <stdio.h>\n#include \"own.h\"\n\nstruct node { int v; };\n\nstatic int twice(int x) {\n  return x * 2;\n}\n\nint main(void)\n{\n  while (twice(1)) { printf(\"%d\", 1); }\n}\n",
        [("node", "struct", 4, 4, None, None), ("twice", "function", 6, 8, None, 1), ("main", "function", 10, 13, None, 2)],
        [("main", "twice", None, 12), ("main", "printf", None, 12)],
        [(None, "stdio.h", None), (None, "own.h", None)],
    ),
}


@pytest.mark.parametrize("path", CASES)
def test_rows_of_a_file(path):
    source, symbols, calls, imports = CASES[path]
    rows = list(lexical.rows_of(path, source))
    own = [(r["name"], r["kind"], r["start_line"], r["end_line"], r["parent"], r["complexity"]) for r in rows if r["relation"] == "symbols"]
    assert [s for s in own if s[0] != "constructor"] == symbols
    assert [(r["caller_symbol"], r["callee_name"], r["callee_qualifier"], r["line"]) for r in rows if r["relation"] == "calls" and r["caller_symbol"] != "constructor"] == calls
    assert [(r["module"], r["name"], r["alias"]) for r in rows if r["relation"] == "imports"] == imports


def test_odd_files():
    for path, text in [("a.rs", ""), ("a.rs", "fn f( {"), ("a.js", "}}}} function f() {"), ("a.java", "class"), ("a.txt", "fn f() {}"), ("rs", "fn f() {}"), ("a.c", "x" * 20_000), ("a.go", '"unclosed')]:
        list(lexical.rows_of(path, text))


def test_relations(spark):
    files = spark.createDataFrame([(p, c[0]) for p, c in CASES.items()] + [("x.rs", None), ("y.md", "# fn f() {}")], "path string, content string")
    rows = lexical.extract(files)
    found = python_code.relation(rows, "symbols")
    assert {(r.file, r.name) for r in found.where("visibility = 'public'").collect()} >= {("a.rs", "new"), ("b.ts", "Circle"), ("c.go", "Do"), ("D.java", "D"), ("e.c", "main")}
    assert python_code.relation(rows, "calls").count() == sum(len(c[2]) for c in CASES.values()) + 1
    assert python_code.relation(rows, "imports").columns == ["file", "module", "name", "alias", "line"]
