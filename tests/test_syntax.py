"""Token rows: definitions, calls, complexity and hashes of code in several languages."""

import random

import pytest
from codelode.operators import nested, syntax

RUST = """use std::fmt;
// fn not_here() { if }
struct Point { x: i32 }
impl Point {
    fn len(&self, s: &'static str) -> i32 {
        let t = "if { while"; /* for { */
        if self.x > 0 && t.len() > 1 { math::abs::run(self.x) } else { 0 }
    }
    fn other(c: char) -> bool { match c { '{' => true, '"' => helper(c), _ => false } }
}
fn outer() { fn inner() { while go() {} } inner(); }
"""
GO = 'package a\nfunc (p *Point) Len(n int) int {\n\tfor i := range n { fmt.Println("a") }\n\treturn 1\n}\ntype Box struct {\n\tw int\n}\nfunc Plain() {}\n'
JAVA = 'class A {\n  int f(int x) {\n    return x > 0 ? g(x) : this.h.run(x);\n  }\n  class B {\n    void k() { new Thing(); if (true || false) { } }\n  }\n}\n'
JS = "function a(x) { return `if ${x}`; }\nclass C {\n  m(y) {\n    for (const z of y) { z.go(); }\n  }\n}\n"
PYTHON = '''import os


class A:
    """if x: for"""

    async def f(self, x):
        if x and os.path.join(x):
            return [y for y in x]  # while

        def g():
            h(1,
2)
        return g()

    def k(self): pass


def last():
    try:
        A().run()
    except ValueError:
        pass
'''


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame([("a.rs", "Rust", RUST), ("a.go", "Go", GO), ("A.java", "Java", JAVA), ("a.js", "JavaScript", JS), ("a.py", "Python", PYTHON), ("e.rs", "Rust", ""), ("n.rs", "Rust", None), ("t.txt", "Text", "fn no() {}"), ("odd.rs", "Rust", 'fn open( { " never closed')], "path string, language string, content string")
    found = syntax.tokens(files).cache()
    return found, syntax.definitions(found).cache()


def test_definitions(code):
    got = {(r.path, r.name): (r.kind, r.start_line, r.end_line, r.parent) for r in code[1].collect() if r.path != "odd.rs"}
    assert got == {
        ("a.rs", "Point"): got["a.rs", "Point"], ("a.rs", "len"): ("function", 5, 8, "Point"), ("a.rs", "other"): ("function", 9, 9, "Point"), ("a.rs", "outer"): ("function", 11, 11, None), ("a.rs", "inner"): ("function", 11, 11, "outer"),
        ("a.go", "Len"): ("function", 2, 5, None), ("a.go", "Box"): ("type", 6, 8, None), ("a.go", "Plain"): ("function", 9, 9, None),
        ("A.java", "A"): ("class", 1, 8, None), ("A.java", "f"): ("function", 2, 4, "A"), ("A.java", "B"): ("class", 5, 7, "A"), ("A.java", "k"): ("function", 6, 6, "B"),
        ("a.js", "a"): ("function", 1, 1, None), ("a.js", "C"): ("class", 2, 6, None), ("a.js", "m"): ("function", 3, 5, "C"),
        ("a.py", "A"): ("class", 4, 16, None), ("a.py", "f"): ("function", 7, 14, "A"), ("a.py", "g"): ("function", 11, 13, "f"), ("a.py", "k"): ("function", 16, 16, "A"), ("a.py", "last"): ("function", 19, 23, None),
    }
    assert sorted((r.kind, r.start_line, r.end_line) for r in code[1].where("path = 'a.rs' and name = 'Point'").collect()) == [("impl", 4, 10), ("struct", 3, 3)]


def test_complexity(code):
    got = {(r.path, r.name): r.complexity for r in syntax.complexity(*code).collect() if r.path != "odd.rs"}
    assert got == {
        ("a.rs", "len"): 3, ("a.rs", "other"): 5, ("a.rs", "outer"): 2, ("a.rs", "inner"): 2, ("a.go", "Len"): 2, ("a.go", "Plain"): 1, ("A.java", "f"): 2, ("A.java", "k"): 3, ("a.js", "a"): 1, ("a.js", "m"): 2,
        ("a.py", "f"): 4, ("a.py", "g"): 1, ("a.py", "k"): 1, ("a.py", "last"): 3,
    }


def test_calls(code):
    got = {(r.caller_file, r.caller_symbol, r.callee_name, r.callee_qualifier, r.line) for r in syntax.calls(*code).collect() if r.caller_file != "odd.rs"}
    assert got == {
        ("a.rs", "len", "len", "t", 7), ("a.rs", "len", "run", "math::abs", 7), ("a.rs", "other", "helper", None, 9), ("a.rs", "outer", "go", None, 11), ("a.rs", "inner", "go", None, 11), ("a.rs", "outer", "inner", None, 11),
        ("a.go", "Len", "Println", "fmt", 3), ("A.java", "f", "g", None, 3), ("A.java", "f", "run", "this.h", 3), ("A.java", "k", "Thing", None, 6), ("a.js", "m", "go", "z", 4),
        ("a.py", "f", "join", "os.path", 8), ("a.py", "f", "h", None, 12), ("a.py", "g", "h", None, 12), ("a.py", "f", "g", None, 14), ("a.py", "last", "A", None, 21), ("a.py", "last", "run", None, 21),
    }


def test_clone_hashes(spark):
    rows = [("a.rs", "fn one(a: i32) { call(a, 1); }\nfn two(b: i32) {\n call(b, 2); // x\n}\nfn three(a: i32) { call(a, 1); }\nfn four(a: i32) { other(); }")]
    found = syntax.tokens(spark.createDataFrame([(p, "Rust", t) for p, t in rows], "path string, language string, content string"))
    symbols = syntax.definitions(found)
    hashes = lambda **k: {r.name: r.hash for r in syntax.clone_hashes(found, symbols, **k).collect()}
    exact, loose = hashes(), hashes(elide_names=True, elide_literals=True)
    assert exact["one"] == exact["three"] != exact["two"] and len({*exact.values()}) == 3
    assert loose["one"] == loose["two"] == loose["three"] != loose["four"]


def test_around_equals_brute_force(spark):
    rng = random.Random(3)
    spans, points = [], []

    def fill(group, a, b, level):
        while a < b and rng.random() < 0.8:
            start = rng.randrange(a, b + 1)
            end = rng.randrange(start, b + 1)
            spans.append((group, f"s{len(spans)}", start, end))
            if level < 4 and end - start > 2:
                fill(group, start + 1, end - 1, level + 1)
            a = end + 1

    for group in ("p", "q", None):
        fill(group, 0, 60, 0)
        points += [(group, k, k) for k in range(-1, 62)]
    intervals = spark.createDataFrame(spans, "path string, name string, start int, end int")
    asked = spark.createDataFrame(points, "path string, id int, at int")
    got = sorted(((r.path or "", r.id, r.depth, r.around.name) for r in nested.around(intervals, asked).collect()))
    want = []
    for group, k, at in points:
        held = sorted((s for s in spans if s[0] == group and s[2] <= at <= s[3]), key=lambda s: (s[2], -s[3]))
        want += [(group or "", k, d, s[1]) for d, s in enumerate(held, 1)]
    assert got == sorted(want) and len(want) > 100
    inner = {(r.path or "", r.id): r.around.name for r in nested.innermost(intervals, asked).collect()}
    assert inner == {(g, k): name for g, k, _, name in sorted(want)}


def test_imports(spark):
    rust = "use std::{fs, io::{self, Read as R, buf::*}};\nuse a::b::c;\nuse x as y;\npub use q::*;\nfn f() { g(); }\nuse {one, two::{three}};\n"
    python = "import os, sys as s\nfrom a.b import (c as d,\n  e)\nfrom . import k\nx = 1\nfrom m import *\n"
    found = syntax.tokens(spark.createDataFrame([("a.rs", "Rust", rust), ("a.py", "Python", python)], "path string, language string, content string"))
    got = {(r.file, r.module, r.name, r.alias, r.line) for r in syntax.imports(found).collect()}
    assert got == {
        ("a.rs", "std", "fs", None, 1), ("a.rs", "std::io", "self", None, 1), ("a.rs", "std::io", "Read", "R", 1), ("a.rs", "std::io::buf", "*", None, 1), ("a.rs", "a::b", "c", None, 2), ("a.rs", None, "x", "y", 3),
        ("a.rs", "q", "*", None, 4), ("a.rs", None, "one", None, 6), ("a.rs", "two", "three", None, 6),
        ("a.py", None, "os", None, 1), ("a.py", None, "sys", "s", 1), ("a.py", "a.b", "c", "d", 2), ("a.py", "a.b", "e", None, 3), ("a.py", None, "k", None, 4), ("a.py", "m", "*", None, 6),
    }
