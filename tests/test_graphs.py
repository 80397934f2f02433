"""Iterated joins against plain walks over small random graphs."""

import random

import pytest
from codelode.operators import graphs, views


def below(edges, start):
    seen, todo = {start}, [start]
    while todo:
        for child in edges.get(todo.pop(), ()):
            if child not in seen:
                seen.add(child)
                todo.append(child)
    return seen


def test_preorder_equals_a_depth_first_walk(spark):
    rng = random.Random(2)
    rows, want = [], []
    for project in ("p", "q", "r"):
        nodes = [f"n{rng.randrange(1000):03d}_{i}" for i in range(14)]
        children = {}
        for i, parent in enumerate(nodes):
            for k, child in enumerate(rng.sample(nodes[i + 1 :], min(len(nodes) - i - 1, rng.randrange(4)))):
                children.setdefault(parent, []).append((k, child))
                rows.append((project, parent, child, k))
        inner = {c for own in children.values() for _, c in own}
        seen, out = set(), []

        def walk(name, depth):
            first = name not in seen
            seen.add(name)
            out.append((project, len(out), depth, name, first))
            for _, child in sorted(children.get(name, [])) if first else []:
                walk(child, depth + 1)

        for root in sorted(set(children) - inner):
            walk(root, 0)
        want += out
    edges = spark.createDataFrame(rows, "project string, parent string, child string, ordinal int")
    assert sorted(tuple(r) for r in graphs.preorder(edges).collect()) == sorted(want)
    assert len(want) > len({(p, n) for p, *_, n, _ in want})


def test_preorder_of_cycles_and_wide_trees(spark):
    cycle = [("p", "a", "b", 0), ("p", "b", "c", 0), ("p", "c", "b", 0), ("p", "c", "d", 1)]
    got = graphs.preorder(spark.createDataFrame(cycle, "project string, parent string, child string, ordinal int")).collect()
    assert [(r.depth, r.name, r.expanded) for r in sorted(got, key=lambda r: r.position)] == [(0, "a", True), (1, "b", True), (2, "c", True), (3, "b", False), (3, "d", True)]
    wide = spark.range(30_000).selectExpr("'w' as project", "if(id = 0, 'root', concat('n', (id - 1) div 20)) as parent", "concat('n', id) as child", "id as ordinal").where("parent <> child")
    rows = graphs.preorder(wide).agg({"position": "max", "depth": "max"}).first()
    assert rows["max(position)"] >= 29_999
    assert graphs.preorder(spark.createDataFrame([], "project string, parent string, child string, ordinal int")).count() == 0


def test_merge_bases_and_changes(spark):
    rng = random.Random(7)
    parents = {c: sorted({rng.randrange(max(0, c - 6), c) for _ in range(1 + (c % 3 == 0))}) for c in range(1, 40)}
    rows = spark.createDataFrame([(c, p) for c, own in parents.items() for p in own], "commit long, parent long")
    pairs = [(k, rng.randrange(20, 40), rng.randrange(20, 40)) for k in range(12)]
    got = {}
    for r in graphs.merge_bases(rows, spark.createDataFrame(pairs, "pair long, a long, b long")).collect():
        got.setdefault(r.pair, set()).add(r.commit)
    for k, a, b in pairs:
        common = below(parents, a) & below(parents, b)
        assert got[k] == {c for c in common if not any(c != d and c in below(parents, d) for d in common)}
    touched = spark.createDataFrame([(c, f"f{c % 9}") for c in range(40)], "commit long, path string")
    own = below(parents, 39) - below(parents, 30)
    assert {r.path for r in graphs.changed_since(rows, touched, 39, 30).collect()} == {f"f{c % 9}" for c in own}


def test_exports_over_barrels(spark):
    local = spark.createDataFrame([("a", "x"), ("a", "default"), ("b", "y")], "file string, name string")
    again = spark.createDataFrame([("i", "a", "*", None), ("i", "b", "y", "why"), ("top", "i", "*", None), ("i", "top", "*", None), ("d", "a", "default", "A")], "file string, target string, name string, alias string")
    found = {(r.file, r.name, r.origin, r.origin_name): r.depth for r in graphs.exported(local, again).collect()}
    assert found == {
        ("a", "x", "a", "x"): 0, ("a", "default", "a", "default"): 0, ("b", "y", "b", "y"): 0, ("i", "x", "a", "x"): 1, ("i", "why", "b", "y"): 1,
        ("top", "x", "a", "x"): 2, ("top", "why", "b", "y"): 2, ("d", "A", "a", "default"): 1,
    }


def test_flows_stay_in_their_scope(spark):
    rows = spark.createDataFrame([("f", "s", "a", ["b", "c"]), ("f", "s", "b", ["d"]), ("f", "t", "d", ["e"]), ("f", "s", "d", ["a"])], "file string, scope string, variable string, flows_from array<string>")
    got = {(r.scope, r.variable, r.source) for r in graphs.flows(rows).collect()}
    assert got == {("s", v, x) for v in ("a", "b", "d") for x in ("a", "b", "c", "d")} | {("t", "d", "e")}


@pytest.mark.parametrize("kinds", [("class", "struct", "enum"), ("function", "class", "class"), ("class", "method", "class")])
def test_types_below_other_things_go(spark, kinds):
    symbols = spark.createDataFrame([("f", n, k, p) for (n, p), k in zip((("a", None), ("b", "a"), ("c", "b")), kinds)] + [("f", "a", "class", "a"), ("g", "b", "class", "a")], "file string, name string, kind string, parent string")
    got = {(r.file, r.name, r.parent) for r in views.type_skeleton(symbols).collect()}
    want = set()
    for n, p, k in zip("abc", (None, "a", "b"), kinds):
        if k not in views.TYPE_KINDS:
            break
        want.add(("f", n, p))
    # a type in one of its own name counts as inside of it
    assert got == want | ({("f", "a", "a")} if kinds[0] == "class" else set())
