"""Tree patterns against a walk over small trees."""

import itertools
import random

import pytest
from codelode.operators import treepattern

HTML = '<!DOCTYPE html><html><ul id="u"><li><a href="/x">one</a></li><li>two<br></li><!-- c --><li><a>three</a><b>un<i>closed</i></li></ul><script>if (a < b) "</ul>"</script></html>'


@pytest.fixture(scope="module")
def nodes(spark):
    return treepattern.markup_nodes(spark.createDataFrame([("p", HTML), ("q", ""), ("r", None), (None, "<a><b/></a>")], "path string, content string")).cache()


def test_markup_nodes(nodes):
    got = {(r.path, r.start): (r.kind, r.end, r.parent, r.ordinal) for r in nodes.collect()}
    kinds = [v[0] for k, v in sorted(((k, v) for k, v in got.items() if k[0] == "p"), key=lambda x: x[0][1])]
    assert kinds == ["html", "ul", "li", "a", "text", "li", "text", "br", "comment", "li", "a", "text", "b", "text", "i", "text", "script"]
    by_kind = {v[0]: (k[1], v) for k, v in got.items() if k[0] == "p"}
    assert by_kind["script"][1][2] == by_kind["html"][0] and by_kind["b"][1][1] == by_kind["b"][0] and by_kind["i"][1][2] == by_kind["li"][0]
    assert sorted(v[0] for k, v in got.items() if k[0] is None) == ["a", "b"]


def test_patterns(nodes):
    said = lambda pattern: sorted((r.capture, r.text) for r in treepattern.captures(nodes.where("path = 'p'"), pattern).collect())
    assert said("(li (a (text) @t))") == [("t", "one"), ("t", "three")]
    assert said("(ul (li (text) @a) . (comment) @b)") == [("a", "two"), ("b", "<!-- c -->")]
    assert said("(ul (li (a (text) @a)) (li (a (text) @b)))") == [("a", "one"), ("b", "three")]
    assert said("(ul . (li) @f)") == [("f", "<li>")] and said("(li (i) @x .)") == [("x", "<i>")] and said("(li . (i) @x)") == [] and len(said("(ul (li) @l .)")) == 1
    assert said("(html // (i (text) @deep))") == [("deep", "closed")]
    assert said('((a (text) @t) (#eq? @t "one"))') == [("t", "one")] and said('(a (text) @t (#match? @t "^t"))') == [("t", "three")]
    assert said('(a (text) @t (#not-eq? @t "one"))') == [("t", "three")] and said('(a (text) @t (#any-of? @t "x" "one"))') == [("t", "one")]
    assert len(said('(a (text) @t (#match? @t "("))')) == 2 and len(said('(a (text) @t (#odd? @t "("))')) == 2 and said('(a (text) @t (#eq? @no "x"))') == []
    assert len(said("(_ (_) @x)")) == 16


def test_patterns_equal_a_walk(spark):
    rng = random.Random(6)

    # a random tree, written out
    def grow(depth):
        kind = rng.choice("abc")
        inner = "".join(grow(depth + 1) for _ in range(rng.randrange(4))) if depth < 5 else ""
        return f"<{kind}>{inner}</{kind}>"

    text = "".join(grow(0) for _ in range(12))
    rows = [r.asDict() for r in treepattern.markup_nodes(spark.createDataFrame([("p", text)], "path string, content string")).collect()]
    assert len(rows) == text.count("</")
    below = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    want = sorted((x["start"], y["start"]) for r in rows if r["kind"] == "a" for x, y in itertools.combinations(sorted(below.get(r["start"], []), key=lambda n: n["start"]), 2) if (x["kind"], y["kind"]) == ("b", "c"))
    got = treepattern.matches(spark.createDataFrame(rows, "path string, id int, kind string, start int, end int, text string, parent int, ordinal int, siblings int"), "(a (b) @x (c) @y)")
    assert sorted((r.captures["x"].start, r.captures["y"].start) for r in got.collect()) == want != []
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_tree_rules(spark, nodes):
    rules = [
        {"id": "no-bare", "pattern": "(li (a (text) @t) @whole)", "message": "m", "severity": "error", "fix": "<b>$t</b> in $whole", "allow": ["q*"]},
        {"id": "gated", "pattern": "(ul) @u", "requires": {"edition": ">=2021"}}, {"id": "off", "pattern": "(ul)", "enabled": False}, {"id": "allowed", "pattern": "(ul)", "allow": ["p"]}, {"id": "lang", "pattern": "(ul)", "languages": ["xml"]},
    ]
    contexts = lambda e: spark.createDataFrame([("p", {"edition": e})], "path string, context map<string,string>")
    languages = spark.createDataFrame([("p", "html")], "path string, language string")
    found = lambda e: sorted((r.rule_id, r.severity, r.fixed) for r in treepattern.tree_findings(nodes, rules, contexts(e), languages).collect())
    bare = [("no-bare", "error", '<b>one</b> in <a href="/x">'), ("no-bare", "error", "<b>three</b> in <a>")]
    assert found("2018") == bare and found("2021") == [("gated", "warning", None), *bare]
    assert treepattern.tree_findings(nodes, []).collect() == []
