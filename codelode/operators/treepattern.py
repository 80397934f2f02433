"""Tree patterns as joins over node rows, and rules made of them.

Nodes are rows (path, id, kind, start, end, parent, ordinal, siblings, text):
start and end number a node's first and last token, so one lies below another
exactly if its start lies between; id is the start, parent the id above,
ordinal the place among the siblings. A pattern is an S-expression of kinds:
``(ul (li (a) @link) . (li) @next (#eq? @link "x"))``. Children are equi-joins on
the parent, in the order of the pattern; ``.`` between two asks for neighbours,
at either end for the first or last child; ``//`` before a child asks for any
node below; ``_`` is any kind; ``@name`` captures. Predicates are expressions
over the captured texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.globs import plain_glob
from codelode.operators import nested, rules
from codelode.scratch import together
from codelode.sources.python_trace import parse_query

# fixed values: elements without content
VOID = "area base br col embed hr img input link meta source track wbr".split()
_MARKUP = r"(?i)<!--[\s\S]*?-->|<(script|style)\b[\s\S]*?</\1\s*>|<[^>]*+>|[^<]++"


def markup_nodes(pages: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The nodes of HTML or XML: elements, ``text``, ``comment``; scripts and styles are leaves.

    Tags match by name and depth of that name; an element that is never closed
    is a leaf. An element's text is its tag.
    """
    held = together(pages.select(F.col(path).alias("path"), F.col(content).alias("content")))
    said = held.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(_MARKUP), F.lit(0))).alias("start", "text"))
    name = F.lower(F.regexp_extract("text", r"^</?([A-Za-z][\w:-]*)", 1))
    tag = F.col("text").startswith("<")
    said = said.withColumn("kind", F.when(~tag, "text").when(F.col("text").startswith("<!--"), "comment").otherwise(name)).where("kind <> '' and trim(text) <> ''")
    leaf = F.col("kind").isin("text", "comment", "script", "style", *VOID) | F.col("text").endswith("/>")
    said = said.withColumn("_step", F.when(leaf, 0).when(F.col("text").startswith("</"), -1).otherwise(1))
    same = Window.partitionBy("path", "kind").orderBy("start")
    said = said.withColumn("_level", F.sum("_step").over(same.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("_step") < 0, 1).otherwise(0))
    pairs = Window.partitionBy("path", "kind", "_level", F.col("_step") == 0).orderBy("start")
    closed = (F.col("_step") == 1) & (F.lead("_step").over(pairs) == -1)
    said = said.withColumn("end", F.when(closed, F.lead("start").over(pairs)).otherwise(F.col("start"))).where("_step >= 0")
    found = nested.with_parent(said.select("path", F.col("start").alias("id"), "kind", "start", "end", "text"), name="id")
    family = Window.partitionBy("path", "parent")
    return found.withColumns({"ordinal": F.row_number().over(family.orderBy("start")), "siblings": F.count("*").over(family)})


@dataclass
class _Step:
    kind: str
    above: int | None
    below: bool = False
    after: int | None = None
    close: bool = False
    first: bool = False
    last: bool = False
    captures: list[str] = field(default_factory=list)


def _steps(pattern: list) -> tuple[list[_Step], list[list[str]]]:
    """The pattern's nodes, each after the one above it and the sibling before it, and its predicates."""
    steps, tests = [], []

    def add(node: list, above: int | None) -> int:
        me = len(steps)
        steps.append(_Step(node[0], above))
        last, below, close, at = None, False, False, None
        for item in node[1:]:
            if isinstance(item, list) and item and str(item[0]).startswith("#"):
                tests.append(item)
            elif isinstance(item, list):
                at = add(item, me)
                step = steps[at]
                step.below, step.after, step.close, step.first = below, None if below else last, close and last is not None, close and last is None and not below
                last, below, close = (last, False, False) if step.below else (at, False, False)
            elif item == "//":
                below = True
            elif item == ".":
                close = True
            elif item.startswith("@"):
                steps[me if at is None else at].captures.append(item[1:])
            else:
                raise ValueError(f"can't read {item!r} in a pattern")
        if close and last is not None:
            steps[last].last = True
        return me

    add(pattern, None)
    return steps, tests


def matches(nodes: DataFrame, pattern: str) -> DataFrame:
    """(path, match, captures) of every way the pattern fits; captures: name to (kind, start, end, text), match: the root's."""
    top = parse_query(pattern)
    root = next(p for p in top if isinstance(p, list))
    if root and isinstance(root[0], list):
        # a group: the pattern and its predicates in one more pair of parentheses
        top = [*root, *top[1:]]
        root = root[0]
    steps, tests = _steps(root)
    steps[0].captures += [t[1:] for t in top if isinstance(t, str) and t.startswith("@")]
    tests += [p for p in top if isinstance(p, list) and str(p[0]).startswith("#")]
    columns = ("id", "kind", "start", "end", "parent", "ordinal", "siblings", "text")
    found = None
    for k, step in enumerate(steps):
        own = nodes if step.kind == "_" else nodes.where(F.col("kind") == step.kind)
        if step.first:
            own = own.where("ordinal = 1")
        if step.last:
            own = own.where("ordinal = siblings")
        mine = own.select("path", *[F.col(c).alias(f"{c}_{k}") for c in columns])
        if found is None:
            found = mine
        elif step.below:
            upper = steps[step.above].kind
            outer = (nodes if upper == "_" else nodes.where(F.col("kind") == upper)).select("path", F.col("id").alias("up"), "start", "end")
            pairs = nested.around(outer, mine.withColumn("at", F.col(f"start_{k}"))).where(F.col("around.up") < F.col(f"id_{k}"))
            found = found.join(pairs.select("path", F.col("around.up").alias(f"id_{step.above}"), *mine.columns[1:]), ["path", f"id_{step.above}"])
        else:
            found = found.join(mine.withColumnRenamed(f"parent_{k}", f"id_{step.above}"), ["path", f"id_{step.above}"])
            if step.after is not None:
                here, before = F.col(f"ordinal_{k}"), F.col(f"ordinal_{step.after}")
                found = found.where(here == before + 1 if step.close else here > before)
    entry = lambda k: F.struct(*[F.col(f"{c}_{k}").alias(c) for c in ("kind", "start", "end", "text")])
    captures = [x for k, step in enumerate(steps) for name in step.captures for x in (F.lit(name), entry(k))]
    held = F.create_map(*captures) if captures else F.create_map(F.lit(""), entry(0))
    found = found.select("path", entry(0).alias("match"), held.alias("captures"))
    texts = F.transform_values("captures", lambda _, v: v["text"])
    for name, *args in tests:
        # a capture that the pattern doesn't make is empty
        known = F.map_concat(texts, F.create_map(*[x for a in {a for a in args if a.startswith("@")} - {f"@{n}" for s in steps for n in s.captures} for x in (F.lit(a[1:]), F.lit(""))])) if {a for a in args if a.startswith("@")} - {f"@{n}" for s in steps for n in s.captures} else texts
        found = found.where(rules.predicate(name.lstrip("#"), known, [a.strip('"') for a in args]))
    return found


def captures(nodes: DataFrame, pattern: str) -> DataFrame:
    """A row for each capture of each match: path, start of the match, name, kind, start, end, text."""
    found = matches(nodes, pattern).select("path", F.col("match.start").alias("match_start"), F.explode("captures").alias("capture", "c"))
    return found.select("path", "match_start", "capture", "c.*")


def tree_findings(nodes: DataFrame, given: list[dict], contexts: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """(rule_id, path, start, end, severity, message, fixed) of rules (as :func:`rules.parse_rule` reads them).

    A rule's ``allow`` globs name paths that it leaves alone; ``requires`` is
    held against a path's context (contexts: path, context), where a missing
    key fails; languages (path, language) limit rules that name some. ``$name``
    in a fix is the capture's text. Each rule is one branch of a union; they
    read the same nodes.
    """
    out = None
    for rule in given:
        if not rule.get("enabled", True):
            continue
        own = nodes
        for glob in rule.get("allow", []):
            own = own.where(~F.col("path").rlike(plain_glob(glob)))
        if rule.get("languages") and languages is not None:
            own = own.join(languages.where(F.col("language").isin(rule["languages"])).select("path").distinct(), "path", "left_semi")
        if rule.get("requires"):
            wanted = F.create_map(*[F.lit(str(x)) for pair in rule["requires"].items() for x in pair])
            if contexts is None:
                continue
            own = own.join(contexts.where(rules.meets(wanted, F.col("context"))).select("path"), "path", "left_semi")
        found = matches(own, rule["pattern"])
        fixed: Column = F.lit(rule.get("fix"))
        names = sorted(set(re.findall(r"@([\w.-]+)", rule["pattern"])), key=len, reverse=True)
        for name in names if rule.get("fix") else []:
            fixed = F.replace(fixed, F.lit("$" + name), F.coalesce(F.try_element_at("captures", F.lit(name))["text"], F.lit("")))
        part = found.select(F.lit(rule["id"]).alias("rule_id"), "path", F.col("match.start").alias("start"), F.col("match.end").alias("end"), F.lit(rule.get("severity", "warning")).alias("severity"), F.lit(rule.get("message", "")).alias("message"), fixed.cast("string").alias("fixed"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = nodes.sparkSession.createDataFrame([], "rule_id string, path string, start int, end int, severity string, message string, fixed string")
    return out
