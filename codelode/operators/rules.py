"""Rule findings: predicates over captures, suppression, gating, overrides and fixes."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precedence of where a rule comes from.
LAYERS = ("builtin", "user", "project")
#: Rules that one pass over the lines tries.
RULES_AT_ONCE = 100


def predicate(name: str, captures: Column, args: list[str]) -> Column:
    """A predicate over a map of captures; unknown predicates and broken patterns pass.

    args: capture names start with ``@``, others are literal.
    """
    value = lambda a: F.element_at(captures, a[1:]) if a.startswith("@") else F.lit(a)
    if name in ("eq?", "not-eq?"):
        out = value(args[0]).eqNullSafe(value(args[1]))
        return ~out if name.startswith("not") else out
    if name in ("match?", "not-match?"):
        try:
            re.compile(args[1])
        except re.error:
            return F.lit(True)
        out = F.coalesce(value(args[0]).rlike(args[1]), F.lit(False))
        return ~out if name.startswith("not") else out
    if name in ("any-of?", "not-any-of?"):
        out = F.coalesce(value(args[0]).isin(args[1:]), F.lit(False))
        return ~out if name.startswith("not") else out
    return F.lit(True)


def parse_rule(text: str) -> dict:
    """A rule file: a TOML header in comments between ``# ---`` lines, then the pattern."""
    header, body, inside = [], [], False
    for line in text.splitlines():
        if line.strip() == "# ---":
            inside = not inside
        elif inside:
            header.append(line.removeprefix("#").removeprefix(" "))
        else:
            body.append(line)
    meta = tomllib.loads("\n".join(header))
    return {
        "id": meta["id"], "severity": meta.get("severity", "warning"), "message": meta.get("message", ""), "languages": meta.get("languages", []),
        "allow": meta.get("allow", []), "requires": meta.get("requires", {}), "enabled": meta.get("enabled", True), "fix": meta.get("fix"), "pattern": "\n".join(body).strip(),
    }


def effective_rules(rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Of rules (id, layer, ...) the highest layer of each id; overrides (id, severity, enabled) win where not null."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    others = [c for c in rules.columns if c != "id"]
    out = rules.groupBy("id").agg(F.max_by(F.struct(*others), rank).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in others])
    if overrides is not None:
        given = overrides.select("id", F.col("severity").alias("_s"), F.col("enabled").alias("_e"))
        out = out.join(given, "id", "left").withColumn("severity", F.coalesce("_s", "severity")).withColumn("enabled", F.coalesce("_e", "enabled")).drop("_s", "_e")
    return out.where("enabled")


def meets(requires: Column, context: Column, numeric: bool = False) -> Column:
    """Whether a context (map) meets all requirements (map of key to ``value``, ``>=value``, ``<=value`` or ``!value``).

    A missing key fails. Orders compare strings, or dotted numbers if
    ``numeric``.
    """
    form = (lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\d{1,9})"), F.lit(1)), lambda d: d.cast("long"))) if numeric else (lambda x: x)

    def one(key, want):
        have = F.element_at(context, key)
        rest = lambda n: F.substr(want, F.lit(n))
        return F.coalesce(
            F.when(want.startswith(">="), form(have) >= form(rest(3))).when(want.startswith("<="), form(have) <= form(rest(3))).when(want.startswith("!"), have != rest(2)).otherwise(have == want),
            F.lit(False),
        )

    return F.forall(F.map_entries(requires), lambda e: one(e["key"], e["value"]))


def nearest_contexts(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (path) with the context (map) of the manifest (folder, context) nearest above; ``""`` is the root's folder.

    A file meets its folders by equality, however many manifests there are;
    without any manifest above, the context is empty.
    """
    parts = F.split("path", "/")
    own = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_n", "folder"))
    best = own.join(manifests, "folder").groupBy("path").agg(F.max_by("context", "_n").alias("context"))
    return files.join(best, "path", "left").withColumn("context", F.coalesce("context", F.create_map().cast("map<string,string>")))


def line_findings(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of line rules (id, severity, message, regex) on lines (file, line, text, language).

    Rules are a stated list and come to the driver; RULES_AT_ONCE of them share
    one pass over the lines, with each pattern as a literal that is compiled
    once, and lines without any match leave before the rules are told apart. A
    rule with languages only looks at those.
    """
    given = sorted(tuple(r) for r in rules.select("id", "severity", "message", "regex", "languages").collect())
    out = None
    for begin in range(0, max(1, len(given)), RULES_AT_ONCE):
        tried = []
        for rule, severity, message, regex, languages in given[begin : begin + RULES_AT_ONCE]:
            met = F.col("text").rlike(regex)
            if languages:
                met &= F.col("language").isin(list(languages))
            col = F.regexp_instr("text", F.lit(regex)).cast("long")
            told = (F.lit(rule).alias("rule_id"), col.alias("col"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.regexp_substr("text", F.lit(regex)).alias("matched"))
            tried.append(F.when(met, F.struct(*told)))
        none = F.array().cast("array<struct<rule_id:string,col:bigint,severity:string,message:string,matched:string>>")
        found = F.array_compact(F.array(*tried)) if tried else none
        # lines that no pattern finds leave by one pass of all patterns together
        some = lines.where(F.col("text").rlike("|".join(f"(?:{x[3]})" for x in given[begin : begin + RULES_AT_ONCE]))) if tried else lines.limit(0)
        part = some.select("file", "line", F.explode(found).alias("f")).select("f.rule_id", "file", "line", "f.col", "f.severity", "f.message", "f.matched")
        out = part if out is None else out.unionByName(part)
    return out


def allow_comment(rule_id: Column, text: Column, word: str = "allow") -> Column:
    """Whether a line has a comment ``<word>: id`` that names the rule (a longer id doesn't count)."""
    named = F.regexp_extract_all(text, F.lit(rf"{word}:\s*([A-Za-z0-9_/\-]+)"), F.lit(1))
    return F.array_contains(named, rule_id)


def unsuppressed(findings: DataFrame, lines: DataFrame, word: str = "allow") -> DataFrame:
    """Findings without an allowing comment on their line or the line before."""
    context = lines.where(F.col("text").contains(f"{word}:")).select("file", "line", "text")
    here = findings.join(context.withColumnRenamed("text", "_here"), ["file", "line"], "left")
    above = context.select("file", (F.col("line") + 1).alias("line"), F.col("text").alias("_above"))
    both = here.join(above, ["file", "line"], "left")
    said = lambda c: F.coalesce(allow_comment(F.col("rule_id"), F.col(c), word), F.lit(False))
    return both.where(~said("_here") & ~said("_above")).drop("_here", "_above")


def expand_fix(template: str, captures: dict[str, str]) -> str:
    """``$name`` by its capture; longer names first."""
    for name in sorted(captures, key=len, reverse=True):
        template = template.replace("$" + name, captures[name])
    return template


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """files (file, content) after fixes (file, start, end, text), in characters; the last place first.

    Of overlapping fixes the later one wins. A file's fixes meet in one row,
    which any rewrite of that file's text needs.
    """
    per = fixes.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text")), asc=False).alias("fixes"))
    zero = F.struct(F.col("content").alias("out"), F.lit(1 << 60).alias("limit"))

    def put(state, fix):
        fits = fix["end"] <= state["limit"]
        new = F.concat(F.left(state["out"], fix["start"].cast("int")), fix["text"], F.substr(state["out"], (fix["end"] + 1).cast("int")))
        return F.struct(F.when(fits, new).otherwise(state["out"]).alias("out"), F.when(fits, fix["start"]).otherwise(state["limit"]).alias("limit"))

    done = F.aggregate(F.transform("fixes", lambda f: F.struct(f["start"].cast("long").alias("start"), f["end"].cast("long").alias("end"), f["text"].alias("text"))), zero, put, lambda s: s["out"])
    return files.join(per, "file", "left").select("file", F.when(F.col("fixes").isNull(), F.col("content")).otherwise(done).alias("content"))
