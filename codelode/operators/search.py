"""Search over files, lines and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.globs import any_of
from codelode.functions.text import normal_path

#: Lines of a block in the interval join.
BLOCK = 64

#: White space of any kind at a line's ends, Unicode's included.
WHITE_START, WHITE_END = r"(?U)^\s+", r"(?U)\s+$"

# fixed values: built-in path groups; tests has more patterns for some languages
ALIASES = {
    "tests": ["**/test_*.py", "**/*_test.py", "**/tests/**"],
    "config": ["*.toml", "*.yaml", "*.yml", "*.json", "*.ini", "*.cfg", ".env", ".env.*", "*.config.js", "*.config.ts"],
    "build": ["target/**", "dist/**", "build/**", "out/**", "node_modules/**", ".next/**", ".nuxt/**", "__pycache__/**", "*.pyc"],
    "docs": ["*.md", "*.rst", "*.txt", "docs/**", "doc/**", "README*", "CHANGELOG*", "LICENSE*"],
    "generated": ["*.gen.*", "*.generated.*", "*.pb.go", "*.pb.rs", "*_generated.go", "*_generated.rs", "generated/**"],
}
_SCRIPT_TESTS = ["**/*.test.js", "**/*.spec.js", "**/*.test.ts", "**/*.spec.ts", "**/__tests__/**"]
TESTS_BY_LANGUAGE = {
    "go": ["*_test.go", "**/*_test.go"],
    "rust": ["**/tests/**/*.rs"],
    "javascript": _SCRIPT_TESTS,
    "typescript": _SCRIPT_TESTS,
    "java": ["**/test/**", "**/*Test.java"],
    "ruby": ["**/test/**", "**/*_test.rb", "**/spec/**", "**/*_spec.rb"],
}


def text_search(lines: DataFrame, pattern: str, ignore_case: bool = False, limit: int | None = None) -> DataFrame:
    """Lines (file, line, text) that match, trimmed of all white space, with the first match's range in the trimmed line."""
    regex = f"(?i){pattern}" if ignore_case else pattern
    hit = lines.where(F.col("text").rlike(regex))
    indent = F.length(F.regexp_extract("text", WHITE_START, 0))
    trimmed = F.regexp_replace(F.regexp_replace("text", WHITE_START, ""), WHITE_END, "")
    said = F.regexp_extract("text", regex, 0)
    start = F.greatest(F.lit(0), F.regexp_instr("text", F.lit(regex)) - 1 - indent)
    out = hit.select("file", "line", trimmed.alias("content"), start.cast("long").alias("start"), (start + F.length(said)).cast("long").alias("end"))
    return out.orderBy("file", "line").limit(limit) if limit is not None else out


def search_total(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matching lines and files, before any limit."""
    regex = f"(?i){pattern}" if ignore_case else pattern
    return lines.where(F.col("text").rlike(regex)).agg(F.count("*").alias("total"), F.countDistinct("file").alias("files"))


def enclosing(hits: DataFrame, spans: DataFrame, hit_key: list[str]) -> DataFrame:
    """hits (file, line, ...) with the smallest span (file, name, start_line, end_line) around the line, if any.

    Spans are dealt to the blocks of lines that they touch, so the join has
    equality keys; ties go to the later start, then the name.
    """
    blocks = spans.select("file", "name", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BLOCK), F.floor(F.col("end_line") / BLOCK))).alias("_block"))
    near = hits.withColumn("_block", F.floor(F.col("line") / BLOCK))
    inside = near.join(blocks, ["file", "_block"]).where("line between start_line and end_line")
    best = inside.groupBy(*hit_key).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("start_line")).alias("from"), "name", "end_line")).alias("s"))
    found = best.select(*hit_key, F.col("s.name").alias("symbol"), (-F.col("s.from")).alias("symbol_start"), F.col("s.end_line").alias("symbol_end"))
    return hits.join(found, hit_key, "left")


def find_by_name(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.col("path").ilike(f"%/{name}") | F.col("path").ilike(name))


def find_by_stem(files: DataFrame, stem: str) -> DataFrame:
    return files.where(F.col("path").ilike(f"%/{stem}%") | F.col("path").ilike(f"{stem}%"))


def find_like(files: DataFrame, query: str, limit: int = 50, extension_limit: int = 1000) -> DataFrame:
    """Files that hold all terms of the query; a query ``.ext`` asks for an extension. Ordered by path."""
    if query.startswith("."):
        return files.where(F.lower("path").endswith(query.lower())).orderBy("path").limit(extension_limit)
    terms = query.lower().replace("_", " ").replace("-", " ").split()
    if not terms:
        return files.limit(0)
    return files.where(reduce(Column.__and__, [F.lower("path").contains(t) for t in terms])).orderBy("path").limit(limit)


def expand_aliases(patterns: list[str], custom: dict[str, list[str]] | None = None, languages: list[str] = ()) -> list[str]:
    """``@name`` becomes the group's patterns; unknown names are an error, emptied groups give none.

    languages: those of the tree, in lower case; they widen the built-in tests.
    """
    tests = ALIASES["tests"] + [p for x in languages for p in TESTS_BY_LANGUAGE.get(x, [])]
    known = ALIASES | {"tests": tests} | (custom or {})
    out = []
    for p in patterns:
        if not p.startswith("@"):
            out.append(p)
        elif p[1:] in known:
            out += known[p[1:]]
        else:
            raise ValueError(f"unknown alias {p}")
    return out


def only_exclude(files: DataFrame, only: list[str] = (), exclude: list[str] = (), custom: dict[str, list[str]] | None = None, languages: list[str] = ()) -> DataFrame:
    """Files that match some ``only`` pattern (if any is given) and no ``exclude`` pattern."""
    out = files
    if only:
        out = out.where(F.col("path").rlike(any_of(expand_aliases(list(only), custom, languages))))
    if exclude:
        out = out.where(~F.col("path").rlike(any_of(expand_aliases(list(exclude), custom, languages))))
    return out


def alias_status(spark, custom: dict[str, list[str]]) -> DataFrame:
    """name, status (builtin, custom, disabled, overridden) and patterns in force."""
    rows = []
    for name in sorted(ALIASES | custom):
        status = "builtin" if name not in custom else "disabled" if not custom[name] else "overridden" if name in ALIASES else "custom"
        rows.append((name, status, custom.get(name, ALIASES.get(name))))
    return spark.createDataFrame(rows, "name string, status string, patterns array<string>")


def find_symbols(symbols: DataFrame, query: str, kind: str | None = None, fuzzy: bool = True, limit: int = 50) -> DataFrame:
    """Symbols by name, case-insensitively: exact, then prefix, then contained; shorter names first."""
    name, asked = F.lower("name"), query.lower()
    rank = F.when(name == asked, 0).when(name.startswith(asked), 1).when(name.contains(asked), 2)
    out = symbols.withColumn("rank", rank).where(F.col("rank").isNotNull() if fuzzy else F.col("rank") == 0)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out.orderBy("rank", F.length("name"), "name", "file", "start_line").limit(limit)


def search_symbols(symbols: DataFrame, path: str, pool: int = 50, limit: int = 10) -> DataFrame:
    """``file/Parent/name``: parent and file filter the ``pool`` best matches of the name."""
    *above, name = path.split("/")
    found = find_symbols(symbols, name, limit=pool)
    if above:
        found = found.where(F.lower("parent").contains(above[-1].lower()))
    if len(above) > 1:
        found = found.where(F.lower("file").contains("/".join(above[:-1]).lower()))
    return found.orderBy("rank", F.length("name"), "name", "file", "start_line").limit(limit)


def resolve_path(files: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The cascade of path lookup: exact, equal but for separators, name or stem, suffix, fuzzy."""
    from codelode.operators import fuzzy
    from codelode.operators.tiers import first_answer

    path = F.col("path")
    normal = query.lower().translate(str.maketrans("-._", "   "))
    last = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    top = (1 << 31) - 1
    exact = files.where(path == query).select("path", F.lit(top).alias("score"))
    alike = files.where(normal_path(path) == normal).orderBy("path").limit(1).select("path", F.lit(top).alias("score"))
    named = files.where((F.lower(last) == query.lower()) | (F.lower(stem) == query.lower())).select("path", F.lit(top - 1).alias("score"))
    ending = files.where(F.endswith(normal_path(path), F.lit("/" + normal))).select("path", F.lit(top - 2).alias("score"))
    near = fuzzy.ranked(files.select("path").distinct(), "path", query, limit).select("path", "score")
    return first_answer(exact, alike, named, ending, near)


def split_unified(queries: DataFrame, files: DataFrame, column: str = "query") -> DataFrame:
    """``file/Symbol``, ``file::Symbol``, ``file#Symbol``, ``file:Symbol``: the longest leading part that is a file, and the symbol path after it."""
    plain = F.regexp_replace(column, r"::|#|:", "/")
    parts = queries.select(F.col(column), F.split(plain, "/").alias("_parts"))
    tried = parts.select(column, "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("_n"))
    tried = tried.withColumn("path", F.array_join(F.slice("_parts", 1, F.col("_n")), "/"))
    hit = tried.join(files.select("path").distinct(), "path")
    best = hit.groupBy(column).agg(F.max(F.struct("_n", "path", "_parts")).alias("b"))
    found = best.select(column, F.col("b.path").alias("file"), F.slice("b._parts", F.col("b._n") + 1, F.size("b._parts")).alias("symbol_path"))
    return queries.select(column).distinct().join(found, column, "left")
