"""Views over the index: symbols by path, at a line, by kind; skeletons, previews, folders, scopes of a report.

symbols (file, name, kind, start_line, end_line, parent), lines (file, line, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.globs import ignore_glob, plain_glob
from codelode.functions.text import extension
from codelode.operators import callgraph, graphs, nested, quality, search

# fixed values: kinds that hold others, in a skeleton of types
TYPE_KINDS = ("class", "struct", "enum", "trait", "interface", "type", "module")
#: Lines or members that a preview shows.
PREVIEW = 20


def symbol_path() -> Column:
    """``parent/name``, or the name of a top-level symbol."""
    return F.concat_ws("/", "parent", "name")


def symbol_glob(symbols: DataFrame, pattern: str, file: str | None = None) -> DataFrame:
    """Symbols whose path matches the pattern, by file and line."""
    own = symbols if file is None else symbols.where(F.col("file") == file)
    return own.withColumn("path", symbol_path()).where(F.col("path").rlike(plain_glob(pattern))).orderBy("file", "start_line", "path")


def find_exact(symbols: DataFrame, name: str) -> DataFrame:
    """Definitions of exactly this name (case counts)."""
    return symbols.where(F.col("name") == name).select("file", "kind", "start_line", "end_line")


def of_kind(symbols: DataFrame, kind: str, folder: str = "") -> DataFrame:
    """Symbols of a kind in files below a folder, by file and line."""
    return symbols.where((F.col("kind") == kind) & F.col("file").startswith(folder)).select("file", "start_line", "name", "parent").orderBy("file", "start_line", "name")


def at_line(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (file, line) with the path of the innermost symbol around the line (parent included)."""
    spans = symbols.withColumn("name", symbol_path()).select("file", "name", "start_line", "end_line")
    return search.enclosing(hits, spans, ["file", "line"])


def ancestors_at(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (file, line) with the names of all symbols around the line, the outermost first; lines outside of all are left out."""
    spans = symbols.select("file", "name", "start_line", "end_line")
    met = nested.around(spans, hits.select("file", "line").distinct(), "file", "start_line", "end_line", "line")
    names = F.array_sort(F.collect_list(F.struct("depth", F.col("around.name").alias("name"))))
    return met.groupBy("file", "line").agg(names.alias("n")).select("file", "line", F.transform("n", lambda x: x["name"]).alias("symbols"))


def route(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, view, file, symbol, line) of targets: how each is to be shown.

    A path is a file's skeleton, a folder is a tree, ``file:12`` is the symbol
    at that line, a file and a symbol behind ``#``, ``::``, ``:`` or ``/`` is
    the symbol's source, ``@name`` is a group of paths, anything else a search.
    Each kind is an equi-join with the files or their folders.
    """
    asked = targets.select("target").distinct()
    path = files.select(F.col("path").alias("file")).distinct()
    parts = F.split("file", "/")
    above = path.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_folder")).distinct()
    bare = F.regexp_replace("target", r"/+$", "")
    numbered = asked.select("target", F.regexp_extract("target", r"^(.+):(\d+)$", 1).alias("file"), F.nullif(F.regexp_extract("target", r"^(.+):(\d+)$", 2), F.lit("")).cast("long").alias("line"))
    at = numbered.where("line is not null").join(path, "file").select("target", F.lit("line").alias("view"), "file", F.lit(None).cast("string").alias("symbol"), "line", F.lit(1).alias("_rank"))
    none = (F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("long").alias("line"))
    whole = asked.withColumn("file", bare).join(path, "file").select("target", F.lit("file").alias("view"), "file", *none, F.lit(0).alias("_rank"))
    folders = asked.withColumn("_folder", bare).join(above, "_folder").select("target", F.lit("folder").alias("view"), F.col("_folder").alias("file"), *none, F.lit(0).alias("_rank"))
    split = search.split_unified(asked.withColumnRenamed("target", "query"), files.select("path")).where("file is not null and size(symbol_path) > 0")
    symbol = split.select(F.col("query").alias("target"), F.lit("symbol").alias("view"), "file", F.array_join("symbol_path", "/").alias("symbol"), F.lit(None).cast("long").alias("line"), F.lit(2).alias("_rank"))
    found = whole.unionByName(folders).unionByName(at).unionByName(symbol)
    first = found.groupBy("target").agg(F.min_by(F.struct("view", "file", "symbol", "line"), F.struct("_rank", "view")).alias("r"))
    other = F.when(F.col("target").startswith("@"), "alias").otherwise("search")
    return asked.join(first, "target", "left").select("target", F.coalesce("r.view", other).alias("view"), "r.file", "r.symbol", "r.line")


def allow_added(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """An allow file (line, text) with wanted texts (text, reason) that it doesn't have yet behind its last line, each below its reason's comment, by text."""
    have = entries.select(F.trim("text").alias("text")).where("text <> '' and not startswith(text, '#')").distinct()
    fresh = wanted.groupBy(F.trim("text").alias("text")).agg(F.min("reason").alias("reason")).join(have, "text", "left_anti")
    said = F.when(F.col("reason").isNotNull(), F.array(F.concat(F.lit("# "), "reason"), "text")).otherwise(F.array("text"))
    # a stated list of what is to be allowed
    rows = fresh.select("text", F.posexplode(said).alias("k", "said")).withColumn("_n", F.row_number().over(Window.orderBy("text", "k")))
    last = entries.agg(F.coalesce(F.max("line"), F.lit(0)).alias("_last"))
    added = rows.crossJoin(F.broadcast(last)).select((F.col("_last") + F.col("_n")).cast("long").alias("line"), F.col("said").alias("text"))
    return entries.select(F.col("line").cast("long").alias("line"), "text").unionByName(added)


def type_skeleton(symbols: DataFrame) -> DataFrame:
    """Types that are top-level or stand in kept types; whatever is below anything else goes, types too."""
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS))
    # names below names, from the top-level ones down
    inside = types.where("parent is not null").select(F.struct("file", F.col("parent").alias("name")).alias("node"), F.struct("file", "name").alias("below"))
    kept = graphs.reached(inside, types.where("parent is null").select(F.struct("file", "name").alias("node")), "node", "below")
    parents = kept.select("node.file", F.col("node.name").alias("parent"))
    return types.where("parent is null").unionByName(types.join(parents, ["file", "parent"], "left_semi").select(*types.columns))


def file_skeleton(symbols: DataFrame, imports: DataFrame, file: str) -> DataFrame:
    """(section, name, line, detail) of one file: imports, then exports, then its symbols."""
    used = imports.where(F.col("file") == file).select(F.lit("import").alias("section"), "name", "line", F.col("module").alias("detail"))
    own = symbols.where(F.col("file") == file)
    public = own.where("parent is null").select(F.lit("export").alias("section"), "name", F.col("start_line").alias("line"), F.col("kind").alias("detail"))
    members = own.select(F.lit("symbol").alias("section"), symbol_path().alias("name"), F.col("start_line").alias("line"), F.col("kind").alias("detail"))
    return used.union(public).union(members)


def symbol_source(lines: DataFrame, symbols: DataFrame, file: str, name: str) -> DataFrame:
    """The lines of a symbol's definitions in a file; a name may be a path."""
    spans = symbols.where((F.col("file") == file) & ((symbol_path() == name) | (F.col("name") == name))).select("start_line", "end_line").distinct()
    own = lines.where(F.col("file") == file)
    # one file's definitions of one name
    numbers = spans.select(F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    return own.join(numbers, "line", "left_semi").select("line", "text").orderBy("line")


def previews(lines: DataFrame, spans: DataFrame, most: int = PREVIEW) -> DataFrame:
    """(file, name, preview, hidden): the first lines of each span, and how many more it has."""
    numbers = spans.select("file", "name", "start_line", "end_line", F.explode(F.sequence("start_line", F.least("end_line", F.col("start_line") + most - 1))).alias("line"))
    shown = numbers.join(lines, ["file", "line"]).groupBy("file", "name", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return shown.select("file", "name", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("preview"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1 - most).cast("long").alias("hidden"))


def folder_view(files: DataFrame, keep: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(path, kind, files) of folders and files that survive a filter (keep: path); empty folders go."""
    left = files if keep is None else files.join(keep.select("path").distinct(), "path", "left_semi")
    parts = left.select(F.split("path", "/").alias("p"))
    nodes = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    if depth is not None:
        nodes = nodes.where(F.col("n") <= depth)
    nodes = nodes.select(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("path"), (F.col("n") == F.size("p")).alias("leaf"))
    out = nodes.groupBy("path").agg(F.bool_and("leaf").alias("leaf"), F.count("*").alias("files"))
    return out.select("path", F.when(F.col("leaf"), "file").otherwise("directory").alias("kind"), "files")


# ---- scopes ----------------------------------------------------------------------------------


def markdown_files(files: DataFrame) -> DataFrame:
    """Markdown files, none of whose path segments starts with a dot."""
    return files.where(F.col("path").rlike(r"\.md$") & ~F.col("path").rlike(r"(?:^|/)\."))


def with_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files with one of the extensions (source files of the known languages)."""
    return files.where(extension(F.col("path")).isin(*extensions))


def changed_only(report: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """Rows of a report whose file is among the changed ones (path), as a version-control range names them."""
    return report.join(changed.select(F.col("path").alias(key)).distinct(), key, "left_semi")


def project_languages(files: DataFrame, languages: DataFrame, depth: int = 5) -> DataFrame:
    """Languages (language, files) of a tree's files down to a depth. languages (extension, language)."""
    near = files.where(F.size(F.split("path", "/")) <= depth).select(extension(F.col("path")).alias("extension"))
    return near.join(F.broadcast(languages), "extension").groupBy("language").agg(F.count("*").alias("files"))


def glob_report(functions: DataFrame, pattern: str, metric: str) -> DataFrame:
    """A metric report over all files that match a pattern, without a limit."""
    return quality.metric_report(functions.where(F.col("file").rlike(ignore_glob(pattern))), metric, limit=None)


def storage(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of the top-level folders. files (path, size)."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return files.groupBy(top.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# ---- targets ---------------------------------------------------------------------------------


def split_target(target: str) -> tuple[str | None, str]:
    """(file, symbol) of ``file#symbol``, ``file::symbol``, ``file:symbol`` or a bare symbol."""
    for sign in ("#", "::", ":"):
        file, found, symbol = target.partition(sign)
        if found and file and symbol:
            return file, symbol
    return None, target


def expand_sigil(query: str, aliases: dict[str, list[str]]) -> list[tuple[str, str]] | None:
    """(path, suffix) for each path of ``@name`` followed by ``/``, ``:``, ``::`` or ``#`` and a suffix; None if unknown."""
    if not query.startswith("@"):
        return None
    end = next((k for k, c in enumerate(query[1:], 1) if not (c.isalnum() or c in "_-")), len(query))
    name, rest = query[1:end], query[end:]
    for sign in ("::", "/", ":", "#"):
        if rest.startswith(sign):
            rest = rest.removeprefix(sign)
            break
    return [(p, rest) for p in aliases[name]] if name in aliases else None


def callees_resolved(calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame, file: str, symbol: str) -> DataFrame:
    """Callees (callee_name, line) with the module and original name that an import gives them."""
    # the file stays a column: a literal would take the joins' keys away
    own = calls.where((F.col("caller_file") == file) & (F.col("caller_symbol") == symbol)).select(F.col("caller_file").alias("file"), F.col("callee_name").alias("name"), "line")
    found = callgraph.resolve_imports(own, imports.where(F.col("file") == file), symbols, files).select("file", "name", "module", "original")
    return own.join(found, ["file", "name"], "left").select(F.col("name").alias("callee_name"), "line", "module", "original")


def call_graph(calls: DataFrame, symbols: DataFrame, imports: DataFrame, target: str, callers: bool = True, callees: bool = True) -> DataFrame:
    """(file, symbol, line, direction) around a target, by file and line."""
    file, symbol = split_target(target)
    parts = []
    if callers:
        parts.append(callgraph.find_callers(calls, symbols, imports, symbol).select(F.col("caller_file").alias("file"), F.col("caller_symbol").alias("symbol"), "line", F.lit("caller").alias("direction")))
    if callees:
        home = symbols.where(F.col("name") == symbol).agg(F.min("file").alias("caller_file")) if file is None else symbols.sparkSession.createDataFrame([(file,)], "caller_file string")
        # one row
        own = calls.where(F.col("caller_symbol") == symbol).join(F.broadcast(home), "caller_file")
        parts.append(own.select(F.col("caller_file").alias("file"), F.col("callee_name").alias("symbol"), "line", F.lit("callee").alias("direction")))
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out.orderBy("file", "line", "symbol", "direction")


def signatures_of(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (file, name, ...) with a signature: of the same file, else of the first file that has the name."""
    here = symbols.groupBy("file", "name").agg(F.min_by("signature", "start_line").alias("_own"))
    there = symbols.groupBy("name").agg(F.min_by("signature", F.struct("file", "start_line")).alias("_other"))
    return calls.join(here, ["file", "name"], "left").join(there, "name", "left").withColumn("signature", F.coalesce("_own", "_other")).drop("_own", "_other")


def fuzzy_symbols(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Symbols whose name holds the query's letters in order: exact, prefix, part, then by the gaps between the letters."""
    name, asked = F.lower("name"), query.lower()
    spread = F.length(F.regexp_extract(name, ".*?".join(f"\\Q{c}\\E" for c in asked), 0))
    score = F.when(name == asked, 1000).when(name.startswith(asked), 500).when(name.contains(asked), 300).when(spread > 0, F.greatest(F.lit(1), 200 - 10 * (spread - len(asked))))
    return symbols.withColumn("score", score.cast("long")).where("score is not null").orderBy(F.desc("score"), F.length("name"), "name", "file", "start_line").limit(limit)


# ---- reports ---------------------------------------------------------------------------------


def metric_sarif(report: DataFrame, rule: str, metric: str) -> DataFrame:
    """Findings (rule_id, severity, message, file, line) of the high and critical rows of a metric report."""
    level = F.when(F.col("risk").isin("critical", "too-long"), "error").when(F.col("risk").isin("high", "long"), "warning")
    message = F.concat(F.lit(f"{metric} of "), F.col("name"), F.lit(" is "), F.col(metric).cast("string"))
    return report.withColumn("severity", level).where("severity is not null").select(F.lit(rule).alias("rule_id"), "severity", message.alias("message"), "file", F.coalesce("start_line", F.lit(1)).cast("long").alias("line"))


def ordered_clones(groups: DataFrame, limit: int | None = 20) -> DataFrame:
    """Clone groups, longest first, then the largest."""
    out = groups.orderBy(F.desc("line_count"), F.desc("members"), "hash")
    return out.limit(limit) if limit is not None else out


def ordered_findings(findings: DataFrame, limit: int = 20) -> DataFrame:
    """Security findings, the worst first. findings (severity, file, line, ...)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), F.col("severity"))
    return findings.orderBy(F.when(rank > 0, rank).otherwise(9), "file", "line").limit(limit)


def merged_sessions(stats: DataFrame) -> DataFrame:
    """Statistics of sessions (path, calls, errors, tokens, min_context, max_context) as one row: sums, least and greatest; a least of 0 is none."""
    return stats.agg(F.count("*").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("calls", "errors", "tokens")], F.min(F.when(F.col("min_context") > 0, F.col("min_context"))).alias("min_context"), F.max("max_context").alias("max_context"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """(kind, key, n, errors) over all sessions of counts (path, kind, key, n, errors): messages by role, calls and errors by tool, tokens by kind, tokens by file."""
    return counts.groupBy("kind", "key").agg(F.sum("n").cast("long").alias("n"), F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"))


def merge_impls(symbols: DataFrame) -> DataFrame:
    """Methods of ``impl`` blocks under the struct or enum of that name; blocks without one become modules."""
    types = symbols.where(F.col("kind").isin("struct", "enum")).select("file", F.col("name").alias("_type"), F.col("start_line").alias("_line"))
    blocks = symbols.where("kind = 'impl'").join(types.groupBy("file", "_type").agg(F.min("_line").alias("_line")), [symbols["file"] == types["file"], F.col("name") == F.col("_type")], "left").drop(types["file"])
    orphans = blocks.where("_type is null").select(*[F.lit("module").alias("kind") if c == "kind" else F.col(c) for c in symbols.columns])
    return symbols.where("kind <> 'impl'").unionByName(orphans)


def with_help(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings with their rule's help address. rules (rule_id, help_uri)."""
    return findings.join(rules.select("rule_id", "help_uri"), "rule_id", "left")
