"""Directory trees, heading scopes and view slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: folders that cost no depth
BOILERPLATE = ("src", "lib", "pkg", "packages", "crates", "internal", "cmd")


def directory_tree(files: DataFrame, depth: int = 2, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Folders and files (path, kind, depth, effective_depth, files) down to an effective depth.

    Boilerplate folders cost no depth; ``files`` counts what lies below, shown or not.
    """
    parts = files.select(F.split("path", "/").alias("parts"))
    nodes = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")).select(F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("path"), F.col("n").alias("depth"), (F.col("n") == F.size("parts")).alias("leaf"), F.slice("parts", 1, F.col("n")).alias("_p"))
    out = nodes.groupBy("path").agg(F.first("depth").cast("long").alias("depth"), F.bool_and("leaf").alias("leaf"), F.count("*").alias("files"), F.first("_p").alias("_p"))
    names = F.array(*[F.lit(b) for b in boilerplate])
    effective = F.size(F.filter("_p", lambda s: ~F.array_contains(names, s))).cast("long")
    out = out.withColumn("effective_depth", effective).where(F.col("effective_depth") <= depth)
    return out.select("path", F.when(F.col("leaf"), "file").otherwise("directory").alias("kind"), "depth", "effective_depth", "files")


def collapse_chains(tree: DataFrame) -> DataFrame:
    """Folders whose only child is a folder are shown as one with it: their own rows go."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    kids = tree.withColumn("parent", parent).groupBy("parent").agg(F.count("*").alias("n"), F.max("kind").alias("k"), F.min("kind").alias("k2"))
    chained = kids.where("n = 1 and k = 'directory' and k2 = 'directory'").select(F.col("parent").alias("path"))
    return tree.join(chained, "path", "left_anti")


def heading_scopes(headings: DataFrame) -> DataFrame:
    """headings (file, line, level, title, n_lines) with end_line and parent.

    A heading ends before the next one of its level or above; its parent is
    the last earlier one of a lower level number. Six levels: one running
    minimum each way and level, no join; both ways are frames that grow by a row.
    """
    after = Window.partitionBy("file").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    next_at = {k: F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)}
    last_at = {k: F.max(F.when(F.col("level") < k, F.struct("line", "title"))).over(before) for k in range(1, 7)}
    pick = lambda values: F.coalesce(*[F.when(F.col("level") == k, F.col(f"_{k}")) for k in values])
    named = lambda values: {f"_{k}": value for k, value in values.items()}
    # all levels of a way in one window, so two sorts; the first one's values go before the second sorts
    out = headings.withColumns(named(next_at)).select("file", "line", "level", "title", F.coalesce(pick(next_at) - 1, F.col("n_lines")).alias("end_line"))
    return out.withColumns(named(last_at)).select("file", "line", "level", "title", "end_line", pick(last_at)["title"].alias("parent"))


def markdown_headings(lines: DataFrame) -> DataFrame:
    """ATX headings of markdown lines, outside fenced blocks."""
    fence = F.col("text").rlike(r"^\s*(?:```|~~~)")
    w = Window.partitionBy("file")
    marked = lines.withColumn("_f", F.sum(fence.cast("int")).over(w.orderBy("line"))).withColumn("n_lines", F.max("line").over(w))
    heads = marked.where((F.col("_f") % 2 == 0) & F.col("text").rlike(r"^#{1,6}\s+\S"))
    return heads.select("file", "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.regexp_extract("text", r"^#+\s+(.*?)\s*#*$", 1).alias("title"), "n_lines")


def line_range(lines: DataFrame, file: str, first: int, last: int, without: DataFrame | None = None) -> DataFrame:
    """Lines of a file's range, without given (file, line) rows (documentation comments)."""
    out = lines.where((F.col("file") == file) & F.col("line").between(first, last))
    return out.join(without.select("file", "line"), ["file", "line"], "left_anti") if without is not None else out


def docstring_summary(doc: Column) -> Column:
    """The first sentence or line."""
    return F.trim(F.regexp_extract(F.trim(doc), r"^([^\n]*?(?:\.(?=\s|$)|$|(?=\n)))", 1))


def says_only_name(doc: Column, name: Column) -> Column:
    """Whether a docstring repeats the name's words and nothing else."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return bare(doc) == bare(name)
