"""Package analytics: dependency trees and paths, versions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators import graphs


def version_pair(text: Column) -> Column:
    """major and minor of a dotted version as a comparable struct."""
    parts = F.split(F.regexp_replace(text, "^[vV]", ""), r"\.")
    number = lambda k: F.coalesce(F.try_to_number(F.regexp_extract(F.get(parts, k), r"^\d+", 0), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(number(0).alias("major"), number(1).alias("minor"))


def version_numbers(text: Column) -> Column:
    """All dotted numbers of a version, for comparison as an array."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("long"))


def in_range(version: Column, least: Column, most: Column) -> Column:
    """least <= version <= most by (major, minor); a null upper end is open."""
    return (version >= least) & (most.isNull() | (version <= most))


def package_symbols(packages: DataFrame, symbols: DataFrame, version: tuple[int, int]) -> DataFrame:
    """Symbols of the packages whose version range holds ``version``, by package and line."""
    v = F.struct(F.lit(version[0]).alias("major"), F.lit(version[1]).alias("minor"))
    least = F.struct(F.col("min_major").alias("major"), F.col("min_minor").alias("minor"))
    most = F.when(F.col("max_major").isNotNull(), F.struct(F.col("max_major").alias("major"), F.coalesce("max_minor", F.lit(1 << 30)).alias("minor")))
    held = packages.where(in_range(v, least, most))
    return symbols.join(held.select(F.col("id").alias("package_id"), F.col("name").alias("package")), "package_id")


def dependency_paths(edges: DataFrame, roots: DataFrame, target: str, levels: int = 60) -> DataFrame:
    """All paths from roots (name) over edges (parent, child) to the target; a path ends at its first hit.

    A target also matches names that end in ``/target``. Cycles are not walked twice.
    """
    spark = edges.sparkSession
    said = "'" + target.replace("\\", "\\\\").replace("'", "\\'") + "'"
    is_hit = lambda c: f"({c} = {said} OR endswith({c}, concat('/', {said})))"
    return spark.sql(
        f"""
        WITH RECURSIVE walk(name, path, hit) MAX RECURSION LEVEL {int(levels)} AS (
          SELECT name, array(name), {is_hit('name')} FROM {{roots}}
          UNION ALL
          SELECT e.child, concat(w.path, array(e.child)), {is_hit('e.child')}
          FROM walk w JOIN {{edges}} e ON e.parent = w.name
          WHERE NOT w.hit AND NOT array_contains(w.path, e.child))
        SELECT array_join(path, ' > ') AS path, CAST(size(path) - 1 AS BIGINT) AS depth FROM walk WHERE hit
        """,
        edges=edges,
        roots=roots,
    )


def dependency_tree(edges: DataFrame, project_col: str = "project") -> DataFrame:
    """Pre-order rows (depth, position) of each project's tree; a package is expanded at its first occurrence only.

    edges (project, parent, child, ordinal), roots are parents that are no child.
    """
    return graphs.preorder(edges, project_col)


def outdated(installed: DataFrame, latest: DataFrame) -> DataFrame:
    """Packages (name, installed, latest) that are not installed in their latest version."""
    return latest.join(installed, "name", "left").where("installed is null or installed <> latest").select("name", "installed", "latest")


def audit(vulnerabilities: DataFrame) -> DataFrame:
    """Counts by severity, and whether any is critical or high (one row)."""
    count = lambda s: F.count_if(F.lower("severity") == s).alias(s)
    out = vulnerabilities.agg(*[count(s) for s in ("critical", "high", "medium", "low")])
    return out.withColumn("fails", (F.col("critical") + F.col("high")) > 0)


def search_registry(packages: DataFrame, query: str, descriptions: bool = False) -> DataFrame:
    hit = F.col("name").ilike(f"%{query}%")
    return packages.where(hit | F.col("description").ilike(f"%{query}%") if descriptions else hit)


def first_by_name(rows: DataFrame, order: str = "line") -> DataFrame:
    """The first row of each name in an append-only listing."""
    others = [c for c in rows.columns if c != "name"]
    return rows.groupBy("name").agg(F.min_by(F.struct(*others), order).alias("r")).select("name", *[F.col(f"r.{c}").alias(c) for c in others])
