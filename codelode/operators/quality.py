"""Quality reports: complexity, length, health, coverage, hotspots, clones, similar types, grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.scratch import written
from codelode.functions.globs import any_of, plain_glob
from codelode.functions.text import tenths

# fixed values: bands and steps of the scores
COMPLEXITY_BANDS = ((5, "low"), (10, "moderate"), (20, "high"))
LENGTH_BANDS = ((20, "short"), (50, "medium"), (100, "long"))
COMPLEXITY_STEPS = ((3, 1.0), (5, 0.9), (7, 0.8), (10, 0.7), (15, 0.5))
RISK_STEPS = ((0.01, 1.0), (0.02, 0.9), (0.03, 0.8), (0.05, 0.7), (0.1, 0.5))
LOCKFILES = (
    "uv.lock", "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "composer.lock", "go.sum", "flake.lock",
    "packages.lock.json", "paket.lock", "pubspec.lock", "mix.lock", "rebar.lock", "Podfile.lock", "shrinkwrap.yaml", "deno.lock", "gradle.lockfile",
)


#: Names of a type that is met by two of them at once; it has 276 such keys at most.
NARROW = 24

# fixed values: folders and name endings of tests
TEST_FOLDERS = ("/tests/", "/test/", "/__tests__/")
TEST_ENDINGS = ("_test.rs", "_tests.rs", ".test.ts", ".test.js", ".spec.ts", ".spec.js")


def is_test_path(path: Column) -> Column:
    """Whether a path is a test's, by a folder below the root or by its name."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    tests = [low.contains(f) for f in TEST_FOLDERS] + [name.endswith(e) for e in TEST_ENDINGS] + [name.startswith("test_")]
    return reduce(lambda a, b: a | b, tests)


def _steps(x: Column, steps, otherwise) -> Column:
    return reduce(lambda out, step: F.when(x <= step[0], step[1]).otherwise(out), reversed(steps), F.lit(otherwise))


def complexity_band(n: Column) -> Column:
    return _steps(n, COMPLEXITY_BANDS, "critical")


def length_band(n: Column) -> Column:
    return _steps(n, LENGTH_BANDS, "too-long")


def metric_report(functions: DataFrame, metric: str, threshold: int | None = None, allowed: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """Functions (file, name, metric) over a threshold and not on the allow list, worst first.

    allowed: one column ``pattern``; a function is allowed if its qualified
    name contains one.
    """
    out = functions.where(F.col(metric) >= threshold) if threshold is not None else functions
    if allowed is not None:
        qualified = F.concat_ws(":", "file", "name")
        out = out.join(allowed.select("pattern"), qualified.contains(F.col("pattern")), "left_anti")
    out = out.withColumn("risk", complexity_band(F.col(metric)) if metric == "complexity" else length_band(F.col(metric)))
    return out.orderBy(F.desc(metric), "file", "name").limit(limit) if limit is not None else out


def metric_stats(functions: DataFrame, metric: str) -> DataFrame:
    """One row over all functions, before any limit: totals, mean, maximum, high and critical counts, score."""
    high, critical = (("high", "critical") if metric == "complexity" else ("long", "too-long"))
    band = complexity_band(F.col(metric)) if metric == "complexity" else length_band(F.col(metric))
    out = functions.select(F.col(metric).alias("m"), band.alias("band")).agg(
        F.count("*").alias("total_count"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("total_avg"), F.coalesce(F.max("m"), F.lit(0)).cast("long").alias("total_max"),
        F.count_if(F.col("band") == critical).alias("critical_count"), F.count_if(F.col("band") == high).alias("high_count"),
    )
    share = lambda bad: F.when(F.col("total_count") > 0, 100.0 * (1 - bad / F.col("total_count"))).otherwise(100.0)
    return out.withColumns({"score": share(F.col("high_count")), "score_strict": share(F.col("high_count") + F.col("critical_count"))})


def health(files: DataFrame, functions: DataFrame, allow: list[str] = (), large: int = 500) -> DataFrame:
    """One row: files, lines, complexity figures, large files, score and grade.

    files (path, language, lines); functions (complexity). Lock files and
    allowed globs don't count as large.
    """
    name = F.substring_index("path", "/", -1)
    counted = ~name.isin(*LOCKFILES) & ~F.col("path").rlike(any_of(list(allow), plain_glob))
    big = lambda lo, hi=None: F.count_if(counted & (F.col("lines") >= lo) & (F.lit(True) if hi is None else F.col("lines") < hi))
    of_files = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), big(large).alias("large_files"), big(1000, 2000).alias("very_large"), big(2000).alias("massive"))
    of_functions = metric_stats(functions, "complexity").select("total_count", F.col("total_avg").alias("avg_complexity"), "total_max", (F.col("high_count") + F.col("critical_count")).alias("risky"))
    # one row each
    row = of_files.crossJoin(of_functions)
    risk = F.when(F.col("total_count") > 0, F.col("risky") / F.col("total_count")).otherwise(0.0)
    size = F.when(F.col("massive") > 0, F.greatest(F.lit(0.3), 0.5 - 0.1 * F.col("massive"))).when(F.col("very_large") > 5, 0.5).when(F.col("very_large") > 0, 0.7).otherwise(1.0)
    score = 0.3 * _steps(F.col("avg_complexity"), COMPLEXITY_STEPS, 0.3) + 0.3 * _steps(risk, RISK_STEPS, 0.3) + 0.4 * size
    return row.withColumn("score", F.round(score, 6)).withColumn("grade", letter(F.col("score") * 100))


def letter(score: Column) -> Column:
    whole = F.floor(F.round(score, 6))
    return F.when(whole >= 90, "A").when(whole >= 80, "B").when(whole >= 70, "C").when(whole >= 60, "D").otherwise("F")


def languages_by_lines(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def longest_files(files: DataFrame, limit: int = 20) -> DataFrame:
    return files.orderBy(F.desc("lines"), "path").limit(limit).select("path", "language", "lines")


def doc_coverage(callables: DataFrame, by: str) -> DataFrame:
    """documented, total and percent (to a tenth) of callables (documented boolean) by a column."""
    out = callables.groupBy(by).agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"))
    return out.withColumn("percent", tenths(100.0 * F.col("documented") / F.col("total")))


def worst_documented(callables: DataFrame, limit: int = 10) -> DataFrame:
    """Files by the mean of a Beta(1, 1) posterior of being documented, lowest first."""
    out = callables.groupBy("file").agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"))
    return out.withColumn("estimate", (F.col("documented") + 1) / (F.col("total") + 2)).orderBy("estimate", "file").limit(limit)


def overall_coverage(callables: DataFrame) -> DataFrame:
    """One row; an empty set counts as nothing documented."""
    out = callables.agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"))
    return out.withColumn("percent", F.when(F.col("total") > 0, tenths(100.0 * F.col("documented") / F.col("total"))).otherwise(0.0))


def hotspots(numstat: DataFrame, files: DataFrame | None = None, exclude: list[str] = (), limit: int = 20) -> DataFrame:
    """Paths by commits x sqrt(changed lines). numstat (path, added, deleted)."""
    out = numstat
    if exclude:
        out = out.where(~F.col("path").rlike(any_of(list(exclude), plain_glob)))
    out = out.groupBy("path").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    if files is not None:
        out = out.join(files.select("path"), "path", "left_semi")
    score = F.col("commits") * F.sqrt(F.col("added") + F.col("deleted"))
    return out.withColumn("score", tenths(score)).orderBy(F.desc("score"), "path").limit(limit)


def clone_groups(functions: DataFrame, allowed: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Groups of functions (hash, file, name, start_line, line_count) of one hash.

    A group goes only if the allow list (file, name) holds all its members.
    Members are counted, and the first named; nothing collects a group.
    """
    marked = functions.withColumn("ok", F.lit(False))
    if allowed is not None:
        marked = functions.join(allowed.select("file", "name", F.lit(True).alias("ok")), ["file", "name"], "left").fillna(False, ["ok"])
    first = F.min(F.struct("file", "start_line", "name", "line_count")).alias("f")
    out = marked.groupBy("hash").agg(F.count("*").alias("members"), F.bool_and("ok").alias("all_ok"), first).where((F.col("members") >= least) & ~F.col("all_ok"))
    return out.select("hash", "members", F.col("f.line_count").alias("line_count"), F.col("f.file").alias("first_file"), F.col("f.name").alias("first_name"))


def clone_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("functions"), F.coalesce(F.sum(F.col("members") * F.col("line_count")), F.lit(0)).alias("lines"))


def _meeting(listed: DataFrame, wide: bool) -> DataFrame:
    """(small, large): pairs of types that may share as many names as the smaller one needs, once each; see :func:`similar_types`.

    listed (type, size, need, names), the names from rare to frequent; wide: whether
    there are types of more than ``NARROW`` names, or such that need but one.
    """
    narrow, short = F.size("names") <= NARROW, (F.size("names") <= NARROW) & (F.col("need") >= 2)
    prefix = lambda n: F.slice("names", 1, (F.size("names") - F.col("need") + n).cast("int"))
    small = lambda rows, keys: rows.where(F.col("need") <= F.size("names")).select(F.explode(keys).alias("key"), F.col("type").alias("small"), F.col("size").alias("small_size"))
    large = lambda rows, keys: rows.select(F.explode(keys).alias("key"), F.col("type").alias("large"), F.col("size").alias("large_size"))
    # all types have one order of names, so two common names make the same key in both
    twos = lambda names: F.flatten(F.transform(names, lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.xxhash64(x, y))))
    joins = [(small(listed.where(short), twos(prefix(2))), large(listed.where(narrow), twos(F.col("names"))))]
    if wide:
        joins += [(small(listed.where(~short), prefix(1)), large(listed, F.col("names"))), (small(listed.where(short), prefix(1)), large(listed.where(~narrow), F.col("names")))]
    met = reduce(DataFrame.unionByName, [a.join(b, "key").where("small_size < large_size or (small_size = large_size and small < large)").select("small", "large") for a, b in joins])
    return met.distinct()


def similar_types(fields: DataFrame, threshold: int = 70, least: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """Pairs of types whose shared fields make ``threshold`` percent of the smaller one.

    fields (type, name): repeated names count in a type's size, but once as
    shared. Names are ranked by how rare they are. Of a pair over the threshold
    the smaller type, with d distinct names, needs c = ceil(t * size / 100) in
    common, so its d - c + 1 rarest names hold one of them, and its d - c + 2
    rarest two. Types of up to ``NARROW`` names therefore meet by two names at
    once, of which few other types have both; wider ones, and those that need
    but one name, meet by one. Candidates are pairs of ids; the names come back
    for those alone. Types of equal name are no pair.
    """
    if threshold <= 0:
        raise ValueError("a threshold over 0 is needed")
    need = F.ceil(F.lit(threshold) * F.col("size") / 100.0)
    own = fields.where("type is not null").groupBy("type", "name").agg(F.count("*").alias("n"))
    own = own.groupBy("type").agg(F.sum("n").alias("size"), F.collect_list("name").alias("names")).where((F.col("size") >= least) & (F.size("names") > 0))
    own = written(own, "type-names")
    each = own.select("type", "size", F.explode("names").alias("name"))
    ranked = each.join(each.groupBy("name").agg(F.count("*").alias("df")), "name").groupBy("type", "size").agg(F.array_sort(F.collect_list(F.struct("df", "name"))).alias("names"))
    # both sides of the pairs and verification read this table
    listed = written(ranked.select("type", "size", need.alias("need"), F.transform("names", lambda x: x["name"]).alias("names")), "types")
    wide = not listed.where((F.size("names") > NARROW) | (F.col("need") < 2)).isEmpty()
    held = lambda c: listed.select(F.col("type").alias(c), F.col("names").alias(f"names_{c}"), F.col("size").alias(f"size_{c}"))
    common = F.size(F.array_intersect("names_small", "names_large"))
    out = _meeting(listed, wide).join(held("small"), "small").join(held("large").drop("size_large"), "large").withColumn("common", common.cast("long"))
    out = out.withColumn("overlap", F.expr("(common * 100) div size_small")).where(F.col("overlap") >= threshold)
    out = out.select(F.least("small", "large").alias("type_a"), F.greatest("small", "large").alias("type_b"), "common", "overlap")
    if allowed is not None:
        out = out.join(allowed.select(F.least("a", "b").alias("type_a"), F.greatest("a", "b").alias("type_b")), ["type_a", "type_b"], "left_anti")
    return out.select("type_a", "type_b", "common", "overlap")


SEVERITY = {"error": "critical", "warning": "high", "info": "medium", "hint": "low"}


def security_counts(findings: DataFrame) -> DataFrame:
    """One row of counts by severity, zero where there are none, and the score."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    out = findings.agg(*[count(s) for s in ("critical", "high", "medium", "low")])
    lost = 40 * F.col("critical") + 20 * F.col("high") + 10 * F.col("medium") + 5 * F.col("low")
    return out.withColumn("score", F.greatest(F.lit(0), 100 - lost).cast("long"))


def overall_grade(scores: DataFrame) -> DataFrame:
    """scores (score, weight) to one row: weighted mean and letter."""
    out = scores.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"))
    return out.withColumn("score", F.round("score", 6)).withColumn("grade", letter(F.col("score")))


def clone_score(groups: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 5 * groups)
