"""Graphs by iterated joins: what a round adds is joined on, until nothing new comes.

Each round's result is written, so plans stay short and a lost executor costs
a task; only whether anything is new comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.scratch import dealt, written

#: Nodes of a round that are broadcast to the edges (about 32 MB); of more, both are dealt to tasks of bounded rows.
BROADCAST_ROWS = 300_000


def reached(edges: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """(columns of seeds, depth): what can be reached over edges (source, target) from seeds (key columns..., ``source``), seeds at depth 0.

    Every node is kept once a key, at its least depth, so cycles end. Edges are
    written once; a round shuffles them only if its nodes are too many to be
    broadcast.
    """
    keys = [c for c in seeds.columns if c != source]
    node = [*keys, source]
    steps = written(edges.select(F.col(source), F.col(target).alias("_next")), "steps")
    known = written(seeds.distinct().withColumn("depth", F.lit(0)), "reached")
    fresh, depth, n_steps, n_known = known, 0, steps.count(), known.count()
    n_fresh = n_known
    while True:
        depth += 1
        rows = max(n_steps, n_known)
        if n_fresh <= BROADCAST_ROWS:
            met = steps.join(F.broadcast(fresh), source)
        else:
            met = dealt(steps, rows, source).join(dealt(fresh, rows, source), source)
        found = dealt(met.select(*keys, F.col("_next").alias(source)), rows, *node).distinct()
        left = found.join(dealt(known.select(*node), rows, *node), node, "left_anti")
        fresh = written(left.withColumn("depth", F.lit(depth)).select(*known.columns), "reached")
        n_fresh = fresh.count()
        if not n_fresh:
            return known
        known, n_known = known.unionByName(fresh), n_known + n_fresh


# ---- version control -------------------------------------------------------------------------


def merge_bases(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, commit): the common ancestors of each pair that are no ancestors of another one. parents (commit, parent), pairs (pair, a, b)."""
    edges = parents.select(F.col("commit"), "parent")
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("commit")), F.struct(F.lit("b").alias("side"), F.col("b").alias("commit")))).alias("s")).select("pair", "s.side", "s.commit")
    known = reached(edges, sides, "commit", "parent")
    common = written(known.groupBy("pair", "commit").agg(F.count_distinct("side").alias("n")).where("n = 2").select("pair", "commit"), "common")
    # all ancestors of a common one are common: those with a common child are not the last
    older = common.join(edges, "commit").select("pair", F.col("parent").alias("commit")).distinct()
    return common.join(older, ["pair", "commit"], "left_anti")


def changed_since(parents: DataFrame, touched: DataFrame, head: str, base: str) -> DataFrame:
    """(path) of the files that commits after the merge base with ``base`` touch on the way to ``head``. touched (commit, path)."""
    spark = parents.sparkSession
    kind = parents.schema["commit"].dataType.simpleString()
    seeds = spark.createDataFrame([("head", head), ("base", base)], f"side string, commit {kind}")
    known = reached(parents.select("commit", "parent"), seeds, "commit", "parent")
    own = known.where("side = 'head'").select("commit").join(known.where("side = 'base'").select("commit"), "commit", "left_anti")
    return touched.join(own, "commit", "left_semi").select("path").distinct()


# ---- re-exports ------------------------------------------------------------------------------


def exported(local: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, name, origin, origin_name, depth): all that files export, their own and, over any number of barrels, others'.

    local (file, name); reexports (file, target, name, alias): ``*`` hands on
    all of the target's names but ``default``; a name hands on itself, under its
    alias if it has one. Cycles of barrels end, each export counts once, by its
    shortest way.
    """
    key = ["file", "name", "origin", "origin_name"]
    known = written(local.select("file", "name", F.col("file").alias("origin"), F.col("name").alias("origin_name")).distinct().withColumn("depth", F.lit(0)), "exports")
    steps = reexports.select(F.col("file").alias("_by"), F.col("target").alias("file"), F.col("name").alias("_said"), "alias")
    fresh, depth = known, 0
    while True:
        depth += 1
        met = fresh.join(steps, "file").where((F.col("_said") == F.col("name")) | (F.col("_said") == "*") & (F.col("name") != "default"))
        named = F.when(F.col("_said") == "*", F.col("name")).otherwise(F.coalesce("alias", "name"))
        found = met.select(F.col("_by").alias("file"), named.alias("name"), "origin", "origin_name").distinct()
        fresh = written(found.join(known, key, "left_anti").withColumn("depth", F.lit(depth)), "exports")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def focus_view(file: str, imports: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, name, defined_in, kind, start_line, depth) of what a file's imports bring in, through barrels to the definitions.

    imports (file, target, name): ``*`` brings all exports of the target file;
    exports as :func:`exported` makes them; symbols (file, name, kind, start_line).
    """
    used = imports.where(F.col("file") == file).select(F.col("target").alias("file"), F.col("name").alias("_asked"))
    met = exports.join(used, "file").where((F.col("_asked") == "*") | (F.col("_asked") == F.col("name"))).drop("_asked").distinct()
    own = symbols.select(F.col("file").alias("origin"), F.col("name").alias("origin_name"), "kind", "start_line")
    return met.join(own, ["origin", "origin_name"], "left").select(F.col("file").alias("module"), "name", F.col("origin").alias("defined_in"), "kind", "start_line", "depth")


# ---- flows -----------------------------------------------------------------------------------


def flows(assignments: DataFrame) -> DataFrame:
    """(file, scope, variable, source, depth): all variables that a variable's values come from, directly or not, within its scope.

    assignments (file, scope, variable, flows_from).
    """
    direct = assignments.select("file", "scope", "variable", F.explode("flows_from").alias("source")).distinct()
    place = F.struct("file", "scope")
    edges = direct.select(F.struct(place.alias("place"), F.col("variable").alias("v")).alias("node"), F.struct(place.alias("place"), F.col("source").alias("v")).alias("below"))
    seeds = edges.select(F.col("node").alias("of"), F.col("below").alias("node")).distinct()
    found = reached(edges, seeds, "node", "below")
    return found.select("of.place.file", "of.place.scope", F.col("of.v").alias("variable"), F.col("node.v").alias("source"), (F.col("depth") + 1).alias("depth"))


# ---- dependency trees ------------------------------------------------------------------------


def preorder(edges: DataFrame, group: str = "project") -> DataFrame:
    """(group, position, depth, name, expanded): each group's tree in pre-order, every node expanded where it first comes.

    edges (group, parent, child, ordinal); roots are parents that are no child,
    by name. Where a node first comes is the end of the least of all paths to
    it, compared place by place; that is found by relaxing edges, a round for
    each level, and no path is listed but the least. An edge back to a node on
    its own path isn't followed.
    """
    edge = edges.select(F.col(group).alias("_g"), "parent", "child", F.col("ordinal").cast("long").alias("ordinal"))
    step = lambda o, n: F.struct(o.cast("long").alias("o"), n.cast("string").alias("n"))
    roots = edge.select("_g", F.col("parent").alias("name")).distinct().join(edge.select("_g", F.col("child").alias("name")).distinct(), ["_g", "name"], "left_anti")
    best = written(roots.select("_g", "name", F.array(step(F.lit(0), F.col("name"))).alias("way")), "ways")
    fresh = best
    while True:
        went = fresh.join(edge.withColumnRenamed("parent", "name"), ["_g", "name"]).where(~F.exists("way", lambda s: s["n"] == F.col("child")))
        found = went.groupBy("_g", F.col("child").alias("name")).agg(F.min(F.concat("way", F.array(step(F.col("ordinal"), F.col("child"))))).alias("way"))
        before = best.select("_g", "name", F.col("way").alias("_old"))
        fresh = written(found.join(before, ["_g", "name"], "left").where("_old is null or way < _old").drop("_old"), "ways")
        if fresh.isEmpty():
            break
        best = written(best.join(fresh, ["_g", "name"], "left_anti").unionByName(fresh), "ways")
    # a row for each edge of a node, where that node is expanded
    below = best.join(edge.withColumnRenamed("parent", "name"), ["_g", "name"]).select("_g", F.col("child").alias("name"), F.concat("way", F.array(step(F.col("ordinal"), F.col("child")))).alias("way"))
    rows = below.unionByName(best.where(F.size("way") == 1)).join(best.withColumnRenamed("way", "_first"), ["_g", "name"])
    place = F.expr("row_number() over (partition by _g order by way)") - 1
    return rows.select(F.col("_g").alias(group), place.cast("long").alias("position"), (F.size("way") - 1).cast("long").alias("depth"), "name", (F.col("way") == F.col("_first")).alias("expanded"))
