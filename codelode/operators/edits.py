"""Structural edits on versioned text, and their history.

Edits are rows (edit_id, file, action, start_line, end_line, content,
position); lines count from 1, both ends included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import split_lines
from codelode.operators import graphs
from codelode.scratch import dealt

ACTIONS = ("delete", "replace", "insert")


def conflicts(edits: DataFrame) -> DataFrame:
    """Pairs of edits of one file whose ranges overlap.

    Ranges are dealt to blocks of 64 lines, so the join has equality keys.
    """
    dealt = edits.select("edit_id", "file", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / 64), F.floor(F.col("end_line") / 64))).alias("block"))
    a, b = (dealt.select("file", "block", *[F.col(c).alias(f"{c}_{s}") for c in ("edit_id", "start_line", "end_line")]) for s in "ab")
    met = a.join(b, ["file", "block"]).where("edit_id_a < edit_id_b and start_line_a <= end_line_b and start_line_b <= end_line_a")
    return met.select("file", "edit_id_a", "edit_id_b").distinct()


def problems(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Reasons against a batch (edit_id, reason): unknown action, file or range, place of an insert, overlap."""
    sized = edits.join(files.select("file", F.size(split_lines(F.col("content"))).alias("n_lines")), "file", "left")
    reason = (
        F.when(~F.col("action").isin(*ACTIONS), "unknown action")
        .when(F.col("n_lines").isNull(), "no such file")
        .when((F.col("start_line") < 1) | (F.col("end_line") > F.col("n_lines")) | (F.col("end_line") < F.col("start_line")), "no such lines")
        .when((F.col("action") == "insert") & ~F.coalesce(F.col("position").isin("before", "after"), F.lit(False)), "insert before or after only")
    )
    own = sized.select("edit_id", reason.alias("reason")).where("reason is not null")
    return own.union(conflicts(edits).select(F.col("edit_id_b").alias("edit_id"), F.lit("overlap").alias("reason")))


def apply_batch(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (file, content) after all edits, from the bottom up; any problem of the batch leaves all files as they are.

    Replaced and inserted text takes the indent of the first line it replaces
    or stands beside.
    """
    blocked = problems(edits, files).agg((F.count("*") > 0).alias("_blocked"))
    per = edits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "action", "content", "position")), asc=False).alias("_edits"))
    lines = split_lines(F.col("content"))

    def put(state, e):
        first, last = e["start_line"].cast("int"), e["end_line"].cast("int")
        indent = F.regexp_extract(F.get(state, first - 1), r"^\s*", 0)
        body = F.transform(split_lines(e["content"]), lambda t: F.when(t == "", t).otherwise(F.concat(indent, t)))
        head = lambda n: F.slice(state, 1, n)
        tail = lambda n: F.slice(state, n + 1, F.greatest(F.size(state) - n, F.lit(0)))
        return (
            F.when(e["action"] == "delete", F.concat(head(first - 1), tail(last)))
            .when(e["action"] == "replace", F.concat(head(first - 1), body, tail(last)))
            .when(e["position"] == "before", F.concat(head(first - 1), body, tail(first - 1)))
            .otherwise(F.concat(head(last), body, tail(last)))
        )

    closing = F.when(F.endswith("content", F.lit("\n")), "\n").otherwise("")
    done = F.concat(F.array_join(F.aggregate("_edits", lines, put), "\n"), closing)
    # one row
    out = files.join(per, "file", "left").crossJoin(F.broadcast(blocked))
    return out.select("file", F.when(F.col("_edits").isNull() | F.col("_blocked"), F.col("content")).otherwise(done).alias("content"))


def history(log: DataFrame, file: str | None = None) -> DataFrame:
    """Edits newest first (id counts from the oldest). log (seq, operation, target, files, ...)."""
    out = log.withColumn("id", F.row_number().over(Window.orderBy("seq")))
    if file is not None:
        out = out.where(F.array_contains("files", file))
    return out.orderBy(F.desc("id"))


def current(versions: DataFrame) -> DataFrame:
    """Latest content of each file. versions (file, version, operation, content, git_head)."""
    latest = versions.groupBy("file").agg(F.max_by(F.struct("version", "operation", "content", "git_head"), "version").alias("v"))
    return latest.select("file", "v.*")


def undo(versions: DataFrame, git_head: str | None = None, force: bool = False) -> DataFrame:
    """The versions that an undo adds: for each file the content before its last edit that stands.

    An undo is itself a version. Each undo takes back one more edit, and each
    redo one less, so the edit to take back is found by walking the count of
    both. Files at another ``git_head`` are refused unless forced.
    """
    edits = versions.where("operation not in ('undo', 'redo')")
    steps = versions.groupBy("file").agg(F.max(F.when(~F.col("operation").isin("undo", "redo"), F.col("version"))).alias("last_edit"), F.max("version").alias("top"), F.max_by("git_head", "version").alias("head"))
    since = versions.join(steps, "file").where("version > last_edit").groupBy("file").agg(F.sum(F.when(F.col("operation") == "undo", 1).otherwise(-1)).alias("back"))
    ranked = edits.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("version"))))
    wanted = steps.join(since, "file", "left").withColumn("rank", F.coalesce("back", F.lit(0)) + 2)
    if git_head is not None and not force:
        wanted = wanted.where(F.col("head") == git_head)
    out = wanted.join(ranked.select("file", "rank", "content"), ["file", "rank"])
    return out.select("file", (F.col("top") + 1).alias("version"), F.lit("undo").alias("operation"), "content", F.col("head").alias("git_head"))


def redo(versions: DataFrame) -> DataFrame:
    """The versions that a redo adds; only where the last operation was an undo."""
    steps = versions.groupBy("file").agg(F.max(F.when(~F.col("operation").isin("undo", "redo"), F.col("version"))).alias("last_edit"), F.max("version").alias("top"), F.max_by(F.struct("operation", "git_head"), "version").alias("last"))
    since = versions.join(steps, "file").where("version > last_edit").groupBy("file").agg(F.sum(F.when(F.col("operation") == "undo", 1).otherwise(-1)).alias("back"))
    ranked = versions.where("operation not in ('undo', 'redo')").withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("version"))))
    out = steps.where("last.operation = 'undo'").join(since, "file").withColumn("rank", F.col("back")).where("rank >= 1").join(ranked.select("file", "rank", "content"), ["file", "rank"])
    return out.select("file", (F.col("top") + 1).alias("version"), F.lit("redo").alias("operation"), "content", F.col("last.git_head").alias("git_head"))


def goto(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, step, version, operation, content) of the way from one version to another in a tree of versions.

    versions (file, version, parent, content), the first without a parent;
    wanted (file, source, target). Edits are undone up to the nearest version
    that both descend from, then redone down to the target; content is what the
    file holds after the step.
    """
    edges = versions.where("parent is not null").select(F.struct("file", "version").alias("node"), F.struct("file", F.col("parent").alias("version")).alias("above"))
    ends = wanted.select("file", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("version")), F.struct(F.lit("target").alias("side"), F.col("target").alias("version")))).alias("e"))
    known = graphs.reached(edges, ends.select("file", "e.side", F.struct("file", "e.version").alias("node")), "node", "above").select("file", "side", "node.version", "depth")
    both = known.groupBy("file", "version").agg(F.max(F.when(F.col("side") == "source", F.col("depth"))).alias("up"), F.max(F.when(F.col("side") == "target", F.col("depth"))).alias("down")).where("up is not null and down is not null")
    turn = both.groupBy("file").agg(F.min_by(F.struct("version", "up", "down"), "up").alias("turn"))
    # undoing leads to the parent, redoing to the version itself
    way = known.join(turn, "file")
    undone = way.where("side = 'source' and depth > 0 and depth <= turn.up").select("file", F.col("depth").alias("step"), "version", F.lit("undo").alias("operation"))
    redone = way.where("side = 'target' and depth < turn.down").select("file", (F.col("turn.up") + F.col("turn.down") - F.col("depth")).alias("step"), "version", F.lit("redo").alias("operation"))
    rows, key = versions.count(), ["file", "version"]
    said = dealt(versions.select(*key, "content"), rows, *key)
    return dealt(undone.unionByName(redone), rows, *key).join(said, key).select("file", F.col("step").cast("long").alias("step"), "version", "operation", "content")


def line_conflicts(base: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(file, line) where two successors of a text, all as line rows (file, line, text), differ from it and from each other."""
    texts = [df.select("file", "line", F.struct("text").alias(name)) for df, name in ((base, "b"), (own, "o"), (other, "t"))]
    met = texts[0].join(texts[1], ["file", "line"], "full").join(texts[2], ["file", "line"], "full")
    differ = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    return met.where(differ("b", "o") & differ("b", "t") & differ("o", "t")).select("file", "line")


def prune(versions: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` versions of each file."""
    ranked = versions.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("version"))))
    return ranked.where(F.col("_r") <= keep).drop("_r")
