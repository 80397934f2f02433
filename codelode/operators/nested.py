"""Properly nested intervals and the points inside them, by running sums instead of range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def around(intervals: DataFrame, points: DataFrame, group: str = "path", start: str = "start", end: str = "end", at: str = "at", least: Column | None = None) -> DataFrame:
    """Each point with every interval around it: (``around``, the interval as a struct, and ``depth``, 1 for the outermost).

    Intervals of a group are nested or apart, both ends included. Opened and
    closed, they and the points make one sequence; the running sum is a point's
    depth, and its interval at depth d is the last that opened there. ``least``
    asks for depths from there on, as a function of the point's ``_depth``.
    One shuffle, by the group; linear but for the depths.
    """
    spans, asked = {c: f"_i{k}" for k, c in enumerate(intervals.columns)}, {c: f"_p{k}" for k, c in enumerate(points.columns)}
    # both sides have the group, once: what is grouped by it afterwards stays where it is
    spans[group] = asked[group] = "_g"
    # columns, not structs: the optimizer can't prune structs that windows pass on
    # of one place: first what opens there (the longer one first), then points, then what closes
    opens, closes = (F.struct(place.cast("long").alias("_at"), F.lit(turn).alias("_turn"), tie.cast("long").alias("_tie"), F.lit(step).alias("_step")) for place, turn, tie, step in ((F.col(start), 0, -F.col(end), 1), (F.col(end), 2, F.lit(0), -1)))
    own = intervals.select(F.col(group).alias("_g"), F.inline(F.array(opens, closes)), *[F.col(c).alias(n) for c, n in spans.items() if n != "_g"])
    asks = points.select(F.col(group).alias("_g"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_turn"), F.lit(0).cast("long").alias("_tie"), F.lit(0).alias("_step"), *[F.col(c).alias(n) for c, n in asked.items() if n != "_g"])
    order = ["_at", "_turn", "_tie"]
    events = own.unionByName(asks, allowMissingColumns=True)
    events = events.withColumn("_depth", F.sum("_step").over(_running(["_g"], order))).where("_step >= 0 and _depth > 0")
    least = F.lit(1) if least is None else least
    levels = F.when(F.col("_step") == 1, F.array("_depth")).when(least <= F.col("_depth"), F.sequence(least.cast("long"), F.col("_depth"))).otherwise(F.array().cast("array<bigint>"))
    keyed = events.withColumn("depth", F.explode(levels))
    here = _running(["_g", "depth"], order)
    # places of openings at one depth ascend
    found = keyed.withColumns({n: F.max_by(n, F.when(F.col("_step") == 1, F.col("_at"))).over(here) for n in spans.values() if n != "_g"}).where("_step = 0")
    return found.select(*[F.col(n).alias(c) for c, n in asked.items()], F.struct(*[F.col(n).alias(c) for c, n in spans.items()]).alias("around"), F.col("depth").cast("int").alias("depth"))


def with_parent(intervals: DataFrame, group: str = "path", start: str = "start", end: str = "end", name: str = "name", into: str = "parent") -> DataFrame:
    """Intervals, nested or apart, with the ``name`` of the innermost one around each (``into``); one pass over them."""
    held = {c: f"_i{k}" for k, c in enumerate(intervals.columns)}
    opens, closes = (F.struct(place.cast("long").alias("_at"), tie.cast("long").alias("_tie"), F.lit(step).alias("_step")) for place, tie, step in ((F.col(start), -F.col(end), 1), (F.col(end), F.lit(1), -1)))
    events = intervals.select(F.col(group).alias("_g"), F.inline(F.array(opens, closes)), *[F.col(c).alias(n) for c, n in held.items()])
    opened = events.withColumn("_depth", F.sum("_step").over(_running(["_g"], ["_at", "_tie"]))).where("_step = 1")
    # at its own depth it may become a parent, one above it looks for its own
    keyed = opened.withColumn("_key", F.explode(F.array(F.col("_depth"), F.col("_depth") - 1)))
    here = _running(["_g", "_key"], ["_at", "_tie"])
    found = keyed.withColumn("_parent", F.max_by(held[name], F.when(F.col("_key") == F.col("_depth"), F.struct("_at", -F.col("_tie")))).over(here)).where("_key < _depth")
    return found.select(*[F.col(n).alias(c) for c, n in held.items()], F.col("_parent").alias(into))


def innermost(intervals: DataFrame, points: DataFrame, group: str = "path", start: str = "start", end: str = "end", at: str = "at") -> DataFrame:
    """Points with the innermost interval around each; points outside of all are left out."""
    return around(intervals, points, group, start, end, at, least=F.col("_depth")).drop("depth")
