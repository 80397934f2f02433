"""Session logs: turns, tools, errors and tokens.

messages (path, line, role, ...), blocks (path, line, turn, role, type, id,
name, text, tool_use_id, is_error), usage (path, turn, input, output,
cache_read, cache_create).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("input", "output", "cache_read", "cache_create")
# fixed values: error categories by what the lower-cased text contains, the first that fits counts
ERRORS = (
    ("exit code", "Command failure"),
    ("not found", "File not found"),
    ("permission", "Permission error"),
    ("timeout", "Timeout"),
    ("syntax", "Syntax error"),
    ("import", "Import error"),
)
OTHER = "Other"


def turns(messages: DataFrame) -> DataFrame:
    """Adds ``turn``: a new one starts at each message of the user; messages before the first are turn 0."""
    return messages.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("path").orderBy("line")).cast("long"))


def usage_by_request(records: DataFrame) -> DataFrame:
    """Streamed usage records of one request count once, with the maximum of each figure, at the last record's turn."""
    most = [F.max(c).alias(c) for c in USAGE]
    return records.groupBy("path", "request_id").agg(F.max_by("turn", "line").alias("turn"), *most)


def error_category(text: Column) -> Column:
    said = F.lower(text)
    return reduce(lambda out, rule: F.when(said.contains(rule[0]), rule[1]).otherwise(out), reversed(ERRORS), F.lit(OTHER))


def role_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(F.count("*").alias("messages"))


def single_tool_turns(blocks: DataFrame) -> DataFrame:
    """Turns of a session with exactly one tool call."""
    per = blocks.groupBy("path", "turn").agg(F.count_if(F.col("type") == "tool_use").alias("calls"))
    return per.groupBy("path").agg(F.count_if(F.col("calls") == 1).alias("single_tool_turns"), F.count("*").alias("turns"))


def tool_stats(blocks: DataFrame) -> DataFrame:
    """calls, errors and success_rate of each tool; results are joined to their calls by id."""
    calls = blocks.where("type = 'tool_use'").select("path", F.col("id").alias("tool_use_id"), "name")
    results = blocks.where("type = 'tool_result'").groupBy("path", "tool_use_id").agg(F.max(F.col("is_error").cast("int")).alias("failed"))
    out = calls.join(results, ["path", "tool_use_id"], "left").groupBy("name").agg(F.count("*").alias("calls"), F.coalesce(F.sum("failed"), F.lit(0)).alias("errors"))
    return out.withColumn("success_rate", (F.col("calls") - F.col("errors")) / F.col("calls"))


def error_patterns(errors: DataFrame, examples: int = 3, width: int = 100) -> DataFrame:
    """category, count and the first examples by (path, line), cut to ``width`` characters.

    Only the examples are ranked, inside each (category, path), so a frequent
    category is not gathered in one task.
    """
    marked = errors.withColumn("category", error_category(F.col("text")))
    local = marked.withColumn("_k", F.row_number().over(Window.partitionBy("category", "path").orderBy("line", "text"))).where(F.col("_k") <= examples)
    firsts = local.groupBy("category").agg(F.expr(f"slice(array_sort(collect_list(struct(path, line, left(text, {width}) as text))), 1, {examples})").alias("examples"))
    return marked.groupBy("category").agg(F.count("*").alias("count")).join(firsts, "category").select("category", "count", F.transform("examples", lambda e: e["text"]).alias("examples"))


def token_stats(usage: DataFrame) -> DataFrame:
    """One row: sums, calls, mean context (whole numbers), least and greatest context (0: unset)."""
    context = F.col("input") + F.col("cache_read")
    out = usage.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE], F.count("*").alias("calls"),
        F.coalesce(F.min(F.nullif(context, F.lit(0))), F.lit(0)).alias("min_context"), F.coalesce(F.max(context), F.lit(0)).alias("max_context"),
    )
    return out.withColumn("avg_context", F.expr("case when calls > 0 then (input + cache_read) div calls else 0 end")).withColumn("total_tokens", sum((F.col(c) for c in USAGE[1:]), F.col(USAGE[0])))


def sessions_by_time(sessions: DataFrame, since: int | None = None, until: int | None = None, matching: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Newest sessions (path, mtime in seconds) in a window (until: that day included) and among matching paths."""
    out = sessions
    if since is not None:
        out = out.where(F.col("mtime") >= since)
    if until is not None:
        out = out.where(F.col("mtime") < until + 86_400)
    if matching is not None:
        out = out.join(matching.select("path").distinct(), "path", "left_semi")
    return out.orderBy(F.desc("mtime"), "path").limit(limit)


def normal_project_path(path: Column) -> Column:
    """From the first well-known folder on; the path as it is without one."""
    found = F.regexp_extract(path, r"(?:^|/)((?:src|lib|crates|tests|docs|packages)/.*)$", 1)
    return F.when(found != "", found).otherwise(path)
