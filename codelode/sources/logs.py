"""Session logs, version-control logs and lint reports, parsed with Spark's JSON and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.operators.sessions import turns

_BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
_ENTRY = f"type string, requestId string, sessionId string, timestamp string, message struct<role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text lines. Lines of one file are numbered by their place in its whole text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''")


def detect(lines: DataFrame) -> DataFrame:
    """(path, format): the format most of a file's lines speak for; rows (path, line, value)."""
    get = lambda p: F.get_json_object("value", p)
    score = F.struct(
        F.avg((get("$.type").isin("user", "assistant", "summary") & get("$.message").isNotNull()).cast("int")).alias("s"), F.lit("turns").alias("f")
    )
    payload = F.struct(F.avg(F.coalesce(get("$.payload.type").isNotNull(), F.lit(False)).cast("int")).alias("s"), F.lit("payload").alias("f"))
    event = F.struct(F.avg(F.coalesce(get("$.event").isNotNull(), F.lit(False)).cast("int")).alias("s"), F.lit("event").alias("f"))
    document = F.struct(F.avg(F.coalesce(get("$.messages[0]").isNotNull(), F.lit(False)).cast("int")).alias("s"), F.lit("document").alias("f"))
    return lines.groupBy("path").agg(F.greatest(score, payload, event, document).alias("best")).where("best.s > 0").select("path", F.col("best.f").alias("format"))


def turn_entries(lines: DataFrame) -> DataFrame:
    """Entries of the turn format (path, line, role, request_id, model, content, usage, turn); lines that don't parse are skipped."""
    e = lines.select("path", "line", F.from_json("value", _ENTRY).alias("e")).where(F.col("e.type").isin("user", "assistant"))
    rows = e.select("path", "line", F.col("e.type").alias("role"), F.col("e.requestId").alias("request_id"), F.col("e.message.model").alias("model"), F.col("e.message.content").alias("content"), F.col("e.message.usage").alias("usage"))
    return turns(rows)


def entry_blocks(entries: DataFrame) -> DataFrame:
    """Content blocks; a content that is a plain string is one text block."""
    array = F.when(F.col("content").startswith("["), F.from_json("content", _BLOCK))
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))), _BLOCK[6:-1]))
    return entries.where("content is not null").select("path", "line", "turn", "role", F.explode(F.coalesce(array, plain)).alias("b")).select("path", "line", "turn", "role", "b.type", "b.id", "b.name", F.coalesce("b.text", "b.thinking", "b.content").alias("text"), "b.input", "b.tool_use_id", F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def entry_usage(entries: DataFrame) -> DataFrame:
    """Usage records (path, line, turn, request_id, and the four figures) for ``usage_by_request``."""
    zero = lambda c: F.coalesce(F.col(f"usage.{c}"), F.lit(0))
    named = entries.where("usage is not null")
    return named.select("path", "line", "turn", "request_id", zero("input_tokens").alias("input"), zero("output_tokens").alias("output"), zero("cache_read_input_tokens").alias("cache_read"), zero("cache_creation_input_tokens").alias("cache_create"))


def payload_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of the payload format; an output that reports a failure is an error."""
    get = lambda p: F.get_json_object("value", p)
    p = lines.select("path", "line", get("$.payload.type").alias("kind"), get("$.payload.call_id").alias("call_id"), get("$.payload.name").alias("name"), get("$.payload.arguments").alias("input"), get("$.payload.output").alias("output"), get("$.payload.message").alias("message"))
    role = F.when(F.col("kind") == "user_message", "user").otherwise("assistant")
    rows = turns(p.where(F.col("kind").isin("user_message", "message", "function_call", "function_call_output")).withColumn("role", role))
    kind = F.when(F.col("kind") == "function_call", "tool_use").when(F.col("kind") == "function_call_output", "tool_result").otherwise("text")
    failed = F.coalesce(F.col("output").contains("Exit code: 1") | F.col("output").contains("Error:"), F.lit(False))
    return rows.select("path", "line", "turn", "role", kind.alias("type"), F.col("call_id").alias("id"), "name", F.coalesce("message", "output").alias("text"), "input", F.col("call_id").alias("tool_use_id"), failed.alias("is_error"))


def payload_usage(lines: DataFrame) -> DataFrame:
    """One row a session: running totals, so the last (greatest) one counts."""
    total = lambda k: F.max(F.get_json_object("value", f"$.payload.info.total_token_usage.{k}").cast("long"))
    out = lines.groupBy("path").agg(total("input_tokens").alias("input"), total("output_tokens").alias("output"), total("cached_input_tokens").alias("cache_read"))
    return out.where("input is not null").select("path", F.lit(0).cast("long").alias("turn"), "input", F.coalesce("output", F.lit(0)).alias("output"), F.coalesce("cache_read", F.lit(0)).alias("cache_read"), F.lit(0).cast("long").alias("cache_create"))


def event_turns(lines: DataFrame) -> DataFrame:
    """Commands of the event format: (path, turn, name, is_error)."""
    get = lambda p: F.get_json_object("value", p)
    own = lines.where(get("$.event") == "command")
    return own.select("path", "line", get("$.turn").cast("long").alias("turn"), F.substring_index(get("$.cmd"), " ", 1).alias("name"), (get("$.success") != "true").alias("is_error"))


def document_messages(files: DataFrame) -> DataFrame:
    """Messages of the one-document format: (path, line, role, model, input, output, cache_read)."""
    schema = "struct<sessionId:string,messages:array<struct<type:string,model:string,content:string,tokens:struct<input:bigint,output:bigint,cached:bigint>>>>"
    rows = files.select("path", F.posexplode(F.from_json("value", schema)["messages"]).alias("line", "m"))
    return rows.select("path", "line", F.when(F.col("m.type") == "user", "user").otherwise("assistant").alias("role"), "m.model", "m.tokens.input", "m.tokens.output", F.col("m.tokens.cached").alias("cache_read"))


def numstat(lines: DataFrame) -> DataFrame:
    """(path, added, deleted) of ``added<TAB>deleted<TAB>path`` lines; binary rows (``-``) are left out."""
    parts = F.split("value", "\t")
    return lines.where(F.col("value").rlike(r"^\d+\t\d+\t.")).select(F.get(parts, 2).alias("path"), F.get(parts, 0).cast("long").alias("added"), F.get(parts, 1).cast("long").alias("deleted"))


def line_history(lines: DataFrame) -> DataFrame:
    """hash, author, date and subject of records split by the unit separator."""
    parts = F.split("value", "\x1f")
    return lines.where(F.size(parts) >= 4).select(*[F.get(parts, k).alias(c) for k, c in enumerate(("hash", "author", "date", "subject"))])


def edit_history(records: DataFrame) -> DataFrame:
    """Edit records (value) with their body's fields."""
    parts = F.split(F.trim("value"), "\x1f")
    body = F.get(parts, 2)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(body, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return records.where(F.size(parts) >= 4).select(
        F.get(parts, 0).alias("hash"), F.get(parts, 1).alias("subject"), field("Operation").alias("operation"), field("Target").alias("target"), F.split(field("Files"), r",\s*").alias("files"),
        field("Message").alias("message"), field("Workflow").alias("workflow"), field("Git-HEAD").alias("git_head"), F.get(parts, 3).alias("timestamp"),
    )


_SARIF = (
    "struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,helpUri:string>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,endLine:int,endColumn:int>>>>>>>>>"
)


def sarif(reports: DataFrame) -> DataFrame:
    """Diagnostics of SARIF reports (value): tool, rule_id, message, severity, place, help_url."""
    runs = reports.select(F.explode(F.from_json("value", _SARIF)["runs"]).alias("r")).select(F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("rules"), F.explode("r.results").alias("x"))
    help_of = F.get(F.transform(F.filter("rules", lambda rule: rule["id"] == F.col("x.ruleId")), lambda rule: rule["helpUri"]), 0)
    place = F.get(F.col("x.locations"), 0)["physicalLocation"]
    severity = F.when(F.col("x.level") == "error", "error").when(F.col("x.level") == "note", "info").when(F.col("x.level") == "none", "hint").otherwise("warning")
    return runs.select("tool", F.col("x.ruleId").alias("rule_id"), F.col("x.message.text").alias("message"), severity.alias("severity"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("column"), place["region"]["endLine"].alias("end_line"), place["region"]["endColumn"].alias("end_column"), help_of.alias("help_url"))


def to_sarif(diagnostics: DataFrame) -> DataFrame:
    """One SARIF run (JSON) a tool, its results in order of file and line, its rules once each.

    A run is one JSON document; the tool's diagnostics meet in it.
    """
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    result = F.struct("file", "line", F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region")).alias("physicalLocation"))).alias("locations"))
    per = diagnostics.groupBy("tool").agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
    results = F.transform("results", lambda r: F.struct(r["ruleId"].alias("ruleId"), r["level"].alias("level"), r["message"].alias("message"), r["locations"].alias("locations")))
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return per.select("tool", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def last_by_request(records: DataFrame) -> DataFrame:
    w = Window.partitionBy("path", "request_id").orderBy(F.desc("line"))
    return records.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
