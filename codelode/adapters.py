"""The driver's tables as the relations that the operators read.

These are stand-ins with the right shapes, not real code: documents are files,
line items are calls, suppliers are imports, conversations are sessions. Each
frame has its SQL twin, a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import explode_lines, line_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(prefix: str, number: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.expr(number) if isinstance(number, str) else number).cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, lines, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), line_count(F.col("text")).alias("lines"), F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line, text."""
    return explode_lines(files(spark, sf_dir), "path")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    qualifier = F.when(F.col("l_returnflag") == "A", "self").when(F.col("l_returnflag") == "R", tag("m", "l_suppkey % 20"))
    return table(spark, sf_dir, "lineitem").select(tag("f", "l_orderkey % 50").alias("caller_file"), tag("s", "l_orderkey % 400").alias("caller_symbol"), tag("p", "l_partkey % 300").alias("callee_name"), qualifier.alias("callee_qualifier"), F.col("l_linenumber").cast("long").alias("line"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.expr("p_size % 3 = 0"), tag("C", "p_size % 10"))
    return table(spark, sf_dir, "part").select(tag("f", "p_partkey % 50").alias("file"), tag("s", "p_partkey % 400").alias("name"), F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + 10).cast("long").alias("end_line"), parent.alias("parent"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.when(F.expr("s_suppkey % 4 <> 0"), tag("m", "s_suppkey % 20"))
    name = F.when(F.expr("s_suppkey % 7 = 0"), "*").otherwise(tag("p", "s_suppkey % 300"))
    alias = F.when(F.expr("s_suppkey % 5 = 0"), tag("p", "s_suppkey % 300 + 1"))
    return table(spark, sf_dir, "supplier").select(tag("f", "s_suppkey % 50").alias("file"), module.alias("module"), name.alias("name"), alias.alias("alias"), F.col("s_suppkey").cast("long").alias("line"))


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold modules: m0 to m19 with a varying place."""
    return table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.when(F.expr("n_nationkey % 2 = 0"), F.concat(tag("src/m", "n_nationkey"), F.lit(".py"))).otherwise(F.concat(tag("m", "n_nationkey"), F.lit("/__init__.py"))).alias("path"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("file"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("start_line"), F.col("p_type").alias("parent"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range of lines (file, id, start_line, end_line, number) for each order and line number."""
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("number"))
    start = F.col("l_linenumber").cast("long") * 3
    return item.select(tag("o", "l_orderkey").alias("file"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), start.alias("start_line"), (start + F.col("number") % 5).alias("end_line"), "number", F.col("l_linenumber").cast("long").alias("line"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name, complexity (1 and the branch words), length (lines), hash of the normal form."""
    docs = table(spark, sf_dir, "documents")
    normal = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    return docs.select(
        F.col("source").alias("file"), tag("d", "doc_id").alias("name"), (F.regexp_count("text", F.lit(" on | an | la | der ")) + 1).cast("long").alias("complexity"), line_count(F.col("text")).alias("length"),
        line_count(F.col("text")).alias("line_count"), F.md5(normal.cast("binary")).alias("hash"), F.col("doc_id").alias("start_line"),
    )


def callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; good quality counts as documented."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.col("lang").alias("language"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("documented")), "doc_id")


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda kind: F.when(F.col("event_type") == kind, F.floor("value").cast("long")).otherwise(0)
    return table(spark, sf_dir, "events").select(tag("u", "user_id").alias("path"), number("purchase").alias("added"), number("error").alias("deleted"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), "role", "text")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "click", "medium").when(kind == "view", "low")
    return table(spark, sf_dir, "events").select("event_id", severity.alias("severity"))


#: SQL twins, by name; a query's SQL starts with those it names.
CTES = {
    "files": r"""files AS (SELECT source || '/' || doc_id AS path, lang AS language, CASE WHEN text = '' OR strlen(text) >= 1000000 THEN 0 ELSE len(string_split_regex(regexp_replace(text, '\n$', ''), '\r?\n')) END AS lines, text AS content FROM documents)""",
    "lines": r"""lines AS (SELECT file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT source || '/' || doc_id AS file, CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\n$', ''), '\r?\n') END AS l FROM documents))""",
    "calls": """calls AS (SELECT 'f' || (l_orderkey % 50) AS caller_file, 's' || (l_orderkey % 400) AS caller_symbol, 'p' || (l_partkey % 300) AS callee_name, CASE l_returnflag WHEN 'A' THEN 'self' WHEN 'R' THEN 'm' || (l_suppkey % 20) END AS callee_qualifier, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)""",
    "symbols": """symbols AS (SELECT 'f' || (p_partkey % 50) AS file, 's' || (p_partkey % 400) AS name, p_brand AS kind, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + 10 AS BIGINT) AS end_line, CASE WHEN p_size % 3 = 0 THEN 'C' || (p_size % 10) END AS parent FROM part)""",
    "imports": """imports AS (SELECT 'f' || (s_suppkey % 50) AS file, CASE WHEN s_suppkey % 4 <> 0 THEN 'm' || (s_suppkey % 20) END AS module, CASE WHEN s_suppkey % 7 = 0 THEN '*' ELSE 'p' || (s_suppkey % 300) END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'p' || (s_suppkey % 300 + 1) END AS alias, s_suppkey AS line FROM supplier)""",
    "module_files": """module_files AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'src/m' || n_nationkey || '.py' ELSE 'm' || n_nationkey || '/__init__.py' END AS path FROM nation WHERE n_nationkey < 20)""",
    "part_symbols": """part_symbols AS (SELECT p_type AS file, p_name AS name, p_brand AS kind, p_partkey AS start_line, p_type AS parent FROM part)""",
    "ranges": """ranges AS (SELECT 'o' || l_orderkey AS file, l_orderkey || '-' || l_linenumber AS id, CAST(l_linenumber * 3 AS BIGINT) AS start_line, CAST(l_linenumber * 3 + min(l_partkey) % 5 AS BIGINT) AS end_line, min(l_partkey) AS number, CAST(l_linenumber AS BIGINT) AS line FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "functions": r"""functions AS (SELECT source AS file, 'd' || doc_id AS name, CAST(len(regexp_extract_all(text, ' on | an | la | der ')) + 1 AS BIGINT) AS complexity, CASE WHEN text = '' OR strlen(text) >= 1000000 THEN 0 ELSE len(string_split_regex(regexp_replace(text, '\n$', ''), '\r?\n')) END AS length, md5(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS hash, doc_id AS start_line FROM documents)""",
    "callables": """callables AS (SELECT d.doc_id, source AS file, lang AS language, quality = 1 AS documented FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "numstat": """numstat AS (SELECT 'u' || user_id AS path, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS added, CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS deleted FROM events)""",
    "messages": """messages AS (SELECT conv_id AS path, turn AS line, role, text FROM conversations)""",
    "findings": """findings AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' END AS severity FROM events)""",
}


def with_ctes(names: str, body: str) -> str:
    """SQL that starts with the named expressions; a body with expressions of its own starts with a comma."""
    return "WITH RECURSIVE " + ", ".join(CTES[n] for n in names.split()) + " " + body.strip()
