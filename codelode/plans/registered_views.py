"""Registered queries of views, targets, scopes and symbol edits, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode import adapters as A
from codelode.operators import views
from codelode.plans.registered import _DIRECT, query

_PATH = "CASE WHEN parent IS NULL THEN name ELSE parent || '/' || name END"


@query("SELECT file, kind, start_line, end_line FROM symbols WHERE name = 's8'", "symbols")
def find_symbol_exact_case(spark, sf_dir):
    return views.find_exact(A.symbols(spark, sf_dir), "s8")


@query(f"SELECT file, start_line, {_PATH} AS path FROM symbols WHERE regexp_matches({_PATH}, '^C[1-4]/s1.*$')", "symbols")
def symbol_glob_paths(spark, sf_dir):
    return views.symbol_glob(A.symbols(spark, sf_dir), "C[1-4]/s1*").select("file", "start_line", "path")


@query("SELECT file, start_line, name, parent FROM symbols WHERE kind = 'Brand#11' AND starts_with(file, 'f1')", "symbols")
def symbols_of_kind(spark, sf_dir):
    return views.of_kind(A.symbols(spark, sf_dir), "Brand#11", "f1")


@query(
    f""", hits AS (SELECT DISTINCT file, start_line + 2 AS line FROM symbols WHERE end_line % 2 = 0),
        near AS (SELECT h.file, h.line, {_PATH} AS symbol, row_number() OVER (PARTITION BY h.file, h.line ORDER BY s.end_line - s.start_line, s.start_line DESC, {_PATH}) AS k
                 FROM hits h JOIN symbols s ON h.file = s.file AND h.line BETWEEN s.start_line AND s.end_line)
        SELECT h.file, h.line, symbol FROM hits h LEFT JOIN near n ON h.file = n.file AND h.line = n.line AND k = 1""",
    "symbols",
)
def symbol_at_line(spark, sf_dir):
    symbols = A.symbols(spark, sf_dir)
    hits = symbols.where("end_line % 2 = 0").select("file", (F.col("start_line") + 2).alias("line")).distinct()
    return views.at_line(symbols, hits).select("file", "line", "symbol")


@query(
    """, typed AS (SELECT file, name, CASE start_line % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'struct' ELSE 'method' END AS kind, CASE WHEN start_line % 4 <> 1 THEN 's' || (start_line * 7) END AS parent FROM symbols),
       held AS (SELECT DISTINCT file, name, parent FROM typed WHERE kind <> 'method'),
       chain AS (SELECT file, name, parent AS up, [name] AS seen FROM held
                 UNION ALL SELECT c.file, c.name, h.parent, list_append(seen, h.name) FROM chain c JOIN held h ON h.file = c.file AND h.name = c.up WHERE NOT list_contains(seen, h.name)),
       rooted AS (SELECT DISTINCT file, name FROM chain WHERE up IS NULL)
       SELECT file, name, kind, parent FROM typed t WHERE kind <> 'method' AND (parent IS NULL OR EXISTS (SELECT 1 FROM rooted r WHERE r.file = t.file AND r.name = t.parent))""",
    "symbols",
)
def type_skeleton(spark, sf_dir):
    kind = F.expr("case start_line % 3 when 0 then 'class' when 1 then 'struct' else 'method' end")
    parent = F.when(F.expr("start_line % 4 <> 1"), A.tag("s", "start_line * 7"))
    return views.type_skeleton(A.symbols(spark, sf_dir).select("file", "name", kind.alias("kind"), parent.alias("parent")))


@query(
    f"""SELECT 'import' AS section, name, line, module AS detail FROM imports WHERE file = 'f7'
        UNION ALL SELECT 'export', name, start_line, kind FROM symbols WHERE file = 'f7' AND parent IS NULL
        UNION ALL SELECT 'symbol', {_PATH}, start_line, kind FROM symbols WHERE file = 'f7'""",
    "symbols imports",
)
def file_skeleton(spark, sf_dir):
    return views.file_skeleton(A.symbols(spark, sf_dir), A.imports(spark, sf_dir), "f7")


@query(
    """, s AS (SELECT path AS file, CAST(2 AS BIGINT) AS a, CAST(lines AS BIGINT) AS b FROM files WHERE lines >= 2),
       l AS (SELECT s.file, string_agg(text, chr(10) ORDER BY line) AS preview, greatest(0, any_value(b) - any_value(a) + 1 - 3) AS hidden FROM s JOIN lines ON s.file = lines.file AND line BETWEEN a AND least(b, a + 2) GROUP BY s.file)
       SELECT file, md5(preview) AS digest, CAST(hidden AS BIGINT) AS hidden FROM l""",
    "files lines",
)
def span_previews(spark, sf_dir):
    spans = A.files(spark, sf_dir).where("lines >= 2").select(F.col("path").alias("file"), F.lit("body").alias("name"), F.lit(2).cast("long").alias("start_line"), F.col("lines").cast("long").alias("end_line"))
    return views.previews(A.lines(spark, sf_dir), spans, 3).select("file", F.md5(F.col("preview").cast("binary")).alias("digest"), "hidden")


@query("""SELECT line, text FROM lines WHERE file = (SELECT min(file) FROM lines) AND line BETWEEN 2 AND 4""", "lines")
def symbol_source(spark, sf_dir):
    lines = A.lines(spark, sf_dir)
    file = lines.agg(F.min("file")).first()[0]
    symbols = spark.createDataFrame([(file, "f", "function", 2, 3, None), (file, "g", "method", 4, 4, "f"), (file, "f", "method", 3, 4, "C")], "file string, name string, kind string, start_line long, end_line long, parent string")
    return views.symbol_source(lines, symbols, file, "f")


@query(
    """WITH kept AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path, url FROM pages WHERE ends_with(url, '.html')),
       p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS l FROM pages WHERE regexp_replace(url, '^[a-z]+://', '') IN (SELECT path FROM kept)),
       n AS (SELECT array_to_string(l[1:k], '/') AS path, k = len(l) AS leaf FROM (SELECT l, unnest(range(1, len(l) + 1)) AS k FROM p) WHERE k <= 3)
       SELECT path, CASE WHEN bool_and(leaf) THEN 'file' ELSE 'directory' END AS kind, count(*) AS files FROM n GROUP BY path"""
)
def folder_view_filtered(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return views.folder_view(pages, pages.where(F.col("path").endswith(".html")), depth=3)


@query("""SELECT path FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '.hidden/' WHEN 1 THEN 'docs/' ELSE '' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents) WHERE ends_with(path, '.md') AND NOT starts_with(path, '.')""")
def markdown_walk(spark, sf_dir):
    path = F.concat(F.expr("case doc_id % 4 when 0 then '.hidden/' when 1 then 'docs/' else '' end"), F.col("doc_id").cast("string"), F.expr("case when doc_id % 3 = 0 then '.txt' else '.md' end"))
    return views.markdown_files(A.table(spark, sf_dir, "documents").select(path.alias("path")))


@query("""SELECT url AS path FROM pages WHERE regexp_extract(url, '[^/]\\.([^./]+)$', 1) IN ('html', 'md')""")
def files_with_extensions(spark, sf_dir):
    return views.with_extensions(A.table(spark, sf_dir, "pages").select(F.col("url").alias("path")), ["html", "md"])


@query("""SELECT file, name, complexity FROM functions WHERE file IN (SELECT source FROM documents WHERE doc_id % 9 = 0 AND lang = 'fr')""", "functions")
def report_of_changed_files(spark, sf_dir):
    changed = A.table(spark, sf_dir, "documents").where("doc_id % 9 = 0 and lang = 'fr'").select(F.col("source").alias("path"))
    return views.changed_only(A.functions(spark, sf_dir).select("file", "name", "complexity"), changed)


@query("""SELECT file, name, length, CASE WHEN length <= 20 THEN 'short' WHEN length <= 50 THEN 'medium' WHEN length <= 100 THEN 'long' ELSE 'too-long' END AS risk FROM functions WHERE regexp_matches(file, '^src1.*$')""", "functions")
def glob_length_report(spark, sf_dir):
    return views.glob_report(A.functions(spark, sf_dir).select("file", "name", "length"), "src1*", "length")


@query("""SELECT l AS language, count(*) AS files FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' END AS l, doc_id % 7 AS d FROM documents) WHERE l IS NOT NULL AND d <= 4 GROUP BY l""")
def project_language_set(spark, sf_dir):
    path = F.concat(F.expr("repeat('d/', cast(doc_id % 7 as int))"), F.col("doc_id").cast("string"), F.expr("element_at(array('.py', '.rs', '.zzz'), cast(doc_id % 3 + 1 as int))"))
    known = spark.createDataFrame([("py", "Python"), ("rs", "Rust")], "extension string, language string")
    return views.project_languages(A.table(spark, sf_dir, "documents").select(path.alias("path")), known)


@query("""SELECT source AS folder, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def storage_by_folder(spark, sf_dir):
    return views.storage(A.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("long").alias("size")))


@query(
    """, asked AS (SELECT DISTINCT callee_name AS name, line FROM calls WHERE caller_file = 'f7' AND caller_symbol = 's7'), own AS (SELECT callee_name AS name, line FROM calls WHERE caller_file = 'f7' AND caller_symbol = 's7'),
       named AS (SELECT a.name, coalesce(module, i.name) AS module, i.name AS original, row_number() OVER (PARTITION BY a.name ORDER BY i.line, coalesce(module, i.name), i.name) AS k
                 FROM (SELECT DISTINCT name FROM asked) a JOIN imports i ON i.file = 'f7' AND (i.name = a.name OR i.alias = a.name)),
       stars AS (SELECT a.name, module, row_number() OVER (PARTITION BY a.name ORDER BY i.line, module) AS k FROM (SELECT DISTINCT name FROM asked) a JOIN imports i ON i.file = 'f7' AND i.name = '*' AND module IS NOT NULL),
       answers AS (SELECT name, module, original FROM named WHERE k = 1 UNION ALL SELECT name, module, name FROM stars WHERE k = 1 AND name NOT IN (SELECT name FROM named))
       SELECT o.name AS callee_name, line, module, original FROM own o LEFT JOIN answers b ON o.name = b.name""",
    "calls imports",
)
def callees_resolved(spark, sf_dir):
    return views.callees_resolved(A.calls(spark, sf_dir), A.symbols(spark, sf_dir), A.imports(spark, sf_dir), A.module_files(spark, sf_dir), "f7", "s7")


@query(
    """, named AS (SELECT caller_file, caller_symbol, 's' || substr(callee_name, 2) AS callee_name, callee_qualifier, line FROM calls)
       SELECT caller_file AS file, caller_symbol AS symbol, line, 'caller' AS direction FROM (""" + _DIRECT.format("s8").replace("FROM calls", "FROM named") + """)
       UNION ALL SELECT caller_file, callee_name, line, 'callee' FROM named WHERE caller_symbol = 's8' AND caller_file = 'f8'""",
    "symbols calls imports",
)
def call_graph_of_target(spark, sf_dir):
    calls = A.calls(spark, sf_dir).withColumn("callee_name", F.concat(F.lit("s"), F.substring("callee_name", 2, 100)))
    return views.call_graph(calls, A.symbols(spark, sf_dir), A.imports(spark, sf_dir), "f8::s8")


@query("""SELECT hash, members, line_count, first_file, first_name FROM (SELECT hash, count(*) AS members, arg_min(length, (file, start_line)) AS line_count, arg_min(file, (file, start_line)) AS first_file, arg_min(name, (file, start_line)) AS first_name FROM functions GROUP BY hash HAVING count(*) >= 2) ORDER BY line_count DESC, members DESC, hash LIMIT 20""", "functions")
def clone_groups_ordered(spark, sf_dir):
    from codelode.operators import quality

    return views.ordered_clones(quality.clone_groups(A.functions(spark, sf_dir)))


@query(
    """WITH s AS (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, sum(event_id) AS tokens, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY user_id)
       SELECT count(*) AS sessions, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(tokens) AS BIGINT) AS tokens, min(a) FILTER (a > 0) AS min_context, max(b) AS max_context FROM s"""
)
def sessions_merged(spark, sf_dir):
    events = A.table(spark, sf_dir, "events")
    own = events.groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("event_id").alias("tokens"), F.min("event_id").alias("min_context"), F.max("event_id").alias("max_context"))
    return views.merged_sessions(own)


@query("""SELECT 'length' AS rule_id, CASE WHEN length > 100 THEN 'error' ELSE 'warning' END AS severity, 'length of ' || name || ' is ' || length AS message, file, start_line AS line FROM functions WHERE length > 50""", "functions")
def length_findings(spark, sf_dir):
    from codelode.operators import quality

    report = quality.metric_report(A.functions(spark, sf_dir).select("file", "name", "length", "start_line"), "length", limit=None)
    return views.metric_sarif(report, "length", "length")
