"""Registered queries: operators over the driver's tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode import adapters as A
from codelode.functions import jq
from codelode.functions.text import extension, normal_path
from codelode.operators import callgraph, edits, packages, quality, refs, rules, search, sessions, tree
from codelode.plans import upkeep
from codelode.scratch import folder
from codelode.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ""):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = A.with_ctes(ctes, sql) if ctes else sql.strip()
        return f

    return add


# ---- text search and file lookup -------------------------------------------------------------

PATTERN = "th[ao]t"


@query(
    r""", tabbed AS (SELECT file, line, chr(9) || ' ' || text || chr(9) AS text FROM lines)
       SELECT file, line, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS content, CAST(strpos(regexp_replace(text, '^\s+', ''), regexp_extract(text, 'th[ao]t')) - 1 AS BIGINT) AS start,
       CAST(strpos(regexp_replace(text, '^\s+', ''), regexp_extract(text, 'th[ao]t')) - 1 + length(regexp_extract(text, 'th[ao]t')) AS BIGINT) AS "end"
       FROM tabbed WHERE regexp_matches(text, 'th[ao]t')""",
    "lines",
)
def text_search_lines(spark, sf_dir):
    tabbed = F.concat(F.lit("\t "), F.col("text"), F.lit("\t"))
    return search.text_search(A.lines(spark, sf_dir).withColumn("text", tabbed), PATTERN)


@query("""SELECT file, line, trim(text, ' ' || chr(9) || chr(13)) AS content FROM lines WHERE regexp_matches(text, '(?i)THAT') ORDER BY file, line LIMIT 100""", "lines")
def text_search_first_hundred(spark, sf_dir):
    return search.text_search(A.lines(spark, sf_dir), "THAT", ignore_case=True, limit=100).select("file", "line", "content")


@query("""SELECT count(*) AS total, count(DISTINCT file) AS files FROM lines WHERE regexp_matches(text, 'th[ao]t')""", "lines")
def text_search_total(spark, sf_dir):
    return search.search_total(A.lines(spark, sf_dir), PATTERN)


@query("""SELECT file, count(*) AS hits FROM lines WHERE regexp_matches(text, 'th[ao]t') GROUP BY file""", "lines")
def text_search_total_by_file(spark, sf_dir):
    return search.text_search(A.lines(spark, sf_dir), PATTERN).groupBy("file").agg(F.count("*").alias("hits"))


@query(
    """, hits AS (SELECT DISTINCT file, number % 25 AS line FROM ranges),
       best AS (SELECT h.file, h.line, r.id AS symbol, r.start_line AS symbol_start, r.end_line AS symbol_end,
                row_number() OVER (PARTITION BY h.file, h.line ORDER BY r.end_line - r.start_line, r.start_line DESC, r.id) AS k
                FROM hits h JOIN ranges r ON h.file = r.file AND h.line BETWEEN r.start_line AND r.end_line)
       SELECT h.file, h.line, symbol, symbol_start, symbol_end FROM hits h LEFT JOIN best b ON h.file = b.file AND h.line = b.line AND k = 1""",
    "ranges",
)
def text_search_enclosing_symbol(spark, sf_dir):
    spans = A.ranges(spark, sf_dir)
    hits = spans.select("file", (F.col("number") % 25).alias("line")).distinct()
    return search.enclosing(hits, spans.select("file", F.col("id").alias("name"), "start_line", "end_line"), ["file", "line"]).select("file", "line", "symbol", "symbol_start", "symbol_end")


@query("""SELECT path, lines FROM files WHERE path ILIKE '%/7' OR path ILIKE '7'""", "files")
def find_files_by_name(spark, sf_dir):
    return search.find_by_name(A.files(spark, sf_dir), "7").select("path", "lines")


@query("""SELECT path FROM files WHERE path ILIKE '%/12%' OR path ILIKE '12%'""", "files")
def find_files_by_stem(spark, sf_dir):
    return search.find_by_stem(A.files(spark, sf_dir), "12").select("path")


@query("""SELECT url AS path FROM pages WHERE contains(lower(url), 'blog') AND contains(lower(url), 'html') ORDER BY url LIMIT 50""")
def find_files_like(spark, sf_dir):
    return search.find_like(A.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("")).alias("path")), "blog_HTML").drop("page_id")


@query("""SELECT url AS path FROM pages WHERE ends_with(lower(url), '.html') ORDER BY url LIMIT 1000""")
def find_files_by_extension(spark, sf_dir):
    return search.find_like(A.table(spark, sf_dir, "pages").select(F.col("url").alias("path")), ".html")


@query("""SELECT page_id, url AS path FROM pages WHERE regexp_matches(url, '^(?:.*/)?[^/]*\\.html(?:/.*)?$') AND NOT regexp_matches(url, '^(?:.*/)?de/.+$')""")
def filter_only_exclude(spark, sf_dir):
    return search.only_exclude(A.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")), only=["*.html"], exclude=["de/"])


@query("""SELECT path, lines FROM files WHERE starts_with(path, 'src1') ORDER BY path LIMIT 100""", "files")
def list_files_with_prefix(spark, sf_dir):
    return A.files(spark, sf_dir).where(F.col("path").startswith("src1")).orderBy("path").limit(100).select("path", "lines")


@query("""SELECT name, kind, start_line FROM part_symbols WHERE lower(name) = (SELECT lower(min(p_name)) FROM part) ORDER BY length(name), name, file, start_line LIMIT 50""", "part_symbols")
def find_symbols_exact(spark, sf_dir):
    symbols = A.part_symbols(spark, sf_dir)
    return search.find_symbols(symbols, symbols.agg(F.min("name")).first()[0].upper(), fuzzy=False).select("name", "kind", "start_line")


_RANK = "CASE WHEN lower(name) = 'o' THEN 0 WHEN starts_with(lower(name), 'o') THEN 1 WHEN contains(lower(name), 'o') THEN 2 END"


@query(f"""SELECT name, kind, start_line, {_RANK} AS rank FROM part_symbols WHERE {_RANK} IS NOT NULL ORDER BY rank, length(name), name, file, start_line LIMIT 50""", "part_symbols")
def find_symbols_fuzzy_ranked(spark, sf_dir):
    return search.find_symbols(A.part_symbols(spark, sf_dir), "o").select("name", "kind", "start_line", "rank")


@query(
    f"""SELECT name, parent, start_line FROM (SELECT *, {_RANK} AS rank FROM part_symbols WHERE {_RANK} IS NOT NULL ORDER BY rank, length(name), name, file, start_line LIMIT 50)
        WHERE contains(lower(parent), 'e') ORDER BY rank, length(name), name, file, start_line LIMIT 10""",
    "part_symbols",
)
def qualified_symbol_search(spark, sf_dir):
    return search.search_symbols(A.part_symbols(spark, sf_dir), "E/o").select("name", "parent", "start_line")


@query("""SELECT DISTINCT name FROM symbols""", "symbols")
def all_symbol_names(spark, sf_dir):
    return A.symbols(spark, sf_dir).select("name").distinct()


@query(
    """SELECT path, 2147483645 AS score, 4 AS tier FROM files WHERE ends_with(translate(lower(path), '-._', '   '), '/15')
       AND NOT EXISTS (SELECT 1 FROM files WHERE path = '15' OR lower(regexp_replace(path, '^.*/', '')) = '15')
       UNION ALL SELECT path, 2147483646, 3 FROM files WHERE lower(regexp_replace(path, '^.*/', '')) = '15'""",
    "files",
)
def path_resolve_cascade(spark, sf_dir):
    return search.resolve_path(A.files(spark, sf_dir).select("path"), "15").select("path", "score", "tier")


@query("""SELECT path || '::Outer#inner' AS query, path AS file, 'Outer>inner' AS symbol_path FROM files""", "files")
def unified_path_split(spark, sf_dir):
    files = A.files(spark, sf_dir).select("path")
    found = search.split_unified(files.select(F.concat("path", F.lit("::Outer#inner")).alias("query")), files)
    return found.select("query", "file", F.array_join("symbol_path", ">").alias("symbol_path"))


@query(
    """SELECT coalesce(nullif(regexp_extract(url, '[^/]\\.([^./]+)$', 1), ''), '(none)') AS ext, count(*) AS files FROM pages
       GROUP BY 1 ORDER BY files DESC, ext LIMIT 20"""
)
def extension_histogram(spark, sf_dir):
    ext = F.coalesce(F.nullif(extension(F.col("url")), F.lit("")), F.lit("(none)"))
    return A.table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(20)


# ---- calls and imports -----------------------------------------------------------------------

_DIRECT = """
SELECT caller_file, caller_symbol, line FROM calls WHERE callee_name = '{0}'
UNION SELECT c.caller_file, c.caller_symbol, c.line FROM calls c JOIN imports i ON c.caller_file = i.file AND c.callee_name = coalesce(i.alias, i.name) WHERE i.name = '{0}'
UNION SELECT c.caller_file, c.caller_symbol, c.line FROM calls c JOIN imports i ON c.caller_file = i.file AND c.callee_qualifier = coalesce(i.alias, i.name) WHERE c.callee_name = '{0}' AND i.module IS NULL
UNION SELECT c.caller_file, c.caller_symbol, c.line FROM calls c JOIN symbols s ON c.caller_file = s.file AND c.caller_symbol = s.name WHERE c.callee_name = '{0}' AND c.callee_qualifier = 'self' AND s.parent IS NOT NULL
"""


@query(_DIRECT.format("p5"), "calls symbols imports")
def callers_union(spark, sf_dir):
    return callgraph.direct_callers(A.calls(spark, sf_dir), A.symbols(spark, sf_dir), A.imports(spark, sf_dir), "p5")


@query(
    """, t1 AS (SELECT caller_file, caller_symbol, line FROM calls c WHERE callee_name = 'p15' AND callee_qualifier = 'self' AND EXISTS (SELECT 1 FROM symbols s WHERE c.caller_file = s.file AND c.caller_symbol = s.name AND s.parent = 'C3')),
       t2 AS (""" + _DIRECT.format("p15") + """)
       SELECT *, 1 AS tier FROM t1 UNION ALL SELECT *, 2 FROM t2 WHERE NOT EXISTS (SELECT 1 FROM t1)""",
    "calls symbols imports",
)
def callers_tiered(spark, sf_dir):
    return callgraph.find_callers(A.calls(spark, sf_dir), A.symbols(spark, sf_dir), A.imports(spark, sf_dir), "C3.p15").select("caller_file", "caller_symbol", "line", "tier")


@query("""SELECT caller_file, caller_symbol, line, 2 AS tier FROM calls WHERE lower(callee_name) = 'p77'""", "calls")
def callers_any_case(spark, sf_dir):
    return callgraph.find_callers(A.calls(spark, sf_dir), A.symbols(spark, sf_dir), A.imports(spark, sf_dir), "P77").select("caller_file", "caller_symbol", "line", "tier")


@query("""SELECT caller_file, caller_symbol, line, 3 AS tier FROM calls WHERE callee_name ILIKE '%p_7%' ORDER BY caller_file, caller_symbol, line LIMIT 100""", "calls")
def callers_by_part(spark, sf_dir):
    calls = A.calls(spark, sf_dir)
    return callgraph.find_callers(calls, A.symbols(spark, sf_dir), A.imports(spark, sf_dir), "P_7").select("caller_file", "caller_symbol", "line", "tier")


@query("""SELECT callee_name, callee_qualifier, line FROM calls WHERE caller_file = 'f7' AND caller_symbol = 's7'""", "calls")
def callees(spark, sf_dir):
    return callgraph.find_callees(A.calls(spark, sf_dir), "f7", "s7")


@query(
    """, named AS (SELECT caller_file, caller_symbol, 's' || substr(callee_name, 2) AS callee_name, callee_qualifier, line FROM calls)
       SELECT file, start_line AS line, 'definition' AS role FROM symbols WHERE name = 's8'
       UNION ALL SELECT caller_file, line, 'caller' FROM (""" + _DIRECT.format("s8").replace("FROM calls", "FROM named") + """)""",
    "symbols calls imports",
)
def symbol_references(spark, sf_dir):
    """Callees take the symbols' names, so that a name is both defined and called."""
    calls = A.calls(spark, sf_dir).withColumn("callee_name", F.concat(F.lit("s"), F.substring("callee_name", 2, 100)))
    return callgraph.references(A.symbols(spark, sf_dir), calls, A.imports(spark, sf_dir), "s8")


@query(
    """, asked AS (SELECT DISTINCT caller_file AS file, callee_name AS name FROM calls),
       named AS (SELECT a.file, a.name, coalesce(module, i.name) AS module, i.name AS original, row_number() OVER (PARTITION BY a.file, a.name ORDER BY line, coalesce(module, i.name)) AS k
                 FROM asked a JOIN imports i ON a.file = i.file AND (i.name = a.name OR i.alias = a.name)),
       stars AS (SELECT a.file, a.name, module, row_number() OVER (PARTITION BY a.file, a.name ORDER BY line, module) AS k
                 FROM asked a JOIN imports i ON a.file = i.file AND i.name = '*' AND module IS NOT NULL)
       SELECT file, name, module, original, 1 AS tier FROM named WHERE k = 1
       UNION ALL SELECT file, name, module, name, 3 FROM stars s WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM named n WHERE n.file = s.file AND n.name = s.name)""",
    "calls imports",
)
def resolve_import_tiered(spark, sf_dir):
    asked = A.calls(spark, sf_dir).select(F.col("caller_file").alias("file"), F.col("callee_name").alias("name"))
    return callgraph.resolve_imports(asked, A.imports(spark, sf_dir), A.symbols(spark, sf_dir), A.module_files(spark, sf_dir)).select("file", "name", "module", "original", "tier")


@query(
    """, tried AS (SELECT DISTINCT module, path, CASE WHEN path = 'src/' || module || '.py' THEN 0 WHEN path = 'src/' || module || '/__init__.py' THEN 1 WHEN path = module || '.py' THEN 2 WHEN path = module || '/__init__.py' THEN 3 END AS k
                   FROM imports, module_files)
       SELECT module, arg_min(path, k) AS path FROM tried WHERE k IS NOT NULL GROUP BY module""",
    "imports module_files",
)
def module_to_files(spark, sf_dir):
    return callgraph.module_files(A.imports(spark, sf_dir).where("module is not null"), A.module_files(spark, sf_dir))


@query("""SELECT file, module, name, line FROM imports WHERE module = 'm1' OR module ILIKE 'm1%'""", "imports")
def importers_prefix(spark, sf_dir):
    return callgraph.find_importers(A.imports(spark, sf_dir), "m1").select("file", "module", "name", "line")


@query("""SELECT 'symbols' AS relation, count(*) AS rows FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'imports', count(*) FROM imports""", "symbols calls imports")
def index_stats(spark, sf_dir):
    return callgraph.index_stats(A.symbols(spark, sf_dir), A.calls(spark, sf_dir), A.imports(spark, sf_dir))


# ---- index upkeep ----------------------------------------------------------------------------

_DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"


def _day(c: str):
    return F.unix_date(F.to_date(c)).cast("long")


@query(
    f""", held AS (SELECT 'o' || o_orderkey AS path, {_DAY.format('o_orderdate')} AS mtime FROM orders WHERE o_orderkey % 10 <> 1),
        found AS (SELECT 'o' || o_orderkey AS path, {_DAY.format('o_orderdate')} + CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 0 END AS mtime FROM orders WHERE o_orderkey % 10 <> 3)
        SELECT coalesce(h.path, f.path) AS path, CASE WHEN h.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
        FROM held h FULL JOIN found f ON h.path = f.path WHERE h.path IS NULL OR f.path IS NULL OR h.mtime <> f.mtime""",
    "files",
)
def changed_files(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", A.tag("o", "o_orderkey").alias("path"), _day("o_orderdate").alias("mtime"))
    held = orders.where("o_orderkey % 10 <> 1").select("path", "mtime")
    found = orders.where("o_orderkey % 10 <> 3").select("path", (F.col("mtime") + F.expr("case when o_orderkey % 10 = 2 then 1 else 0 end")).alias("mtime"))
    return upkeep.changes(held, found)


@query(
    """SELECT o_orderkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 <> 1""",
)
def incremental_upsert(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"))
    return upkeep.upsert(orders.where("path % 4 <> 0 or path % 8 = 0"), orders.where("path % 4 = 0").withColumn("status", F.lit("new")), gone=orders.where("path % 4 = 1"))


@query("""SELECT DISTINCT l_orderkey AS file, l_suppkey AS name FROM lineitem""")
def insert_ignore(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name"), "l_linenumber")
    held = rows.where("l_linenumber = 1").select("file", "name").distinct()
    return upkeep.insert_ignore(held, rows.select("file", "name"), ["file", "name"])


# ---- quality ---------------------------------------------------------------------------------


@query(
    """, g AS (SELECT path, count(*) AS commits, sum(added) AS added, sum(deleted) AS deleted FROM numstat GROUP BY path)
       SELECT path, commits, CAST(added AS BIGINT) AS added, CAST(deleted AS BIGINT) AS deleted, floor(commits * sqrt(added + deleted) * 10 + 0.5) / 10 AS score FROM g ORDER BY score DESC, path LIMIT 20""",
    "numstat",
)
def hotspots(spark, sf_dir):
    return quality.hotspots(A.numstat(spark, sf_dir))


_BAND = "CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'high' ELSE 'critical' END"
_LBAND = "CASE WHEN length <= 20 THEN 'short' WHEN length <= 50 THEN 'medium' WHEN length <= 100 THEN 'long' ELSE 'too-long' END"


@query(f"""SELECT file, name, complexity, {_BAND} AS risk FROM functions WHERE complexity >= 3 ORDER BY complexity DESC, file, name LIMIT 10""", "functions")
def complexity_report(spark, sf_dir):
    return quality.metric_report(A.functions(spark, sf_dir).select("file", "name", "complexity"), "complexity", threshold=3)


_STATS = """SELECT count(*) AS total_count, avg({m}) AS total_avg, CAST(max({m}) AS BIGINT) AS total_max, count(*) FILTER (band = '{c}') AS critical_count, count(*) FILTER (band = '{h}') AS high_count,
    100.0::DOUBLE * (1 - count(*) FILTER (band = '{h}') / count(*)) AS score, 100.0::DOUBLE * (1 - (count(*) FILTER (band = '{h}') + count(*) FILTER (band = '{c}')) / count(*)) AS score_strict
    FROM (SELECT {m}, {b} AS band FROM functions)"""


@query(_STATS.format(m="complexity", c="critical", h="high", b=_BAND), "functions")
def complexity_full_stats(spark, sf_dir):
    return quality.metric_stats(A.functions(spark, sf_dir), "complexity")


@query(f"""SELECT file, name, length, {_LBAND} AS risk FROM functions ORDER BY length DESC, file, name LIMIT 10""", "functions")
def length_report(spark, sf_dir):
    return quality.metric_report(A.functions(spark, sf_dir).select("file", "name", "length"), "length")


@query(_STATS.format(m="length", c="too-long", h="long", b=_LBAND), "functions")
def length_full_stats(spark, sf_dir):
    return quality.metric_stats(A.functions(spark, sf_dir), "length")


@query(
    f""", f AS (SELECT count(*) AS total_files, CAST(sum(lines) AS BIGINT) AS total_lines, count(*) FILTER (lines >= 500) AS large_files, count(*) FILTER (lines >= 1000 AND lines < 2000) AS very_large, count(*) FILTER (lines >= 2000) AS massive FROM files),
        c AS (SELECT count(*) AS total_count, avg(complexity) AS avg_complexity, max(complexity) AS total_max, count(*) FILTER ({_BAND} IN ('high', 'critical')) AS risky FROM functions),
        s AS (SELECT *, risky / total_count AS r FROM f, c),
        t AS (SELECT *, round(0.3::DOUBLE * CASE WHEN avg_complexity <= 3 THEN 1.0 WHEN avg_complexity <= 5 THEN 0.9 WHEN avg_complexity <= 7 THEN 0.8 WHEN avg_complexity <= 10 THEN 0.7 WHEN avg_complexity <= 15 THEN 0.5 ELSE 0.3 END
              + 0.3::DOUBLE * CASE WHEN r <= 0.01 THEN 1.0 WHEN r <= 0.02 THEN 0.9 WHEN r <= 0.03 THEN 0.8 WHEN r <= 0.05 THEN 0.7 WHEN r <= 0.1 THEN 0.5 ELSE 0.3 END
              + 0.4::DOUBLE * CASE WHEN massive > 0 THEN greatest(0.3, 0.5 - 0.1 * massive) WHEN very_large > 5 THEN 0.5 WHEN very_large > 0 THEN 0.7 ELSE 1.0 END, 6) AS score FROM s)
        SELECT total_files, total_lines, large_files, very_large, massive, total_count, avg_complexity, total_max, risky, score,
               CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM t""",
    "files functions",
)
def health_score(spark, sf_dir):
    return quality.health(A.files(spark, sf_dir), A.functions(spark, sf_dir))


@query("""SELECT path, language, lines FROM files ORDER BY lines DESC, path LIMIT 20""", "files")
def longest_files(spark, sf_dir):
    return quality.longest_files(A.files(spark, sf_dir))


@query("""SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM files GROUP BY language""", "files")
def lines_by_language(spark, sf_dir):
    return quality.languages_by_lines(A.files(spark, sf_dir))


@query("""SELECT language, count(*) AS total, count(*) FILTER (documented) AS documented, floor(100.0::DOUBLE * count(*) FILTER (documented) / count(*) * 10 + 0.5) / 10 AS percent FROM callables GROUP BY language""", "callables")
def doc_coverage_by_language(spark, sf_dir):
    return quality.doc_coverage(A.callables(spark, sf_dir), "language")


@query("""SELECT file, count(*) AS total, count(*) FILTER (documented) AS documented, (count(*) FILTER (documented) + 1) / (count(*) + 2) AS estimate FROM callables GROUP BY file ORDER BY estimate, file LIMIT 10""", "callables")
def doc_coverage_worst(spark, sf_dir):
    return quality.worst_documented(A.callables(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (documented) AS documented, floor(100.0::DOUBLE * count(*) FILTER (documented) / count(*) * 10 + 0.5) / 10 AS percent FROM callables""", "callables")
def doc_coverage_overall(spark, sf_dir):
    return quality.overall_coverage(A.callables(spark, sf_dir))


_CLONES = """, f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file, start_line) AS k, count(*) OVER (PARTITION BY hash) AS members FROM functions),
       groups AS (SELECT hash, members, length AS line_count, file AS first_file, name AS first_name FROM f WHERE k = 1 AND members >= 2)
"""


@query(_CLONES + "SELECT * FROM groups", "functions")
def clone_groups(spark, sf_dir):
    return quality.clone_groups(A.functions(spark, sf_dir))


@query(_CLONES + "SELECT count(*) AS groups, CAST(coalesce(sum(members), 0) AS BIGINT) AS functions, CAST(coalesce(sum(members * line_count), 0) AS BIGINT) AS lines FROM groups", "functions")
def clone_totals(spark, sf_dir):
    return quality.clone_totals(quality.clone_groups(A.functions(spark, sf_dir)))


@query(
    """WITH fields AS (SELECT l_orderkey AS type, l_partkey AS name FROM lineitem), sizes AS (SELECT type, count(*) AS size FROM fields GROUP BY type HAVING count(*) >= 2),
       d AS (SELECT DISTINCT type, name FROM fields), c AS (SELECT a.type AS type_a, b.type AS type_b, count(*) AS common FROM d a JOIN d b ON a.name = b.name AND a.type < b.type GROUP BY ALL)
       SELECT type_a, type_b, common, (common * 100) // least(a.size, b.size) AS overlap FROM c JOIN sizes a ON a.type = type_a JOIN sizes b ON b.type = type_b WHERE (common * 100) // least(a.size, b.size) >= 70"""
)
def duplicate_types_overlap(spark, sf_dir):
    return quality.similar_types(A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("type"), F.col("l_partkey").alias("name")))


_COUNTS = """SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"""


@query(_COUNTS + """, CAST(greatest(0, 100 - 40 * count(*) FILTER (severity = 'critical') - 20 * count(*) FILTER (severity = 'high') - 10 * count(*) FILTER (severity = 'medium') - 5 * count(*) FILTER (severity = 'low')) AS BIGINT) AS score FROM findings""", "findings")
def security_severity_counts(spark, sf_dir):
    return quality.security_counts(A.findings(spark, sf_dir))


@query(
    """SELECT round(sum(score * weight) / sum(weight), 6) AS score, CASE WHEN round(sum(score * weight) / sum(weight), 6) >= 90 THEN 'A' WHEN round(sum(score * weight) / sum(weight), 6) >= 80 THEN 'B' WHEN round(sum(score * weight) / sum(weight), 6) >= 70 THEN 'C' WHEN round(sum(score * weight) / sum(weight), 6) >= 60 THEN 'D' ELSE 'F' END AS grade
       FROM (SELECT p_size * 2.0::DOUBLE AS score, p_size % 4 + 0.5::DOUBLE AS weight FROM part)"""
)
def weighted_grade(spark, sf_dir):
    return quality.overall_grade(A.table(spark, sf_dir, "part").select((F.col("p_size") * 2.0).alias("score"), (F.col("p_size") % 4 + 0.5).alias("weight")))


# ---- references ------------------------------------------------------------------------------

_WORD = "(?:^|[ \\n])([A-Z][a-z]{3,})"


@query(
    """WITH lines AS (SELECT CAST(item_id AS VARCHAR) AS file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark)),
       r AS (SELECT file, line, unnest(regexp_extract_all(text, '(?:^|[ \\n])([A-Z][a-z]{3,})', 1)) AS reference FROM lines),
       known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:^|[ \\n])([A-Z][a-z]{3,})', 1)) AS name FROM conversations)
       SELECT file, line, reference, reference AS name FROM r WHERE reference NOT IN (SELECT name FROM known) AND reference NOT IN ('None', 'Some', 'True', 'Path', 'File', 'Read', 'Send', 'Sync', 'Copy', 'False', 'Write', 'Debug', 'Clone', 'String', 'Option', 'Result', 'Default', 'Serialize', 'Deserialize')"""
)
def broken_refs(spark, sf_dir):
    items = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).cast("long").alias("line"), "text")
    known = A.table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(1))).alias("name")).distinct()
    return refs.broken_references(refs.doc_references(items, _WORD), known)


@query(
    """SELECT 'd' || doc_id || '#q' || quality AS reference, 'l' AS file, doc_id AS line FROM labels
       WHERE 'd' || doc_id || '#q' || quality NOT IN (SELECT 'd' || doc_id || '#q1' FROM documents)"""
)
def missing_examples(spark, sf_dir):
    lines = A.table(spark, sf_dir, "labels").select(F.lit("l").alias("file"), F.col("doc_id").alias("line"), F.concat(F.lit("see {{example: d"), F.col("doc_id").cast("string"), F.lit("#q"), F.col("quality").cast("string"), F.lit("}}")).alias("text"))
    markers = refs.example_markers(A.table(spark, sf_dir, "documents").select(A.tag("d", "doc_id").alias("file"), F.lit("// [example: q1]").alias("text")))
    return refs.missing_examples(lines.withColumn("file", F.concat(F.lit("l"), F.col("line").cast("string"))), markers).select("reference", F.lit("l").alias("file"), "line")


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS doc, count(*) FILTER ({_DAY.format('l_shipdate')} > {_DAY.format('o_orderdate')}) AS newer, max({_DAY.format('l_shipdate')}) - {_DAY.format('o_orderdate')} AS days
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate HAVING max({_DAY.format('l_shipdate')}) > {_DAY.format('o_orderdate')}"""
)
def stale_docs(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", (_day("o_orderdate") * 86400).alias("doc_mtime"))
    items = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("path"), (_day("l_shipdate") * 86400).alias("mtime"))
    return refs.stale_docs(orders.join(items, "o_orderkey").withColumn("doc", F.col("o_orderkey").cast("string")))


# ---- sessions --------------------------------------------------------------------------------

_TURNS = """, t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS BIGINT) AS turn FROM messages)
"""


@query(_TURNS + "SELECT path, line, role, turn FROM t", "messages")
def session_turns(spark, sf_dir):
    return sessions.turns(A.messages(spark, sf_dir)).select("path", "line", "role", "turn")


@query("""SELECT role, count(*) AS messages FROM messages GROUP BY role""", "messages")
def session_role_counts(spark, sf_dir):
    return sessions.role_counts(A.messages(spark, sf_dir))


@query(_TURNS + """, p AS (SELECT path, turn, count(*) FILTER (role = 'assistant') AS calls FROM t GROUP BY path, turn)
       SELECT path, count(*) FILTER (calls = 1) AS single_tool_turns, count(*) AS turns FROM p GROUP BY path""", "messages")
def session_single_tool_turns(spark, sf_dir):
    rows = sessions.turns(A.messages(spark, sf_dir))
    return sessions.single_tool_turns(rows.withColumn("type", F.when(F.col("role") == "assistant", "tool_use").otherwise("text")))


@query(
    """WITH e AS (SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 'Exit code 1, timeout ' WHEN 1 THEN 'Not Found: import ' WHEN 2 THEN 'no permission ' WHEN 3 THEN 'TIMEOUT ' WHEN 4 THEN 'SyntaxError, import ' WHEN 5 THEN 'ImportError ' WHEN 6 THEN 'timed out ' ELSE 'broke ' END || event_id AS text,
                  CASE event_id % 8 WHEN 0 THEN 'Command failure' WHEN 1 THEN 'File not found' WHEN 2 THEN 'Permission error' WHEN 3 THEN 'Timeout' WHEN 4 THEN 'Syntax error' WHEN 5 THEN 'Import error' ELSE 'Other' END AS category FROM events WHERE event_type = 'error'),
       r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY user_id, event_id) AS k FROM e)
       SELECT category, count(*) AS count, string_agg(left(text, 100), '|' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY category"""
)
def session_error_patterns(spark, sf_dir):
    said = F.expr("element_at(array('Exit code 1, timeout ', 'Not Found: import ', 'no permission ', 'TIMEOUT ', 'SyntaxError, import ', 'ImportError ', 'timed out ', 'broke '), cast(event_id % 8 + 1 as int))")
    errors = A.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.concat(said, F.col("event_id").cast("string")).alias("text"))
    return sessions.error_patterns(errors).select("category", "count", F.array_join("examples", "|").alias("examples"))


@query(
    """WITH c AS (SELECT event_type AS name, count(*) AS calls, count(*) FILTER (event_id % 4 = 0 AND event_id % 2 = 0) AS errors FROM events GROUP BY event_type)
       SELECT name, calls, CAST(errors AS BIGINT) AS errors, (calls - errors) / calls AS success_rate FROM c"""
)
def session_tool_stats(spark, sf_dir):
    events = A.table(spark, sf_dir, "events")
    calls = events.select(F.col("user_id").alias("path"), F.lit("tool_use").alias("type"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(False).alias("is_error"))
    results = events.where("event_id % 2 = 0").select(F.col("user_id").alias("path"), F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.col("event_id").cast("string").alias("tool_use_id"), F.expr("event_id % 4 = 0").alias("is_error"))
    return sessions.tool_stats(calls.union(results))


_USAGE = """, u AS (SELECT CAST(length(text) AS BIGINT) AS input, CAST(line * 10 AS BIGINT) AS output, CAST(path % 7 AS BIGINT) AS cache_read, CAST(path % 3 AS BIGINT) AS cache_create FROM messages WHERE role = 'assistant')
"""


@query(
    _USAGE + """SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_create) AS BIGINT) AS cache_create, count(*) AS calls,
       min(nullif(input + cache_read, 0)) AS min_context, max(input + cache_read) AS max_context, CAST((sum(input) + sum(cache_read)) // count(*) AS BIGINT) AS avg_context,
       CAST(sum(input) + sum(output) + sum(cache_read) + sum(cache_create) AS BIGINT) AS total_tokens FROM u""",
    "messages",
)
def session_token_stats(spark, sf_dir):
    usage = A.messages(spark, sf_dir).where("role = 'assistant'").select(F.length("text").cast("long").alias("input"), (F.col("line") * 10).cast("long").alias("output"), (F.col("path") % 7).cast("long").alias("cache_read"), (F.col("path") % 3).cast("long").alias("cache_create"))
    return sessions.token_stats(usage)


@query(
    """SELECT user_id AS path, event_type AS request_id, max_by(event_id % 100, event_id) AS turn, max(CAST(floor(value) AS BIGINT)) AS input, max(event_id % 11) AS output, max(event_id % 13) AS cache_read, max(event_id % 17) AS cache_create
       FROM events GROUP BY user_id, event_type"""
)
def usage_dedup_max_per_request(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    records = e.select(F.col("user_id").alias("path"), F.col("event_type").alias("request_id"), F.col("event_id").alias("line"), (F.col("event_id") % 100).alias("turn"), F.floor("value").cast("long").alias("input"), *[(F.col("event_id") % n).alias(c) for n, c in ((11, "output"), (13, "cache_read"), (17, "cache_create"))])
    return sessions.usage_by_request(records)


@query(
    """SELECT conv_id AS path, max(turn) * 86400 AS mtime FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE regexp_matches(text, 'th')) GROUP BY conv_id HAVING max(turn) * 86400 >= 86400 AND max(turn) * 86400 < 4 * 86400 ORDER BY mtime DESC, path LIMIT 20"""
)
def session_list_window(spark, sf_dir):
    rows = A.messages(spark, sf_dir)
    listed = rows.groupBy("path").agg((F.max("line") * 86400).alias("mtime"))
    return sessions.sessions_by_time(listed, since=86400, until=3 * 86400, matching=rows.where(F.col("text").rlike("th")))


# ---- packages --------------------------------------------------------------------------------


@query("""SELECT p_name AS package, p_partkey AS line FROM part WHERE (p_size % 5, p_size % 3) <= (3, 1) AND (p_size % 2 = 0 OR (p_size % 7, 0) >= (3, 1))""")
def package_version_range_lookup(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    held = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("p_size % 5").alias("min_major"), F.expr("p_size % 3").alias("min_minor"), F.expr("case when p_size % 2 <> 0 then p_size % 7 end").alias("max_major"), F.expr("case when p_size % 2 <> 0 then 0 end").alias("max_minor"))
    return packages.package_symbols(held, part.select(F.col("p_partkey").alias("package_id"), F.col("p_partkey").alias("line")), (3, 1)).select("package", "line")


def _edges(spark, sf_dir):
    region, nation, supplier = (A.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    lower = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    top = lower.select(F.col("r_name").alias("project"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.col("n_nationkey").cast("long").alias("ordinal"))
    leaf = supplier.join(lower, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("project"), F.col("n_name").alias("parent"), F.col("s_name").alias("child"), F.col("s_suppkey").cast("long").alias("ordinal"))
    return top.union(leaf)


@query(
    """WITH RECURSIVE edges AS (SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
       target AS (SELECT min(s_name) AS t FROM supplier),
       walk AS (SELECT r_name AS name, [r_name] AS path FROM region UNION ALL SELECT child, list_append(path, child) FROM walk JOIN edges ON parent = name)
       SELECT array_to_string(path, ' > ') AS path, CAST(len(path) - 1 AS BIGINT) AS depth FROM walk, target WHERE name = t"""
)
def dependency_paths(spark, sf_dir):
    target = A.table(spark, sf_dir, "supplier").agg(F.min("s_name")).first()[0]
    return packages.dependency_paths(_edges(spark, sf_dir).select("parent", "child"), A.table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), target)


@query(
    """WITH n AS (SELECT r_name AS project, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
       rows AS (SELECT DISTINCT project, -1 AS a, -1 AS b, CAST(0 AS BIGINT) AS depth, project AS name FROM n
                UNION ALL SELECT project, n_nationkey, -1, 1, n_name FROM n UNION ALL SELECT project, n_nationkey, s_suppkey, 2, s_name FROM supplier JOIN n ON s_nationkey = n_nationkey)
       SELECT project, row_number() OVER (PARTITION BY project ORDER BY a, b) - 1 AS position, depth, name, true AS expanded FROM rows"""
)
def dependency_tree(spark, sf_dir):
    return packages.dependency_tree(_edges(spark, sf_dir))


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey + s_suppkey % 2 END AS installed, CAST(s_nationkey AS BIGINT) AS latest FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 <> 0""")
def outdated_join(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    return packages.outdated(s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.expr("s_nationkey + s_suppkey % 2").alias("installed")), s.select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("latest")))


@query(_COUNTS + ", count(*) FILTER (severity IN ('critical', 'high')) > 0 AS fails FROM findings", "findings")
def audit_counts(spark, sf_dir):
    return packages.audit(A.findings(spark, sf_dir))


@query("""SELECT p_partkey, p_name AS name FROM part WHERE p_name ILIKE '%bol%' OR p_type ILIKE '%bol%' UNION SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%promo%' OR p_type ILIKE '%promo%'""")
def registry_search(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return packages.search_registry(parts, "BOL", descriptions=True).union(packages.search_registry(parts, "promo", descriptions=True)).select("p_partkey", "name").distinct()


@query("""SELECT l_orderkey AS name, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey""")
def first_entry_by_name(spark, sf_dir):
    return packages.first_by_name(A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("line")))


# ---- rules, edits and trees ------------------------------------------------------------------


@query(
    """, rules(id, severity, message, languages, regex) AS (VALUES ('no-todo', 'info', 'found', [], 'of the'), ('no-la', 'warning', 'la', ['fr'], 'la [a-z]+'))
       SELECT id AS rule_id, l.file, l.line, CAST(strpos(l.text, regexp_extract(l.text, regex)) AS BIGINT) AS col, severity, message, regexp_extract(l.text, regex) AS matched
       FROM lines l JOIN files f ON l.file = f.path JOIN rules ON regexp_matches(l.text, regex) AND (len(languages) = 0 OR list_contains(languages, language))""",
    "lines files",
)
def rules_findings(spark, sf_dir):
    files = A.files(spark, sf_dir)
    lines = files.select(F.col("path").alias("file"), "language", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), r"\r?\n")).alias("at", "text")).select("file", "language", (F.col("at") + 1).cast("long").alias("line"), "text")
    given = spark.createDataFrame([("no-todo", "info", "found", [], "of the"), ("no-la", "warning", "la", ["fr"], "la [a-z]+")], "id string, severity string, message string, languages array<string>, regex string")
    return rules.line_findings(lines, given)


@query(
    """, l AS (SELECT file, line, CASE number % 3 WHEN 0 THEN 'allow: rule-a' WHEN 1 THEN 'allow: rule-ab' ELSE 'x' END AS text FROM ranges)
       SELECT a.file, a.line, 'rule-a' AS rule_id FROM l a LEFT JOIN l b ON a.file = b.file AND b.line = a.line - 1 WHERE a.text <> 'allow: rule-a' AND (b.text IS NULL OR b.text <> 'allow: rule-a')""",
    "ranges",
)
def rule_suppression(spark, sf_dir):
    lines = A.ranges(spark, sf_dir).select("file", "line", F.expr("case number % 3 when 0 then 'x // allow: rule-a' when 1 then 'y // allow: rule-ab' else 'z' end").alias("text"))
    return rules.unsuppressed(lines.select("file", "line", F.lit("rule-a").alias("rule_id")), lines).select("file", "line", "rule_id")


@query("""SELECT path AS file, md5(CASE WHEN length(content) >= 8 THEN 'X' || substr(content, 3, 3) || '[6]' || substr(content, 7) ELSE content END) AS digest FROM files""", "files")
def fix_apply(spark, sf_dir):
    files = A.files(spark, sf_dir).select(F.col("path").alias("file"), "content")
    some = files.where(F.length("content") >= 8)
    fixes = some.select("file", F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("X").alias("text")).union(some.select("file", F.lit(5), F.lit(6), F.lit("[6]")))
    return rules.apply_fixes(files, fixes).select("file", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""SELECT a.file, a.id AS edit_id_a, b.id AS edit_id_b FROM ranges a JOIN ranges b ON a.file = b.file AND a.id < b.id AND a.start_line <= b.end_line AND b.start_line <= a.end_line""", "ranges")
def edit_plan_overlaps(spark, sf_dir):
    return edits.conflicts(A.ranges(spark, sf_dir).withColumnRenamed("id", "edit_id")).select("file", "edit_id_a", "edit_id_b")


@query("""SELECT path AS file, md5(CASE WHEN content <> '' THEN regexp_extract(split_part(content, chr(10), 1), '^\\s*') || 'HEAD' || chr(10) || content ELSE content END) AS digest FROM files""", "files")
def edit_apply(spark, sf_dir):
    files = A.files(spark, sf_dir).select(F.col("path").alias("file"), "content")
    batch = files.where("content <> ''").select(F.col("file").alias("edit_id"), "file", F.lit("insert").alias("action"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("HEAD").alias("content"), F.lit("before").alias("position"))
    return edits.apply_batch(files, batch).select("file", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    """WITH v AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_type AS content, count(*) OVER (PARTITION BY user_id) AS n FROM events)
       SELECT file, n + 1 AS version, 'undo' AS operation, content, 'h' AS git_head FROM v WHERE version = n - 1"""
)
def history_undo(spark, sf_dir):
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    versions = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), version.alias("version"), F.lit("edit").alias("operation"), F.col("event_type").alias("content"), F.lit("h").alias("git_head"))
    return edits.undo(versions)


@query("""SELECT props ->> '$.k' AS value FROM events WHERE json_type(props, '$.k') IS NOT NULL""")
def json_path_select(spark, sf_dir):
    return jq.apply(A.table(spark, sf_dir, "events"), "props", ".k").where("value is not null")


@query(
    """WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS l FROM pages),
       n AS (SELECT array_to_string(l[1:k], '/') AS path, k AS depth, k = len(l) AS leaf, l[1:k] AS own FROM (SELECT l, unnest(range(1, len(l) + 1)) AS k FROM p)),
       g AS (SELECT path, any_value(depth) AS depth, bool_and(leaf) AS leaf, count(*) AS files, any_value(own) AS own FROM n GROUP BY path)
       SELECT path, CASE WHEN leaf THEN 'file' ELSE 'directory' END AS kind, depth, len(list_filter(own, lambda x: x NOT IN ('src', 'lib', 'pkg', 'packages', 'crates', 'internal', 'cmd'))) AS effective_depth, files FROM g
       WHERE len(list_filter(own, lambda x: x NOT IN ('src', 'lib', 'pkg', 'packages', 'crates', 'internal', 'cmd'))) <= 2"""
)
def dir_tree_smart_depth(spark, sf_dir):
    return tree.directory_tree(A.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


@query(
    """, h AS (SELECT file, line, CAST(1 + number % 6 AS INTEGER) AS level, 't' || number AS title FROM ranges)
       SELECT file, line, level, title,
         coalesce((SELECT min(b.line) - 1 FROM h b WHERE b.file = a.file AND b.line > a.line AND b.level <= a.level), 99) AS end_line,
         (SELECT arg_max(b.title, b.line) FROM h b WHERE b.file = a.file AND b.line < a.line AND b.level < a.level) AS parent FROM h a""",
    "ranges",
)
def heading_scopes(spark, sf_dir):
    heads = A.ranges(spark, sf_dir).select("file", "line", (F.col("number") % 6 + 1).cast("int").alias("level"), A.tag("t", "number").alias("title"), F.lit(99).cast("long").alias("n_lines"))
    return tree.heading_scopes(heads)


@query("""SELECT path, translate(lower(path), '-._', '   ') AS normal FROM files""", "files")
def normalized_paths(spark, sf_dir):
    return A.files(spark, sf_dir).select("path", normal_path(F.col("path")).alias("normal"))


# ---- streams ------------------------------------------------------------

@query("""SELECT CAST(user_id AS VARCHAR) AS path, max(event_id) AS mtime, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id""")
def stream_incremental_refresh(spark, sf_dir):
    """All events through a file stream into the latest state of each user."""
    scratch = folder(spark, "stream")
    kept = A.table(spark, sf_dir, "events")
    # a file source reads folders only
    kept.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("mtime"), F.col("event_type").alias("status")).write.parquet(f"{scratch}/in")
    events = spark.readStream.schema("path string, mtime long, status string").parquet(f"{scratch}/in")
    refresh.follow(events, f"{scratch}/out", f"{scratch}/checkpoint", once=True).awaitTermination()
    return refresh.state(spark, f"{scratch}/out")
