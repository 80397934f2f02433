"""Registered queries of views, context, reports and upkeep over relations that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode import adapters as A
from codelode.operators import callgraph, context, edits, outline, quality, refs, rules, sessions, syntax, tree, views
from codelode.plans import upkeep
from codelode.plans.registered import query
from codelode.plans.registered_code import CODE, code_files, placed_files
from codelode.scratch import folder, written
from codelode.sources import registries

_CODE = "WITH nothing AS (SELECT 1)" + CODE


# ---- views -----------------------------------------------------------------------------------


@query(_CODE + """ SELECT path AS file, start_line + 3 AS line, CASE WHEN lang = 'de' THEN ['Box', name] ELSE [name] END AS symbols FROM code""")
def symbol_ancestors(spark, sf_dir):
    found = syntax.rows(placed_files(code_files(spark, sf_dir)))
    symbols = written(syntax.definitions(found).withColumnRenamed("path", "file"), "symbols")
    return views.ancestors_at(symbols, symbols.where("kind = 'function'").select("file", (F.col("start_line") + 3).alias("line")))


@query(
    """, named AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM files), folders AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) AS f FROM files)
       SELECT path AS target, 'file' AS view, path AS file, NULL AS symbol, CAST(NULL AS BIGINT) AS line FROM files
       UNION ALL SELECT path || ':12', 'line', path, NULL, 12 FROM files UNION ALL SELECT path || '#Outer', 'symbol', path, 'Outer', NULL FROM files UNION ALL SELECT path || '/Outer/inner', 'symbol', path, 'Outer/inner', NULL FROM files
       UNION ALL SELECT f || '/', 'folder', f, NULL, NULL FROM folders UNION ALL SELECT '@' || f, 'alias', NULL, NULL, NULL FROM folders UNION ALL SELECT 'x' || f, 'search', NULL, NULL, NULL FROM folders""",
    "files",
)
def view_routes(spark, sf_dir):
    files = A.files(spark, sf_dir).select("path")
    tops = files.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("f")).distinct()
    shapes = [files.select(F.concat("path", F.lit(end)).alias("target")) for end in ("", ":12", "#Outer", "/Outer/inner")] + [tops.select(F.concat(F.lit(a), "f", F.lit(b)).alias("target")) for a, b in (("", "/"), ("@", ""), ("x", ""))]
    targets = shapes[0]
    for more in shapes[1:]:
        targets = targets.union(more)
    return views.route(targets, files)


@query(
    """WITH held AS (SELECT s_suppkey + 1 AS line, 'x/' || (s_suppkey % 30) AS text FROM supplier), asked AS (SELECT DISTINCT 'x/' || (p_partkey % 45) AS text FROM part),
       fresh AS (SELECT text, row_number() OVER (ORDER BY text) AS n FROM asked WHERE text NOT IN (SELECT text FROM held))
       SELECT line, text FROM held UNION ALL SELECT (SELECT max(line) FROM held) + 2 * n - 1, '# moved' FROM fresh UNION ALL SELECT (SELECT max(line) FROM held) + 2 * n, text FROM fresh"""
)
def allow_file_appended(spark, sf_dir):
    held = A.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("line"), A.tag("x/", "s_suppkey % 30").alias("text"))
    return views.allow_added(held, A.table(spark, sf_dir, "part").select(A.tag("x/", "p_partkey % 45").alias("text"), F.lit("moved").alias("reason")))


@query("""SELECT file, line, text FROM lines WHERE line BETWEEN 2 AND 4 AND file = (SELECT min(file) FROM lines) AND line <> 3""", "lines")
def lines_of_range(spark, sf_dir):
    lines = A.lines(spark, sf_dir)
    first = lines.agg(F.min("file")).first()[0]
    return tree.line_range(lines, first, 2, 4, without=lines.where("line = 3")).select("file", "line", "text")


@query(
    """, marked AS (SELECT file, line, CASE WHEN line % 3 = 1 THEN repeat('#', 1 + CAST(line % 6 AS INTEGER)) || ' ' || text || ' #' ELSE text END AS text FROM lines WHERE text NOT LIKE '%#%' AND trim(text) <> '')
       SELECT file, line, CAST(1 + line % 6 AS INTEGER) AS level, trim(regexp_replace(text, '^#+', '')) AS said FROM marked WHERE text LIKE '#%'""",
    "lines",
)
def markdown_headings(spark, sf_dir):
    plain = A.lines(spark, sf_dir).where("text not like '%#%' and trim(text) <> ''")
    text = F.when(F.col("line") % 3 == 1, F.concat(F.expr("repeat('#', cast(1 + line % 6 as int))"), F.lit(" "), "text", F.lit(" #"))).otherwise(F.col("text"))
    return tree.markdown_headings(plain.withColumn("text", text)).select("file", "line", "level", F.concat(F.trim("title"), F.lit(" #")).alias("said"))


@query(
    """WITH parts AS (SELECT string_split('r/' || regexp_replace(url, '^[a-z]+://', ''), '/') AS l FROM pages),
       nodes AS (SELECT array_to_string(l[1:k], '/') AS path, bool_and(k = len(l)) AS leaf FROM (SELECT l, unnest(range(1, len(l) + 1)) AS k FROM parts) GROUP BY 1),
       kids AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, count(*) AS n, bool_or(leaf) AS leafy FROM nodes GROUP BY 1)
       SELECT path FROM nodes WHERE path NOT IN (SELECT up FROM kids WHERE n = 1 AND NOT leafy)"""
)
def collapsed_chains(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(F.concat(F.lit("r/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    return tree.collapse_chains(tree.directory_tree(pages, depth=1_000_000)).select("path")


# ---- context ---------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT page_id, page_id % 6 AS a, page_id % 4 AS b FROM pages)
       SELECT 'd' || a || '/e' || b || '/p' || page_id AS path, 'root' || CASE WHEN a % 2 = 0 THEN chr(10) || chr(10) || 'in d' || a ELSE '' END || CASE WHEN b = 1 THEN chr(10) || chr(10) || 'in e1' ELSE '' END AS context FROM t"""
)
def merged_context(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select("page_id", F.expr("page_id % 6").alias("a"), F.expr("page_id % 4").alias("b"))
    targets = pages.select(F.concat(A.tag("d", "a"), A.tag("/e", "b"), A.tag("/p", "page_id")).alias("path"))
    notes = pages.where("a % 2 = 0").select(F.concat(A.tag("d", "a"), F.lit("/.context.md")).alias("path"), F.concat(A.tag("in d", "a"), F.lit("\n")).alias("content")).distinct()
    more = pages.where("b = 1").select(F.concat(A.tag("d", "a"), A.tag("/e", "b"), F.lit("/CONTEXT.md")).alias("path"), F.lit(" in e1").alias("content")).distinct()
    top = pages.limit(1).select(F.lit("CONTEXT.md").alias("path"), F.lit("root").alias("content"))
    return context.merged_context(notes.union(more).union(top), targets)


@query(
    """WITH seen AS (SELECT DISTINCT 'm' || (p_partkey % 30) AS marker FROM part), tools AS (SELECT 't' || (s_suppkey % 9) AS tool, 'm' || (s_suppkey % 40) AS marker, s_suppkey % 5 AS weight FROM supplier WHERE s_suppkey % 4 <> 0)
       SELECT tool, max(weight) AS score FROM tools JOIN seen USING (marker) GROUP BY tool HAVING max(weight) > 0"""
)
def tools_detected(spark, sf_dir):
    files = A.table(spark, sf_dir, "part").select(F.concat(F.col("p_brand"), A.tag("/m", "p_partkey % 30")).alias("path"))
    tools = A.table(spark, sf_dir, "supplier").select(A.tag("t", "s_suppkey % 9").alias("tool"), A.tag("m", "s_suppkey % 40").alias("marker"), F.expr("s_suppkey % 5").alias("weight"), F.expr("s_suppkey % 4 <> 0").alias("available"))
    return context.detected_tools(tools, files)


_SPANS = "spans AS (SELECT DISTINCT 'f' || (l_orderkey % 50) AS file, 's' || (l_orderkey % 400) AS symbol, 'p' || (l_partkey % 300) AS identifier FROM lineitem)"


def _spans(spark, sf_dir):
    """Sources of spans: the names that a span's calls use, between words of code."""
    item = A.table(spark, sf_dir, "lineitem").select(A.tag("f", "l_orderkey % 50").alias("file"), A.tag("s", "l_orderkey % 400").alias("symbol"), A.tag("p", "l_partkey % 300").alias("n")).distinct()
    return context.identifiers(item.groupBy("file", "symbol").agg(F.array_join(F.collect_list("n"), "(1); ").alias("source")))


@query(", " + _SPANS + """ SELECT s.file, symbol, coalesce(alias, name) AS identifier, module, line FROM spans s JOIN imports i ON i.file = s.file AND coalesce(alias, name) = identifier""", "imports")
def smart_imports(spark, sf_dir):
    return context.smart_imports(A.imports(spark, sf_dir), _spans(spark, sf_dir)).select("file", "symbol", "identifier", "module", "line")


@query(
    "WITH " + _SPANS + """, refs AS (SELECT DISTINCT file, identifier FROM spans), d AS (SELECT 'f' || (p_partkey % 50) AS def_file, 'p' || (p_partkey % 300) AS name, p_size AS start_line FROM part)
       SELECT file, identifier, def_file, CAST(start_line AS BIGINT) AS start_line FROM (SELECT r.*, d.def_file, d.start_line, row_number() OVER (PARTITION BY file, identifier ORDER BY def_file <> file, def_file, start_line) AS k FROM refs r JOIN d ON name = identifier) WHERE k = 1"""
)
def type_references(spark, sf_dir):
    defined = A.table(spark, sf_dir, "part").select(A.tag("f", "p_partkey % 50").alias("file"), A.tag("p", "p_partkey % 300").alias("name"), F.col("p_size").cast("long").alias("start_line"))
    return context.type_references(_spans(spark, sf_dir).select("file", "identifier").distinct(), defined)


@query(
    """WITH b AS (SELECT s_suppkey, 'mod_' || (s_suppkey % 20) AS module, CASE s_suppkey % 3 WHEN 0 THEN 'pyo3' WHEN 1 THEN 'napi' END AS binding FROM supplier),
       mods AS (SELECT DISTINCT module, binding, CASE binding WHEN 'pyo3' THEN 'Python' ELSE 'JavaScript' END AS language FROM b WHERE binding IS NOT NULL)
       SELECT 'f' || (p_partkey % 50) AS file, CAST(p_size AS BIGINT) AS line, module, binding, language FROM part JOIN mods ON module = 'mod_' || (p_partkey % 25)"""
)
def foreign_references(spark, sf_dir):
    marks = F.expr("case s_suppkey % 3 when 0 then 'pyo3 = \"1\"' when 1 then 'napi = \"2\"' else '' end")
    build = A.table(spark, sf_dir, "supplier").select(F.concat(A.tag("c", "s_suppkey"), F.lit("/Cargo.toml")).alias("path"), F.concat(F.lit('[package]\nname = "mod-'), F.expr("s_suppkey % 20"), F.lit('"\n[dependencies]\n'), marks).alias("content"))
    used = A.table(spark, sf_dir, "part").select(A.tag("f", "p_partkey % 50").alias("file"), F.concat(A.tag("mod_", "p_partkey % 25"), F.lit(".inner")).alias("module"), F.lit("x").alias("name"), F.col("p_size").cast("long").alias("line"))
    return context.foreign_references(used, context.foreign_modules(build).distinct())


@query(
    """, signed AS (SELECT file, name, start_line, min('sig ' || kind) AS signature FROM symbols GROUP BY ALL)
       SELECT c.file, c.name, coalesce((SELECT arg_min(signature, start_line) FROM signed s WHERE s.file = c.file AND s.name = c.name), (SELECT arg_min(signature, (file, start_line)) FROM signed s WHERE s.name = c.name)) AS signature
       FROM (SELECT DISTINCT 'f' || (l_partkey % 50) AS file, 's' || (l_suppkey % 420) AS name FROM lineitem) c""",
    "symbols",
)
def call_signatures(spark, sf_dir):
    # one signature for each place, so that ties cannot differ
    signed = A.symbols(spark, sf_dir).groupBy("file", "name", "start_line").agg(F.min(F.concat(F.lit("sig "), "kind")).alias("signature"))
    called = A.table(spark, sf_dir, "lineitem").select(A.tag("f", "l_partkey % 50").alias("file"), A.tag("s", "l_suppkey % 420").alias("name")).distinct()
    return views.signatures_of(called, signed)


@query(
    """WITH impl AS (SELECT DISTINCT 'f' || (s_suppkey % 50) AS file, 'C' || (s_suppkey % 10) AS parent, 'i' || (s_suppkey % 8) AS interface FROM supplier),
       meth AS (SELECT DISTINCT 'f' || (p_partkey % 60) AS file, 'i' || (p_partkey % 8) AS interface, 's' || (p_partkey * 3 % 400) AS name FROM part),
       here AS (SELECT i.file, i.parent, i.interface, m.name FROM impl i JOIN meth m ON m.file = i.file AND m.interface = i.interface),
       there AS (SELECT i.file, i.parent, i.interface, m.name FROM impl i JOIN meth m ON m.interface = i.interface WHERE (i.file, i.interface) NOT IN (SELECT (file, interface) FROM here)),
       marked AS (SELECT file, parent, name FROM here UNION SELECT file, parent, name FROM there)
       SELECT 'f' || (p_partkey % 50) AS file, 's' || (p_partkey % 400) AS name, CASE WHEN p_size % 3 = 0 THEN 'C' || (p_size % 10) END AS parent, p_partkey AS id,
              EXISTS (SELECT 1 FROM marked m WHERE m.file = 'f' || (p_partkey % 50) AND m.name = 's' || (p_partkey % 400) AND m.parent = CASE WHEN p_size % 3 = 0 THEN 'C' || (p_size % 10) END) AS is_interface_impl FROM part"""
)
def interface_methods(spark, sf_dir):
    implements = A.table(spark, sf_dir, "supplier").select(A.tag("f", "s_suppkey % 50").alias("file"), A.tag("C", "s_suppkey % 10").alias("name"), A.tag("i", "s_suppkey % 8").alias("interface")).distinct()
    methods = A.table(spark, sf_dir, "part").select(A.tag("f", "p_partkey % 60").alias("file"), A.tag("i", "p_partkey % 8").alias("type_name"), A.tag("s", "p_partkey * 3 % 400").alias("method_name")).distinct()
    symbols = A.table(spark, sf_dir, "part").select(A.tag("f", "p_partkey % 50").alias("file"), A.tag("s", "p_partkey % 400").alias("name"), F.when(F.expr("p_size % 3 = 0"), A.tag("C", "p_size % 10")).alias("parent"), F.col("p_partkey").alias("id"))
    return callgraph.mark_interface_methods(symbols, implements, methods).select("file", "name", "parent", "id", "is_interface_impl")


# ---- reports, rules, sessions, upkeep --------------------------------------------------------


@query(
    """WITH n AS (SELECT 'd' || s_suppkey AS doc, s_suppkey * 1000 AS doc_mtime, CASE WHEN s_suppkey % 2 = 0 THEN 'h' || (s_suppkey % 5) || '/*' ELSE 'h' || (s_suppkey % 5) || '/p1' END AS pattern, 'h' || (s_suppkey % 5) AS h, s_suppkey % 2 AS odd FROM supplier),
       f AS (SELECT 'h' || (page_id % 5) || '/p' || page_id AS path, page_id * 997 AS mtime, 'h' || (page_id % 5) AS h FROM pages)
       SELECT doc, path FROM n JOIN f USING (h) WHERE odd = 0 OR starts_with(path, pattern)"""
)
def covers_joined(spark, sf_dir):
    notes = A.table(spark, sf_dir, "supplier").select(A.tag("d", "s_suppkey").alias("doc"), F.expr("s_suppkey * 1000").alias("doc_mtime"), F.concat(A.tag("h", "s_suppkey % 5"), F.when(F.expr("s_suppkey % 2 = 0"), "/*").otherwise("/p1")).alias("pattern"))
    files = A.table(spark, sf_dir, "pages").select(F.concat(A.tag("h", "page_id % 5"), A.tag("/p", "page_id")).alias("path"), F.expr("page_id * 997").alias("mtime"))
    return refs.cover_links(notes, files).select("doc", "path")


@query("""SELECT 'c' || conv_id AS path, CAST(conv_id AS BIGINT) * 3600 AS mtime FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id * 3600 >= 36000 AND conv_id * 3600 < 86400 + 86400 ORDER BY mtime DESC, path LIMIT 20""")
def sessions_by_time(spark, sf_dir):
    held = A.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(A.tag("c", "conv_id").alias("path"), (F.col("conv_id").cast("long") * 3600).alias("mtime"))
    return sessions.sessions_by_time(held, since=36_000, until=86_400)


@query("""SELECT event_id, severity, 'f' || (event_id % 7) AS file, event_id AS line FROM findings WHERE severity IS NOT NULL ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, file, line LIMIT 20""", "findings")
def findings_worst_first(spark, sf_dir):
    rows = A.findings(spark, sf_dir).where("severity is not null").select("event_id", "severity", A.tag("f", "event_id % 7").alias("file"), F.col("event_id").alias("line"))
    return views.ordered_findings(rows)


@query("""SELECT event_id, event_type AS rule_id, CASE WHEN event_type <> 'view' THEN 'help/' || event_type END AS help_uri FROM events""")
def findings_with_help(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule_id"))
    return views.with_help(events, events.where("rule_id <> 'view'").select("rule_id", F.concat(F.lit("help/"), "rule_id").alias("help_uri")).distinct())


@query(
    """WITH r AS (SELECT 'r' || (p_partkey % 60) AS id, ['builtin', 'user', 'project'][1 + p_partkey % 3] AS layer, p_brand AS severity, p_size % 7 <> 0 AS enabled, p_partkey FROM part),
       one AS (SELECT id, layer, min(p_partkey) AS k FROM r GROUP BY id, layer), best AS (SELECT r.* FROM one JOIN r ON r.id = one.id AND r.layer = one.layer AND p_partkey = k QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY list_position(['builtin', 'user', 'project'], r.layer) DESC) = 1)
       SELECT best.id, layer, coalesce(s, severity) AS severity FROM best LEFT JOIN (SELECT 'r' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'error' END AS s, CASE WHEN n_nationkey % 5 = 0 THEN true WHEN n_nationkey % 5 = 1 THEN false END AS e FROM nation) o ON o.id = best.id WHERE coalesce(e, enabled)"""
)
def rules_effective(spark, sf_dir):
    part = A.table(spark, sf_dir, "part").select(A.tag("r", "p_partkey % 60").alias("id"), F.expr("array('builtin', 'user', 'project')[p_partkey % 3]").alias("layer"), F.col("p_brand").alias("severity"), F.expr("p_size % 7 <> 0").alias("enabled"), "p_partkey")
    given = part.groupBy("id", "layer").agg(F.min_by(F.struct("severity", "enabled"), "p_partkey").alias("r")).select("id", "layer", "r.severity", "r.enabled")
    nation = A.table(spark, sf_dir, "nation").select(A.tag("r", "n_nationkey").alias("id"), F.when(F.expr("n_nationkey % 2 = 0"), "error").alias("severity"), F.expr("case n_nationkey % 5 when 0 then true when 1 then false end").alias("enabled"))
    return rules.effective_rules(given, nation).select("id", "layer", "severity")


@query(
    """SELECT path, regexp_matches(path, '/(tests|test|__tests__)/') OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '(_tests?[.]rs|[.](test|spec)[.][tj]s)$') AS is_test FROM (
         SELECT ['a/tests/x', 'tests/x', 'a/__tests__/b', 'a/test_x', 'a/x_test', 'a/x'][1 + page_id % 6] || page_id || ['.rs', '_test.rs', '.spec.ts', '.test.js'][1 + page_id % 4] AS path FROM pages)"""
)
def test_paths(spark, sf_dir):
    path = F.concat(F.expr("array('a/tests/x', 'tests/x', 'a/__tests__/b', 'a/test_x', 'a/x_test', 'a/x')[page_id % 6]"), F.col("page_id").cast("string"), F.expr("array('.rs', '_test.rs', '.spec.ts', '.test.js')[page_id % 4]"))
    return A.table(spark, sf_dir, "pages").select(path.alias("path")).select("path", quality.is_test_path(F.col("path")).alias("is_test"))


@query("""SELECT user_id AS file, event_id AS seq, row_number() OVER (ORDER BY event_id) AS id, event_type AS operation FROM events WHERE event_type = 'error' QUALIFY true""")
def edit_history(spark, sf_dir):
    log = A.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("operation"))
    return edits.history(log).select("file", "seq", F.col("id").cast("long").alias("id"), "operation")


@query("""SELECT user_id AS file, version FROM (SELECT user_id, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3""")
def history_pruned(spark, sf_dir):
    return edits.prune(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("version")), 3)


@query(
    """WITH cache AS (SELECT 'n' || user_id AS name, max(event_id) AS fetched_at, 'old' AS value FROM events WHERE user_id % 3 <> 0 GROUP BY user_id), got AS (SELECT DISTINCT 'n' || user_id AS name, 'new' AS value FROM events WHERE user_id % 2 = 0)
       SELECT coalesce(cache.name, got.name) AS name, CASE WHEN got.name IS NOT NULL AND NOT coalesce(fetched_at > 1000 - 100, false) THEN 1000 ELSE fetched_at END AS fetched_at, CASE WHEN got.name IS NOT NULL AND NOT coalesce(fetched_at > 1000 - 100, false) THEN 'new' ELSE cache.value END AS value
       FROM cache FULL JOIN got ON cache.name = got.name"""
)
def registry_cache(spark, sf_dir):
    events = A.table(spark, sf_dir, "events")
    cache = events.where("user_id % 3 <> 0").groupBy(A.tag("n", "user_id").alias("name")).agg(F.max("event_id").alias("fetched_at")).withColumn("value", F.lit("old"))
    got = events.where("user_id % 2 = 0").select(A.tag("n", "user_id").alias("name"), F.lit("new").alias("value")).distinct()
    return registries.fresh_or_stale(cache, got, now=1000, ttl=100)


@query(
    """WITH old AS (SELECT 'f' || o_custkey AS file, o_orderkey AS line, 'old' AS text FROM orders), touched AS (SELECT DISTINCT 'f' || c_custkey AS file FROM customer WHERE c_custkey % 3 = 0)
       SELECT file, line, text FROM old WHERE file NOT IN (SELECT file FROM touched) UNION ALL SELECT 'f' || c_custkey, -1, 'new' FROM customer WHERE c_custkey % 6 = 0"""
)
def index_refreshed(spark, sf_dir):
    """An index of two batches: the second renews some files and deletes others."""
    path = folder(spark, "index")
    old = A.table(spark, sf_dir, "orders").select(A.tag("f", "o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.lit("old").alias("text"))
    upkeep.write_index({"rows": old}, path, 32)
    customer = A.table(spark, sf_dir, "customer")
    fresh = customer.where("c_custkey % 6 = 0").select(A.tag("f", "c_custkey").alias("file"), F.lit(-1).cast("long").alias("line"), F.lit("new").alias("text"))
    upkeep.refresh(spark, path, "rows", fresh, customer.where("c_custkey % 3 = 0").select(A.tag("f", "c_custkey").alias("file")), buckets=32)
    return spark.read.parquet(f"{path}/rows").select("file", "line", "text")


@query("""SELECT 'apt' AS registry, 'p' || p_partkey AS name, p_size || '.' || (p_partkey % 9) AS version, nullif(p_name, '') AS description, CASE WHEN p_partkey % 2 = 0 THEN 'http://' || p_brand END AS homepage FROM part""")
def index_of_stanzas(spark, sf_dir):
    """Parts written as an index of stanzas, and read back record by record."""
    path = folder(spark, "index")
    home = F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("\nHomepage: http://"), "p_brand")).otherwise("")
    stanza = F.concat(A.tag("Package: p", "p_partkey"), F.lit("\nVersion: "), F.expr("p_size || '.' || (p_partkey % 9)"), F.lit("\nDescription: "), "p_name", F.lit("\n more"), home)
    A.table(spark, sf_dir, "part").select(stanza.alias("value")).write.option("lineSep", "\n\n").text(path)
    return registries.read_index(spark, path, "apt").select("registry", "name", "version", "description", "homepage")


@query(
    _CODE + r""" SELECT path AS file, name, 'fn ' || name || '(x: i32) -> i32 {' || chr(10) || '    let s = "for ' || w[2] || ' {{ ";' || chr(10) || '    if v_' || w[3] || '(x) && v_' || w[4] || '::v_' || w[5] || '(s) { v_' || w[6] || '.run(); }'
         || CASE WHEN odd = 1 THEN chr(10) || '    while go(x) { }' ELSE '' END || chr(10) || '}' AS preview FROM code WHERE lang IN ('en', 'es')"""
)
def structural_previews(spark, sf_dir):
    """Of the functions in Rust: signature, bindings, branches and the closing brace."""
    files = code_files(spark, sf_dir).where("language = 'Rust'")
    symbols = written(syntax.definitions(syntax.rows(placed_files(files))), "symbols")
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")
    spans = symbols.select(F.col("path").alias("file"), "name", F.lit("Rust").alias("language"), "start_line", "end_line")
    return outline.structures(lines, spans).select("file", "name", "preview")
