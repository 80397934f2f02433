"""Registered queries over code, trees and graphs that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode import adapters as A
from codelode.operators import edits, fuzzy, graphs, rules, symbol_edits, syntax, treepattern, views
from codelode.plans.registered import query
from codelode.scratch import dealt, together, written
from codelode.streaming import watch

# ---- code as token rows ----------------------------------------------------------------------

#: A function for each thirty words of a text; what is in comments and strings must not count.
_RUST = ("'fn v_', w[30 * k], '_', k, '(x: i32) -> i32 {'", "'    // ', array_join(slice(w, 30 * k + 1, 30), ' if '), ' {'", "'    let s = \"for ', w[30 * k + 1], ' {{ \";'", "'    if v_', w[30 * k + 2], '(x) && v_', w[30 * k + 3], '::v_', w[30 * k + 4], '(s) { v_', w[30 * k + 5], '.run(); }'", "'    while go(x) { }'", "'    x'", "'}'")
_JAVA = ("'  int v_', w[30 * k], '_', k, '(int x) {'", "'    /* ', array_join(slice(w, 30 * k + 1, 30), ' if '), ' { */'", "'    String s = \"for ', w[30 * k + 1], ' {{ \";'", "'    if (v_', w[30 * k + 2], '(x) && v_', w[30 * k + 3], '.v_', w[30 * k + 4], '(s)) { v_', w[30 * k + 5], '.run(); }'", "'    while (go(x)) { }'", "'    return x;'", "'  }'")
_PYTHON = ("'def v_', w[30 * k], '_', k, '(x):'", "'    # ', array_join(slice(w, 30 * k + 1, 30), ' if '), ':'", "'    s = \"for ', w[30 * k + 1], ' ((\"'", "'    if v_', w[30 * k + 2], '(x) and v_', w[30 * k + 3], '.v_', w[30 * k + 4], '(s): v_', w[30 * k + 5], '.run()'", "'    while go(x): pass'", "'    return x'", "''")


def _function(lines: tuple[str, ...]) -> str:
    said = [f"concat({x})" if k != 4 else f"if(length(w[30 * k + 1]) % 2 = 1, {x}, null)" for k, x in enumerate(lines)]
    return f"array_join(transform(sequence(0, size(w) div 30 - 1), k -> concat_ws('\\n', {', '.join(said)}, '')), '')"


def _worded(spark, sf_dir):
    """path, lang, w: the words of documents, which are dealt to tasks before anything is made of them."""
    docs = A.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "lang", F.col("text").alias("content"))
    return together(docs).select("path", "lang", F.expr("regexp_extract_all(lower(content), '[a-z]+', 0)").alias("w"))


def code_files(spark, sf_dir):
    """path, language, content: documents of at least thirty words as Rust (en, es), Python (fr) or Java (de)."""
    docs = _worded(spark, sf_dir).where(F.size("w") >= 30)
    content = F.expr(f"case lang when 'fr' then {_function(_PYTHON)} when 'de' then concat('class Box {{\\n', {_function(_JAVA)}, '}}\\n') else {_function(_RUST)} end")
    return docs.select("path", F.expr("case lang when 'fr' then 'Python' when 'de' then 'Java' else 'Rust' end").alias("language"), content.alias("content"))


#: The same functions, with their lines, from the words alone.
CODE = r""", worded AS (SELECT source || '/' || doc_id AS path, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
  chunks AS (SELECT path, lang, k, w[30 * k + 1:30 * k + 30] AS w, length(w[30 * k + 2]) % 2 AS odd FROM (SELECT path, lang, w, unnest(range(len(w) // 30)) AS k FROM worded)),
  code AS (SELECT *, 'v_' || w[1] || '_' || k AS name, CASE WHEN lang = 'de' THEN 2 ELSE 1 END + coalesce(sum(6 + odd) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_line FROM chunks)"""
_CODE = "WITH nothing AS (SELECT 1)" + CODE


def placed_files(files):
    """Files with their tokens, as a table: a row a file, so nothing is said twice."""
    return written(syntax.placed(files, dealt=True), "tokens")


def _tokens(spark, sf_dir):
    return syntax.rows(placed_files(code_files(spark, sf_dir)))


def _symbols(found):
    return written(syntax.definitions(found), "symbols")


@query(_CODE + """ SELECT path, name, 'function' AS kind, start_line, start_line + 5 + odd - CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS end_line, CASE WHEN lang = 'de' THEN 'Box' END AS parent FROM code
       UNION ALL SELECT path, 'Box', 'class', 1, max(start_line + 6 + odd), NULL FROM code WHERE lang = 'de' GROUP BY path""")
def code_symbols(spark, sf_dir):
    return _symbols(_tokens(spark, sf_dir)).select("path", "name", "kind", "start_line", "end_line", "parent")


@query(_CODE + """ SELECT path, name, start_line, 3 + odd AS complexity FROM code""")
def code_complexity(spark, sf_dir):
    found = _tokens(spark, sf_dir)
    return syntax.complexity(found, _symbols(found)).select("path", "name", "start_line", "complexity")


_CALLS = """ SELECT path AS caller_file, name AS caller_symbol, unnest(['v_' || w[3], 'v_' || w[5], 'run'] || CASE WHEN odd = 1 THEN ['go'] ELSE [] END) AS callee_name, unnest([NULL, 'v_' || w[4], 'v_' || w[6]] || CASE WHEN odd = 1 THEN [NULL] ELSE [] END) AS callee_qualifier,
       unnest([start_line + 3, start_line + 3, start_line + 3] || CASE WHEN odd = 1 THEN [start_line + 4] ELSE [] END) AS line FROM code"""


@query(_CODE + _CALLS)
def code_calls(spark, sf_dir):
    found = _tokens(spark, sf_dir)
    return syntax.calls(found, _symbols(found))


@query(_CODE + """ SELECT members, count(*) AS groups FROM (SELECT lang IN ('fr') AS py, lang IN ('de') AS java, odd, w[1] = w[3] AND false AS x, count(*) AS members FROM code GROUP BY ALL) GROUP BY members""")
def code_clones_elided(spark, sf_dir):
    """Functions alike but for names and literals: two forms a language."""
    found = placed_files(code_files(spark, sf_dir))
    hashes = syntax.clone_hashes(found, _symbols(syntax.rows(found)), elide_names=True, elide_literals=True)
    return hashes.groupBy("hash").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))


def _python(spark, sf_dir):
    return syntax.rows(placed_files(code_files(spark, sf_dir).where("language = 'Python'")))


@query(_CODE + """ SELECT path AS file, name, 'function' AS kind, start_line, start_line + 4 + odd AS end_line, CAST(NULL AS VARCHAR) AS parent, 3 + odd AS complexity FROM code WHERE lang = 'fr'""")
def python_symbols(spark, sf_dir):
    found = _python(spark, sf_dir)
    symbols = _symbols(found)
    counted = syntax.complexity(found, symbols).select("path", "name", "start_line", "complexity")
    return symbols.join(counted, ["path", "name", "start_line"], "left").select(F.col("path").alias("file"), "name", "kind", "start_line", "end_line", "parent", "complexity")


@query(_CODE + _CALLS + " WHERE lang = 'fr'")
def python_calls(spark, sf_dir):
    found = _python(spark, sf_dir)
    return syntax.calls(found, _symbols(found))


@query(
    r"""WITH worded AS (SELECT source || '/' || doc_id AS file, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
       said AS (SELECT file, unnest(range(len(w) // 3)) AS k, w FROM worded)
       SELECT file, 'v_' || w[3 * k + 1] AS module, 'v_' || w[3 * k + 2] AS name, 'v_' || w[3 * k + 3] AS alias, k + 1 AS line FROM said UNION ALL SELECT file, 'v_' || w[3 * k + 1], 'other', NULL, k + 1 FROM said"""
)
def python_imports(spark, sf_dir):
    """Each three words of a text as an import statement."""
    docs = _worded(spark, sf_dir).where(F.size("w") >= 3)
    statements = F.expr("array_join(transform(sequence(0, size(w) div 3 - 1), k -> concat('from v_', w[3 * k], ' import v_', w[3 * k + 1], ' as v_', w[3 * k + 2], ', other\\n')), '')")
    files = docs.select("path", F.lit("Python").alias("language"), statements.alias("content"))
    return syntax.imports(syntax.rows(syntax.placed(files, dealt=True)))


# ---- trees of markup -------------------------------------------------------------------------


def _nodes(spark, sf_dir):
    return written(treepattern.markup_nodes(A.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))), "nodes")


_ITEMS = r"""WITH items AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]+</a></li>') AS l FROM pages),
  item AS (SELECT page_id, k, regexp_extract(l[k + 1], '<a href="[^"]*">') AS tag, regexp_extract(l[k + 1], '>([^<]+)</a>', 1) AS said, len(l) AS n FROM (SELECT *, unnest(range(len(l))) AS k FROM items))"""


@query(_ITEMS + r""" SELECT page_id::VARCHAR AS path, unnest(['link', 'said']) AS capture, unnest([tag, said]) AS text FROM item WHERE regexp_matches(said, '^[a-m]')""")
def tree_pattern_captures(spark, sf_dir):
    return treepattern.captures(_nodes(spark, sf_dir), '(li (a (text) @said) @link (#match? @said "^[a-m]"))').select("path", "capture", "text")


@query(_ITEMS + """ SELECT a.page_id::VARCHAR AS path, a.said AS a, b.said AS b FROM item a JOIN item b ON a.page_id = b.page_id AND b.k = a.k + 1 WHERE a.said <> b.said""")
def tree_pattern_neighbours(spark, sf_dir):
    found = treepattern.matches(_nodes(spark, sf_dir), "(ul (li (a (text) @a)) . (li (a (text) @b)) (#not-eq? @a @b))")
    return found.select("path", F.col("captures.a.text").alias("a"), F.col("captures.b.text").alias("b"))


@query(_ITEMS + """ SELECT page_id::VARCHAR AS path, said FROM item""")
def tree_pattern_below(spark, sf_dir):
    return treepattern.matches(_nodes(spark, sf_dir), "(nav // (a (text) @said))").select("path", F.col("captures.said.text").alias("said"))


_RULES = [
    {"id": "short-link", "severity": "info", "message": "short", "pattern": '(li (a (text) @t) @a (#match? @t "^.{1,2}$"))', "fix": "$t: $a", "allow": ["1*"]},
    {"id": "last-item", "pattern": "(ul (li (a (text) @t)) .)", "requires": {"edition": ">=2020"}},
]


@query(
    _ITEMS + r""", found AS (SELECT 'short-link' AS rule_id, page_id::VARCHAR AS path, 'info' AS severity, 'short' AS message, said || ': ' || tag AS fixed FROM item WHERE length(said) <= 2 AND NOT starts_with(page_id::VARCHAR, '1')
       UNION ALL SELECT 'last-item', page_id::VARCHAR, 'warning', '', NULL FROM item WHERE k = n - 1 AND page_id % 3 = 0)
       SELECT * FROM found"""
)
def tree_rule_findings(spark, sf_dir):
    """Rules on trees: one leaves pages out by a glob, the other is gated by each page's context."""
    pages = A.table(spark, sf_dir, "pages")
    contexts = pages.select(F.col("page_id").cast("string").alias("path"), F.create_map(F.lit("edition"), F.when(F.expr("page_id % 3 = 0"), "2021").otherwise("2018")).alias("context"))
    return treepattern.tree_findings(_nodes(spark, sf_dir), _RULES, contexts).select("rule_id", "path", "severity", "message", "fixed")


# ---- edits of symbols ------------------------------------------------------------------------


@query(
    r"""WITH parts AS (SELECT source || '/' || doc_id AS path, string_split(coalesce(text, ''), chr(10)) AS l, text FROM documents),
       flat AS (SELECT path, text, array_to_string(list_filter(l, lambda x: trim(x) <> ''), chr(10)) AS body, len(list_filter(l, lambda x: trim(x) <> '')) AS n FROM parts)
       SELECT path AS file, md5('top' || chr(10) || chr(10) || 'class K:' || chr(10) || '    new = 1' || chr(10) || chr(10) || '    def g(): ...' || chr(10) || chr(10) || 'last' || chr(10) || body || CASE WHEN body = '' THEN '' ELSE chr(10) END || 'end' || chr(10)) AS digest FROM flat"""
)
def symbol_edits_applied(spark, sf_dir):
    """Each text, without its blank lines, behind a head of code in which a method behind a blank line goes with the two that follow, another is replaced, and text comes into the class and at the end."""
    body = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), "\n")
    head = "top\n\nclass K:\n    x = 1\n\n    def f():\n        pass\n\n\n    def g():\n        y\n\nlast\n"
    files = A.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit(head), body, F.when(body == "", "").otherwise("\n")).alias("content"))
    names = [("f", "K", 6, 7), ("g", "K", 10, 11), ("x", "K", 4, 4)]
    symbols = files.select(F.col("path").alias("file"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("parent"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for n, p, a, b in names])))
    asked = symbol_edits.glob_edits(symbols, [("K/f", "delete", None), ("*/g", "replace", "def g(): ..."), ("K/x", "replace", "new = 1")])
    ends = files.select(F.lit("z").alias("edit_id"), "path", F.lit("append").alias("action"), F.lit(None).cast("long").alias("start_line"), F.lit(None).cast("long").alias("end_line"), F.lit("end").alias("text"))
    return symbol_edits.edit_symbols(files, asked.unionByName(ends)).select(F.col("path").alias("file"), F.md5(F.col("content").cast("binary")).alias("digest"))


# ---- graphs ----------------------------------------------------------------------------------

#: Commits from 1 in the order of the orders' keys; each has its half, and every third a third, as parents.
_COMMITS = """numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS c FROM orders),
  parents AS (SELECT c AS commit, c // 2 AS parent FROM numbered WHERE c > 1 UNION SELECT c, c // 3 FROM numbered WHERE c % 3 = 0)"""


def _commits(spark, sf_dir):
    # numbers of keys by a sum over ranges of keys, so that no task orders them all
    keys = A.table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 4096).alias("b"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    first = keys.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = keys.join(first, "b").select("o_orderkey", (F.col("first") + F.row_number().over(Window.partitionBy("b").orderBy("o_orderkey"))).alias("commit"))
    parents = numbered.where("commit > 1").select("commit", F.expr("commit div 2").alias("parent")).unionByName(numbered.where("commit % 3 = 0").select("commit", F.expr("commit div 3").alias("parent"))).distinct()
    return written(numbered, "commits"), written(parents, "parents")


@query(
    "WITH RECURSIVE " + _COMMITS + """, pairs AS (SELECT k AS pair, n - k AS a, n - 7 * k - 1 AS b FROM (SELECT count(*) AS n FROM orders), range(5) t(k)),
       up(pair, side, c) AS (SELECT pair, 'a', a FROM pairs UNION SELECT pair, 'b', b FROM pairs UNION SELECT pair, side, parent FROM up JOIN parents ON commit = c),
       common AS (SELECT pair, c FROM up GROUP BY ALL HAVING count(DISTINCT side) = 2)
       SELECT pair, c AS commit FROM common x WHERE NOT EXISTS (SELECT 1 FROM common y JOIN parents ON commit = y.c WHERE y.pair = x.pair AND parent = x.c)"""
)
def merge_bases(spark, sf_dir):
    numbered, parents = _commits(spark, sf_dir)
    n = F.lit(numbered.count())
    pairs = spark.range(5).select(F.col("id").alias("pair"), (n - F.col("id")).alias("a"), (n - 7 * F.col("id") - 1).alias("b"))
    return graphs.merge_bases(parents, pairs)


@query(
    "WITH RECURSIVE " + _COMMITS + """, ends AS (SELECT count(*) AS head, count(*) - 5 AS base FROM orders),
       own(c) AS (SELECT head FROM ends UNION SELECT parent FROM own JOIN parents ON commit = c), other(c) AS (SELECT base FROM ends UNION SELECT parent FROM other JOIN parents ON commit = c),
       changed AS (SELECT DISTINCT 'f' || (l_partkey % 50) AS file FROM lineitem JOIN numbered ON l_orderkey = o_orderkey WHERE c IN (SELECT c FROM own) AND c NOT IN (SELECT c FROM other))
       SELECT caller_file AS file, count(*) AS calls FROM (SELECT 'f' || (l_orderkey % 50) AS caller_file FROM lineitem) WHERE caller_file IN (SELECT file FROM changed) GROUP BY caller_file"""
)
def changed_against_merge_base(spark, sf_dir):
    """A report on the files that a branch changed since it left the other."""
    numbered, parents = _commits(spark, sf_dir)
    head = numbered.count()
    touched = A.table(spark, sf_dir, "lineitem").join(numbered, F.col("l_orderkey") == F.col("o_orderkey")).select("commit", A.tag("f", "l_partkey % 50").alias("path"))
    changed = graphs.changed_since(parents, touched, head, head - 5)
    report = A.calls(spark, sf_dir).groupBy(F.col("caller_file").alias("file")).agg(F.count("*").alias("calls"))
    return views.changed_only(report, changed)


_EXPORTS = """WITH RECURSIVE local AS (SELECT DISTINCT 'f' || (p_partkey % 50) AS file, CASE WHEN p_partkey % 11 = 0 THEN 'default' ELSE 'p' || (p_partkey % 97) END AS name FROM part WHERE p_size % 2 = 0),
  again AS (SELECT 'f' || (s_suppkey % 50) AS file, 'f' || (s_suppkey * 7 % 50) AS target, CASE WHEN s_suppkey % 3 = 0 THEN '*' WHEN s_suppkey % 3 = 1 THEN 'default' ELSE 'p' || (s_suppkey % 97) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'x' || (s_suppkey % 13) END AS alias FROM supplier),
  out(file, name, origin, origin_name) AS (SELECT file, name, file, name FROM local
    UNION SELECT a.file, CASE WHEN a.name = '*' THEN o.name ELSE coalesce(a.alias, o.name) END, origin, origin_name FROM out o JOIN again a ON a.target = o.file AND (a.name = o.name OR a.name = '*' AND o.name <> 'default'))"""


def _exports(spark, sf_dir):
    local = A.table(spark, sf_dir, "part").where("p_size % 2 = 0").select(A.tag("f", "p_partkey % 50").alias("file"), F.when(F.expr("p_partkey % 11 = 0"), "default").otherwise(A.tag("p", "p_partkey % 97")).alias("name"))
    name = F.when(F.expr("s_suppkey % 3 = 0"), "*").when(F.expr("s_suppkey % 3 = 1"), "default").otherwise(A.tag("p", "s_suppkey % 97"))
    again = A.table(spark, sf_dir, "supplier").select(A.tag("f", "s_suppkey % 50").alias("file"), A.tag("f", "s_suppkey * 7 % 50").alias("target"), name.alias("name"), F.when(F.expr("s_suppkey % 2 = 0"), A.tag("x", "s_suppkey % 13")).alias("alias"))
    return graphs.exported(local, again)


@query(_EXPORTS + " SELECT * FROM out")
def reexported_names(spark, sf_dir):
    """Barrels over barrels, in cycles too."""
    return _exports(spark, sf_dir).select("file", "name", "origin", "origin_name")


@query(
    _EXPORTS + """, used AS (SELECT DISTINCT 'f' || (s_suppkey * 3 % 50) AS target, CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE 'p' || (s_suppkey % 97) END AS name FROM supplier WHERE s_suppkey % 50 = 7),
       met AS (SELECT DISTINCT out.* FROM out JOIN used ON out.file = used.target AND (used.name = '*' OR used.name = out.name))
       SELECT met.file AS module, met.name, origin AS defined_in, p_brand AS kind, CAST(p_size AS BIGINT) AS start_line FROM met LEFT JOIN part ON 'f' || (p_partkey % 50) = origin AND 'p' || (p_partkey % 97) = origin_name"""
)
def focus_view(spark, sf_dir):
    """What the imports of one file bring in, through barrels to the definitions."""
    used = A.table(spark, sf_dir, "supplier").where("s_suppkey % 50 = 7").select(F.lit("f7").alias("file"), A.tag("f", "s_suppkey * 3 % 50").alias("target"), F.when(F.expr("s_suppkey % 2 = 0"), "*").otherwise(A.tag("p", "s_suppkey % 97")).alias("name")).distinct()
    symbols = A.table(spark, sf_dir, "part").select(A.tag("f", "p_partkey % 50").alias("file"), A.tag("p", "p_partkey % 97").alias("name"), F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("start_line"))
    return graphs.focus_view("f7", used, _exports(spark, sf_dir), symbols).drop("depth")


@query(
    """WITH RECURSIVE steps AS (SELECT DISTINCT 'f' || (l_orderkey % 5) AS file, 'v' || (l_partkey % 40) AS variable, 'v' || (l_suppkey % 40) AS source FROM lineitem WHERE l_quantity > 48),
       flow(file, variable, source) AS (SELECT * FROM steps UNION SELECT flow.file, flow.variable, steps.source FROM flow JOIN steps ON steps.file = flow.file AND steps.variable = flow.source)
       SELECT file, variable, source FROM flow"""
)
def variable_flows(spark, sf_dir):
    """All variables that a variable's values come from, over any number of assignments."""
    item = A.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(A.tag("f", "l_orderkey % 5").alias("file"), F.lit("main").alias("scope"), A.tag("v", "l_partkey % 40").alias("variable"), A.tag("v", "l_suppkey % 40").alias("source"))
    made = item.groupBy("file", "scope", "variable").agg(F.collect_set("source").alias("flows_from"))
    return graphs.flows(made).select("file", "variable", "source")


@query(
    """WITH c AS (SELECT conv_id, 'role' AS kind, role AS key, count(*) AS n, 0 AS errors FROM conversations GROUP BY ALL UNION ALL SELECT user_id, 'tool', event_type, count(*), count(*) FILTER (value > 50) FROM events GROUP BY ALL)
       SELECT kind, key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(errors) AS BIGINT) AS errors FROM c GROUP BY kind, key"""
)
def sessions_merged_counts(spark, sf_dir):
    roles = A.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("path"), F.col("role").alias("key")).agg(F.count("*").alias("n")).select("path", F.lit("role").alias("kind"), "key", "n", F.lit(0).cast("long").alias("errors"))
    tools = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("errors")).select("path", F.lit("tool").alias("kind"), "key", "n", "errors")
    return views.merged_counts(roles.unionByName(tools))


# ---- fuzzy ranking, contexts, versions, bursts -------------------------------------------------

_ASKED = "l-wdt"


def _alignment(query: str) -> str:
    """The alignment's rounds as list expressions, one after the other."""
    said = fuzzy.letters(query)
    steps = [f"""s0 AS (SELECT *, list_transform(range(len(ch)), lambda j: CASE WHEN ch[j + 1] = '{said[0]}' THEN gain[j + 1] END) AS best FROM scored)"""]
    for k, c in enumerate(said[1:], 1):
        far = f"list_max(list_transform(range(greatest(j - 1, 0)), lambda i: best[i + 1] + i)) - {fuzzy.GAP} - (j - 2)"
        steps.append(f"""s{k} AS (SELECT * EXCLUDE (best), list_transform(range(len(ch)), lambda j: CASE WHEN ch[j + 1] = '{c}' THEN gain[j + 1] + greatest(best[j] + {fuzzy.NEXT}, {far}) END) AS best FROM s{k - 1})""")
    return ", ".join(steps) + f", aligned AS (SELECT * EXCLUDE (best), list_max(best)::INTEGER AS score FROM s{len(said) - 1})"


@query(
    f"""WITH typed AS (SELECT DISTINCT p_name AS path FROM part), chars AS (SELECT path, string_split(lower(path), '') AS ch FROM typed WHERE path ILIKE '{"%".join(["", *fuzzy.letters(_ASKED), ""])}'),
        scored AS (SELECT *, list_transform(range(len(ch)), lambda j: {fuzzy.MATCH} + CASE WHEN j = 0 OR ch[j] IN ('/', '-', '_', '.', ' ', ':') THEN {fuzzy.START} ELSE 0 END) AS gain FROM chars), {_alignment(_ASKED)}
        SELECT path, score FROM aligned ORDER BY score DESC, path LIMIT 10"""
)
def fuzzy_ranked(spark, sf_dir):
    return fuzzy.ranked(A.table(spark, sf_dir, "part").select(F.col("p_name").alias("path")).distinct(), "path", _ASKED).select("path", "score")


@query(
    """WITH given AS (SELECT 'h' || (page_id % 40) || '/s' || (page_id % 7) || '/p' || page_id AS path, page_id % 40 AS h, page_id % 7 AS s FROM pages),
       near AS (SELECT path, CASE WHEN h % 2 = 0 AND s < 3 THEN '20' || (15 + h % 9) WHEN h % 3 = 0 THEN '20' || (16 + h % 5) ELSE '2015' END AS edition FROM given)
       SELECT path, edition, edition >= '2018' AS gated FROM near"""
)
def nearest_contexts(spark, sf_dir):
    """Of each path the edition that the nearest manifest above it names, and whether a rule that requires 2018 applies."""
    files = A.table(spark, sf_dir, "pages").select(F.concat(A.tag("h", "page_id % 40"), A.tag("/s", "page_id % 7"), A.tag("/p", "page_id")).alias("path"), F.expr("page_id % 40").alias("h"), F.expr("page_id % 7").alias("s"))
    edition = lambda column, text: F.create_map(F.lit("edition"), F.concat(F.lit("20"), F.expr(text).cast("string"))).alias(column)
    low = files.where("h % 2 = 0 and s < 3").select(F.concat(A.tag("h", "h"), A.tag("/s", "s")).alias("folder"), edition("context", "15 + h % 9")).dropDuplicates(["folder"])
    middle = files.where("h % 3 = 0").select(A.tag("h", "h").alias("folder"), edition("context", "16 + h % 5")).dropDuplicates(["folder"])
    top = files.limit(1).select(F.lit("").alias("folder"), edition("context", "15"))
    met = rules.nearest_contexts(files.select("path"), low.unionByName(middle).unionByName(top))
    wanted = F.create_map(F.lit("edition"), F.lit(">=2018"))
    return met.select("path", F.element_at("context", "edition").alias("edition"), rules.meets(wanted, F.col("context")).alias("gated"))


_TREE = """numbered AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events), held AS (SELECT user_id, max(v) AS top FROM numbered GROUP BY user_id)"""


@query(
    "WITH RECURSIVE " + _TREE + """, up(user_id, side, v, d) AS (SELECT user_id, 's', top, 0 FROM held UNION ALL SELECT user_id, 't', greatest(top - 1, 1), 0 FROM held UNION ALL SELECT user_id, side, v // 2, d + 1 FROM up WHERE v > 1),
       turn AS (SELECT a.user_id, min(a.d) AS u, min(b.d) AS w FROM up a JOIN up b ON a.user_id = b.user_id AND a.v = b.v AND a.side = 's' AND b.side = 't' GROUP BY a.user_id),
       steps AS (SELECT up.user_id, d AS step, v // 2 AS v, 'undo' AS operation FROM up JOIN turn USING (user_id) WHERE side = 's' AND d < u UNION ALL SELECT up.user_id, u + w - d, v, 'redo' FROM up JOIN turn USING (user_id) WHERE side = 't' AND d < w)
       SELECT user_id AS file, CASE WHEN operation = 'undo' THEN step + 1 ELSE step END AS step, s.v AS version, operation, event_type AS content FROM steps s JOIN numbered USING (user_id, v)"""
)
def history_goto(spark, sf_dir):
    """From each user's last version to the one before, in a tree where version n follows n div 2."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    events = A.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    versions = dealt(events, events.count(), "user_id").select(F.col("user_id").alias("file"), number.alias("version"), F.col("event_type").alias("content"))
    versions = written(versions.withColumn("parent", F.when(F.col("version") > 1, F.expr("version div 2"))), "versions")
    ends = versions.groupBy("file").agg(F.max("version").alias("source")).withColumn("target", F.greatest(F.col("source") - 1, F.lit(1)))
    return edits.goto(versions, ends)


@query("""SELECT file, line FROM lines WHERE contains(text, 'th') AND contains(text, 'an') AND replace(text, 'th', 'TH') <> replace(text, 'an', 'AN')""", "lines")
def three_way_conflicts(spark, sf_dir):
    base = A.lines(spark, sf_dir)
    return edits.line_conflicts(base, base.withColumn("text", F.replace("text", F.lit("th"), F.lit("TH"))), base.withColumn("text", F.replace("text", F.lit("an"), F.lit("AN"))))


@query(
    """WITH e AS (SELECT 'u' || user_id || CASE WHEN event_type = 'view' THEN '.md' ELSE '.rs' END AS path, ts AS moment FROM events),
       marked AS (SELECT path, moment, CASE WHEN moment - lag(moment) OVER (PARTITION BY path ORDER BY moment) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WHERE ends_with(path, '.rs')),
       numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY moment ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
       SELECT path, min(moment) AS first, max(moment) AS last, count(*) AS events FROM numbered GROUP BY path, burst"""
)
def watch_runs(spark, sf_dir):
    """Bursts of events of one file, other extensions left out."""
    events = A.table(spark, sf_dir, "events").select(F.concat(A.tag("u", "user_id"), F.when(F.col("event_type") == "view", ".md").otherwise(".rs")).alias("path"), F.col("ts").alias("at"))
    return watch.runs(events, ["rs"], pause="10 minutes")
