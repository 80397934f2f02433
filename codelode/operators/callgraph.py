"""Callers, callees and import resolution over the index tables.

calls (caller_file, caller_symbol, callee_name, callee_qualifier, line),
symbols (file, name, kind, start_line, end_line, parent),
imports (file, module, name, alias, line), files (path, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.scratch import written


CALLER = ("caller_file", "caller_symbol", "line")


def _methods(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    own = calls.where("callee_qualifier = 'self'")
    return own.join(symbols.select(F.col("file").alias("caller_file"), F.col("name").alias("caller_symbol"), "parent"), ["caller_file", "caller_symbol"])


def direct_callers(calls: DataFrame, symbols: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """Distinct callers by name, by an import's alias, through a module, or as a method of self."""
    local = F.coalesce("alias", "name")
    aliased = imports.where(F.col("name") == name).select(F.col("file").alias("caller_file"), local.alias("callee_name")).distinct()
    modules = imports.where("module is null").select(F.col("file").alias("caller_file"), local.alias("callee_qualifier")).distinct()
    called = calls.where(F.col("callee_name") == name)
    return (
        called.select(*CALLER)
        .union(calls.join(aliased, ["caller_file", "callee_name"]).select(*CALLER))
        .union(called.join(modules, ["caller_file", "callee_qualifier"]).select(*CALLER))
        .union(_methods(called, symbols).where("parent is not null").select(*CALLER))
        .distinct()
    )


def find_callers(calls: DataFrame, symbols: DataFrame, imports: DataFrame, name: str, like_limit: int = 100) -> DataFrame:
    """Callers of ``name`` or ``Class.method``; looser answers only if stricter ones are empty.

    Tiers: a method of that class, the name or an import's alias for it, the
    name in any case, a part of the name. Each call is labelled with its
    strictest tier in one scan; the least of all is one row.
    """
    owner, method = name.split(".", 1) if "." in name else (None, name)
    first = 0 if owner is None else 1
    local = F.coalesce("alias", "name")
    aliased = imports.where(F.col("name") == method).select(F.col("file").alias("caller_file"), local.alias("callee_name"), F.lit(True).alias("_aliased")).distinct()
    rows = calls.join(aliased, ["caller_file", "callee_name"], "left")
    direct = (F.col("callee_name") == method) | F.coalesce("_aliased", F.lit(False))
    tier = F.when(direct, first + 1).when(F.lower("callee_name") == method.lower(), first + 2).when(F.col("callee_name").ilike(f"%{method}%"), first + 3)
    if owner is not None:
        own = symbols.where(F.col("parent") == owner).select(F.col("file").alias("caller_file"), F.col("name").alias("caller_symbol"), F.lit(True).alias("_own")).distinct()
        rows = rows.join(own, ["caller_file", "caller_symbol"], "left")
        tier = F.when((F.col("callee_name") == method) & (F.col("callee_qualifier") == "self") & F.col("_own"), 1).otherwise(tier)
    # what any tier finds is written once, then read for the least tier and for the answer
    rows = written(rows.select(*CALLER, tier.alias("tier")).where("tier is not null"), "callers")
    # one row: the aggregate has no keys
    best = rows.join(F.broadcast(rows.agg(F.min("tier").alias("tier"))), "tier")
    # places of the direct tier count once, those of the others once a call
    strict = best.where(F.col("tier") < first + 3).withColumn("_call", F.when(F.col("tier") != first + 1, F.monotonically_increasing_id())).distinct().select(*CALLER, "tier")
    return strict.union(best.where(F.col("tier") == first + 3).orderBy(*CALLER).limit(like_limit).select(*CALLER, "tier"))


def find_callees(calls: DataFrame, file: str, symbol: str) -> DataFrame:
    return calls.where((F.col("caller_file") == file) & (F.col("caller_symbol") == symbol)).select("callee_name", "callee_qualifier", "line")


def references(symbols: DataFrame, calls: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """Definitions and callers as places (file, line, role)."""
    defined = symbols.where(F.col("name") == name).select("file", F.col("start_line").alias("line"), F.lit("definition").alias("role"))
    called = find_callers(calls, symbols, imports, name).select(F.col("caller_file").alias("file"), "line", F.lit("caller").alias("role"))
    return defined.union(called)


def module_paths(module: Column) -> Column:
    """Files that may hold a Python module, most likely first."""
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(*[F.concat(F.lit(root), slashed, F.lit(end)) for root in ("src/", "") for end in (".py", "/__init__.py")])


def path_module(path: Column) -> Column:
    """The module of a Python file."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py[iw]?$", ""), r"^(?:src|lib)/", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))


def module_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module, path): the first candidate that exists."""
    tried = modules.select("module").distinct().select("module", F.posexplode(module_paths(F.col("module"))).alias("at", "path"))
    return tried.join(files.select("path"), "path").groupBy("module").agg(F.min_by("path", "at").alias("path"))


def exports(symbols: DataFrame) -> DataFrame:
    """Top-level names by file."""
    return symbols.where("parent is null").select(F.col("file").alias("path"), "name").distinct()


def resolve_imports(asked: DataFrame, imports: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name) to (module, original, tier): named import, else verified wildcard, else first wildcard."""
    asked = asked.select("file", "name").distinct()
    own = imports.select("file", "module", F.col("name").alias("original"), "alias", "line")
    star = (F.col("original") == "*") & F.col("module").isNotNull()
    named = (F.col("original") == F.col("name")) | F.coalesce(F.col("alias") == F.col("name"), F.lit(False))
    met = asked.join(own, "file").where(named | star)
    homes = module_files(imports.where("name = '*'").select("module"), files)
    told = met.join(homes, "module", "left").join(exports(symbols).withColumn("_verified", F.lit(True)), ["path", "name"], "left")
    tier = F.when(named, 1).when(F.col("_verified"), 2).otherwise(3)
    answer = F.struct(tier.alias("tier"), "line", F.when(named, F.coalesce("module", "original")).otherwise(F.col("module")).alias("module"), F.when(named, F.col("original")).otherwise(F.col("name")).alias("original"))
    return told.groupBy("file", "name").agg(F.min(answer).alias("m")).select("file", "name", "m.module", "m.original", "m.tier")


def find_importers(imports: DataFrame, module: str) -> DataFrame:
    """Imports of a module or of anything whose module name starts with it."""
    return imports.where((F.col("module") == module) | F.col("module").ilike(f"{module}%"))


def index_stats(symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Row counts of the three relations, in one pass each."""
    out = None
    for name, df in (("symbols", symbols), ("calls", calls), ("imports", imports)):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = one if out is None else out.union(one)
    return out


def mark_interface_methods(symbols: DataFrame, implements: DataFrame, type_methods: DataFrame) -> DataFrame:
    """symbols with is_interface_impl: its class implements a type that has a method of that name.

    implements: (file, name, interface). A type's methods are sought in the
    same file first, then anywhere.
    """
    wanted = implements.select("file", F.col("name").alias("parent"), "interface")
    here = wanted.join(type_methods.select("file", F.col("type_name").alias("interface"), F.col("method_name").alias("name")), ["file", "interface"])
    known = here.select("file", "interface").distinct()
    there = wanted.join(known, ["file", "interface"], "left_anti").join(type_methods.select(F.col("type_name").alias("interface"), F.col("method_name").alias("name")).distinct(), "interface")
    marked = here.select("file", "parent", "name").union(there.select("file", "parent", "name")).distinct().withColumn("is_interface_impl", F.lit(True))
    return symbols.join(marked, ["file", "parent", "name"], "left").fillna(False, ["is_interface_impl"])
