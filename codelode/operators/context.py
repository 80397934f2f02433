"""Context files, configuration layers, tools, field names, foreign-function links and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT_NAMES = (".context.md", "CONTEXT.md")


def merged_context(files: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (path) with the context files of their folders, root first, joined by blank lines. files (path, content)."""
    name = F.substring_index("path", "/", -1)
    order = F.array_position(F.array(*[F.lit(n) for n in CONTEXT_NAMES]), name)
    folder = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    notes = files.where(name.isin(*CONTEXT_NAMES)).groupBy(folder.alias("folder")).agg(F.min_by("content", order).alias("content"))
    parts = targets.select("path", F.split("path", "/").alias("p"))
    above = parts.select("path", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("depth"), "p").select("path", "depth", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"))
    joined = above.join(notes, "folder").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "content"))).alias("n"))
    return joined.select("path", F.array_join(F.transform("n", lambda x: F.regexp_replace(x["content"], r"^\s+|\s+$", "")), "\n\n").alias("context"))


def merge_layers(*layers: dict) -> dict:
    """Configuration layers, later ones over earlier: tables merge by key, sets unite, other values and lists are replaced; None keeps."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if value is None:
                continue
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merge_layers(out[key], value)
            elif isinstance(value, set) and isinstance(out.get(key), set):
                out[key] = out[key] | value
            else:
                out[key] = value
    return out


def detected_tools(tools: DataFrame, files: DataFrame) -> DataFrame:
    """tools (tool, marker, weight, available) that the files' names speak for, most confident first."""
    name = F.substring_index("path", "/", -1)
    seen = files.select(name.alias("marker")).distinct()
    out = tools.where("available").join(seen, "marker").groupBy("tool").agg(F.max("weight").alias("score"))
    return out.where("score > 0").orderBy(F.desc("score"), "tool")


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("tool").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def field_names(types: DataFrame) -> DataFrame:
    """(type, name) of the fields in types' sources (type, source), repeated as they stand."""
    return types.select("type", F.explode(F.regexp_extract_all("source", F.lit(r"(?m)^\s*(?:pub\s+)?(\w+)\s*:\s*\S"), F.lit(1))).alias("name"))


# fixed values: what marks a module that other languages may import
FOREIGN = {"pyo3": "Python", "maturin": "Python", "wasm-bindgen": "JavaScript", "napi": "JavaScript", "cdylib": "C"}


def foreign_modules(files: DataFrame) -> DataFrame:
    """(module, binding, language) of build files (path, content) that export to another language."""
    build = files.where(F.col("path").rlike(r"(?:^|/)Cargo\.toml$"))
    module = F.regexp_replace(F.regexp_extract("content", r'(?m)^name\s*=\s*"([^"]+)"', 1), "-", "_")
    marks = F.filter(F.array(*[F.when(F.col("content").contains(b), F.struct(F.lit(b).alias("binding"), F.lit(lang).alias("language"))) for b, lang in FOREIGN.items()]), lambda x: x.isNotNull())
    return build.select(module.alias("module"), F.explode(marks).alias("m")).select("module", "m.binding", "m.language")


def foreign_references(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports (file, module, name, line) of exported modules."""
    first = F.regexp_extract(F.coalesce("module", "name"), r"^([^./]+)", 1)
    return imports.select("file", "line", first.alias("module")).join(modules, "module")


def smart_imports(imports: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Imports that a span uses. identifiers (file, symbol, identifier)."""
    local = F.coalesce("alias", "name")
    return identifiers.join(imports.withColumn("identifier", F.regexp_extract(local, r"^([^.]+)", 1)), ["file", "identifier"])


def identifiers(spans: DataFrame) -> DataFrame:
    """(file, symbol, identifier), distinct, of source spans (file, symbol, source)."""
    found = F.array_distinct(F.regexp_extract_all("source", F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1)))
    return spans.select("file", "symbol", F.explode(found).alias("identifier"))


def type_references(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Where each referenced type (file, identifier) is defined (file, name, start_line): the same file first, then the first other."""
    # of a file's definitions of a name only the first matters (one without a line before all); a hash aggregate, so the join meets files, not definitions
    first = F.when(F.count("*") == F.count("start_line"), F.min("start_line")).alias("start_line")
    d = definitions.groupBy(F.col("file").alias("def_file"), F.col("name").alias("identifier")).agg(first)
    rank = F.struct((F.col("def_file") != F.col("file")).alias("far"), "def_file", "start_line")
    return refs.join(d, "identifier").groupBy("file", "identifier").agg(F.min(rank).alias("r")).select("file", "identifier", "r.def_file", "r.start_line")
