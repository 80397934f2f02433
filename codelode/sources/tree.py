"""Source trees as file tables."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.globs import ignore_glob
from codelode.functions.text import extension, line_count

MOST_BYTES = 1_000_000
# fixed values: folders that a structural query skips
SKIPPED = ("node_modules", "target", "vendor")


def tree(spark: SparkSession, root: str, hidden: bool = True, skip: tuple[str, ...] = (), ignore: bool = True) -> DataFrame:
    """files (path, is_dir, mtime, size, lines, content) below a root.

    ``.git`` is never read. Of the ignore files' lines the last one that matches
    a path decides, deeper files after higher ones.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    # Spark's listing leaves out names that start with a dot or an underscore
    unlisted = _unlisted(spark, base)
    if unlisted is not None:
        raw = raw.select("path", "modificationTime", "length", "content").unionByName(unlisted)
    start = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    prefix = "/" + base.split(":", 1)[-1].lstrip("/") + "/"
    files = raw.select(F.replace(start, F.lit(prefix), F.lit("")).alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    files = files.where(~F.col("path").rlike(r"(?:^|/)\.git/"))
    if skip:
        files = files.where(~F.col("path").rlike(r"(?:^|/)(?:" + "|".join(skip) + ")/"))
    if ignore:
        files = without_ignored(files)
    if not hidden:
        files = files.where(~F.col("path").rlike(r"(?:^|/)\.[^/]"))
    text = F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string"))
    return files.select("path", F.lit(False).alias("is_dir"), "mtime", "size", F.coalesce(line_count(text, MOST_BYTES), F.lit(0)).alias("lines"), text.alias("content"))


def _unlisted(spark: SparkSession, base: str) -> DataFrame | None:
    """Files below ``base`` that Spark's own listing would skip, but for those of ``.git``.

    The driver lists the root alone; what lies below is walked, and opened, on
    the executors, a folder of the root at a time.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    top = [(s.getPath().toString(), s.isDirectory()) for s in listed if s.getPath().getName() != ".git"]
    top = [(path, is_dir) for path, is_dir in top if is_dir or path.rsplit("/", 1)[-1][:1] in (".", "_")]
    if not top:
        return None
    schema = pa.schema([("path", pa.string()), ("changed", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, is_dir in zip(batch.column("path").to_pylist(), batch.column("is_dir").to_pylist()):
                system, name = pafs.FileSystem.from_uri(path)
                hidden = path.rsplit("/", 1)[-1][:1] in (".", "_")
                for info in system.get_file_info(pafs.FileSelector(name, recursive=True)) if is_dir else system.get_file_info([name]):
                    below = info.path[len(name) :].lstrip("/").split("/")
                    if info.type != pafs.FileType.File or ".git" in below or not (hidden or any(x[:1] in (".", "_") for x in below)):
                        continue
                    with system.open_input_file(info.path) as source:
                        content = source.read()
                    yield pa.RecordBatch.from_pylist([{"path": path + info.path[len(name) :], "changed": int(info.mtime.timestamp()), "length": len(content), "content": content}], schema=schema)

    rows = spark.createDataFrame(top, "path string, is_dir boolean").repartition(min(len(top), 256))
    found = rows.mapInArrow(run, "path string, changed long, length long, content binary")
    return found.select("path", F.timestamp_seconds("changed").alias("modificationTime"), "length", "content")


def without_ignored(files: DataFrame) -> DataFrame:
    """Applies the ``.gitignore`` files among ``files``: the last line that matches decides, deeper files after higher ones.

    Files are joined with the lines of the folders above them.
    """
    notes = files.where(F.col("path").rlike(r"(?:^|/)\.gitignore$")).select("path", F.col("content").cast("string").alias("text"))
    schema = pa.schema([("folder", pa.string()), ("depth", pa.int32()), ("n", pa.int32()), ("regex", pa.string()), ("back", pa.bool_())])

    def compiled(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                folder = path.removesuffix(".gitignore")
                for n, line in enumerate((text or "").splitlines()):
                    if regex := ignore_glob(line):
                        rows.append({"folder": folder, "depth": folder.count("/"), "n": n, "regex": regex, "back": line.strip().startswith("!")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rules = notes.mapInArrow(compiled, "folder string, depth int, n int, regex string, back boolean")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    near = files.select("path", F.explode(above).alias("folder")).join(rules, "folder").where(F.expr("substring(path, length(folder) + 1) rlike regex"))
    out = near.groupBy("path").agg(F.max_by("back", F.struct("depth", "n")).alias("back")).where("not back").select("path")
    return files.join(out, "path", "left_anti")


def with_language(files: DataFrame, languages: DataFrame) -> DataFrame:
    """files with their language by extension, as written, then in lower case. languages (extension, language)."""
    dim = F.broadcast(languages)
    own = files.withColumn("_ext", extension(F.col("path")))
    exact = own.join(dim.select(F.col("extension").alias("_ext"), F.col("language").alias("_l1")), "_ext", "left")
    loose = exact.withColumn("_low", F.lower("_ext")).join(dim.select(F.col("extension").alias("_low"), F.col("language").alias("_l2")), "_low", "left")
    return loose.withColumn("language", F.coalesce("_l1", "_l2")).drop("_ext", "_low", "_l1", "_l2")


# fixed values: extensions of common languages
EXTENSIONS = {
    "Python": "py pyi pyw", "Rust": "rs", "JavaScript": "js mjs cjs jsx", "TypeScript": "ts mts cts", "TSX": "tsx", "Go": "go", "Java": "java", "Kotlin": "kt kts", "C#": "cs", "Swift": "swift",
    "PHP": "php phtml", "C": "c h", "C++": "cpp cc cxx hpp hh hxx", "Ruby": "rb", "Scala": "scala sc", "Vue": "vue", "Markdown": "md markdown", "JSON": "json jsonc", "YAML": "yaml yml", "TOML": "toml",
    "HTML": "html htm", "CSS": "css", "SCSS": "scss sass", "Bash": "sh bash", "Lua": "lua", "Zig": "zig", "Elixir": "ex exs", "Erlang": "erl hrl", "Dart": "dart", "F#": "fs fsi fsx", "SQL": "sql",
    "GraphQL": "graphql gql", "HCL": "tf tfvars hcl", "Svelte": "svelte", "XML": "xml xsl xslt xsd svg plist", "Clojure": "clj cljs cljc edn", "Haskell": "hs lhs", "OCaml": "ml mli", "Nix": "nix",
    "Perl": "pm t", "R": "r R rmd Rmd", "Julia": "jl", "Elm": "elm", "CMake": "cmake", "Vim": "vim", "AWK": "awk gawk", "Fish": "fish", "jq": "jq", "PowerShell": "ps1 psm1 psd1", "Zsh": "zsh",
    "Groovy": "groovy gradle", "Verilog": "v sv svh", "VHDL": "vhd vhdl", "Thrift": "thrift", "Starlark": "star bzl", "Diff": "diff patch", "INI": "ini cfg properties", "Dockerfile": "dockerfile",
}


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, name) for name, own in EXTENSIONS.items() for e in own.split()], "extension string, language string")
