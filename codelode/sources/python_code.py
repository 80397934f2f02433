"""Python sources parsed with the standard library: symbols, calls, imports, complexity.

One pass over a file yields rows tagged with their relation;
files that don't parse yield none.
"""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.perfile import rows_per_file

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCHEMA = (
    "relation string, file string, name string, kind string, start_line int, end_line int, parent string, signature string, docstring string, visibility string, "
    "complexity int, hash string, caller_symbol string, callee_name string, callee_qualifier string, module string, alias string, line int, text string"
)
#: Node types that add one to the complexity of the function around them.
BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.match_case, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)


def visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__"):
        return "public"
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def complexity(node: ast.AST) -> int:
    """1, and 1 for each branch in all descendants; an ``elif`` is part of its ``if``; each and/or adds 1."""
    total = 1
    for parent in ast.walk(node):
        total += isinstance(parent, BRANCHES)
        if isinstance(parent, ast.BoolOp):
            total += len(parent.values) - 1
        if isinstance(parent, ast.If) and len(parent.orelse) == 1 and isinstance(parent.orelse[0], ast.If) and parent.orelse[0].col_offset == parent.col_offset:
            total -= 1
    return total


def shape_hash(node: ast.AST, names: bool = True, literals: bool = True) -> str:
    """Digest of the tree's node types, with identifiers and literals unless elided."""
    digest = hashlib.sha256()

    def visit(n: ast.AST) -> None:
        digest.update(type(n).__name__.encode() + b"(")
        if isinstance(n, ast.Constant) and literals:
            digest.update(repr(n.value).encode())
        for key in ("id", "attr", "arg", "name"):
            value = getattr(n, key, None)
            if names and isinstance(value, str) and not (key == "name" and isinstance(n, FUNCTIONS)):
                digest.update(value.encode())
        for child in ast.iter_child_nodes(n):
            visit(child)
        digest.update(b")")

    for child in ast.iter_child_nodes(node):
        visit(child)
    return digest.hexdigest()[:16]


def _called(node: ast.Call) -> tuple[str, str | None] | None:
    f = node.func
    if isinstance(f, ast.Name):
        return f.id, None
    if isinstance(f, ast.Attribute):
        return f.attr, ast.unparse(f.value)
    return None


def rows_of(file: str, source: str) -> Iterator[dict]:
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return

    def walk(body, parent, inside):
        for node in body:
            if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if inside == "class" else "function"
                signature = f"class {node.name}" if is_class else f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                yield {
                    "relation": "symbols", "name": node.name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "parent": parent, "signature": signature, "docstring": ast.get_docstring(node),
                    "visibility": visibility(node.name), "complexity": None if is_class else complexity(node), "hash": None if is_class else shape_hash(node),
                }
                if is_class:
                    for base in node.bases:
                        yield {"relation": "implements", "name": node.name, "callee_name": ast.unparse(base), "line": node.lineno}
                else:
                    for sub in ast.walk(node):
                        if isinstance(sub, ast.Call) and (said := _called(sub)):
                            yield {"relation": "calls", "caller_symbol": node.name, "callee_name": said[0], "callee_qualifier": said[1], "line": sub.lineno}
                yield from walk(node.body, node.name, "class" if is_class else "function")
            else:
                # bodies, else and finally, except handlers, match cases
                for field in ("body", "handlers", "cases", "orelse", "finalbody"):
                    if isinstance(below := getattr(node, field, None), list):
                        yield from walk(below, parent, inside)

    yield from walk(module.body, None, "module")
    for node in ast.walk(module):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield {"relation": "imports", "module": None, "name": a.name, "alias": a.asname, "line": node.lineno}
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield {"relation": "imports", "module": "." * node.level + (node.module or ""), "name": a.name, "alias": None, "line": node.lineno}
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type == tokenize.COMMENT:
                yield {"relation": "comments", "line": token.start[0], "text": token.string}
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return


def extract(files: DataFrame) -> DataFrame:
    """All rows of files (path, content) of Python, tagged by relation; meant to be written once and read by relation."""
    return rows_per_file(files.where(F.col("path").rlike(r"\.pyi?w?$")), lambda path, content: ({**r, "file": path} for r in rows_of(path, content)), SCHEMA)


def relation(rows: DataFrame, name: str) -> DataFrame:
    """One relation of :func:`extract`'s rows."""
    own = rows.where(F.col("relation") == name)
    if name == "symbols":
        return own.select("file", "name", "kind", "start_line", "end_line", "parent", "signature", "docstring", "visibility", "complexity", "hash")
    if name == "calls":
        return own.select(F.col("file").alias("caller_file"), "caller_symbol", "callee_name", "callee_qualifier", "line")
    if name == "imports":
        return own.select("file", "module", "name", "alias", "line")
    if name == "implements":
        return own.select("file", "name", F.col("callee_name").alias("interface"))
    return own.select("file", "line", "text")


def type_methods(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'method'").select("file", F.col("parent").alias("type_name"), F.col("name").alias("method_name")).distinct()


def without_tests(symbols: DataFrame) -> DataFrame:
    return symbols.where(~(((F.col("kind") != "class") & F.col("name").startswith("test_")) | ((F.col("kind") == "class") & F.col("name").startswith("Test"))))
