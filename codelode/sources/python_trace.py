"""Assignments, returns, tree dumps and structural queries of Python sources.

Queries are S-expressions over the standard library's node types: a node kind
in brackets, ``field: (kind)`` for children, ``_`` for any kind, ``@name``
captures, and the predicates ``#eq?``, ``#not-eq?``, ``#match?``,
``#not-match?``, ``#any-of?`` and ``#not-any-of?``. Other languages have no
parser here: asking for them is an error, never an empty answer.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.perfile import rows_per_file

NAMES = re.compile(r"\(|\)|//|@[\w.-]+|#[\w-]+\?|\"(?:[^\"\\]|\\.)*\"|[\w.-]+:|[\w.*-]+")


def parse_query(text: str) -> list:
    """Nested lists of tokens."""
    stack: list[list] = [[]]
    for token in NAMES.findall(text):
        if token == "(":
            stack.append([])
        elif token == ")":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) != 1:
        raise ValueError("unbalanced query")
    return stack[0]


def _match(node: ast.AST, pattern: list, source: str) -> dict[str, str] | None:
    kind, *rest = pattern
    if kind != "_" and type(node).__name__ != kind:
        return None
    found: dict[str, str] = {}
    k = 0
    while k < len(rest):
        token = rest[k]
        if isinstance(token, str) and token.endswith(":"):
            value, want = getattr(node, token[:-1], None), rest[k + 1]
            k += 1
            capture = rest[k + 1] if k + 1 < len(rest) and isinstance(rest[k + 1], str) and rest[k + 1].startswith("@") else None
            options = value if isinstance(value, list) else [value]
            for option in options:
                if isinstance(option, ast.AST) and isinstance(want, list):
                    got = _match(option, want, source)
                    if got is not None:
                        if capture:
                            got[capture[1:]] = ast.get_source_segment(source, option) or ast.unparse(option)
                        break
                elif not isinstance(option, ast.AST) and option is not None and want in ("_", f'"{option}"'):
                    got = {capture[1:]: str(option)} if capture else {}
                    break
            else:
                return None
            found |= got
            k += bool(capture)
        elif isinstance(token, list) and not token[0].startswith("#"):
            for child in ast.iter_child_nodes(node):
                got = _match(child, token, source)
                if got is not None:
                    found |= got
                    break
            else:
                return None
        k += 1
    return found


def _holds(captures: dict[str, str], predicate: list) -> bool:
    name, *args = predicate
    value = lambda a: captures.get(a[1:]) if a.startswith("@") else a.strip('"')
    first = value(args[0])
    if name in ("#eq?", "#not-eq?"):
        out = first == value(args[1])
    elif name in ("#match?", "#not-match?"):
        try:
            out = first is not None and re.search(value(args[1]), first) is not None
        except re.error:
            return True
    elif name in ("#any-of?", "#not-any-of?"):
        out = first in [value(a) for a in args[1:]]
    else:
        return True
    return not out if name.startswith("#not-") else out


def query(files: DataFrame, text: str, language: str = "python") -> DataFrame:
    """(file, kind, text, start_line, start_col, end_line, end_col, captures) of every match, a row per match."""
    if language != "python":
        raise NotImplementedError(f"no parser for {language}")
    top = parse_query(text)
    pattern = next(p for p in top if isinstance(p, list))
    predicates = [p for p in pattern if isinstance(p, list) and p[0].startswith("#")] + [p for p in top if isinstance(p, list) and p[0].startswith("#")]
    whole = next((t[1:] for t in top if isinstance(t, str) and t.startswith("@")), None)
    def rows(path, source):
        for node in ast.walk(ast.parse(source)):
            captures = _match(node, pattern, source)
            if captures is None or not hasattr(node, "lineno"):
                continue
            said = ast.get_source_segment(source, node) or ""
            if whole:
                captures[whole] = said
            if all(_holds(captures, p) for p in predicates):
                yield {"file": path, "kind": type(node).__name__, "text": said, "start_line": node.lineno, "start_col": node.col_offset, "end_line": node.end_lineno, "end_col": node.end_col_offset, "captures": list(captures.items())}

    schema = "file string, kind string, text string, start_line int, start_col int, end_line int, end_col int, captures map<string,string>"
    return rows_per_file(files.where(F.col("path").rlike(r"\.pyi?w?$")), rows, schema)


def assignments(files: DataFrame) -> DataFrame:
    """(file, scope, variable, line, value, flows_from, terminal, calls, branch) of every assignment to a name."""
    columns = ["file", "scope", "variable", "line", "value", "flows_from", "terminal", "calls", "branch"]

    def rows(source):
        module = ast.parse(source)

        def walk(body, scope, branch):
            for node in body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield from walk(node.body, node.name, None)
                    continue
                if isinstance(node, ast.ClassDef):
                    yield from walk(node.body, scope, branch)
                    continue
                targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) and node.value else []
                for target in targets:
                    for name in [n.id for n in ast.walk(target) if isinstance(n, ast.Name)]:
                        ids = sorted({n.id for n in ast.walk(node.value) if isinstance(n, ast.Name)})
                        said = sorted({ast.unparse(n.func) for n in ast.walk(node.value) if isinstance(n, ast.Call)})
                        yield scope, name, node.lineno, ast.unparse(node.value), ids, isinstance(node.value, ast.Constant), said, branch
                for field, label in (("body", type(node).__name__.lower()), ("orelse", "else"), ("finalbody", "finally")):
                    inner = getattr(node, field, None)
                    if isinstance(inner, list):
                        test = getattr(node, "test", None)
                        yield from walk(inner, scope, f"{label} {ast.unparse(test)}" if test is not None and field == "body" else label)

        yield from walk(module.body, None, None)

    return _per_file(files, rows, columns, "file string, scope string, variable string, line int, value string, flows_from array<string>, terminal boolean, calls array<string>, branch string")


def returns(files: DataFrame) -> DataFrame:
    """(file, function, line, value) of every return."""

    def rows(source):
        for f in ast.walk(ast.parse(source)):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for n in ast.walk(f):
                    if isinstance(n, ast.Return):
                        yield f.name, n.lineno, ast.unparse(n.value) if n.value else None

    return _per_file(files, rows, ["file", "function", "line", "value"], "file string, function string, line int, value string")


def nodes(files: DataFrame) -> DataFrame:
    """The tree in order: (file, position, depth, kind, start_line, end_line)."""

    def rows(source):
        stack, at = [(0, ast.parse(source))], 0
        while stack:
            depth, node = stack.pop()
            yield at, depth, type(node).__name__, getattr(node, "lineno", None), getattr(node, "end_lineno", None)
            at += 1
            stack += [(depth + 1, c) for c in reversed(list(ast.iter_child_nodes(node)))]

    return _per_file(files, rows, ["file", "position", "depth", "kind", "start_line", "end_line"], "file string, position int, depth int, kind string, start_line int, end_line int")


def _per_file(files: DataFrame, rows, columns: list[str], schema: str) -> DataFrame:
    named = lambda path, source: (dict(zip(columns, (path, *r))) for r in rows(source))
    return rows_per_file(files.where(F.col("path").rlike(r"\.pyi?w?$")), named, schema)
