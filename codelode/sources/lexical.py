"""Symbols, calls, imports and complexity of languages with braces, by a lexical scan.

No grammar is parsed. Comments and strings are blanked, definitions are found
by their keywords, a body reaches from its opening brace to the closing one,
and a symbol's parent is the innermost type around it. So macros, generated
names, and definitions without a keyword or a brace are not seen; what is
found has the schema of the Python extractor.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.perfile import rows_per_file
from codelode.sources.python_code import SCHEMA

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_C_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_COMMENTS = r"//[^\n]*|/\*.*?\*/"
#: A method or function that starts with its type, as in Java, C and C#.
_TYPED = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|inline|extern|const|unsafe|synchronized|sealed|partial)\s+)*(?!(?:return|new|else|throw|case|goto|delete|using|typedef)\b)[\w:<>\[\],.?*&~]+(?:\s+|\s*[*&]+\s*)" + _NAME + r"\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|throws\s+[\w., ]+|where[^{;]+)?\s*(?=\{)"


@dataclass(frozen=True)
class Grammar:
    extensions: tuple[str, ...]
    blank: str
    #: (kind, pattern); a pattern names the symbol ``name``.
    definitions: tuple[tuple[str, str], ...]
    #: Patterns with ``module`` and, if there are any, ``names``.
    imports: tuple[str, ...]
    branches: str
    public: str = r"\b(?:pub|public|export)\b"


_BRANCH = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?=[^.:?])"
_SCRIPT_DEFS = (
    ("class", r"\bclass\s+" + _NAME),
    ("function", r"\bfunction\s*\*?\s*" + _NAME + r"\s*(?:<[^>]*>)?\s*\("),
    ("function", r"\b(?:const|let|var)\s+" + _NAME + r"\s*(?::[^=;{]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=;{]+)?=>\s*(?=\{)"),
    ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?!(?:if|for|while|switch|catch|function|return|with)\b)#?" + _NAME + r"\s*(?:<[^>]*>)?\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?::[^{;=]+)?(?=\{)"),
)
_SCRIPT_IMPORTS = (
    r"\bimport\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}|\*\s*as\s+(?P<star>[\w$]+))?\s*(?:from\s*)?(?P<quote>['\"])(?P<module>[^'\"\n]+)(?P=quote)",
    r"\bexport\s+(?:\{(?P<names>[^}]*)\}|(?P<all>\*)(?:\s*as\s+[\w$]+)?)\s*from\s*(?P<quote>['\"])(?P<module>[^'\"\n]+)(?P=quote)",
    r"\brequire\(\s*(?P<quote>['\"])(?P<module>[^'\"\n]+)(?P=quote)\s*\)",
)
_SCRIPT_BLANK = _COMMENTS + "|" + _C_STRINGS + r"|`(?:\\.|[^`\\])*`"

GRAMMARS = {
    "Rust": Grammar(
        ("rs",), _COMMENTS + r"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
        (("struct", r"\bstruct\s+" + _NAME), ("enum", r"\benum\s+" + _NAME), ("trait", r"\btrait\s+" + _NAME), ("module", r"\bmod\s+" + _NAME + r"\s*(?=\{)"), ("impl", r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>,' &]+?\s+for\s+)?(?:[\w]+::)*" + _NAME), ("function", r"\bfn\s+" + _NAME)),
        (r"\buse\s+(?P<module>[\w:]+?)(?:::\{(?P<names>[^}]*)\})?(?:\s+as\s+(?P<alias>\w+))?\s*;",),
        r"\b(?:if|for|while|loop)\b|=>|&&|\|\||\?(?=[;.,)\s])",
    ),
    "JavaScript": Grammar(("js", "mjs", "cjs", "jsx"), _SCRIPT_BLANK, _SCRIPT_DEFS, _SCRIPT_IMPORTS, _BRANCH, r"\bexport\b"),
    "TypeScript": Grammar(("ts", "mts", "cts", "tsx"), _SCRIPT_BLANK, (("interface", r"\binterface\s+" + _NAME), ("enum", r"\benum\s+" + _NAME), *_SCRIPT_DEFS), _SCRIPT_IMPORTS, _BRANCH, r"\bexport\b"),
    "Go": Grammar(
        ("go",), _COMMENTS + "|" + _C_STRINGS + r"|`[^`]*`",
        (("struct", r"\btype\s+" + _NAME + r"\s+struct\b"), ("interface", r"\btype\s+" + _NAME + r"\s+interface\b"), ("method", r"\bfunc\s*\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*" + _NAME), ("function", r"\bfunc\s+" + _NAME)),
        (r"\bimport\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[^\"\n]+)\"", r"(?m)^\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[\w./-]+)\"\s*$"),
        r"\b(?:if|for|case|select)\b|&&|\|\|", r"\b[A-Z]\w*$",
    ),
    "Java": Grammar(("java",), _COMMENTS + "|" + _C_STRINGS, (("class", r"\b(?:class|record)\s+" + _NAME), ("interface", r"\binterface\s+" + _NAME), ("enum", r"\benum\s+" + _NAME), ("method", _TYPED)), (r"\bimport\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;",), _BRANCH),
    "C#": Grammar(("cs",), _COMMENTS + r"|@\"(?:[^\"]|\"\")*\"|" + _C_STRINGS, (("class", r"\b(?:class|record)\s+" + _NAME), ("struct", r"\bstruct\s+" + _NAME), ("interface", r"\binterface\s+" + _NAME), ("enum", r"\benum\s+" + _NAME), ("method", _TYPED)), (r"\busing\s+(?:static\s+)?(?P<module>[\w.]+)\s*;",), _BRANCH),
    "C": Grammar(("c", "h"), _COMMENTS + "|" + _C_STRINGS, (("struct", r"\bstruct\s+" + _NAME + r"\s*(?=\{)"), ("enum", r"\benum\s+" + _NAME + r"\s*(?=\{)"), ("function", _TYPED)), (r"#\s*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]",), _BRANCH, r"^(?!.*\bstatic\b)"),
    "C++": Grammar(("cpp", "cc", "cxx", "hpp", "hh"), _COMMENTS + "|" + _C_STRINGS, (("class", r"\bclass\s+" + _NAME + r"(?=[^;{(]*\{)"), ("struct", r"\bstruct\s+" + _NAME + r"(?=[^;{(]*\{)"), ("module", r"\bnamespace\s+" + _NAME), ("function", _TYPED)), (r"#\s*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]",), _BRANCH, r"^(?!.*\bstatic\b)"),
    "Kotlin": Grammar(("kt", "kts"), _COMMENTS + "|" + _C_STRINGS, (("class", r"\b(?:class|object)\s+" + _NAME), ("interface", r"\binterface\s+" + _NAME), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?" + _NAME)), (r"(?m)^\s*import\s+(?P<module>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?",), r"\b(?:if|for|while|catch)\b|->|&&|\|\|", r"^(?!.*\bprivate\b)"),
    "Swift": Grammar(("swift",), _COMMENTS + r"|\"(?:\\.|[^\"\\\n])*\"", (("class", r"\b(?:class|actor)\s+" + _NAME), ("struct", r"\bstruct\s+" + _NAME), ("enum", r"\benum\s+" + _NAME), ("interface", r"\bprotocol\s+" + _NAME), ("function", r"\bfunc\s+" + _NAME)), (r"(?m)^\s*import\s+(?P<module>[\w.]+)",), r"\b(?:if|guard|for|while|case|catch)\b|&&|\|\|"),
    "PHP": Grammar(("php",), _COMMENTS + r"|#[^\[\n][^\n]*|" + _C_STRINGS, (("class", r"\bclass\s+" + _NAME), ("interface", r"\binterface\s+" + _NAME), ("trait", r"\btrait\s+" + _NAME), ("function", r"\bfunction\s+&?" + _NAME)), (r"\buse\s+(?P<module>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;",), _BRANCH, r"^(?!.*\bprivate\b)"),
}
BY_EXTENSION = {e: (name, g) for name, g in GRAMMARS.items() for e in g.extensions}
CONTAINERS = frozenset(("class", "struct", "enum", "trait", "interface", "module", "impl"))
_CALL = re.compile(r"(?:(?P<qualifier>[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)(?:\.|::|->))?(?P<name>[A-Za-z_$][\w$]*)\s*(?:::<[^>()]*>)?\(")
_NO_CALL = frozenset("if for while switch match return catch fn func fun function sizeof new throw await typeof in and or not assert guard else do loop when super constructor using lock foreach defer go".split())

_NO_NAME = _NO_CALL - {"new", "constructor", "do"}


def blanked(source: str, pattern: str) -> str:
    """The source with comments and strings as spaces; line feeds stay."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _closing(text: str) -> dict[int, int]:
    """Place of the closing brace of each opening one; unclosed ones end with the text."""
    out, held = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            out[held.pop()] = m.start()
    return out | {at: len(text) - 1 for at in held}


def _names(text: str | None) -> Iterator[tuple[str, str | None]]:
    for part in (text or "").split(","):
        words = re.split(r"\s+as\s+", part.strip().removeprefix("type "))
        if words[0]:
            yield words[0].strip(), words[1].strip() if len(words) > 1 else None


def rows_of(path: str, source: str) -> Iterator[dict]:
    """Rows of the Python extractor's schema, without ``file``."""
    found = BY_EXTENSION.get(path.rsplit(".", 1)[-1])
    if found is None or "." not in path:
        return
    _, grammar = found
    text = blanked(source, grammar.blank)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at)
    closing = _closing(text)
    opening = sorted(closing)
    symbols, seen = [], set()
    for kind, pattern in grammar.definitions:
        for m in re.finditer(pattern, text, re.M):
            at = m.start("name")
            if at in seen or m["name"] in _NO_NAME:
                continue
            k = bisect_right(opening, m.end() - 1)
            begin = opening[k] if k < len(opening) else None
            stop = text.find(";", m.end())
            if begin is None or 0 <= stop < begin:
                # a declaration without a body counts for types only
                if kind not in ("struct", "enum", "class", "interface"):
                    continue
                begin, end = None, stop if stop >= 0 else m.end()
            else:
                end = closing[begin]
            seen.add(at)
            head = text[starts[line_of(at) - 1] : at]
            symbols.append({"kind": kind, "name": m["name"], "owner": m.groupdict().get("owner"), "from": m.start() + len(m[0]) - len(m[0].lstrip()), "begin": begin, "end": end, "head": head})
    symbols.sort(key=lambda s: (s["from"], -s["end"]))
    around: list[dict] = []
    for s in symbols:
        while around and around[-1]["end"] < s["from"]:
            around.pop()
        holder = next((x for x in reversed(around) if x["kind"] in CONTAINERS), None)
        s["parent"] = s["owner"] or (holder["name"] if holder else around[-1]["name"] if around else None)
        if s["kind"] == "function" and holder and holder["kind"] != "module":
            s["kind"] = "method"
        around.append(s)
    functions = [s for s in symbols if s["kind"] in ("function", "method") and s["begin"] is not None]
    for s in symbols:
        body = text[s["begin"] : s["end"] + 1] if s["begin"] is not None else ""
        callable_ = s["kind"] in ("function", "method")
        shape = re.sub(r"\s+", " ", re.sub(r"[A-Za-z_$][\w$]*", "n", body))
        yield {
            "relation": "symbols", "name": s["name"], "kind": s["kind"], "start_line": line_of(s["from"]), "end_line": line_of(s["end"]), "parent": s["parent"],
            "signature": " ".join(source[s["from"] : s["begin"] if s["begin"] is not None else s["end"]].split()), "docstring": None,
            "visibility": "public" if re.search(grammar.public, s["head"] + s["name"]) else "private",
            "complexity": 1 + len(re.findall(grammar.branches, body)) if callable_ else None, "hash": hashlib.sha256(shape.encode()).hexdigest()[:16] if callable_ else None,
        }
    for m in _CALL.finditer(text):
        if m["name"] in _NO_CALL and not m["qualifier"]:
            continue
        inside = [f for f in functions if f["begin"] < m.start("name") < f["end"]]
        if inside:
            yield {"relation": "calls", "caller_symbol": max(inside, key=lambda f: f["begin"])["name"], "callee_name": m["name"], "callee_qualifier": m["qualifier"], "line": line_of(m.start("name"))}
    # modules may stand in strings, so imports are read from the source
    for pattern in grammar.imports:
        for m in re.finditer(pattern, source):
            own, line = m.groupdict(), line_of(m.start("module"))
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            # in a comment or a string, but for a module that begins the line
            if text[first].isspace() and source[first] != '"':
                continue
            names = [*_names(own.get("names"))]
            names += [("default", own["default"])] if own.get("default") else []
            names += [("*", own.get("star"))] if own.get("star") or own.get("all") else []
            if not names:
                # the last part is the name
                module, sign, last = m["module"].rpartition("::" if "::" in m["module"] else "\\" if "\\" in m["module"] else "." if grammar.extensions[0] in ("java", "kt", "cs") else "\0")
                yield {"relation": "imports", "module": module if sign else None, "name": last, "alias": own.get("alias"), "line": line}
            for name, alias in names:
                yield {"relation": "imports", "module": m["module"], "name": name, "alias": alias, "line": line}
    for m in re.finditer(grammar.blank, source, re.S):
        if m[0][:2] in ("//", "/*") or m[0][:1] == "#":
            yield {"relation": "comments", "line": line_of(m.start()), "text": m[0]}


def extract(files: DataFrame) -> DataFrame:
    """All rows of files (path, content) in the languages of :data:`GRAMMARS`, tagged by relation, as the Python extractor's."""
    known = r"\.(?:" + "|".join(sorted(BY_EXTENSION)) + ")$"
    return rows_per_file(files.where(F.col("path").rlike(known)), lambda path, content: ({**r, "file": path} for r in rows_of(path, content)), SCHEMA)
