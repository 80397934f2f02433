"""Previews of containers and functions by the lines that carry their structure.

spans (file, name, language, start_line, end_line), lines (file, line, text). A
span's lines meet in one row, as its preview does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a function's preview, its closing brace apart.
MOST = 20

_SCRIPTS = ("JavaScript", "TypeScript", "TSX")
# fixed values: how lines begin that are signatures, or structure, by language; other languages have the last ones
SIGNATURES = {
    "Rust": ("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ", "type ", "const "),
    "Python": ("def ", "async def "),
    "Go": ("func ",),
    "": ("fn ", "func ", "def ", "function ", "pub fn "),
}
STRUCTURE = {
    "Rust": ("let ", "if ", "} else", "else ", "match ", "for ", "while ", "loop ", "return ", "return;", "fn ", "pub fn ", "async fn "),
    "Script": ("const ", "let ", "var ", "if ", "} else", "else ", "for ", "while ", "switch ", "return ", "return;", "function ", "async ", "await ", "try ", "} catch"),
    "Python": ("return ", "yield ", "raise ", "def ", "async def "),
    "Go": ("if ", "} else", "for ", "switch ", "select ", "return ", "func "),
    "": ("let ", "const ", "var ", "if ", "for ", "while ", "return "),
}


def _begins(line: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | line.startswith(word)
    return out


def _cases(language: Column, by: dict[str, Column]) -> Column:
    out = F
    for name, value in by.items():
        if name:
            out = out.when(language.isin(*(_SCRIPTS if name == "Script" else (name,))), value)
    return out.otherwise(by[""])


def is_signature(text: Column, language: Column) -> Column:
    line = F.trim(F.translate(text, "\t", " "))
    by = {name: _begins(line, words) for name, words in SIGNATURES.items()}
    by["Go"] = by["Go"] | line.contains(" func(")
    by["Script"] = line.contains("(") & ~_begins(line, ("//", "if", "for", "while")) | _begins(line, ("get ", "set ", "async ", "static ", "constructor"))
    return _cases(language, by)


def is_structure(text: Column, language: Column) -> Column:
    line = F.trim(F.translate(text, "\t", " "))
    by = {name: _begins(line, words) for name, words in STRUCTURE.items()}
    by["Rust"] = by["Rust"] | line.contains("?;")
    by["Python"] = by["Python"] | line.endswith(":")
    by["Go"] = by["Go"] | line.contains(":= ")
    return ~(line.isin("", "{", "}") | line.startswith("//") | line.startswith("#")) & _cases(language, by)


def _spans(lines: DataFrame, spans: DataFrame, wanted: Column) -> DataFrame:
    """Spans with all their lines in order, as structs (line, text, wanted)."""
    numbers = spans.select("file", "name", "language", "start_line", "end_line", F.explode(F.sequence(F.col("start_line").cast("long"), F.col("end_line").cast("long"))).alias("line"))
    rows = numbers.join(lines.select("file", F.col("line").cast("long").alias("line"), "text"), ["file", "line"]).withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    # of lines that aren't shown, the indentation is read, and whether they close
    rows = rows.withColumn("text", F.when(F.col("wanted") | (F.trim("text") == "}"), F.col("text")).otherwise(F.regexp_extract("text", r"^\s*", 0)))
    return rows.groupBy("file", "name", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("line", "text", "wanted"))).alias("l"))


def skeletons(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, name, preview, hidden) of containers: the first line and the signatures, bodies cut off at their brace."""
    first = F.col("line") == F.col("start_line")
    held = _spans(lines, spans, first | is_signature(F.col("text"), F.col("language")))
    short = lambda t: F.when(~t.contains("{") | (F.trim(t).endswith("}") & (F.length(t) < 100)), t).otherwise(F.concat(F.substring_index(t, "{", 1), F.lit("{")))
    shown = F.transform(F.filter("l", lambda x: x["wanted"]), lambda x, i: F.when(i == 0, x["text"]).otherwise(short(x["text"])))
    held = held.withColumn("_s", shown)
    text = F.array_join("_s", "\n")
    closing = (F.size("_s") > 1) & ~F.rtrim(text).endswith("}")
    indent = F.regexp_extract(F.get("l", F.lit(0))["text"], r"^\s*", 0)
    return held.select("file", "name", "start_line", F.concat(text, F.when(closing, F.concat(F.lit("\n"), indent, F.lit("}"))).otherwise("")).alias("preview"), (F.size("l") - F.size("_s")).cast("long").alias("hidden"))


def structures(lines: DataFrame, spans: DataFrame, most: int = MOST) -> DataFrame:
    """(file, name, preview, hidden) of functions: the first line, control flow and bindings (``most`` lines), and the closing brace."""
    first = F.col("line") == F.col("start_line")
    held = _spans(lines, spans, first | is_structure(F.col("text"), F.col("language")))
    held = held.withColumn("_s", F.slice(F.transform(F.filter("l", lambda x: x["wanted"]), lambda x: x["text"]), 1, most))
    last = F.element_at("l", -1)["text"]
    held = held.withColumn("_s", F.when((F.trim(last) == "}") & ~F.array_contains("_s", last), F.array_append("_s", last)).otherwise(F.col("_s")))
    return held.select("file", "name", "start_line", F.array_join("_s", "\n").alias("preview"), (F.size("l") - F.size("_s")).cast("long").alias("hidden"))
