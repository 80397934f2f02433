"""``--help`` texts of command-line programs as rows of options and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: marks of the frameworks whose help texts are told apart
MARKS = {
    "argparse": (r"(?m)^usage: ", r"(?m)^(?:optional arguments|options|positional arguments):", r"show this help message and exit"),
    "clap": (r"(?m)^Usage: ", r"(?m)^Options:", r"Print help"),
    "click": (r"(?m)^Usage: ", r"Show this message and exit\.", r"\[OPTIONS\]"),
    "cobra": (r"(?m)^Usage:\n", r"(?m)^Available Commands:", r"(?m)^Flags:"),
    "commander": (r"(?m)^Usage: ", r"display help for command", r"\[options\]"),
    "yargs": (r"(?m)^Options:", r"Show help", r"\[boolean\]|\[string\]|\[number\]"),
}
SECTION = r"^\S.*:$"
OPTION = r"^\s{1,8}(?:(-[A-Za-z0-9?]),?\s+)?(--[A-Za-z0-9][\w.-]*)?(?:[ =]([<\[]?[A-Za-z][^\s>\]]*[>\]]?(?:\.\.\.)?))?(?:\s{2,}(.*))?$"


def score(value: Column, form: str) -> Column:
    return sum((value.rlike(p).cast("int") for p in MARKS[form]), F.lit(0)) / F.lit(len(MARKS[form]))


def detect(texts: DataFrame) -> DataFrame:
    """texts (program, value) with the format that most marks speak for."""
    best = F.greatest(*[F.struct(score(F.col("value"), f).alias("s"), F.lit(f).alias("f")) for f in sorted(MARKS)])
    return texts.withColumn("_b", best).withColumn("format", F.when(F.col("_b.s") > 0, F.col("_b.f"))).drop("_b")


def _lines(texts: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rows = texts.select("program", F.posexplode(F.split("value", "\n")).alias("line", "text"))
    head = F.when(F.col("text").rlike(r"^\S[^:]*:\s*$"), F.lower(F.regexp_extract("text", r"^([^:]*):", 1)))
    return rows.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("program").orderBy("line")))


def options(texts: DataFrame) -> DataFrame:
    """(program, short, long, value, description), help and version left out."""
    rows = _lines(texts).where(F.col("text").rlike(r"^\s+-"))
    short = F.nullif(F.regexp_extract("text", r"^\s+(-[A-Za-z0-9?])(?:[,\s]|$)", 1), F.lit(""))
    long = F.nullif(F.regexp_extract("text", r"(?:^\s+|,\s*|\s)(--[A-Za-z0-9][\w.-]*)", 1), F.lit(""))
    flags = F.regexp_extract("text", r"^\s+(\S.*?)(?:\s{2,}|$)", 1)
    value = F.nullif(F.regexp_extract(flags, r"[ =]([<\[]?[A-Za-z][^\s,]*)$", 1), F.lit(""))
    said = F.nullif(F.trim(F.regexp_extract("text", r"^\s+\S.*?\s{2,}(.*)$", 1)), F.lit(""))
    out = rows.select("program", short.alias("short"), long.alias("long"), value.alias("value"), said.alias("description"))
    return out.where("coalesce(long, '') not in ('--help', '--version') and (long is not null or short not in ('-h', '-V'))")


def commands(texts: DataFrame) -> DataFrame:
    """(program, name, description) of the commands section; the help command is left out."""
    rows = _lines(texts).where(F.col("section").contains("command") & F.col("text").rlike(r"^\s+[a-z]"))
    return rows.select("program", F.regexp_extract("text", r"^\s+([a-z][\w:-]*)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract("text", r"^\s+\S+.*?\s{2,}(.*)$", 1)), F.lit("")).alias("description")).where("name <> 'help'")
