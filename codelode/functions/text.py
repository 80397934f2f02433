"""Text columns: lines, identifiers and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """Lines without terminators; no phantom last line, none at all for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), r"\r?\n"))


def line_count(text: Column, most_bytes: int = 1_000_000) -> Column:
    """Number of lines; 0 for a null text and one of ``most_bytes`` or more."""
    return F.when(F.octet_length(text) < most_bytes, F.size(split_lines(text))).otherwise(0).cast("long")


def explode_lines(files: DataFrame, file_col: str = "file", text_col: str = "content") -> DataFrame:
    """(file, line, text), lines from 1."""
    lines = files.select(F.col(file_col).alias("file"), F.posexplode(split_lines(F.col(text_col))).alias("at", "text"))
    return lines.select("file", (F.col("at") + 1).cast("long").alias("line"), "text")


def normal_path(path: Column) -> Column:
    """Lower case, with the separators of names as spaces."""
    return F.translate(F.lower(path), "-._", "   ")


def extension(path: Column) -> Column:
    """The part after the last dot of the last segment; empty without one or for a leading dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def tenths(x: Column) -> Column:
    """Rounded half up to one decimal, on the binary value."""
    return F.floor(x * 10 + 0.5) / 10


def qualifier_of(call: Column) -> Column:
    """What stands before the last ``.`` or ``::`` of a call; null without one."""
    return F.nullif(F.regexp_extract(call, r"^(.*)(?:::|\.)[^.:]+$", 1), F.lit(""))


def callee_of(call: Column) -> Column:
    return F.regexp_extract(call, r"([^.:]+)$", 1)


def short_count(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))
