"""A subset of jq over JSON text columns: ``.a.b``, ``.[n]``, ``.[]``, ``|``, ``select(.a == x)``, ``select(.a | test("re"))``."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|(\[\])|\.(?=\[|$)")


def _path(text: str) -> list:
    at, out = 0, []
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unsupported filter {text!r}")
        if m[1]:
            out.append(m[1])
        elif m[2]:
            out.append(int(m[2]))
        elif m[3]:
            out.append(None)
        at = m.end()
    return out


def _get(value: Column, steps: list) -> Column:
    path = "$" + "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in steps)
    return F.variant_get(value, path, "variant") if steps else value


def _stages(program: str) -> list[str]:
    """Split at the pipes outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for k, c in enumerate(program):
        if c == '"' and program[k - 1 : k] != "\\":
            quoted = not quoted
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "|" and depth == 0 and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def apply(df: DataFrame, column: str, program: str) -> DataFrame:
    """Rows of ``value`` (JSON text) that the program gives for each row's document."""
    out = df.select(F.parse_json(column).alias("v"))
    for stage in _stages(program):
        if m := re.fullmatch(r"select\((\.[^|=]*?)\s*==\s*(.+)\)", stage):
            want = json.loads(m[2])
            kind = "string" if isinstance(want, str) else "boolean" if isinstance(want, bool) else "double"
            out = out.where(F.try_variant_get(_get(F.col("v"), _path(m[1])), "$", kind) == F.lit(want).cast(kind))
        elif m := re.fullmatch(r'select\((\.[^|]*?)\s*\|\s*test\("(.*)"\)\)', stage):
            out = out.where(F.try_variant_get(_get(F.col("v"), _path(m[1])), "$", "string").rlike(m[2]))
        else:
            steps: list = []
            for step in _path(stage):
                if step is None:
                    out = out.select(F.explode(F.variant_get(_get(F.col("v"), steps), "$", "array<variant>")).alias("v"))
                    steps = []
                else:
                    steps.append(step)
            out = out.select(_get(F.col("v"), steps).alias("v"))
    return out.select(F.to_json("v").alias("value"))
