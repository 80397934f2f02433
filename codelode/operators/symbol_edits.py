"""Edits of symbols as an algebra of line rows: delete, replace, insert, move, copy, swap.

A file meets its edits once, by path, and is an array of its lines from there
on. Edits name lines of the original: what goes is a set of lines, what comes
is a list of texts at an anchor (sorted by anchor and edit), and both read
blank lines, indentation and container bodies around the symbol by their place
in arrays that name each line's neighbours, so the work grows with lines plus
edits and with the lines of containers. All edits of a batch see the original
text; a batch with overlapping symbols leaves every file as it is.

edits: edit_id (by place if left out), path, action, start_line, end_line, text. Actions: delete,
replace, before, after, prepend, append; without lines, prepend and append mean
the file, with them a container. Text that goes in takes the symbol's
indentation, or the container's and four blanks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.globs import plain_glob
from codelode.operators.edits import conflicts

ACTIONS = ("delete", "replace", "before", "after", "prepend", "append")
_CLOSERS = ("}", "};", ")", "]", "end")


def _blank() -> Column:
    return F.lit("")


def line_rows(files: DataFrame) -> DataFrame:
    """(path, line, text, ended) of files (path, content); ended: a line feed follows."""
    parts = files.select("path", F.posexplode(F.split("content", "\n")).alias("k", "text"), F.size(F.split("content", "\n")).alias("n"))
    return parts.where("k < n - 1 or text <> ''").select("path", (F.col("k") + 1).cast("long").alias("line"), "text", (F.col("k") < F.col("n") - 1).alias("ended"))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values; a lambda evaluates what it names for every element."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def _let(value: Column, say: Callable[[Column], Column]) -> Column:
    """``say`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), say), F.lit(0))


def _blank_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\t\r", "  ")) == ""


def _places(lines: str, wanted: Callable[[Column], Column]) -> Column:
    """Numbers of the lines that are wanted."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(wanted(x), i + 1)))


def _next(places: str) -> Column:
    """For each line, from 0 on, the first of some places behind it."""
    return F.flatten(F.zip_with(F.slice(F.concat(F.array(F.lit(0)), places), 1, F.size(places)), places, lambda a, b: F.array_repeat(b, b - a)))


def _last(places: str, n: Column) -> Column:
    """For each line, from the one behind the first place on, the last of some places before it."""
    ends = F.concat(F.slice(places, 2, F.size(places)), F.array(n))
    return F.flatten(F.zip_with(places, F.slice(ends, 1, F.size(places)), lambda a, b: F.array_repeat(a, b - a)))


def _said(text: Column, indent: Column) -> Column:
    """Lines of a text, indented; empty ones, but for the first, stay empty."""
    lines = F.split(F.regexp_replace(F.coalesce(text, _blank()), "\n$", ""), "\n")
    return F.transform(lines, lambda x, i: F.when((i > 0) & (x == ""), x).otherwise(F.concat(indent, x)))


def _blanks(n: Column) -> Column:
    return F.array_repeat(_blank(), F.greatest(n, F.lit(0)).cast("int"))


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"))


def _put(line: Column, slot: int, texts: Column) -> Column:
    return F.struct(line.cast("long").alias("line"), F.lit(slot).alias("slot"), texts.alias("texts"))


def _simple(e: Column, at: Column) -> Column:
    """(range, put) of an edit that deletes, replaces or stands beside its lines."""
    start, end, action = e["start_line"], e["end_line"], e["action"]
    empty_after = F.coalesce(at["next_full"], at["n"] + 1) - end - 1
    blank_after = F.coalesce(at["next_said"], at["n"] + 1) - end - 1
    blank_before = F.when(at["last_said"].isNotNull(), start - at["last_said"] - 1).otherwise(F.greatest(start - 2, F.lit(0)))
    # a blank line before the symbol makes those behind it superfluous
    spare = F.when((start >= 3) & (at["text_before"] == ""), empty_after).otherwise(0)
    new = _said(e["text"], F.coalesce(at["indent"], _blank()))
    gap = F.greatest(blank_after, F.lit(1))
    behind = F.concat(_blanks(gap - F.when(at["ended"], 0).otherwise(1)), new, F.when(at["next_full"].isNotNull(), _blanks(gap)).otherwise(F.array().cast("array<string>")))
    gone = F.when(action == "delete", _span(start, end + spare)).when(action == "replace", _span(start, end)).when((action == "after") & (empty_after > 0), _span(end + 1, end + empty_after))
    come = F.when(action == "replace", _put(start, -1, new)).when(action == "before", _put(start, -1, F.concat(new, _blanks(F.greatest(blank_before, F.lit(1)))))).when(action == "after", _put(end, 1, behind))
    return F.struct(gone.alias("range"), come.alias("put"))


def _container(e: Column, at: Column) -> Column:
    """(range, put) of an edit at the head or the end of a container."""
    start, end, prepends = e["start_line"], e["end_line"], e["action"] == "prepend"
    python = F.col("path").rlike(r"\.pyi?$")
    low, high = F.greatest(F.least(start, end), F.lit(1)).cast("int"), F.greatest(start, end).cast("int")
    own = F.transform(F.slice("_lines", low, F.greatest(high - low + 1, F.lit(0))), lambda x, i: F.struct((low + i).cast("long").alias("line"), F.trim(F.translate(x, "\t\r", "  ")).alias("t")))
    closed = at["closing"].isin(*_CLOSERS) & (end > start)
    filled_of = lambda lines: F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1 - F.when(closed, 1).otherwise(0), F.lit(0))), lambda x: x["t"] != "")

    def doc_of(filled):
        """The line that ends the docstring: the first itself, or the next with its quotes."""
        head = F.get(filled, F.lit(0))
        quotes = F.substring(head["t"], 1, 3)
        doc = python & quotes.isin('"""', "'''")
        here = (F.length(head["t"]) >= 6) & head["t"].endswith(quotes)
        return F.when(doc & here, head["line"]).when(doc, F.get(F.filter(filled, lambda x: (x["line"] > head["line"]) & x["t"].contains(quotes)), F.lit(0))["line"])

    def placed(filled, doc, real):
        empty = F.when(python, F.forall(real, lambda x: x["t"] == "pass")).otherwise(F.size(filled) == 0)
        new = _said(e["text"], F.concat(F.coalesce(at["indent"], _blank()), F.lit("    ")))
        space = _blanks(F.when(empty, 0).otherwise(1))
        top = F.when(python & (F.size(real) > 0), F.get(real, F.lit(0))["line"] - 1).when(python & doc.isNotNull(), doc).otherwise(start)
        bottom = F.when(F.size(filled) > 0, F.element_at(filled, -1)["line"]).otherwise(start)
        stop = end - F.when(closed, 1).otherwise(0)
        gone = F.when(~prepends & (stop > bottom), _span(bottom + 1, stop))
        return F.struct(gone.alias("range"), F.when(prepends, _put(top, 1, F.concat(new, space))).otherwise(_put(bottom, 1, F.concat(space, new))).alias("put"))

    real_of = lambda filled, doc: F.filter(filled, lambda x: doc.isNull() | (x["line"] > doc))
    told = lambda filled: _let(doc_of(filled), lambda doc: _let(real_of(filled, doc), lambda real: placed(filled, doc, real)))
    return _let(own, lambda lines: F.when(F.size(lines) > 0, _let(filled_of(lines), told)))


def _done(edited: DataFrame) -> DataFrame:
    """Adds ``_done``: the content of files (path, content, _edits) after their edits; null where there are none."""
    some = lambda column: F.when(F.col("_edits").isNotNull(), column)
    df = _held(edited, _all=some(F.split(F.coalesce("content", _blank()), "\n")))
    df = _held(df, _lines=F.when(F.element_at("_all", -1) == "", F.slice("_all", 1, F.size("_all") - 1)).otherwise(F.col("_all")), _n_all=F.size("_all")).drop("_all")
    df = _held(df, _n=F.size("_lines"), _full=_places("_lines", lambda x: x != ""), _text=_places("_lines", lambda x: ~_blank_line(x)))
    df = _held(df, _next_full=_next("_full"), _next_said=_next("_text"), _last_said=_last("_text", F.col("_n")))

    def around(e):
        start, end = e["start_line"].cast("int"), e["end_line"].cast("int")
        known = lambda line, column: F.when(line.between(1, F.col("_n")), column)
        return F.struct(
            F.regexp_extract(F.get("_lines", start - 1), r"^[ \t]*", 0).alias("indent"), known(start, F.get("_lines", start - 2)).alias("text_before"), F.get("_last_said", start - F.get("_text", F.lit(0)) - 1).cast("long").alias("last_said"),
            known(end, F.get("_next_full", end)).cast("long").alias("next_full"), known(end, F.get("_next_said", end)).cast("long").alias("next_said"), known(end, end < F.col("_n_all")).alias("ended"), known(end, F.col("_n")).cast("long").alias("n"), F.trim(F.get("_lines", end - 1)).alias("closing"),
        )

    def told(e):
        # of a whole file: a file without lines has them at place 0
        texts = F.split(F.regexp_replace(F.coalesce(e["text"], _blank()), "\n$", ""), "\n")
        append = e["action"] == "append"
        at_end = _put(F.when(append, F.col("_n") + 1).otherwise(F.lit(0)), 1, F.when(append & (F.col("_n") == 0), F.concat(F.array(_blank()), texts)).otherwise(texts))
        whole = F.struct(F.lit(None).cast("struct<a:long,b:long>").alias("range"), at_end.alias("put"))
        simple = e["action"].isin("delete", "replace", "before", "after")
        return F.when(e["start_line"].isNull(), whole).otherwise(_let(around(e), lambda at: F.when(simple, _simple(e, at)).otherwise(_container(e, at))))

    df = _held(df, _told=F.transform("_edits", lambda e: F.struct(e["edit_id"].alias("edit_id"), told(e).alias("t"))))
    gone = F.flatten(F.transform("_told", lambda x: F.coalesce(F.sequence(x["t"]["range"]["a"], x["t"]["range"]["b"]), F.array().cast("array<long>"))))
    every = F.when(F.col("_n") > 0, F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).otherwise(F.array().cast("array<long>"))
    row = lambda line, slot, edit, k, text, ended: F.struct(line.alias("line"), slot.alias("slot"), edit.alias("edit_id"), k.alias("k"), text.alias("text"), ended.alias("ended"))
    kept = F.transform(F.array_except(every, gone), lambda n: row(n, F.lit(0), _blank(), F.lit(0), F.get("_lines", n.cast("int") - 1), n < F.col("_n_all")))
    put_of = lambda x: F.transform(x["t"]["put"]["texts"], lambda text, k: row(x["t"]["put"]["line"], x["t"]["put"]["slot"], x["edit_id"], k, text, F.lit(True)))
    put = F.flatten(F.transform(F.filter("_told", lambda x: x["t"]["put"]["texts"].isNotNull()), put_of))
    df = _held(df, _rows=F.array_sort(F.concat(kept, put)))
    df = _held(df, _size=F.size("_rows"))
    # the last line that stays before an inserted text is ended
    return df.withColumn("_done", F.array_join(F.transform("_rows", lambda x, i: F.concat(x["text"], F.when(x["ended"] | (i < F.col("_size") - 1), "\n").otherwise(""))), ""))


def edit_symbols(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, content) after all edits; none is made if any two name overlapping symbols."""
    if "edit_id" not in edits.columns:
        edits = edits.withColumn("edit_id", F.concat_ws(":", F.lpad(F.col("start_line").cast("string"), 12, "0"), "action"))
    known = edits.withColumn("action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))))
    ranged = known.where("start_line is not null").select("edit_id", F.col("path").alias("file"), "start_line", "end_line")
    blocked = conflicts(ranged).limit(1).agg((F.count("*") > 0).alias("_blocked"))
    each = F.struct(F.col("edit_id").cast("string").alias("edit_id"), "action", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("text").cast("string").alias("text"))
    edited = files.select("path", "content").join(known.groupBy("path").agg(F.collect_list(each).alias("_edits")), "path", "left")
    # one row says whether the batch is blocked
    out = _done(edited).crossJoin(F.broadcast(blocked))
    return out.select("path", F.when(F.col("_blocked") | F.col("_edits").isNull(), F.col("content")).otherwise(F.coalesce("_done", _blank())).alias("content"))


def glob_edits(symbols: DataFrame, requests: list[tuple[str, str, str | None]]) -> DataFrame:
    """Edits of all symbols (file, name, parent, start_line, end_line) whose path ``parent/name`` matches; requests: (glob, action, text).

    The stated requests share one pass over the symbols.
    """
    path = F.concat_ws("/", "parent", "name")
    tried = [F.when(path.rlike(plain_glob(glob)), F.struct(F.lit(k).alias("k"), F.lit(action).alias("action"), F.lit(text).cast("string").alias("text"))) for k, (glob, action, text) in enumerate(requests)]
    met = symbols.select("file", "start_line", "end_line", path.alias("_p"), F.explode(F.array_compact(F.array(*tried))).alias("r"))
    return met.select(F.concat_ws(":", F.lpad(F.col("r.k").cast("string"), 6, "0"), F.lpad(F.col("start_line").cast("string"), 12, "0"), "_p").alias("edit_id"), F.col("file").alias("path"), "r.action", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "r.text")


def moves(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edits that move, copy or swap symbols: wanted (edit_id, path, action, start_line, end_line, to_start, to_end, place).

    action: move, copy or swap; place: before, after, prepend or append. The
    text leaves its own indentation behind.
    """
    side = lambda name, *lines: F.struct(F.lit(name).alias("side"), *[F.col(c).cast("long").alias(n) for c, n in zip(lines, "abcd")])
    both = F.array(side("own", "start_line", "end_line", "to_start", "to_end"), side("other", "to_start", "to_end", "start_line", "end_line"))
    spans = wanted.select("edit_id", "path", "action", "place", F.explode(both).alias("s")).where("s.side = 'own' or action = 'swap'")
    numbered = spans.withColumn("line", F.explode(F.sequence("s.a", "s.b")))
    said = numbered.join(line_rows(files), ["path", "line"]).groupBy("edit_id", "path", "action", "place", "s").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    lead = F.regexp_extract(F.get("l", F.lit(0))["text"], r"^[ \t]*", 0)
    said = said.withColumn("_lead", lead)
    text = F.array_join(F.transform("l", lambda x: F.when(x["text"].startswith(F.col("_lead")), F.substr(x["text"], F.length("_lead") + 1)).otherwise(x["text"])), "\n")
    put = said.select(F.concat_ws(":", "edit_id", "s.side").alias("edit_id"), "path", F.when(F.col("action") == "swap", "replace").otherwise(F.col("place")).alias("action"), F.col("s.c").cast("long").alias("start_line"), F.col("s.d").cast("long").alias("end_line"), text.alias("text"))
    drop = wanted.where("action = 'move'").select(F.concat_ws(":", "edit_id", F.lit("gone")).alias("edit_id"), "path", F.lit("delete").alias("action"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.lit(None).cast("string").alias("text"))
    return put.unionByName(drop)
