"""Code as token rows: definitions, calls, complexity and clone hashes of many languages by DataFrame operations.

A file's text becomes tokens by one pattern a family of languages; comments and
strings are one token each, so nothing in them counts. Lines and bracket depths
are running sums over the tokens, and brackets match as neighbours of one depth;
both are columns of numbers beside a file's tokens (:func:`placed`), so that no
token is sorted or shuffled for them.
A definition is a keyword and a name, or (C, C++, C#, Java, scripts) a name and
parentheses before a brace; its body reaches to the matching brace, or, in
Python, to the next line that isn't indented further. Everything else follows
from which tokens stand in which definition (:mod:`nested`).

What a grammar would tell and tokens do not: C-like functions whose parentheses
are not followed by the brace itself (return types of TypeScript methods,
``throws`` lists) are not seen; of binary operators only ``&&``, ``||`` and
their like count as branches; receivers that are no plain names give calls
without a qualifier.

files: path, language, content. Files of other languages have no tokens.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators import nested
from codelode.scratch import together

_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_REST = r"\n[ \t]*+|" + _NAME + r"(?:(?:::|\?\.|\.)" + _NAME + r")*+|\p{N}[\p{L}\p{N}_]*+(?:\.\p{N}[\p{L}\p{N}_]*+)?+|&&|\|\||\?\?|\?:|=>|->|::|\?\.|\S"
_SLASHES = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_DOUBLE, _SINGLE, _BACK = r'"(?:[^"\\]|\\[\s\S])*+"?', r"'(?:[^'\\\n]|\\.)*+'?", r"`(?:[^`\\]|\\[\s\S])*+`?"
_TRIPLE = r"(?:[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+(?:''')?)"

#: One pattern a family: comments and strings first, then all other tokens.
FAMILIES = {
    "c": "|".join([_SLASHES, _DOUBLE, _SINGLE, _REST]),
    "script": "|".join([_SLASHES, _DOUBLE, _SINGLE, _BACK, _REST]),
    # a quote that isn't closed after one character begins a lifetime
    "rust": "|".join([_SLASHES, r'b?r"[^"]*+"', r'b?r#"(?:[^"]|"(?!#))*+"#', "b?" + _DOUBLE, r"b?'(?:[^'\\\n]|\\[^\n]{1,8})'", _REST]),
    "go": "|".join([_SLASHES, _DOUBLE, r"'(?:[^'\\\n]|\\[^\n]{1,8})'", r"`[^`]*+`?", _REST]),
    "hash": "|".join([r"#[^\n]*+", _SLASHES, _DOUBLE, _SINGLE, _REST]),
    "python": "|".join([r"#[^\n]*+", _TRIPLE, r"(?:[rRbBuUfF]{1,2})?(?:" + r'"(?:[^"\\\n]|\\[\s\S])*+"?' + "|" + _SINGLE + ")", _REST]),
}

# fixed values: languages, their family, keywords of definitions, and branch tokens
LANGUAGES = {
    "Rust": ("rust", {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "impl": "impl", "union": "struct"}, "if match for while loop => && ||"),
    "Go": ("go", {"func": "function", "type": "type"}, "if for switch select case && ||"),
    "JavaScript": ("script", {"function": "function", "class": "class"}, "if for while do switch case catch ? && ||"),
    "TypeScript": ("script", {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "namespace": "module"}, "if for while do switch case catch ? && ||"),
    "Java": ("c", {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, "if for while do case default catch ? && ||"),
    "C#": ("c", {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "module"}, "if for foreach while do case default catch ? && ||"),
    "C": ("c", {"struct": "struct", "enum": "enum", "union": "struct"}, "if for while do switch case default ? && ||"),
    "C++": ("c", {"class": "class", "struct": "struct", "enum": "enum", "namespace": "module", "union": "struct"}, "if for while do switch case default try catch throw ? && ||"),
    "Kotlin": ("c", {"fun": "function", "class": "class", "interface": "interface", "object": "class"}, "if for while do -> catch ?: && ||"),
    "Swift": ("c", {"func": "function", "class": "class", "struct": "struct", "enum": "enum", "protocol": "interface", "extension": "class"}, "if for while repeat switch catch ? ??"),
    "PHP": ("hash", {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}, "if for foreach while do case catch ? && ||"),
    "Python": ("python", {"def": "function", "class": "class"}, "if elif for while try except with match case and or"),
}
#: Languages whose functions may be a name and parentheses before a brace.
SHAPED = ("JavaScript", "TypeScript", "Java", "C#", "C", "C++")
NOT_CALLED = "if for while switch catch return function match loop elif except in new sizeof typeof await yield throw case when guard foreach fn fun def class do else".split()
#: More of them in single languages.
NOT_CALLED_IN = {"Go": "go defer func select range", "Python": "and or not is lambda with del raise assert", "C#": "using lock fixed", "Java": "synchronized assert", "Kotlin": "super", "PHP": "print"}

#: Words that define something in some language.
_DEFINING = sorted({word for _, words, _ in LANGUAGES.values() for word in words})


def _by_language(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _not_called(token: Column) -> Column:
    """Whether a name before a parenthesis is a keyword; reads the column ``language``."""
    own = [f"{language} {word}" for language, words in NOT_CALLED_IN.items() for word in words.split()]
    return token.isin(*NOT_CALLED) | F.concat_ws(" ", "language", token).isin(*own)


#: Kinds of tokens, by number; line ends and comments only hold places.
KINDS = ("end", "comment", "string", "name", "number", "sign")
#: Numbers of the tokens that are left when line ends and comments go: at is a token's place among all, match, held and stmt are places among these, -1: none.
#: mark: 1 a word that defines something in some language, 2 an opening brace or a semicolon, 0 others.
_PLACES = {"at": "int", "line": "int", "kind": "tinyint", "indent": "int", "depth": "int", "match": "int", "held": "int", "shaped": "boolean", "stmt": "int", "mark": "tinyint"}
_ARROW = {"int": pa.int32(), "tinyint": pa.int8(), "boolean": pa.bool_()}
#: Tokens that are placed at once.
_CHUNK = 1 << 20


def _kinds(flat: pa.Array, family: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's kind, first byte and length in bytes; tokens are told apart by their first and last bytes."""
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data, begin, size = np.frombuffer(flat.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)
    first, last, long = data[begin], data[offsets[1:] - 1], size > 1
    second = np.where(long, data[np.minimum(begin + 1, len(data) - 1)], 0)
    is_any = lambda of, signs: np.isin(of, np.frombuffer(signs, np.uint8))
    kind = np.full(len(flat), KINDS.index("sign"), np.int8)
    kind[(first >= ord("0")) & (first <= ord("9"))] = KINDS.index("number")
    kind[((first | 32) >= ord("a")) & ((first | 32) <= ord("z")) | is_any(first, b"_$")] = KINDS.index("name")
    wide = np.flatnonzero(first > 127)
    if len(wide):
        told = {"L": KINDS.index("name"), "N": KINDS.index("number")}
        kind[wide] = [told.get(unicodedata.category(token[0])[0], KINDS.index("sign")) for token in flat.take(pa.array(wide)).to_pylist()]
    kind[long & is_any(last, b"\"'`#") | is_any(first, b"\"`") | (first == ord("'")) & long] = KINDS.index("string")
    kind[long & ((first == ord("/")) & is_any(second, b"/*") | (first == ord("#")) & np.isin(family, ("hash", "python")))] = KINDS.index("comment")
    kind[first == ord("\n")] = KINDS.index("end")
    return kind, first, size


def _ahead(marks: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The last marked place up to each place of a file that begins at ``begin``; -1: none."""
    last = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
    return np.where(last >= begin, last, -1)


def _numbers(said: pa.Array, family: list[str]) -> pa.StructArray:
    """``_PLACES`` of some files' tokens: running sums and neighbours."""
    flat, lengths = said.flatten().cast(pa.large_string()), pc.list_value_length(said).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    file = np.repeat(np.arange(len(said)), lengths)
    starts = np.cumsum(lengths) - lengths
    if not len(flat):
        empty = pa.array([[]] * len(said), pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([empty.cast(pa.list_(_ARROW[t])) for t in _PLACES.values()], list(_PLACES))
    spoken = np.array(family, dtype=object)[file]
    kind, first, size = _kinds(flat, spoken.astype(str))
    breaks = (kind == 0).astype(np.int64)
    broken = np.flatnonzero((kind == 1) | (kind == 2))
    breaks[broken] = pc.count_substring(flat.take(pa.array(broken)), "\n").to_numpy(zero_copy_only=False)
    so_far = np.cumsum(breaks) - breaks
    kept = np.flatnonzero(kind > 1)
    its, kinds, head = file[kept], kind[kept], first[kept]
    n, counts = len(kept), np.bincount(file[kept], minlength=len(said))
    ends = np.cumsum(counts)
    begin = (ends - counts)[its]
    place = np.arange(n)
    at, line = kept - starts[its], so_far[kept] - so_far[np.minimum(starts, len(flat) - 1)][its]
    before = np.maximum(kept - 1, 0)
    indent = np.where((kept > starts[its]) & (kind[before] == 0), size[before] - 1, -1)
    sign = kinds == KINDS.index("sign")
    opens, closes = sign & np.isin(head, np.frombuffer(b"{([", np.uint8)), sign & np.isin(head, np.frombuffer(b"})]", np.uint8))
    depth = np.cumsum(opens.astype(np.int64) - closes)
    depth = depth - np.concatenate([[0], depth])[begin] - opens
    # brackets of one depth open and close in turn
    brackets = np.flatnonzero(opens | closes)
    brackets = brackets[np.lexsort((depth[brackets], its[brackets]))]
    alike = (its[brackets][1:] == its[brackets][:-1]) & (depth[brackets][1:] == depth[brackets][:-1])
    match = np.full(n, -1)
    left, right = brackets[:-1][alike], brackets[1:][alike]
    match[left[opens[left]]] = right[opens[left]]
    match[right[closes[right]]] = left[closes[right]]
    # behind a closing parenthesis: what stands before its opening one
    behind = np.flatnonzero((place > begin) & np.concatenate([[False], closes[:-1] & (head[:-1] == ord(")"))]))
    opened = match[behind - 1]
    held = np.full(n, -1)
    held[behind] = np.where((opened >= 0) & (opened > begin[behind]), opened - 1, -1)
    shaped = np.zeros(n, bool)
    bodies = held[sign & (head == ord("{"))]
    shaped[bodies[bodies >= 0]] = True
    # statements that import: a line of Python, or what ends with a semicolon in Rust
    tokens = flat.take(pa.array(kept))
    said_any = lambda *words: pc.is_in(tokens, pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)
    python, rust = spoken[kept] == "python", spoken[kept] == "rust"
    fresh = python & (indent >= 0) & (depth == 0)
    starting = fresh & said_any("import", "from") | rust & said_any("use")
    stmt = _ahead(starting | fresh | rust & sign & (head == ord(";")), begin)
    stmt = np.where((stmt >= 0) & starting[np.maximum(stmt, 0)], stmt, -1)
    mark = np.where((kinds == KINDS.index("name")) & said_any(*_DEFINING), 1, np.where(sign & ((head == ord("{")) | (head == ord(";"))), 2, 0))
    local = lambda of: np.where(of >= 0, of - begin, -1)
    columns = {"at": at, "line": line, "kind": kinds, "indent": indent, "depth": depth, "match": local(match), "held": local(held), "shaped": shaped, "stmt": local(stmt), "mark": mark}
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(columns[c], _ARROW[t])) for c, t in _PLACES.items()], list(_PLACES))


def _placed(said: pa.Array, family: pa.Array) -> pa.Array:
    """Some files at a time, by the number of their tokens."""
    total = np.cumsum(pc.list_value_length(said).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1), len(said)]
    parts = [_numbers(said.slice(a, b - a), family.slice(a, b - a).to_pylist()) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(parts)


def placed(files: DataFrame, dealt: bool = False) -> DataFrame:
    """(path, language, said) and the columns ``_PLACES``: a row a file, its tokens as an array and what is known of them as arrays of numbers.

    said has all tokens, the others only those that are no comments and line
    ends; at is a token's place in said. Files are dealt to tasks of bounded
    text first, unless they already are.
    """
    family = F.try_element_at(_by_language({k: v[0] for k, v in LANGUAGES.items()}), F.col("language"))
    text = F.concat(F.lit("\n"), F.col("content"))
    cases = F
    for name, pattern in FAMILIES.items():
        cases = cases.when(F.col("_family") == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    known = files.withColumn("_family", family).where("_family is not null").select("path", "language", "_family", "content")
    said = (known if dealt else together(known)).select("path", "language", "_family", cases.alias("said"))
    numbers = F.arrow_udf(_placed, "struct<" + ", ".join(f"{c}: array<{t}>" for c, t in _PLACES.items()) + ">")
    return said.withColumn("_at", numbers("said", "_family")).select("path", "language", "said", *[F.col(f"_at.{c}").alias(c) for c in _PLACES])


def rows(files: DataFrame) -> DataFrame:
    """Token rows of placed files, as :func:`tokens` tells them."""
    arrays = {c: f"_{c}" for c in ("said", *_PLACES)}
    # arrays that are never null, and all files: else filters that ask for tokens are made of these and run before the files are dealt
    held = files.select("path", "language", *[F.coalesce(c, F.array().cast(files.schema[c].dataType)).alias(a) for c, a in arrays.items()])
    found = held.select("*", F.posexplode_outer("_at").alias("pos", "_raw")).where("_raw is not null")
    here = F.col("pos")
    number = lambda of, k: F.get(F.col(arrays[of]), k)
    place = lambda of: F.when(of >= 0, of)
    token = lambda k: F.get(F.col("_said"), number("at", k))
    kind = lambda k: F.get(F.array(*map(F.lit, KINDS)), number("kind", k).cast("int"))
    other = lambda k: F.struct(token(k).alias("token"), F.when(number("at", k).isNotNull(), k).alias("pos"), number("line", k).cast("long").alias("line"))
    first, stmt, match = number("indent", here) >= 0, number("stmt", here), number("match", here)
    near = lambda by: F.when(number("stmt", here + by) == stmt, token(here + by))
    module = F.when((token(stmt) == "from") & (kind(stmt + 1) == "name"), token(stmt + 1))
    said = F.struct(place(stmt).alias("at"), module.alias("module"), near(-1).alias("b1"), near(-2).alias("b2"), near(1).alias("a1"), near(2).alias("a2"))
    opens = (kind(here) == "sign") & token(here).isin("{", "(", "[")
    columns = {
        "pos": here, "line": number("line", here).cast("long"), "token": F.get(F.col("_said"), F.col("_raw")), "kind": kind(here), "first": first, "indent": F.when(first, number("indent", here)), "depth": number("depth", here).cast("long"),
        "match": place(match), "match_line": F.when(opens, number("line", match).cast("long")), "held": other(number("held", here)), "shaped": number("shaped", here),
        "next": token(here + 1), "next_kind": kind(here + 1), "prev": other(here - 1), "last": other(F.size("_at") - 1), "stmt": said, "mark": number("mark", here),
    }
    return found.select("path", "language", *[c.alias(n) for n, c in columns.items()])


def tokens(files: DataFrame) -> DataFrame:
    """(path, language, pos, line, token, kind, first, indent, depth, match, match_line, held, shaped, next, next_kind, prev, last, stmt, mark) of all tokens but comments and line ends.

    pos: a token's place among these; kind: name, number, string, sign; first: whether a line begins here, then
    with its indent; depth: brackets around; match: where the bracket's other
    half stands, match_line: its line, of an opening one; held: right behind a
    closing parenthesis, what stands before its opening one (token, pos, line);
    shaped: whether parentheses and a brace follow; next, next_kind: the token
    behind, null at the file's end; prev: the one before, last: the file's last
    (token, pos, line); stmt: in an import statement, where it begins (at), what
    it imports from (module) and its tokens around this one (b1, b2, a1, a2);
    mark: see ``_PLACES``. The files are shuffled, not their tokens.
    """
    return rows(placed(files))


def definitions(found: DataFrame) -> DataFrame:
    """(path, name, kind, start, end, start_line, end_line, parent): symbols, with the places of their first and last token."""
    kinds = _by_language({f"{language} {word}": kind for language, (_, words, _) in LANGUAGES.items() for word, kind in words.items()})
    kind = F.when(F.col("mark") == 1, F.try_element_at(kinds, F.concat_ws(" ", "language", "token")))
    # few tokens matter: those that define, end or hold bodies, and those that begin lines of Python
    after_bracket = (F.col("language") == "Go") & (F.col("kind") == "name") & (F.col("prev.token") == ")")
    line = F.col("first") & (F.col("depth") == 0)
    held = found.where((F.col("language") != "Python") & ((F.col("mark") > 0) | after_bracket))
    # what is asked of each token is asked behind the shuffle: in one step with the arrays it would be more code than the JVM compiles
    held = held.select(
        "path", "language", "pos", "line", "token", "depth", "match", "match_line", "mark", F.when(F.col("mark") == 1, F.col("next")).alias("next"), (F.col("next_kind") == "name").alias("_named"),
        (F.col("prev.token") == ")").alias("_behind"), after_bracket.alias("_after"), "held", F.struct("last.pos", "last.line").alias("_last"),
    ).repartition("path").withColumn("_kind", kind)
    # a method with a receiver: the name after the parentheses that follow the keyword
    received = F.col("_after") & (F.col("held.token") == "func")
    plain = F.col("_kind").isNotNull() & F.col("_named")
    control = _not_called(F.col("held.token")) | ~F.col("held.token").rlike(r"^[\p{L}_$]")
    shaped = F.col("language").isin(*SHAPED) & (F.col("token") == "{") & F.col("_behind") & ~control
    place = lambda of: (F.col(f"{of}pos").alias("start"), F.col(f"{of}line").alias("start_line"))
    by_word = F.struct(F.col("next").alias("name"), F.col("_kind").alias("kind"), *place(""))
    by_shape = lambda name: F.struct(name.alias("name"), F.lit("function").alias("kind"), *place("held."))
    braces = held.withColumn("_def", F.when(plain, by_word).when(received, by_shape(F.col("token"))).when(shaped, by_shape(F.col("held.token"))))
    # the body's brace: the next at this depth, unless a statement ends or another definition begins before
    after = Window.partitionBy("path", "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("token", F.col("pos").alias("at"), "match", "match_line")
    met = F.when((F.col("mark") == 2) | F.col("_def").isNotNull(), here)
    braces = braces.withColumn("_body", F.when(F.col("token") == "{", here).otherwise(F.last(met, ignorenulls=True).over(after))).where("_def is not null")
    # a shaped function may also be one by its keyword: function f() {
    body = F.col("_body.token") == "{"
    ends = {"end": F.when(body, F.coalesce("_body.match", "_last.pos")).otherwise(F.col("pos") + 1), "end_line": F.when(body, F.coalesce("_body.match_line", "_last.line")).otherwise(F.col("line"))}
    braced = braces.select("path", "_def.*", *[c.alias(n) for n, c in ends.items()]).groupBy("path", "name", "end", "end_line").agg(F.min_by(F.struct("kind", "start", "start_line"), "start").alias("s")).select("path", "name", "s.*", "end", "end_line")
    python = found.withColumn("_kind", kind).where((F.col("language") == "Python") & ((F.col("mark") == 1) | line)).where(F.col("_kind").isNotNull() | line)
    python = python.withColumn("_def", F.when(F.col("_kind").isNotNull() & (F.col("next_kind") == "name"), by_word))
    return nested.with_parent(braced.unionByName(_indented(python)))


def _indented(python: DataFrame) -> DataFrame:
    """Python's definitions: to the last token before a line that isn't indented further."""
    # one number for each width of indentation at which something is defined
    widths = sorted(r[0] for r in python.where("first and depth = 0 and (_def is not null or token in ('async', '@'))").select("indent").distinct().collect())
    back = Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("path").orderBy("pos")
    # async stands before the keyword on its line
    lines = python.where("(first and depth = 0) or _def is not null").withColumn("indent", F.when(F.col("first"), F.col("indent")).otherwise(F.lag("indent").over(own)))
    stop = F.lit(None).cast("struct<pos:int,line:bigint>")
    for width in widths:
        stop = F.when(F.col("indent") == width, F.last(F.when(F.col("first") & (F.col("indent") <= width), F.struct("prev.pos", "prev.line")), ignorenulls=True).over(back)).otherwise(stop)
    found = lines.withColumn("_stop", F.coalesce(stop, F.struct("last.pos", "last.line"))).where("_def is not null")
    return found.select("path", "_def.name", "_def.kind", "_def.start", "_def.start_line", F.col("_stop.pos").alias("end"), F.col("_stop.line").alias("end_line"))


def complexity(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions (path, name, start_line, end_line, complexity): 1 and the branch tokens inside."""
    branches = [f"{language} {word}" for language, (_, _, words) in LANGUAGES.items() for word in words.split()]
    anywhere = sorted({word for _, _, words in LANGUAGES.values() for word in words.split()})
    functions = symbols.where("kind = 'function'")
    met = nested.around(functions, found.where(F.col("kind").isin("name", "sign") & F.col("token").isin(*anywhere)).where(F.concat_ws(" ", "language", "token").isin(*branches)).select("path", F.col("pos").alias("at")))
    counted = met.groupBy("path", F.col("around.start").alias("start"), F.col("around.end").alias("end")).agg(F.count("*").alias("n"))
    return functions.join(counted, ["path", "start", "end"], "left").select("path", "name", "start_line", "end_line", (1 + F.coalesce("n", F.lit(0))).cast("long").alias("complexity"))


def calls(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_file, caller_symbol, callee_name, callee_qualifier, line) of every call in a function, for each function around it."""
    called = found.where((F.col("kind") == "name") & (F.col("next") == "(") & ~_not_called(F.col("token")) & ~F.coalesce(F.col("prev.token").isin(*_DEFINING), F.lit(False)))
    # a definition's own name is no call: behind a receiver, or before parentheses and a brace
    received = (F.col("language") == "Go") & (F.col("prev.token") == ")") & (F.col("held.token") == "func")
    called = called.where(~(F.coalesce(received, F.lit(False)) | F.col("language").isin(*SHAPED) & F.col("shaped")))
    met = nested.around(symbols.where("kind = 'function'"), called.select("path", "line", "token", F.col("pos").alias("at")))
    cut = r"^(.*)(?:::|\?\.|\.)([^.:]+)$"
    qualifier = F.nullif(F.regexp_extract("token", cut, 1), F.lit(""))
    return met.select(F.col("path").alias("caller_file"), F.col("around.name").alias("caller_symbol"), F.when(qualifier.isNotNull(), F.regexp_extract("token", cut, 2)).otherwise(F.col("token")).alias("callee_name"), qualifier.alias("callee_qualifier"), F.col("line").cast("long").alias("line"))


def clone_hashes(found: DataFrame, symbols: DataFrame, elide_names: bool = False, elide_literals: bool = False) -> DataFrame:
    """Functions (path, name, start_line, line_count, hash) with a digest of their tokens, names and literals left out if asked for.

    found: token rows, or placed files. The function's own name never counts. A
    file's tokens meet in one row, as they do in its text; each function reads
    its stretch of them.
    """
    if "said" in found.columns:
        files = found.select("path", "said", "at", "kind")
    else:
        number = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("tinyint")
        files = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "token", number.alias("kind")))).alias("l")).select("path", F.col("l.token").alias("said"), F.col("l.pos").alias("at"), F.col("l.kind").alias("kind"))
    keywords = sorted({w for _, words, branches in LANGUAGES.values() for w in [*words, *branches.split()]} | set(NOT_CALLED))

    def hashed(function: Column) -> Column:
        def text(k: Column) -> Column:
            token, kind = F.get("said", F.get("at", k)), F.get("kind", k)
            said = F.when(token == function["name"], F.lit("self"))
            if elide_literals:
                said = said.when(kind == KINDS.index("string"), F.lit("string")).when(kind == KINDS.index("number"), F.lit("number"))
            if elide_names:
                said = said.when((kind == KINDS.index("name")) & ~token.isin(*keywords), F.lit("name"))
            return said.otherwise(token)

        whole = F.array_join(F.transform(F.sequence(function["start"], function["end"]), text), "\n")
        return F.struct(function["name"].alias("name"), function["start_line"].alias("start_line"), (function["end_line"] - function["start_line"] + 1).alias("line_count"), F.sha2(whole, 256).alias("hash"))

    # a file meets its functions once: a row for each would copy its tokens
    functions = symbols.where("kind = 'function'").groupBy("path").agg(F.collect_list(F.struct("name", "start", "end", "start_line", "end_line")).alias("_f"))
    return files.join(functions, "path").select("path", F.inline(F.transform("_f", hashed)))


def imports(found: DataFrame) -> DataFrame:
    """(file, module, name, alias, line) of Python's import statements and Rust's use declarations, nested groups included."""
    said = found.where("stmt.at is not null").select("path", "language", "pos", "line", "token", "kind", "match", F.col("stmt.at").alias("stmt"), F.col("stmt.module").alias("_module"), *[F.col(f"stmt.{c}").alias(f"_{c}") for c in ("b1", "b2", "a1", "a2")])
    alias = F.when(F.col("_a1") == "as", F.col("_a2"))
    listed = F.col("_b1").isin("import", ",", "(", "*") & (F.col("kind") == "name") | (F.col("token") == "*") & (F.col("_b1") == "import")
    plain = said.where((F.col("language") == "Python") & listed & (F.col("token") != "import")).select("path", F.col("_module").alias("module"), F.col("token").alias("name"), alias.alias("alias"), "line")
    uses = said.where("language = 'Rust'")
    groups = uses.where("token = '{'").select("path", F.col("pos").alias("start"), F.coalesce("match", F.col("pos")).alias("end"), F.when(F.col("_b1") == "::", F.col("_b2")).alias("prefix"), F.col("stmt").alias("of"))
    star = (F.col("token") == "*") & (F.col("_b1") == "::")
    leaf = uses.where(((F.col("kind") == "name") & (F.col("token") != "as") & ~F.coalesce(F.col("_a1") == "::", F.lit(False)) & ~F.coalesce(F.col("_b1") == "as", F.lit(False)) & (F.col("pos") > F.col("stmt"))) | star)
    leaf = leaf.select("path", "stmt", F.col("pos").alias("at"), "line", F.when(star, F.concat_ws("::", "_b2", "token")).otherwise(F.col("token")).alias("said"), alias.alias("alias"))
    met = nested.around(groups, leaf).where(F.col("around.of") == F.col("stmt")).groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("around.prefix").alias("p")))).alias("_p"))
    full = leaf.join(met, ["path", "at"], "left").withColumn("_full", F.concat_ws("::", F.coalesce(F.transform("_p", lambda x: x["p"]), F.array().cast("array<string>")), "said"))
    full = full.select("path", F.nullif(F.regexp_extract("_full", "^(.*)::([^:]+)$", 1), F.lit("")).alias("module"), F.regexp_extract("_full", "([^:]+)$", 1).alias("name"), "alias", "line")
    return plain.unionByName(full).select(F.col("path").alias("file"), "module", "name", "alias", F.col("line").cast("long").alias("line"))
