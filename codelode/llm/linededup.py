"""Removal of repeated passages by content-defined lines, in Spark SQL functions only.

Words are what white space parts; the kind of white space doesn't count. A
line is a stretch of words that begins where a word's hash is the least of some
``REACH`` words in a row (the first of equal ones): where lines begin depends
on the words around, not on what stands further ahead (shift resistance), a
line has ``REACH`` words at most, and any ``WORDS`` words in a row hold the same
two whole lines at least in every text that has them. Line feeds and sentence
ends would not do as lines: a passage may hold one sentence, or a part of one.

A rolling hash over the hashes of two lines, taken at each line, is counted
over all documents. The chunks that repeat are the longest stretches of lines
whose every two neighbours occur in an earlier document (one of a smaller id)
or earlier in the same text; stretches under ``LEAST`` words are left alone.
Each chunk is compared, byte by byte, with the document that has its lines
first, and grows by the words that stand on both sides there as well; what was
confirmed is removed, the first occurrence stays. So of every passage of
``WORDS`` words or more that occurs before, wherever it begins and ends, its
words go, and what repeats in shorter chunks of two lines or more goes too.

Edge cases: null and empty texts stay as they are; a text that repeats
altogether becomes empty; repeated rows (same id and text) stay or go alike;
rows of one id with different texts count as one document, so what they share
with each other stays, as is so for rows without an id, which come last;
passages that repeat inside a text go but for the first; an empty table gives
an empty table; text in one word of any length is no passage. Columns of any
name are carried along, but for one named ``count_col``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.workspace import materialize, one_of_each, small

#: Words of the shortest passage that is found wherever it begins.
WORDS = 50
#: Words of a window whose least hash begins a line.
REACH = 16
#: Words in whole lines that such a passage holds at least.
LEAST = WORDS - 2 * REACH + 1
#: Words by which a chunk may grow on either side; more would be further lines.
EDGE = 2 * REACH

#: More than a text has words.
_PLACES = (1 << 31) - 1
#: Bits of a hash that order words.
_HASH = 0x7FFFFFFFC0000000


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values.

    A lambda evaluates what it names for every element; passing a column
    through a generator keeps the optimizer from putting its expression there.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def _spaced(text: Column) -> Column:
    """The text with spaces as its only white space, and none at the ends."""
    # each replacement looks at every byte, a pattern takes several times that; all but line feeds are rare
    rare = text.contains("\t") | text.contains("\x0b") | text.contains("\f") | text.contains("\r")
    plain = F.when(rare, F.regexp_replace(text, r"[\t\x0b\f\r]", " ")).otherwise(text)
    return F.trim(F.replace(plain, F.lit("\n"), F.lit(" ")))


def _words(text: Column) -> Column:
    """Words, without the white space around and between them."""
    # a split at one space is far cheaper than one at a pattern
    words = F.split(_spaced(text), " ")
    return F.when(_spaced(text).contains("  "), F.array_remove(words, "")).otherwise(words)


def _joined(text: Column) -> Column:
    """The words with one space before, between and behind them."""
    plain = _spaced(text)
    return F.concat(F.lit(" "), F.when(plain.contains("  "), F.array_join(_words(text), " ")).otherwise(plain), F.lit(" "))


def with_lines(df: DataFrame, text: Column) -> DataFrame:
    """A row for each line with another behind it: its first word ``at``, the other's, ``mid``, and the word behind both, ``to``; ``pair``: the rolling hash of both.

    Only hashing goes through a lambda; a row for each word lets generated code find the least ones.
    """
    names = df.columns
    # a slice is an array of plain numbers
    df = held(df, _h=F.slice(F.transform(_words(text), lambda w: F.xxhash64(w).bitwiseAND(F.lit(_HASH))), 1, _PLACES))
    n, start = F.size("_h"), F.col("_start")
    hashed = lambda at: F.get("_h", at)
    some = lambda at, k: F.slice("_h", at + 1, k)

    def least_of(at: Column, k: int) -> Column:
        """Where the least of ``k`` words is, the first of equal ones."""
        return at + F.array_position(some(at, k), F.array_min(some(at, k))).cast("int") - 1

    # the words that a window and the next one have in common; lines begin at the least of both windows, if these differ
    common = F.array_min(some(start + 1, F.lit(REACH - 1)))
    goes, comes = common >= hashed(start), common > hashed(start + REACH)
    df = df.select(*names, "_h", F.posexplode("_h").alias("_start", "_own")).drop("_own").where((start + REACH < n) & (goes | comes))
    df = held(df, _common=least_of(start + 1, REACH - 1))
    least = hashed(F.col("_common"))
    df = held(df, at=F.when(least >= hashed(start), start).otherwise(F.col("_common")), mid=F.when(least > hashed(start + REACH), start + REACH).otherwise(F.col("_common")))
    # then a lesser one that comes before the second leaves the window, or else the least behind it
    mid = F.col("mid")
    lesser = [F.when(hashed(mid + i) < hashed(mid), mid + i) for i in range(1, REACH)]
    df = held(df, to=F.coalesce(*lesser, F.when(mid + REACH < n, least_of(mid + 1, REACH)))).where("to is not null")
    return df.select(*names, "at", "mid", "to", F.xxhash64(F.xxhash64(some(F.col("at"), mid - F.col("at"))), F.xxhash64(some(mid, F.col("to") - mid))).alias("pair"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id and text, however often it repeats."""
    return one_of_each(docs.where(F.length(text_col) >= 2 * LEAST - 1).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text")), "_id", "_th")


def _same_text(ids: str, hashes: str) -> Column:
    return F.col("_id").eqNullSafe(F.col(ids)) & (F.col("_th") == F.col(hashes))


def candidates(texts: DataFrame) -> DataFrame:
    """(_sid, _sth, _runs): of a text, the chunks to compare, structs (cuts, source).

    cuts: the first words of its lines, and the end; source: the id of the
    document that has its lines first.
    """
    lines = materialize(with_lines(texts, F.col("_text")).drop("_text"), "line-pairs")
    counted = lines.groupBy("pair").agg(F.count("*").alias("n"), F.min("_id").alias("source"))
    often = materialize(counted.where("n > 1").select("pair", "source"), "line-often")
    met = materialize(lines.join(small(often, F.lit(24)), "pair"), "line-met")
    later = met.where("_id > source or (_id is null and source is not null)")
    # in the document that has a pair first, what its text has of it again
    own = met.where("_id <=> source")
    once = own.groupBy("_id", "_th", "pair").agg(F.count("*").alias("n"), F.min("at").alias("_first")).where("n > 1")
    once = materialize(once.select(F.col("_id").alias("_sid"), F.col("_th").alias("_sth"), F.col("pair").alias("_again"), "_first"), "line-again")
    again = own.join(small(once, F.lit(40)), _same_text("_sid", "_sth") & (F.col("pair") == F.col("_again")) & (F.col("at") > F.col("_first"))).select(*met.columns)
    found = later.unionByName(again).groupBy(F.col("_id").alias("_sid"), F.col("_th").alias("_sth")).agg(F.sort_array(F.collect_list(F.struct("at", "mid", "to", "source"))).alias("_found"))
    runs = held(found, _starts=_run_starts())
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_found"))
    last = lambda j: F.get("_found", end(j) - 1)
    cuts = lambda s, j: F.concat(F.slice("_found", s + 1, end(j) - s)["at"], F.array(last(j)["mid"], last(j)["to"]))
    each = F.transform("_starts", lambda s, j: F.struct(cuts(s, j).alias("cuts"), F.get("_found", s)["source"].alias("source")))
    runs = _bounded(runs.select("_sid", "_sth", F.explode(each).alias("run")), "run.cuts")
    return _regions(runs, ["_sid", "_sth"]).groupBy("_sid", "_sth").agg(F.collect_list("run").alias("_runs"))


def _bounded(runs: DataFrame, cuts: str) -> DataFrame:
    """Adds the first word of a run of lines, ``from``, and where it ends, ``to``."""
    return runs.withColumns({"from": F.get(cuts, F.lit(0)), "to": F.element_at(cuts, -1)})


def _run_starts() -> Column:
    """Places in ``_found`` where a stretch of pairs with one source begins."""
    fresh = lambda x, i: (i == 0) | (x["at"] != F.get("_found", i - 1)["mid"]) | ~x["source"].eqNullSafe(F.get("_found", i - 1)["source"])
    return F.array_compact(F.transform("_found", lambda x, i: F.when(fresh(x, i), i)))


def _regions(spans: DataFrame, text: list[str]) -> DataFrame:
    """Spans (from, to) that together, where they meet or overlap, cover LEAST words; adds ``region``."""
    order = Window.partitionBy(*text).orderBy("from", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("from") > before).cast("int"), F.lit(0)))
    marked = marked.withColumn("region", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    own = Window.partitionBy(*text, "region")
    return marked.withColumn("_covered", F.max("to").over(own) - F.min("from").over(own)).where(F.col("_covered") >= LEAST).drop("_covered")


def _alike(mine: str, theirs: str) -> Column:
    """Which words of two arrays are equal, place by place."""
    return F.zip_with(mine, theirs, lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))


def _leading(equal: str) -> Column:
    """How many leading values are true."""
    at = F.array_position(equal, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(equal))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_gid, _gth, _runs) with the runs of words to remove: structs (from, to), the end exclusive, in order."""
    texts = _texts(docs, id_col, text_col)
    runs = materialize(candidates(texts), "line-runs")
    near = held(texts.join(small(runs, 32 + 48 * F.size("_runs")), _same_text("_sid", "_sth")).drop("_sid", "_sth"), _w=_words(F.col("_text"))).drop("_text")
    near = _bounded(near.select("_id", "_th", "_w", F.inline("_runs")), "cuts")

    def said(a, b):
        return F.concat(F.lit(" "), F.array_join(F.slice("_w", a + 1, b - a), " "), F.lit(" "))

    chunks = near.select(
        "_id", "_th", "source", "cuts", "from", "to",
        said(F.col("from"), F.col("to")).alias("said"),
        F.when((F.col("from") > 0) & (F.col("source") == F.col("_id")), F.length(said(F.lit(0), F.col("from")))).otherwise(1).alias("ahead"),
        F.reverse(F.slice("_w", F.greatest(F.col("from") - EDGE, F.lit(0)) + 1, F.least(F.col("from"), F.lit(EDGE)))).alias("left"),
        F.slice("_w", F.col("to") + 1, EDGE).alias("right"),
    )
    sources = runs.select(F.explode("_runs.source").alias("_s")).distinct()
    firsts = texts.join(small(sources, F.lit(16)), F.col("_id") == F.col("_s")).select("_s", F.col("_th").alias("_sth"), _joined(F.col("_text")).alias("_there"))
    # a source may stand for very many chunks: a skewed join that Spark can split
    met = chunks.join(firsts, F.col("source") == F.col("_s"))
    # of its own text, only what stands before
    limit = F.when(F.col("_id") == F.col("_s"), F.when(F.col("_th") == F.col("_sth"), F.col("ahead")).otherwise(F.lit(0)))
    before = lambda place: (place > 0) & (F.col("_limit").isNull() | (place < F.col("_limit")))
    met = held(met.withColumn("_limit", limit), _place=F.instr(F.col("_there"), F.col("said")))
    ahead = F.split(F.substring_index(F.expr("substring(_there, 1, _place - 1)"), " ", -EDGE), " ")
    after = F.split(F.substring_index(F.expr("substring(_there, _place + length(said))"), " ", EDGE), " ")
    grown = held(met, _ahead=F.reverse(ahead), _after=after)
    grown = held(grown, _back=_alike("left", "_ahead"), _on=_alike("right", "_after")).drop("_ahead", "_after", "left", "right")
    whole = F.array(F.struct((F.col("from") - _leading("_back")).alias("from"), (F.col("to") + _leading("_on")).alias("to")))
    # a chunk that its source has in several places: two lines at a time
    grown = held(grown, _w=F.when(~before(F.col("_place")), F.split(F.expr("substring(said, 2)"), " ")))

    def confirmed(a, i):
        words = F.concat(F.lit(" "), F.array_join(F.slice("_w", a - F.col("from") + 1, F.get("cuts", i + 2) - a), " "), F.lit(" "))
        # a search for bytes where no place is asked for
        return F.when(F.col("_limit").isNull(), F.col("_there").contains(words)).otherwise(before(F.instr(F.col("_there"), words)))

    parts = F.array_compact(F.transform(F.slice("cuts", 1, F.size("cuts") - 2), lambda a, i: F.when(confirmed(a, i), F.struct(a.alias("from"), F.get("cuts", i + 2).alias("to")))))
    spans = grown.select("_id", "_th", F.inline(F.when(before(F.col("_place")), whole).otherwise(parts)))
    merged = _regions(spans, ["_id", "_th"]).groupBy("_id", "_th", "region").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return merged.groupBy(F.col("_id").alias("_gid"), F.col("_th").alias("_gth")).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """The documents with repeated passages taken out of the text; ``count_col`` counts the runs of words that went."""
    gone = materialize(repeated_runs(docs, id_col, text_col), "line-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_th"))
    joined = rows.join(small(gone, 32 + 16 * F.size("_runs")), _same_text("_gid", "_gth"), "left")
    lead = F.regexp_extract("_text", r"^\s*", 0)
    cut = held(joined, _pieces=F.split(F.when(F.col("_runs").isNotNull(), F.regexp_replace("_text", r"^\s+", "")), r"(?<=\s)(?=\S)"))
    ends = F.concat(F.transform("_runs", lambda r: r["from"]), F.array(F.size("_pieces")))
    begins = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["to"]))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice("_pieces", a + 1, F.greatest(b - a, F.lit(0)))))
    text = F.when(F.col("_runs").isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col("_text"))
    removed = F.when(F.col("_runs").isNotNull(), F.size("_runs")).otherwise(0).cast("long")
    return cut.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c != count_col], removed.alias(count_col))
