"""Fuzzy ranking: the best alignment of a query's characters with a text, by dynamic programming in SQL functions.

A character that matches counts MATCH, at a word's start START more, directly
behind the last match NEXT more; a gap between two matches costs GAP, and 1 for
each character beyond the first. Case doesn't count, but a capital behind a
small letter starts a word. Texts that don't hold the query's characters in
order leave by one linear pattern before anything is aligned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, START, NEXT, GAP = 16, 8, 6, 3
_SEPARATORS = "/\\-_. :"


def letters(query: str) -> str:
    """What of a query is aligned: separators only say that they don't matter."""
    return "".join(c for c in query.lower() if c not in _SEPARATORS)


def holds_in_order(query: str) -> str:
    """A linear pattern for texts in lower case with the query's letters in order."""
    return "(?s)^" + "".join(f"[^{re.escape(c)}]*+{re.escape(c)}" for c in letters(query))


def aligned(rows: DataFrame, column: str, query: str, into: str = "score") -> DataFrame:
    """Rows whose text holds the query's letters in order, with the best alignment's score."""
    said = letters(query)
    if not said:
        return rows.withColumn(into, F.lit(0).cast("int"))
    hold = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))  # noqa: E731  a value that lambdas read, not an expression they repeat
    low = F.lower(F.col(column))
    met = rows.where(low.rlike(holds_in_order(query)))
    places = F.sequence(F.lit(1), F.length(column))
    met = hold(met, "_own", F.transform(places, lambda i: F.substr(F.col(column), i, F.lit(1))))
    met = hold(met, "_low", F.transform("_own", lambda c: F.lower(c)))
    capital = lambda c: F.lower(c) != c
    starts = lambda c, i: (i == 0) | F.get("_own", i - 1).isin(*_SEPARATORS) | (capital(c) & ~capital(F.get("_own", i - 1)) & (F.upper(F.get("_own", i - 1)) != F.get("_own", i - 1)))
    met = hold(met, "_gain", F.transform("_own", lambda c, i: F.when(starts(c, i), MATCH + START).otherwise(MATCH)))
    met = hold(met, "_best", F.transform("_low", lambda c, i: F.when(c == said[0], F.get("_gain", i))))
    for letter in said[1:]:
        far = lambda i: F.array_max(F.transform(F.slice("_best", F.lit(1), F.greatest(i - 1, F.lit(0))), lambda v, k: v + k)) - GAP - (i - 2)
        met = hold(met, "_new", F.transform("_low", lambda c, i: F.when(c == letter, F.get("_gain", i) + F.greatest(F.get("_best", i - 1) + NEXT, far(i))))).drop("_best").withColumnRenamed("_new", "_best")  # noqa: B023
    return met.withColumn(into, F.array_max("_best").cast("int")).drop("_own", "_low", "_gain", "_best")


def ranked(rows: DataFrame, column: str, query: str, limit: int = 10) -> DataFrame:
    """The best rows, equal scores by text; ``score`` is added."""
    return aligned(rows, column, query).orderBy(F.desc("score"), column).limit(limit)
