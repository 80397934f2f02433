"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four transducers read a clause's tokens one after another, each passing on
the weight that the one before it emits:

  lexicon     token -> class (insult, threat, target, negation, report, quote)
              and, for insults, a weight learned from labelled documents;
  target      an insult weighs in full where somebody is addressed or named
              within a few tokens, before or after it, or where another insult
              stands in the clause; alone it weighs half. A threat weighs
              only where a target follows or precedes it;
  negation    a match within a few tokens after a negation weighs less;
  reported    a match after a verb of saying or inside quotation marks weighs less.

Matched clauses add up to the document's log odds, starting from the share of
toxic documents in training; the score is their logistic.

The insult lexicon is learned from all labelled training rows: terms (words,
and word beginnings of 4 and 5 letters that several words share, which carry
families of invented or inflected words) whose share of toxic documents is
significant after a correction for the number of terms; a term's weight is its
log odds ratio. A term counts once a document and once a context (the words
beside it), whichever is less, so a word that a group of copies repeats in one
place is no evidence. No term that the test could admit is left out; the test
itself runs in Spark, and the terms that it admits come to the driver.

Edge cases: null and empty texts score the training share of toxic rows (0 if
there is none); null labels are left out; without any toxic training row the
lexicon is empty; repeated rows are scored row by row; repeated labels count
repeatedly; texts are read whole, a null label or id joins nothing; an empty
table gives no rows; only the named columns are read, so further ones, of
whatever name, do not matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.arrowtext import slices
from codelode.llm.workspace import materialize, small

# fixed values: the closed word classes of the grammar
TARGET = frozenset("you your yours u he she him her they them their this that these those du dich dir ihr euch sie er es der die das tu te toi vous il elle ils elles ce cette tú usted ustedes él ella ellos ellas este esta".split())
NEGATION = frozenset("not no never none nor neither without hardly nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun aucune nunca jamás sin ningún ninguna".split())
REPORT = frozenset("said says say saying told called quoted wrote claimed sagte sagt sagten nannte schrieb dit disait appelé écrit dijo dice decía llamó escribió".split())
THREAT = frozenset("kill hurt destroy beat punch stab shoot murder töten schlagen umbringen verletzen tuer frapper détruire blesser matar golpear destruir herir".split())
QUOTES = frozenset('"“”„«»')
ENDS = frozenset(".!?;:\n")

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”„«»]")
PREFIXES = (4, 5)
#: Chance that one of all tested terms is taken by accident.
ACCIDENT = 0.05
LEAST_WEIGHT = 2.0
#: A beginning needs so many times the count of its most frequent word.
FAMILY = 1.5
#: Counts of terms, with or without contexts, that a training task holds before it passes them on.
HELD = 300_000
#: What the transducers multiply by, and over how many tokens they reach.
ALONE, NEGATION_LOSS, REPORT_LOSS = 0.5, 0.6, 0.7
TARGET_REACH, NEGATION_REACH = 4, 3
THREAT_WEIGHT = 2.5
THRESHOLD = 0.7


def terms_of(text: str | None) -> set[str]:
    """Distinct words, and beginnings written with a closing star."""
    words = {t for t in _TOKEN.findall((text or "").lower()) if t[0].isalpha()}
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def contexts_of(text: str | None) -> dict[str, set[int]]:
    """Terms with the hashes of the words beside them."""
    words = [t for t in _TOKEN.findall((text or "").lower()) if t[0].isalpha()]
    out: dict[str, set[int]] = {}
    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
        beside = zlib.crc32(f"{before} {after}".encode())
        for term in (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)):
            out.setdefault(term, set()).add(beside)
    return out


class Lexicon:
    """Token to (class, weight)."""

    def __init__(self, weights: dict[str, float]):
        self.words = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.heads = {n: {t[:-1]: w for t, w in weights.items() if t.endswith("*") and len(t) == n + 1} for n in PREFIXES}

    def insult(self, token: str) -> float:
        best = self.words.get(token, 0.0)
        for n, heads in self.heads.items():
            if len(token) > n:
                best = max(best, heads.get(token[:n], 0.0))
        return best

    def step(self, state, token):
        weight = self.insult(token)
        if weight:
            return None, ("insult", weight)
        for kind, words in (("threat", THREAT), ("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("quote", QUOTES)):
            if token in words:
                return None, (kind, THREAT_WEIGHT if kind == "threat" else 0.0)
        return None, ("word", 0.0)


class Target:
    """State: tokens since a target; whether an insult was there; the one that is alone so far (tokens since, what it lacks); threats that wait.

    A match that lacks a target is told, with what it lacks, at the target or
    insult that comes for it.
    """

    start = (99, False, None, ())

    def step(self, state, symbol):
        kind, weight = symbol
        since, insulted, alone, threats = state
        since += 1
        alone = alone and (alone[0] + 1, alone[1])
        threats = tuple((n + 1, w) for n, w in threats if n < TARGET_REACH)
        if kind == "insult":
            if insulted or since <= TARGET_REACH:
                weight += alone[1] if alone else 0.0
                alone = None
            else:
                alone = (0, weight * (1 - ALONE))
                weight *= ALONE
            insulted = True
        elif kind == "threat" and since > TARGET_REACH:
            threats, weight = (*threats, (0, weight)), 0.0
        elif kind == "target":
            since = 0
            weight = sum(w for _, w in threats)
            threats = ()
            if alone and alone[0] <= TARGET_REACH:
                weight += alone[1]
                alone = None
        return (since, insulted, alone, threats), (kind, weight)


class Negation:
    """State: tokens since the last negation."""

    start = 99

    def step(self, state, symbol):
        kind, weight = symbol
        state = 0 if kind == "negation" else state + 1
        return state, (kind, weight * NEGATION_LOSS if weight and state <= NEGATION_REACH else weight)


class Reported:
    """State: after a verb of saying, inside quotation marks."""

    start = (False, False)

    def step(self, state, symbol):
        kind, weight = symbol
        said, quoted = state
        if kind == "report":
            said = True
        elif kind == "quote":
            quoted = not quoted
        return (said, quoted), (kind, weight * REPORT_LOSS if weight and (said or quoted) else weight)


class Grammar:
    """The transducers composed: one pass over a clause."""

    def __init__(self, weights: dict[str, float], prior: float):
        self.lexicon, self.prior = Lexicon(weights), prior
        self.after = (Target(), Negation(), Reported())

    def clause(self, tokens: list[str]) -> float:
        states = [t.start for t in self.after]
        total = 0.0
        for token in tokens:
            _, symbol = self.lexicon.step(None, token)
            for k, transducer in enumerate(self.after):
                states[k], symbol = transducer.step(states[k], symbol)
            total += symbol[1]
        return total

    def score(self, text: str | None) -> float:
        if self.prior <= 0:
            base = -20.0
        else:
            base = math.log(self.prior / (1 - self.prior)) if self.prior < 1 else 20.0
        tokens = _TOKEN.findall((text or "").lower())
        marked = {t for t in set(tokens) if t in THREAT or self.lexicon.insult(t)}
        if marked:
            begin = 0
            for k, token in enumerate([*tokens, "."]):
                if token in ENDS:
                    part = tokens[begin:k]
                    if not marked.isdisjoint(part):
                        base += self.clause(part)
                    begin = k + 1
        return 0.0 if self.prior <= 0 and not marked else 1 / (1 + math.exp(-max(-30.0, min(30.0, base))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """{"weights": term -> weight, "prior": share of toxic rows}, from every labelled row of ``docs``."""
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(small(marks, F.lit(24)), F.col("_id") == F.col("_l")).select("text", "y")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return {"weights": {}, "prior": 0.0}
    prior = n_toxic / (n_toxic + n_clean)

    def met(batches):
        # (term, context) with the number of documents in which it is the term's first
        counts: Counter = Counter()
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                for term, contexts in contexts_of(text).items():
                    counts.update(dict.fromkeys(((term, c) for c in contexts), 0))
                    counts[term, min(contexts)] += 1
            if len(counts) > HELD:
                yield _met(counts)
                counts = Counter()
        yield _met(counts)

    def clean_rows(batches):
        counts: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                counts.update(terms_of(text))
            if len(counts) > HELD:
                yield told()
                counts = Counter()
        yield told()

    places = rows.where("y = 1").select("text").mapInArrow(met, "term string, context long, n long").groupBy("term", "context").agg(F.sum("n").alias("n"))
    totals = materialize(places.groupBy("term").agg(F.least(F.sum("n"), F.count("*")).alias("n")).where("n > 1"), "toxic-terms")
    bar = math.log(max(1, totals.count()) / ACCIDENT)
    # the test admits no rarer term, even if no clean row has it
    least = math.ceil(bar / -math.log(prior)) if prior < 1 else 2
    tested = totals.where(F.col("n") >= least)
    # every task counts all its terms: what it passes on depends on its share of the text alone
    clean = rows.where("y = 0").select("text").mapInArrow(clean_rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("other"))
    # the most frequent word of each beginning
    begins = F.array_compact(F.array(*[F.when(F.length("term") > n, F.concat(F.left("term", F.lit(n)), F.lit("*"))) for n in PREFIXES]))
    top = tested.where(~F.col("term").endswith("*")).select("n", F.explode(begins).alias("term")).groupBy("term").agg(F.max("n").alias("most"))
    both = tested.join(clean, "term", "left").join(top, "term", "left").select("term", F.col("n").cast("double").alias("k"), F.coalesce("other", F.lit(0)).cast("double").alias("o"), "most")
    q, p = F.col("k") / (F.col("k") + F.col("o")), F.lit(prior)
    # Chernoff bound of -log P(at least k of k + o) under chance p
    surprise = (F.col("k") + F.col("o")) * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    weight = F.log((F.col("k") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_clean + 1))
    family = ~F.col("term").endswith("*") | F.col("most").isNull() | (F.col("k") >= FAMILY * F.col("most"))
    admitted = both.where(family & (weight >= LEAST_WEIGHT) & (q > p) & (surprise >= bar)).select("term", weight.alias("weight"))
    return {"weights": dict(map(tuple, admitted.collect())), "prior": prior}


def _met(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([c for _, c in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "context", "n"])


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: id, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        grammar = Grammar(shared.value["weights"], shared.value["prior"])
        for part in slices(batches, "_text"):
            score = [grammar.score(t) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(score, pa.float64())], names=["_id", "score"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, score double").select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
