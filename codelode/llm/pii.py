"""Personal data by weak supervision, in Spark SQL functions only.

Base spans are matches of four fixed patterns that pass a check (parts of an
address, Luhn digit, number of digits). Besides them the method looks at
candidates: base matches that failed their check, numbers written like local
phone numbers, addresses with "at" and "dot" spelled out, and quoted secrets
after a telling word. Three labelers vote on each candidate and base span
(1, -1, or 0 to abstain):

  regex       the strict form of the kind;
  gazetteer   listed words inside the span (domains, country and area codes);
  context     telling words shortly before the span, after the last match.

Expectation-maximisation over the counts of vote patterns, one row a pattern
(a table of bounded size), estimates how reliable each labeler is for each
kind. Its posteriors train the final span classifier, a naive Bayes model over
kind, votes and features that no labeler looks at (length class, separators,
what stands right before); candidates that it takes are added to the base.

Positions are code points, end exclusive. A pattern's matches are extracted
with their gaps (split), whose lengths give the positions. Possessive forms
and look-behinds make the patterns linear on long runs; they match the same
text as the plain forms.

Edge cases: null text is empty; documents without spans give empty lists;
equal positions order by kind as listed; repeated rows are judged row by row;
texts are read whole; an empty table trains nothing and adds nothing; only the
named columns are read, so further ones, of whatever name, do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.linededup import held
from codelode.llm.workspace import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
# fixed values: the base patterns, in possessive form
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: What can't be missing from a text with a base match that passes.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}

LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[a-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[a-z]{2,24}",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?\"[^\"\s]{8,}+\"",
}
LOOSE_GUARDS = {"email": r"(?i)[(\[]at[)\]]", "phone": r"[0-9]{3}[-.][0-9]{4}", "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?\""}
GAZETTEER = {"email": r"(?i)(?:com|org|net|edu|gov|info|de|fr|es|uk)$", "ip": r"^(?:10\.|127\.|192\.168\.)", "card": r"^(?:3[47]|4|5[1-5]|6)", "phone": r"555|^\+?1[^0-9]", "secret": r"(?i)^(?:token|secret|password|passwd|api)"}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|kontakt|courriel|correo",
    "ip": r"(?i)\bip\b|server|host|address|adresse",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)phone|tel|call|fax|mobile|anruf|appel|llam",
    "secret": r"(?i)auth|login|config|bearer|export",
}
CONTEXT_CHARS = 40
ACCEPT = 0.5


def matches(text: Column, pattern: str, guard: str, kind: str) -> Column:
    """Structs (start, end, kind, said, before) of a pattern's matches, leftmost and non-overlapping; before: up to CONTEXT_CHARS since the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,said:string,before:string>>")
    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("said"))), lambda p: p["said"].isNotNull())
    # ends of the matches: sums of all lengths so far
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def add(state, pair):
        end = state["at"] + F.length(pair["gap"]) + F.length(pair["said"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(end)).alias("out"))

    ends = F.aggregate(pairs, zero, add, lambda s: s["out"])
    spans = F.zip_with(
        pairs,
        ends,
        lambda p, e: F.struct((e - F.length(p["said"])).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), p["said"].alias("said"), F.substring(p["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before")),
    )
    return F.when(text.rlike(guard), spans).otherwise(none)


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i):
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def passes(span: Column) -> Column:
    """Whether a base match passes its kind's check."""
    digits = _digits(span["said"])
    n = F.length(digits)
    return (
        F.when(span["kind"] == "email", F.lit(True))
        .when(span["kind"] == "ip", span["said"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(span["kind"] == "card", n.between(14, 19) & luhn(F.when(n.between(14, 19), digits).otherwise("0")))
        .otherwise(n.between(10, 15))
    )


def _vote(span: Column, lists: dict[str, str], text: Column, otherwise: int) -> Column:
    out = F.lit(otherwise)
    for kind, pattern in lists.items():
        out = F.when((span["kind"] == kind) & text.rlike(pattern), 1).otherwise(out)
    return out


_SPAN = ("start", "end", "kind", "said", "before")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and spans: structs (start, end, kind, base, regex, gazetteer, context, size, form, lead)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[matches(F.col("_text"), p, GUARDS[k], k) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))])
    loose = F.concat(*[matches(F.col("_text"), p, LOOSE_GUARDS[k], k) for k, p in LOOSE.items()])
    rows = held(docs.select(F.col(id_col).alias("_id"), text.alias("_text")), _base=base, _loose=loose)

    def checked(array, is_base):
        return F.transform(array, lambda s: F.struct(*[s[c].alias(c) for c in _SPAN], (passes(s) if is_base else F.lit(False)).alias("base"), F.lit(is_base).alias("strict")))

    # numbers that are no cards by length alone aren't worth a vote
    worth = F.filter(checked(F.col("_base"), True), lambda s: s["base"] | ((s["kind"] == "card") & F.length(_digits(s["said"])).between(13, 19)) | (s["kind"] == "ip"))
    rows = held(rows, _some=worth)
    apart = F.filter(checked(F.col("_loose"), False), lambda s: ~F.exists("_some", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_all", F.concat("_some", apart))

    def voted(s):
        return F.struct(
            *[s[c].alias(c) for c in ("start", "end", "kind", "base")],
            F.when(s["base"], 1).when(s["strict"], -1).otherwise(0).alias("regex"),
            _vote(s, GAZETTEER, s["said"], -1).alias("gazetteer"),
            _vote(s, CONTEXT, s["before"], 0).alias("context"),
            F.when(F.length(s["said"]) < 12, "short").when(F.length(s["said"]) < 24, "middle").otherwise("long").alias("size"),
            F.when(s["said"].rlike(r"^[0-9]+$"), "plain").when(s["said"].contains("-"), "dashed").when(s["said"].contains(" "), "spaced").when(s["said"].contains("."), "dotted").otherwise("other").alias("form"),
            F.when(s["before"] == "", "first").when(s["before"].rlike(r"[:=]\s*$"), "told").when(s["before"].rlike("[(\\[\"]$"), "quoted").when(s["before"].rlike(r"\s$"), "free").otherwise("joined").alias("lead"),
        )

    return rows.select("_id", F.transform("_all", voted).alias("spans"))


VOTES = ("regex", "gazetteer", "context")


def fit(patterns: list[tuple], steps: int = 50) -> dict[tuple, float]:
    """EM over (kind, regex, gazetteer, context, size, form, lead, count): the final classifier's probability of each pattern.

    The labelers' votes alone rule the expectation; the classifier that learns
    from its soft labels sees the span's own features besides, which no
    labeler looks at.
    """
    out: dict[tuple, float] = {}
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        if not own:
            continue
        share, right = 0.5, [0.9, 0.7, 0.8]
        post: list[float] = []
        for _ in range(steps):
            post = []
            for _, *rest in own:
                votes = rest[:3]
                yes, no = math.log(share), math.log(1 - share)
                for vote, r in zip(votes, right):
                    if vote:
                        yes += math.log(r if vote > 0 else 1 - r)
                        no += math.log(1 - r if vote > 0 else r)
                post.append(1 / (1 + math.exp(max(-50.0, min(50.0, no - yes)))))
            n = sum(p[-1] for p in own)
            share = min(0.99, max(0.01, sum(q * p[-1] for q, p in zip(post, own)) / n))
            for j in range(3):
                cast = [(p[1 + j], q, p[-1]) for q, p in zip(post, own) if p[1 + j]]
                hit = sum(c * (q if v > 0 else 1 - q) for v, q, c in cast)
                right[j] = min(0.99, max(0.55, (hit + 2) / (sum(c for *_, c in cast) + 3)))
        # naive Bayes over votes and length class, from the soft labels
        total = [1.0, 1.0]
        seen: list[dict] = [{} for _ in range(6)]
        for q, p in zip(post, own):
            for y, w in ((1, q), (0, 1 - q)):
                total[y] += w * p[-1]
                for j, value in enumerate(p[1:7]):
                    seen[j].setdefault(value, [1.0, 1.0])[y] += w * p[-1]
        for p in own:
            odds = math.log(total[1] / total[0])
            for j, value in enumerate(p[1:7]):
                odds += math.log(seen[j][value][1] / (total[1] + len(seen[j]))) - math.log(seen[j][value][0] / (total[0] + len(seen[j])))
            out[p[:7]] = 1 / (1 + math.exp(max(-50.0, min(50.0, -odds))))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per document row: its id, base (spans) and spans (base and added), structs (start, end, kind) in order."""
    rows = materialize(candidates(docs, id_col, text_col), "pii-candidates")
    shape = ("kind", *VOTES, "size", "form", "lead")
    counted = rows.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in shape]).count().collect()
    model = fit([tuple(r) for r in counted])
    taken = sorted("|".join(map(str, key)) for key, p in model.items() if p >= accept)
    named = F.array(*[F.lit(k) for k in taken]) if taken else F.array().cast("array<string>")
    order = F.array(*[F.lit(k) for k in KINDS])

    def listed(keep):
        spans = F.transform(F.filter("spans", keep), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_sort(spans)

    added = lambda s: s["base"] | F.array_contains(named, F.concat_ws("|", *[s[c].cast("string") for c in shape]))
    return rows.select(F.col("_id").alias(id_col), listed(lambda s: s["base"]).alias("base"), listed(added).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`find`'s rows."""

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(number, KINDS[:4]), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
