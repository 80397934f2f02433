"""The driver's queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import collocations, dac, decontaminate, interleave, langid, lexsearch, linededup, media, neardup, packing, pii, toxicity, urlrules

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_before")))
    return docs.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_kept"), (F.col("n_before") - F.length("text")).cast("long").alias("n_cut"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~langid.held_out()), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rules_frame(spark, urlrules.RULES))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_tokens(dac.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.rebuild(*media.store(table(spark, sf_dir, "documents")))


def op11_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave.interleave(interleave.sizes(table(spark, sf_dir, "documents")), "source", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(lexsearch.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_near_duplicates, op3_personal_data, op4_packing, op5_toxicity, op6_decontaminate, op7_url_rules, op8_token_files, op9_language, op10_media, op11_interleaved_shards, op12_collocations, op13_lexical_search)
    return {f.__name__: f for f in own}


_OP7 = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""


def _quarter(x: int) -> int:
    for _ in range(4):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


#: CRC-32 by half bytes, low half first: the table's entries are what four shifts make of 0 to 15.
_OP11 = rf"""
WITH chars AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS bytes, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda x: instr('0123456789ABCDEF', x) - 1) AS d FROM documents),
halves AS (SELECT doc_id, source, bytes, list_prepend(4294967295::BIGINT, list_transform(range(2 * bytes), lambda i: d[xor(i, 1) + 1]::BIGINT)) AS h FROM chars),
sized AS (
  SELECT doc_id, source, bytes + 1 AS size, xor(list_reduce(h, lambda c, x: xor(c >> 4, {[_quarter(x) for x in range(16)]}[(xor(c, x) & 15) + 1])), 4294967295) AS text_crc32 FROM halves),
same AS (SELECT *, md5(concat_ws(':', '{interleave.SEED}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, text_crc32::VARCHAR)) AS s, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS stratum FROM sized),
copied AS (SELECT *, md5(s || ':' || (row_number() OVER (PARTITION BY stratum, s) - 1)) AS digest FROM same),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY digest) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS share FROM copied),
placed AS (SELECT *, row_number() OVER (ORDER BY share, stratum) AS place, count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, (place * {interleave.SHARDS} - 1) // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, place - 1 - (shard * n) // {interleave.SHARDS} AS slot, NULL::INTEGER AS grown_shard, source FROM cut
"""

_OP12 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spoken AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM spoken GROUP BY lang),
said AS (SELECT lang, k, unnest(list_transform(range(0, greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS phrase FROM spoken, range(1, {collocations.WORDS + 1}) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM said GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN total ON cuts.lang = total.lang JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:cut], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[cut + 1:cuts.k], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM least x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.a * 100 >= {collocations.SHARE} * x.a AND length(y.phrase) > length(x.phrase) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
best AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM best WHERE rank <= {collocations.TOP}
"""

_OP13 = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS len FROM tf GROUP BY doc_id),
stats AS (SELECT count(*) AS n, sum(len)::BIGINT AS l FROM lengths),
m AS (SELECT doc_id, 10 + (90 * len * n) // l AS m FROM lengths, stats),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term, n),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_rules": _OP7, "op11_interleaved_shards": _OP11, "op12_collocations": _OP12, "op13_lexical_search": _OP13}
