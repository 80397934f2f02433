"""URL filters: host-suffix and path-prefix expressions joined on hash prefixes.

Every URL is expanded into all (host suffix, path prefix) expressions that a
rule could name; the expressions are equi-joined with the rules on a short
prefix of their SHA-256, full digests confirm the match, and the rule with the
longest host, then the longest path, wins (block before allow, if even that
ties). URLs without a fitting rule get the default verdict.

The join's one key is the short prefix, which carries all rules whose digests
begin so; the full digest, then host and path, decide among them. Suffixes and
prefixes are expanded only at the numbers of labels and the lengths that occur
among the rules (bounded sets collected once), whatever the URL's length.
Rules are a stated list; they are broadcast only within a size in bytes.

Edge cases: null URLs and URLs without ``://`` have empty host and path; only
a rule with an empty host could fit those, and such rules are refused. Hosts
are compared without a port split or trailing dots: they are taken as they
stand. Repeated rows are judged row by row, an empty table gives no rows; only
the named columns are read, so further ones, of whatever name, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.workspace import small

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Hex digits of the digest that the equi-join uses.
PREFIX_HEX = 8
DEFAULT = "allow"

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _ASCII_UPPER, _ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    if any(not host for _, host, _ in rules):
        raise ValueError("a rule needs a host")
    return spark.createDataFrame(rules, "r_verdict string, r_host string, r_path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """One row per page row: host, path, rule, verdict.

    rules: r_verdict, r_host, r_path. Repeated rules count once; of rules that
    differ in the verdict alone, block wins.
    """
    shape = rules.agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"), F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels")).first()
    named = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    # rules whose digests begin alike: the join finds them, the digest tells them apart
    listed = named.groupBy(F.substring("r_digest", 1, prefix_hex).alias("short")).agg(F.collect_list(F.struct("r_digest", "r_host", "r_path", "r_verdict")).alias("likely"))
    listed = small(listed, F.aggregate("likely", F.lit(0), lambda n, r: n + 100 + F.length(r["r_host"]) + F.length(r["r_path"])))
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    known = urls.where("host <> ''")
    suffixes = [F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in shape["labels"] or [1]]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"] or [0]]
    # one row per URL shape, not per page: a hot host or URL is matched once
    shapes = known.select("host", "path").distinct()
    expressions = shapes.withColumn("e_host", F.explode(F.array_compact(F.array(*suffixes)))).withColumn("e_path", F.explode(F.array_compact(F.array(*prefixes)))).withColumn("digest", _digest(F.col("e_host"), F.col("e_path")))
    met = expressions.withColumn("short", F.substring("digest", 1, prefix_hex)).join(listed, "short")
    confirmed = F.filter("likely", lambda r: (r["r_digest"] == F.col("digest")) & (r["r_host"] == F.col("e_host")) & (r["r_path"] == F.col("e_path")))
    fits = met.select("host", "path", F.inline(confirmed))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"), "r_host", "r_path", "r_verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.r_verdict").alias("_v"), F.concat("best.r_host", "best.r_path").alias("rule"))
    # a shape of very many pages: a skewed join that Spark can split
    judged = known.join(best, ["host", "path"], "left")
    rest = urls.where("host = ''").select("*", F.lit(None).cast("string").alias("_v"), F.lit(None).cast("string").alias("rule"))
    return judged.unionByName(rest).select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))
