"""Allow and block rules for URLs.

Each URL is expanded into its host suffixes crossed with its path prefixes. Expressions meet the rules in an equi-join on
a short prefix of their SHA-256; the full digest then confirms the hit, and the longest rule decides. Every step is a
built-in function or a join, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, table

#: Hex digits of a digest that the join compares first: 32 bits.
SHORT = 8

RULE_SCHEMA = "rule_host string, rule_path string, verdict string"


def split_url(url):
    """(host, path) columns: host after the first ``://`` up to ``/ ? #``, A-Z lowered; path up to ``? #``. Else empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row's URL by the longest fitting rule.

    ``rules`` has RULE_SCHEMA. A rule fits its host and all subdomains if the URL's path starts with the rule's path.
    Returns id, host, path, rule (host and path of the rule, or null) and verdict (``default`` where no rule fits).

    Null, empty or scheme-less URLs: host and path are empty, no rule fits. Repeated rows and null ids: one result for each
    input row. Rules with null or empty host never fit; a null path counts as empty; of rules of equal length ``block``
    wins, then the smaller text. Other columns of ``pages`` are ignored, so their names can't clash. Empty tables give an
    empty result, or the default for all.

    The prefix lengths and numbers of host labels tried are those that occur among the rules, sets no larger than the longest
    rule, so that a host of very many labels costs no more than its length. The rules
    are never broadcast by hint: Spark does so by their size, and beyond it joins by shuffle, splitting hot expressions.
    """
    rules = rules.select(ascii_lower("rule_host").alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''")
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    depths = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    suffixes = F.array_compact(F.array(*[F.when(dots >= k - 1, F.substring_index("host", ".", -k)) for k in depths or [1]]))
    prefixes = F.transform(F.filter(F.lit(lengths or [0]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    expressions = F.flatten(F.transform("suffixes", lambda h: F.transform("prefixes", lambda p: F.concat(h, F.lit("\n"), p))))
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    tried = (
        urls.withColumn("suffixes", suffixes)
        .withColumn("prefixes", prefixes)
        .select("row", "id", "host", "path", F.explode_outer(expressions).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .select("row", "id", "host", "path", "digest", F.substring("digest", 1, SHORT).alias("short"))
    )
    known = rules.withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)).select(
        F.substring("rule_digest", 1, SHORT).alias("rule_short"),
        "rule_digest",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
    )
    best = F.struct((-F.length("rule")).alias("n"), (F.col("rule_verdict") != "block").alias("allow"), "rule", "rule_verdict")
    judged = (
        tried.join(known, (F.col("short") == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest")), "left")
        .withColumn("best", F.when(F.col("rule").isNotNull(), best))
        .groupBy("row", "id", "host", "path")
        .agg(F.min("best").alias("best"))
    )
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


#: The query's rules: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule_host, rule_path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP4_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {_VALUES}),
u AS (
  SELECT row_number() OVER () AS rn, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
hits AS (
  SELECT u.rn, rh || rp AS rule, v, row_number() OVER (PARTITION BY u.rn ORDER BY length(rh || rp) DESC) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, hits.rule AS rule, coalesce(hits.v, 'allow') AS verdict
FROM u LEFT JOIN hits ON hits.rn = u.rn AND hits.k = 1
"""
