"""URL block and allow lists by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query (host, path prefix, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Verdict where no rule fits: the lists name exceptions.
DEFAULT_VERDICT = "allow"
#: Hexadecimal digits of the short hash that expressions and rules are joined on.
SHORT = 8


def _host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """Full digest of an expression; host and path can't run into each other."""
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``id_col``, host, path, rule and verdict for every row of ``pages``.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains where the url's
    path starts with the rule's; the longest fitting rule (host and path together, then the
    longer host) decides. Every URL is expanded into its host suffixes times its path
    prefixes of the lengths that rules have; these meet the rules by equality of a short
    hash, then the full digest is confirmed. Null URLs and those without ``://`` have empty
    host and path. Repeated rows are judged once and all come back; of rules that repeat a
    host and path a block wins. The rules are joined by whichever strategy their size allows.
    """
    listed = (
        rules.select(F.lower("host").alias("rhost"), F.col("path").alias("rpath"), F.col("verdict").alias("v"))
        .where("rhost is not null and rpath is not null").groupBy("rhost", "rpath").agg(F.max("v").alias("v"))
        .withColumn("full", digest(F.col("rhost"), F.col("rpath")))
    )
    lengths = sorted(r[0] for r in listed.select(F.length("rpath")).distinct().collect())  # one row per distinct length
    urls = pages.groupBy(id_col, url_col).agg(F.count("*").alias("copies"))
    parsed = urls.select(id_col, url_col, "copies", _host(F.col(url_col)).alias("host"), _path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        parsed.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
        .withColumn("full_u", digest(F.col("suffix"), F.col("prefix"))).withColumn("short_u", F.substring("full_u", 1, SHORT))
    )
    short = listed.withColumn("short", F.substring("full", 1, SHORT))
    met = expanded.join(short, (F.col("short_u") == F.col("short")), "left")
    true = (F.col("full_u") == F.col("full")) & (F.col("suffix") == F.col("rhost")) & (F.col("prefix") == F.col("rpath"))
    rank = F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rhost").alias("nh"), F.concat("rhost", "rpath").alias("rule"), F.col("v").alias("v"))
    best = met.groupBy(id_col, url_col, "copies", "host", "path").agg(F.max(F.when(true, rank)).alias("r"))
    return (
        best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.v", F.lit(default)).alias("verdict"))
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql("VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)).toDF("host", "path", "verdict")
    return judge_urls(pages, rules)


ORACLE = """
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT page_id, row_number() OVER () AS rid,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
