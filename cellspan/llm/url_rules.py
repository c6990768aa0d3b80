"""URL filters by host-suffix and path-prefix rules.

Each distinct (host, path) is expanded into the expressions `suffix of the host at a label` x `prefix of the path`, of
the lengths that rules have. Expressions meet rules in an equi-join on 32-bit hash prefixes; the full SHA-256 digest
then confirms a match, and the longest rule decides. All of it is DataFrame code, and Spark broadcasts the rules only
where their size allows it.

Cases: a null url, or one without "://", has empty host and path, fits no rule and gets the default verdict. Repeated
rows stay repeated. Of rules with the same host and path, a block wins. An empty table gives an empty result. Result
columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import lower_ascii

#: The rules of the contract (verdict, host, path).
CONTRACT_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("`__cs_url`")))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _short(expression: Column) -> Column:
    return F.xxhash64(expression).bitwiseAND(F.lit(0xFFFFFFFF))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict."""
    out = {"host", "path", "rule", "verdict"}
    with_url = pages.withColumn("__cs_url", F.col(url_col))
    host, path = host_and_path(F.col("__cs_url"))
    base = with_url.withColumns({"__cs_host": host, "__cs_path": path})
    book = (
        rules.where("host is not null and path is not null and host <> ''")
        .groupBy(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("r_text", F.concat("r_host", "r_path"))
        .withColumns({"r_short": _short(F.col("r_text")), "r_digest": F.sha2("r_text", 256)})
    )
    lengths = sorted(r[0] for r in book.select(F.length("r_path")).distinct().collect())
    lengths_of = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("__cs_path"))
    urls = base.select("__cs_host", "__cs_path").where("__cs_host <> ''").distinct()
    labels = F.split("__cs_host", r"\.")
    expanded = (
        urls.withColumn("__cs_labels", labels)
        .select("*", F.explode(F.sequence(F.lit(1), F.size("__cs_labels"))).alias("__cs_from"))
        .withColumn("__cs_suffix", F.expr("array_join(slice(__cs_labels, __cs_from, size(__cs_labels)), '.')"))
        .where("__cs_suffix <> ''")
        .select("__cs_host", "__cs_path", "__cs_suffix", F.explode(lengths_of).alias("__cs_length"))
        .withColumn("__cs_prefix", F.expr("substring(__cs_path, 1, __cs_length)"))
        .withColumn("__cs_text", F.concat("__cs_suffix", "__cs_prefix"))
    )
    hits = expanded.join(book, _short(F.col("__cs_text")) == F.col("r_short")).where(
        (F.sha2("__cs_text", 256) == F.col("r_digest"))
        & (F.col("__cs_suffix") == F.col("r_host"))
        & (F.col("__cs_prefix") == F.col("r_path"))
    )
    best = hits.groupBy("__cs_host", "__cs_path").agg(
        F.max(F.struct(F.length("r_text").alias("n"), F.length("r_host").alias("m"), F.col("r_verdict"), F.col("r_text"))).alias("__cs_best")
    )
    keep = [c for c in pages.columns if c.lower() not in out]
    return base.join(best, ["__cs_host", "__cs_path"], "left").select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__cs_host").alias("host"),
        F.col("__cs_path").alias("path"),
        F.col("__cs_best.r_text").alias("rule"),
        F.coalesce(F.col("__cs_best.r_verdict"), F.lit(default)).alias("verdict"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_table(spark, CONTRACT_RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM r
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
"""
