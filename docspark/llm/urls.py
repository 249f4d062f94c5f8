"""URL filter: rules on hosts and paths, looked up by hashed expressions.

Each URL is expanded into the suffixes of its host, each followed by the
prefixes of its path; these expressions meet the rules by an equi-join on the
first bytes of a digest, and the full digest decides.  The longest rule wins.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.frames import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the SHA-256 digest in the join key: 32 bits.
PREFIX_HEX = 8
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def _folders(path: Column) -> Column:
    """The path up to its last slash; that part of a rule is what is hashed."""
    return F.regexp_extract(path, r"^((?:[^/]*/)*)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to the rows of `pages`.

    `rules` has action, host and path; a rule fits its host and all subdomains
    if the path starts with the rule's path (so an empty path fits no rule that
    has one).  Of the rules that fit, the longest wins (host and path together,
    then the host alone); of equal rules with different actions, `block` wins.
    Where none fits, the rule is null and the verdict `default`.

    Null URLs and those without `://` have an empty host and path and fit no
    rule; repeated rows each get their verdict; an empty table gives an empty
    result; columns of `pages` called host, path, rule or verdict are replaced.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.drop("host", "path", "rule", "verdict")
    rows = rows.withColumnsRenamed({url: "url"} if url != "url" else {}).withColumns({"host": host, "path": path})

    rules = rules.select(
        "action", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")
    ).filter("rule_host <> ''")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    rules = rules.withColumn("digest", F.sha2(F.concat("rule_host", _folders(F.col("rule_path"))), 256))
    # One row: how long the expressions of a rule are, so that longer ones need not be made.
    deep = rules.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split(_folders(F.col("rule_path")), "/")) - 1), F.lit(0)).alias("folders"),
    ).first()

    places = rows.select("host", "path").filter("host <> ''").distinct()
    labels, parts = F.split("host", r"\."), F.slice(F.split("path", "/"), 1, deep["folders"] + 1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, deep["labels"])))),
        lambda k: F.array_join(F.slice("labels", -k, k), "."),
    )
    folders = F.least(F.size("parts") - 1, F.lit(deep["folders"]))
    prefixes = F.transform(F.sequence(F.lit(0), folders), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit("/"))))
    made = F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: F.concat(s, p))))
    asked = (
        places.withColumns({"labels": labels, "parts": parts})
        .select("host", "path", suffixes.alias("suffixes"), prefixes.alias("prefixes"))
        .select("host", "path", F.explode(made).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("asked"))
    )
    key = lambda c: F.substring(c, 1, PREFIX_HEX)
    length = F.length(F.concat("rule_host", "rule_path"))
    found = (
        asked.join(rules, key(F.col("asked")) == key(F.col("digest")))
        .filter((F.col("asked") == F.col("digest")) & F.startswith("path", F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), F.struct(length, F.length("rule_host"))).alias("best"))
    )
    best = free_name(rows, "best")
    found = found.withColumnRenamed("best", best)
    judged = rows.filter("host <> ''").join(found, ["host", "path"], "left")
    none = rows.filter("host = ''").withColumn(best, F.lit(None).cast("struct<rule:string,action:string>"))
    kept = [c for c in rows.columns if c not in ("host", "path")]
    out = judged.select(*kept, "host", "path", best).unionByName(none.select(*kept, "host", "path", best))
    out = out.select(*kept, "host", "path", F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["action"], F.lit(default)).alias("verdict"))
    return out.withColumnsRenamed({"url": url} if url != "url" else {})


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
),
rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM (
  SELECT p.*, (SELECT max_by({'rule': rule_host || rule_path, 'action': action}, length(rule_host || rule_path))
               FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts p
)
"""
