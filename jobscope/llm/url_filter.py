"""URL filters: a URL is expanded into host-suffix and path-prefix expressions that meet the rules in an equi-join
on short hash prefixes; full digests confirm, then the longest rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Rules up to this number (some megabytes) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_RULES = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The rule list of the pages query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([Row(rule_host=h, rule_path=p, rule_verdict=v) for h, p, v in rules])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/``, ``?``, ``#``, and from there up to ``?``, ``#``."""
    rest = F.substr(url, F.locate("://", url) + 3)
    found = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, F.translate(host, UPPER, UPPER.lower())).otherwise(""), F.when(found, path).otherwise("")


def _key(host: Column, path: Column) -> Column:
    """Digest of one expression; hosts hold no ``/``, so the text is unambiguous up to where the host ends."""
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule fits its host and all subdomains if the path starts with its path.  The longest rule wins, at equal length
    the longer host, then ``allow``.  A null url, or one without ``://``, has empty host and path, fits no rule with a
    host, and gets the default verdict.  Repeated rows are all returned.  Rule hosts and paths are taken literally,
    hosts in lower case; of a rule given twice with both verdicts ``allow`` counts.

    Each distinct pair of host and path is judged once.  Path prefixes are cut at the lengths that rule paths have, so
    any rule path can match; host suffixes at every dot.
    """
    spark = urls.sparkSession
    known = rules.select(
        F.translate("rule_host", UPPER, UPPER.lower()).alias("rule_host"), "rule_path", "rule_verdict"
    ).groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    known = known.withColumn("rule_digest", _key(F.col("rule_host"), F.col("rule_path")))
    known = known.withColumn("rule_short", _short(F.col("rule_digest")))
    sizes = known.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    host, path = url_parts(F.col("row")[url])
    # The row as one column, so that its names can't meet ours.
    parts = urls.select(F.struct("*").alias("row")).select("row", host.alias("host"), path.alias("path"))
    lengths = F.array(*[F.lit(n) for n in sorted(sizes["lengths"])]).cast("array<int>")
    labels = F.split("host", r"\.", -1)
    expressions = (
        parts.groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one")
        .withColumn("suffix", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )))
        .withColumn("length", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .select("host", "path", _key(F.col("suffix"), F.expr("substr(path, 1, length)")).alias("digest"))
        .withColumn("short", _short(F.col("digest")))
    )
    if sizes["n"] <= MAX_BROADCAST_RULES:
        known = F.broadcast(known)
    best = (
        expressions.join(known, F.col("short") == F.col("rule_short"))
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
            (F.col("rule_verdict") == "allow").alias("allows"), F.concat("rule_host", "rule_path").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        )).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    made = ["host", "path", "rule", "verdict"]
    joined = parts.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return joined.select(*[F.col("row")[c].alias(c) for c in urls.columns if c not in made], *made)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
        translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (SELECT page_id, host, path, max({'n': length(h || r.p), 'rule': h || r.p, 'verdict': v}) AS best
        FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT DISTINCT page_id, host, path, best FROM hit) USING (page_id, host, path)
"""
