"""Allow and block rules for URLs, found through hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.components import joined_by
from zonestudy.llm.shared import written

#: Rules that are broadcast at most.
BROADCAST = 100_000
#: (host, path prefix, action).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` (A-Z lower-cased) and the path up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    parts = r"^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, parts, 1), UPPER, LOWER), F.regexp_extract(rest, parts, 2)


def expressions(host: Column, path: Column, max_labels: int, lengths: list[int]) -> Column:
    """All host suffixes of up to ``max_labels`` labels joined to all path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    pairs = [
        F.when((F.size(labels) >= k) & (F.length(path) >= n), F.concat(F.array_join(F.slice(labels, -k, k), "."), F.substring(path, 1, n)))
        for k in range(1, max_labels + 1)
        for n in lengths
    ]
    return F.array_compact(F.array(*pairs))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Each distinct host and path is expanded into the expressions that a rule could equal: only suffixes with as many
    labels, and prefixes as long, as some rule has. An expression meets the rules through the first ``prefix_hex``
    digits of its SHA-256; the full digest then confirms. The longest rule wins, of equal ones the blocking one; no
    rule gives a null ``rule`` and the default verdict. Null and malformed URLs have an empty host and path and meet no
    rule. Repeated rows stay; no rows give no rows. A rule for a host holds for its subdomains. The rules are a parameter list, broadcast
    up to ``BROADCAST`` of them. URLs that very many pages have, the empty one among them, meet their verdicts by broadcast, all
    others by a join; pages are never grouped by host. Other columns are ignored."""
    spark = pages.sparkSession
    max_labels = max([host.count(".") + 1 for host, _, _ in rules], default=1)
    lengths = sorted({len(path) for _, path, _ in rules})
    table = spark.createDataFrame([(h + p, a) for h, p, a in rules], "rule string, action string")
    table = table.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("many"))
    hits = (
        distinct.withColumn("expression", F.explode(expressions(F.col("host"), F.col("path"), max_labels, lengths)))
        .withColumn("seen", F.sha2("expression", 256))
        .withColumn("short", F.substring("seen", 1, prefix_hex))
        .join(F.broadcast(table) if len(rules) <= BROADCAST else table, "short")
        .filter(F.col("seen") == F.col("digest"))
    )
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("blocks"), "rule", "action")).alias("best")
    )
    judged = written(distinct.join(best, ["host", "path"], "left").select("host", "path", "many", "best.rule", F.coalesce("best.action", F.lit(default)).alias("verdict")), "urls")
    most = judged.agg(F.max("many")).first()[0] or 0
    return joined_by(urls, judged, most, "host", "path").select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM u
), r AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rule_host, rule_path, action)
), urls AS (SELECT DISTINCT host, path FROM p), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM urls JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
