"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL expands into every suffix of its host joined to every prefix of its path, as far as any
rule reaches. Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; what
meets is confirmed on the full digest, and of several confirmed rules the most specific decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: (rule, action, expression): host or host suffix, then a path prefix that ends in "/", or a whole path with or without its query.
RULES = [
    (1, "block", "free-bets.example.com/"),
    (2, "allow", "free-bets.example.com/en/"),
    (3, "block", "example.net/es/"),
    (4, "allow", "www.example.net/es/"),
    (5, "block", "example.org/de/"),
    (6, "block", "m.free-bets.example.com/"),
    (7, "allow", "m.free-bets.example.com/"),
    (8, "block", "tionsh.example.net/"),
    (9, "allow", "blog.tionsh.example.net/fr/"),
    (10, "block", "ththan.example.net/en/"),
    (11, "block", "example.invalid/"),
    (12, "block", "blog.example.com/ads/tracking/"),
    (13, "allow", "tionsh.example.net/en/"),
    (14, "block", "ththnd.example.net/en/?page=1"),
]


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule int, action string, expression string")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case without user, port and final dots; path; path with query."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#[^\\n]*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^([^/?]*)", 1)
    full = F.substr(rest, F.length(host) + 1)
    full = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(host, "\\.+$", ""), F.regexp_extract(full, "^([^?]*)", 1), full


#: Dotted numbers and bracketed addresses have no suffixes but themselves.
ADDRESS = "^([0-9]+([.][0-9]+){3}|\\[.*\\]?)$"


def normalized(rules: DataFrame) -> DataFrame:
    """`rules` with expressions as URLs are: no scheme, hosts in lower case without final dots, a path of at least "/". What has no host has a null expression."""
    host, _, full = split_url(F.col("expression"))
    return rules.withColumn("expression", F.when(host != "", F.concat(host, full)))


def malformed(rules: DataFrame) -> DataFrame:
    """The rules that can never decide: those without a host or with an action other than block and allow."""
    bad = normalized(rules).where(F.col("expression").isNull() | ~F.coalesce(F.col("action").isin("block", "allow"), F.lit(False)))
    return rules.join(bad.select("rule"), "rule", "left_semi")


def decide(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """All columns of `pages`, with action ("block", "allow" or "none") and rule.

    Of the rules confirmed for a URL the one with the longest host decides, then the longest path,
    then "allow" before "block", then the smallest number. A null or empty URL, or one that no rule
    fits, is "none" with a null rule. Rules are normalized like URLs; those that malformed() reports
    are ignored. Paths are compared as they are written, without decoding. Addresses in numbers
    match only as a whole. Rows with the same URL, repeated rows included, get the same decision, and
    a URL is expanded once. Columns of the input named action or rule are replaced, others may have any name.

    No row is dropped and no page content is moved while matching: only distinct matches (url, rule)
    are grouped and joined back. The rules' side is broadcast only if Spark finds it small enough.
    """
    head = F.length(F.regexp_extract("expression", "^([^/]*)", 1))
    r = normalized(rules).where(F.col("expression").isNotNull() & F.col("action").isin("block", "allow")).select(
        "rule", "action", F.sha2("expression", 256).alias("digest"), head.alias("host_length"), F.length("expression").alias("length"),
        (F.length("expression") - F.length(F.translate("expression", "/", ""))).alias("slashes"),
        F.size(F.split(F.regexp_extract("expression", "^([^/]*)", 1), "\\.")).alias("labels"),
    ).withColumn("short", F.substring("digest", 1, 8))
    # No rule has more labels or slashes than these, so deeper expressions can't match any.
    reach = r.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes"))
    host, path, full = split_url(F.col("u"))
    u = pages.select(F.col(url).alias("u")).where("u is not null").distinct().select("u", host.alias("h"), path.alias("p"), full.alias("f")).where("h <> ''")
    u = u.crossJoin(F.broadcast(reach)).select("u", "h", "p", "f", F.split("h", "\\.").alias("hs"), F.split("p", "/").alias("ps"), "labels", "slashes")
    n, m = F.least(F.size("hs"), "labels"), F.least(F.size("ps") - 1, "slashes")
    suffixes = F.expr("transform(sequence(1, least(size(hs), labels)), i -> array_join(slice(hs, -i, i), '.'))")
    prefixes = F.expr("transform(sequence(1, least(size(ps) - 1, slashes)), i -> concat(array_join(slice(ps, 1, i), '/'), '/'))")
    hosts = F.when(F.col("h").rlike(ADDRESS), F.array("h")).otherwise(suffixes)
    u = u.where((n > 0) & (m > 0)).select("u", hosts.alias("hs"), F.array_union(prefixes, F.array("p", "f")).alias("ps"))
    e = u.select("u", F.explode("hs").alias("h"), "ps").select("u", "h", F.explode("ps").alias("p"))
    e = e.select("u", F.sha2(F.concat("h", "p"), 256).alias("d")).withColumn("short", F.substring("d", 1, 8))
    hit = e.join(r, "short").where("d = digest")
    best = F.max(F.struct("host_length", "length", (F.col("action") == "allow").alias("a"), (-F.col("rule")).alias("r"), "action", "rule"))
    best = hit.groupBy("u").agg(best.alias("b")).select("u", F.struct("b.action", "b.rule").alias("b"))
    rest = [c for c in pages.columns if c not in ("action", "rule")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(url).alias("k"))
    out = rows.join(best, F.col("k") == F.col("u"), "left")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.coalesce("b.action", F.lit("none")).alias("action"), F.col("b.rule").alias("rule"))


def query(spark, sf_dir):
    return decide(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


SQL = f"""
WITH rules(rule, action, expression) AS (VALUES {", ".join(f"({a}, '{b}', '{c}')" for a, b, c in RULES)}),
cut AS (
  SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#[^\\n]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
parts AS (
  SELECT url, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS host,
    CASE WHEN starts_with(substr(rest, length(regexp_extract(rest, '^([^/?]*)', 1)) + 1), '/') THEN '' ELSE '/' END
      || substr(rest, length(regexp_extract(rest, '^([^/?]*)', 1)) + 1) AS whole
  FROM cut),
fit AS (
  SELECT url, rule, action, row_number() OVER (PARTITION BY url
    ORDER BY length(split_part(expression, '/', 1)) DESC, length(expression) DESC, action = 'block', rule) AS k
  FROM parts JOIN rules
    ON (host = split_part(expression, '/', 1) OR (NOT regexp_matches(host, '{ADDRESS}') AND ends_with(host, '.' || split_part(expression, '/', 1))))
    AND (substr(expression, length(split_part(expression, '/', 1)) + 1) IN (whole, regexp_extract(whole, '^([^?]*)', 1))
      OR (ends_with(expression, '/') AND starts_with(regexp_extract(whole, '^([^?]*)', 1), substr(expression, length(split_part(expression, '/', 1)) + 1)))))
SELECT p.page_id, p.url, coalesce(f.action, 'none') AS action, f.rule
FROM pages p LEFT JOIN fit f ON f.url = p.url AND f.k = 1
"""
