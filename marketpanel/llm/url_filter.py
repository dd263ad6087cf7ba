"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages (good or not) are counted a host. Beta-binomial priors shrink a host to its
registered domain, that to its suffix, and that to all pages; the strength of a prior is estimated from
the spread of the rates below it. A url without a rule is blocked if the lower posterior bound of its
host's share of good pages falls below a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import query, table
from marketpanel.sources.sinks import materialize

# Rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Suffixes of two labels under which domains are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.tw", "org.uk")
Z = 1.645  # one-sided 95 %
LEAST_GOOD = 0.5
# Range of a prior's strength, in pages.
STRENGTHS = (1.0, 1000.0)


def with_parts(pages: DataFrame) -> DataFrame:
    """`pages` plus host and path; both are empty for a null url or one without ://."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return out.withColumn("host", F.translate(raw, upper, lower)).withColumn(
        "path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    ).drop("_rest")


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null."""
    out = None
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(
        F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)
    ).otherwise(F.substring_index(host, ".", -2))


def _strength(groups: DataFrame, parent: str) -> DataFrame:
    """Strength a parent: s = (1 - r) / r with r the correlation within its groups, by the method of moments:
    sum over groups of (k - n m)^2 = m (1 - m) sum of n (1 + (n - 1) r)."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = groups.groupBy(parent).agg(
        F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k).alias("kk"), F.sum(k * n).alias("kn"), F.sum(n * n).alias("nn")
    )
    m = F.try_divide(F.col("k"), F.col("n"))
    base, pairs = m * (1 - m), F.col("nn") - F.col("n")
    excess = F.col("kk") - 2 * m * F.col("kn") + m * m * F.col("nn") - base * F.col("n")
    s = F.when((base > 0) & (pairs > 0) & (excess > 1e-9 * F.col("n")), F.try_divide(base * pairs, excess) - 1)
    s = F.coalesce(s, F.lit(STRENGTHS[1]))
    return sums.select(F.col(parent), F.least(F.greatest(s, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1])).alias("s"))


def _shrunk(groups: DataFrame, key: str, parent: str, prior: DataFrame) -> DataFrame:
    """Posterior of each group: (key, a, b), given the parents' (parent, p) as prior means."""
    joined = groups.join(_strength(groups, parent), parent).join(prior, parent)
    return joined.select(
        key, (F.col("s") * F.col("p") + F.col("k")).alias("a"), (F.col("s") * (1 - F.col("p")) + F.col("n") - F.col("k")).alias("b")
    )


def _mean(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("p"))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, bound) of every host of `pages` (page_id, host), from `outcomes` (page_id, good 0/1 or null).

    Pages without an outcome, and hosts without pages with one, have n = 0 and keep the prior. Several
    outcomes of a page count as its best. A host is one row of counts before anything else is done, so
    a hot host costs no more than others.
    """
    best = outcomes.groupBy("page_id").agg(F.max("good").alias("good"))
    hosts = materialize(
        pages.join(best, "page_id", "left").groupBy("host").agg(
            F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("k")
        ).select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.lit(1).alias("everything"), "n", "k"),
        "host-counts",
    )
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.first("everything").alias("everything"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    # All pages: a uniform prior of strength 2.
    top = hosts.groupBy("everything").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("p"))
    by_suffix = _shrunk(suffixes, "suffix", "everything", top)
    by_domain = _shrunk(domains, "domain", "suffix", _mean(by_suffix, "suffix"))
    by_host = _shrunk(hosts, "host", "domain", _mean(by_domain, "domain"))
    a, b = F.col("a"), F.col("b")
    mean, total = a / (a + b), a + b
    return by_host.select("host", (mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of each row of `pages` (page_id, url).

    Null urls share the empty host; a null page_id has no outcome; repeated rows are judged alike; an
    empty table gives an empty result. Other columns are not read.
    """
    parts = with_parts(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")))
    reputation = materialize(host_reputation(parts, outcomes), "host-reputation")
    found = parts.withColumn("_rule", rule_of(rules)).join(reputation, "host", "left")
    own = F.when(F.col("bound") < least_good, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "bound"
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), ruled AS (
  SELECT page_id, host, path, arg_max(rule, len(rule)) AS rule, arg_max(v, len(rule)) AS v FROM parts LEFT JOIN (VALUES
    ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) AS r(rule, h, q, v)
    ON (host = h OR suffix(host, '.' || h)) AND prefix(path, q) GROUP BY ALL
), best AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels GROUP BY 1),
hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k FROM parts LEFT JOIN best USING (page_id) GROUP BY 1
), named AS (
  SELECT *, array_to_string(string_split(host, '.')[-2:], '.') IN
    ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'com.tw', 'org.uk') AS two FROM hosts
), h AS (
  SELECT host, n, k, array_to_string(CASE WHEN two THEN string_split(host, '.')[-3:] ELSE string_split(host, '.')[-2:] END, '.') AS domain,
         array_to_string(CASE WHEN two THEN string_split(host, '.')[-2:] ELSE string_split(host, '.')[-1:] END, '.') AS suffix FROM named
), d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
lev AS (
  SELECT 'h' AS lv, host AS key, domain AS parent, n, k FROM h UNION ALL SELECT 'd', domain, suffix, n, k FROM d
  UNION ALL SELECT 's', suffix, '*', n, k FROM s
), mm AS (SELECT lv, parent, sum(k) / sum(n) AS m FROM lev GROUP BY ALL),
st AS (
  SELECT lv, parent, m * (1 - m) AS base, sum((k - n * m) ** 2) AS q, sum(n) AS n, sum(n * (n - 1)) AS pairs
  FROM lev JOIN mm USING (lv, parent) GROUP BY ALL
), str AS (
  SELECT lv, parent, CASE WHEN base > 0 AND pairs > 0 AND q - base * n > 1e-9 * n
    THEN least(greatest(base * pairs / (q - base * n) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM st
), top AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS p FROM h),
ps AS (SELECT key AS suffix, (s * p + k) / (s + n) AS p FROM lev JOIN str USING (lv, parent), top WHERE lv = 's'),
pd AS (SELECT key AS domain, (s * p + k) / (s + n) AS p FROM lev JOIN str USING (lv, parent) JOIN ps ON ps.suffix = parent WHERE lv = 'd'),
ph AS (SELECT key AS host, (s * p + k) / (s + n) AS p, s + n AS t FROM lev JOIN str USING (lv, parent) JOIN pd ON pd.domain = parent WHERE lv = 'h')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN p - 1.645 * sqrt(p * (1 - p) / (t + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN ph USING (host)
"""


@query("op4_url_filter", ORACLE)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).drop("bound")
