"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 bad, 0 good) are counted by host, registered domain and suffix. Each level's rate is
shrunk to its parent's posterior mean through a beta prior whose strength is fitted to that level's counts by
moments of the beta-binomial; a host is blocked if the lower posterior bound of its bad rate reaches the threshold.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, stage, table

#: Fixed values of the registered query: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Public suffixes of two labels, where no fuller list is given.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "co.za", "com.br", "com.cn", "com.mx", "com.tr")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix(host: Column, suffixes=SUFFIXES) -> Column:
    """The longest of the public suffixes that a host ends in, else its last label."""
    out, by = F.substring_index(host, ".", -1), {}
    for s in suffixes:
        by.setdefault(s.count(".") + 1, []).append(s)
    for labels, group in sorted(by.items()):
        tail = F.substring_index(host, ".", -labels)
        out = F.when(tail.isin(group), tail).otherwise(out)
    return out


def registered_domain(host: Column, suffix_: Column) -> Column:
    """The suffix of a host and the label before it."""
    rest = host.substr(F.lit(1), F.char_length(host) - F.char_length(suffix_) - 1)
    return F.when(host == suffix_, host).otherwise(F.concat_ws(".", F.substring_index(rest, ".", -1), suffix_))


def _posterior(counts: DataFrame) -> tuple[Column, Column]:
    """The beta posterior's parameters a and a + b of counts(n, x, up), up the parent's mean; the prior's strength by moments, from all rows."""
    p = F.least(F.greatest(F.col("up"), F.lit(1e-6)), F.lit(1 - 1e-6))
    spread = F.sum((F.col("x") - F.col("n") * p) * (F.col("x") - F.col("n") * p) - F.col("n") * p * (1 - p))
    room = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    rho = counts.agg(F.coalesce(F.least(F.greatest(F.try_divide(spread, room), F.lit(0.01)), F.lit(0.9)), F.lit(0.5))).first()[0]
    strength = F.lit(1 / rho - 1)
    return p * strength + F.col("x"), strength + F.col("n")


def host_reputation(outcomes: DataFrame, z: float = 1.0, suffixes=SUFFIXES) -> DataFrame:
    """outcomes(host, bad 0/1 or null where unlabelled) to one row a host: host, rate, bound.

    Hosts without labelled pages get their domain's mean with the prior's spread. With no labels at all every
    rate is a half. Each level is written once; of its counts only the prior's strength, one number, comes to the driver.
    """
    n, x = F.count("bad").cast("double"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double")
    hosts = outcomes.groupBy("host").agg(n.alias("n"), x.alias("x")).withColumn("sfx", suffix(F.col("host"), suffixes))
    hosts = stage(hosts.withColumn("domain", registered_domain(F.col("host"), F.col("sfx"))), "hosts")
    domains = stage(hosts.groupBy("domain", "sfx").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "domains")
    suffixes_ = stage(domains.groupBy("sfx").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "suffixes")
    overall = suffixes_.agg((F.coalesce(F.sum("x"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).first()[0]
    rows = suffixes_.withColumn("up", F.lit(overall))
    for lower, key in ((domains, "sfx"), (hosts, "domain")):
        a, b = _posterior(rows)
        rows = stage(lower.join(rows.select(key, (a / b).alias("up")), key), "level")
    a, b = _posterior(rows)
    mean = a / b
    return rows.select("host", mean.alias("rate"), (mean - z * F.sqrt(mean * (1 - mean) / (b + 1))).alias("bound"))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, threshold: float = 0.5, z: float = 1.0, outcomes: DataFrame | None = None, suffixes=SUFFIXES) -> DataFrame:
    """pages with host, path, rule, verdict and bad_rate.

    outcomes(host, bad) are labelled pages; where there are none, the pages that a rule decides are the outcomes, which says
    what the rules' hosts are like and nothing of others: a suffix with block rules only has bad outcomes only. Null urls and urls without ://
    have an empty host, which is a host like any other. Rows are judged one by one, repeated ones too. Columns of the
    names made here that pages already has are replaced; others may have any name.
    """
    host, path = url_parts(F.col(url_col))
    made = ("host", "path", "rule", "verdict", "bad_rate")
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(F.struct(*[F.col(c) for c in kept]).alias("row_"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    ruled = rows.select("host", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0).alias("bad"))
    asked = ruled if outcomes is None else outcomes.select("host", "bad").unionByName(ruled.select("host", F.lit(None).cast("int").alias("bad")))
    known = stage(host_reputation(asked, z, suffixes), "reputation")
    found = rows.join(known.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left")
    method = F.when(F.col("bound") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("said", method), "bad_rate": F.col("rate")}
    return found.select(*[F.col("row_").getField(c).alias(c) for c in kept], *[v.alias(k) for k, v in new.items()])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r AS (SELECT *, '.' || host AS dotted FROM p),
ruled AS (SELECT page_id, host, path, CASE
    WHEN suffix(dotted, '.example.com') AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN suffix(dotted, '.example.net') AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN suffix(dotted, '.org') AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN suffix(dotted, '.net') AND prefix(path, '/') THEN 'net/' END AS rule FROM r),
said AS (SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled),
h0 AS (SELECT host, count(said)::DOUBLE AS n, count(*) FILTER (said = 'block')::DOUBLE AS x, CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')
    IN ('ac.uk','co.uk','gov.uk','org.uk','com.au','net.au','org.au','co.nz','co.jp','co.kr','co.in','co.za','com.br','com.cn','com.mx','com.tr') THEN 2 ELSE 1 END AS k FROM said GROUP BY host),
h AS (SELECT host, n, x, array_to_string(list_slice(string_split(host, '.'), -k - 1, -1), '.') AS domain, array_to_string(list_slice(string_split(host, '.'), -k, -1), '.') AS sfx FROM h0),
d AS (SELECT domain, sfx, sum(n) AS n, sum(x) AS x FROM h GROUP BY domain, sfx),
s AS (SELECT sfx, sum(n) AS n, sum(x) AS x FROM d GROUP BY sfx),
s1 AS (SELECT *, least(greatest((SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s), 1e-6), 1 - 1e-6) AS p FROM s),
s2 AS (SELECT *, (SELECT coalesce(least(greatest(sum((x - n * p) * (x - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.01), 0.9), 0.5) FROM s1) AS rho FROM s1),
s3 AS (SELECT sfx, (p * (1 / rho - 1) + x) / (1 / rho - 1 + n) AS up FROM s2),
d1 AS (SELECT d.*, least(greatest(up, 1e-6), 1 - 1e-6) AS p FROM d JOIN s3 USING (sfx)),
d2 AS (SELECT *, (SELECT coalesce(least(greatest(sum((x - n * p) * (x - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.01), 0.9), 0.5) FROM d1) AS rho FROM d1),
d3 AS (SELECT domain, (p * (1 / rho - 1) + x) / (1 / rho - 1 + n) AS up FROM d2),
h1 AS (SELECT h.*, least(greatest(up, 1e-6), 1 - 1e-6) AS p FROM h JOIN d3 USING (domain)),
h2 AS (SELECT *, (SELECT coalesce(least(greatest(sum((x - n * p) * (x - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.01), 0.9), 0.5) FROM h1) AS rho FROM h1),
h3 AS (SELECT host, (p * (1 / rho - 1) + x) / (1 / rho - 1 + n) AS mean, 1 / rho - 1 + n AS b FROM h2)
SELECT page_id, said.host, path, rule, coalesce(said, CASE WHEN mean - 1.0 * sqrt(mean * (1 - mean) / (b + 1)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM said LEFT JOIN h3 ON said.host = h3.host
"""
