"""URL filter: fixed rules first, then empirical-Bayes reputation of hosts.

Labelled pages (good: quality 1 and not toxic) are counted for each host; rates are shrunk through beta-binomial priors from
the host to its registered domain (the last two labels) to its suffix (the last label) to all pages. A level's prior strength
is the method-of-moments estimate of how much its groups' rates spread around their parents'. A host passes if its
posterior mean less ``Z`` standard deviations reaches ``LEAST``; a host without labels has its parents' mean, and so on.

All column functions. Pages are counted by host before anything else; the joins back to pages and hosts are salted, as a
third of all pages may share one host, and most hosts one domain.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged as host ````; several labels of a
page count each; labels with nulls count as bad (a null id: not at all); without labels every rate is one half; repeated
pages are judged alike; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table

Z = 1.0
LEAST = 0.5
SALT = 16
#: verdict, host, path
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, A-Z lower-cased; path)"""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it, and the path's start; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def salted(left: DataFrame, right: DataFrame, key: str, by: list[str], parts: int = SALT) -> DataFrame:
    """Left join whose right side (one row a key) is there ``parts`` times, so that a hot key meets as many tasks."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def _spread(groups: DataFrame, rate: Column) -> float:
    """Prior strength of one level: groups with n, good, and their parent's rate."""
    share = F.col("good") / F.col("n")
    r = groups.agg(
        F.sum(F.col("n") * (share - rate) * (share - rate)).alias("s"),
        F.sum(rate * (1 - rate) * F.col("n")).alias("v"),
        F.sum(rate * (1 - rate)).alias("w"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("q"),
    ).head()
    return strength(r.s, r.v, r.w, r.n, r.q)


def strength(s, v, w, n, q) -> float:
    """Rounded to a whole number between 1 and 1000, so that summation order has no effect."""
    room = (n - q / n) if n else 0
    if not room or not v:
        return 10.0
    between, within = (s - w) / room, v / n
    return 1000.0 if between <= within / 1001 else float(max(1, round(within / between - 1)))


def reputation(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(host, bound) of every host of ``pages``: the lower bound of its posterior rate of good pages."""
    host, _ = url_parts(column(url).cast("string"))
    seen = pages.select(column(page_id).alias("id"), host.alias("host"))
    marks = labels.select(column(label_id).alias("id"), F.coalesce((column(quality) == 1) & (F.coalesce(column(toxic), F.lit(1)) == 0), F.lit(False)).cast("long").alias("good"))
    outcomes = marks.groupBy("id").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = seen.join(outcomes, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = stored(hosts.select("host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "n", "good"), "hosts")
    total = lambda key: [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*total(0))
    suffixes = domains.groupBy("suffix").agg(*total(0))
    r = suffixes.agg(*total(0)).head()
    overall = F.lit(r.good / r.n if r.n else 0.5)
    labelled = lambda df: df.filter("n > 0")
    s1 = _spread(labelled(suffixes), overall)
    suffixes = suffixes.select("suffix", ((F.col("good") + s1 * overall) / (F.col("n") + s1)).alias("rate1"))
    domains = salted(domains, suffixes, "suffix", ["domain"])
    s2 = _spread(labelled(domains), F.col("rate1"))
    domains = domains.select("domain", ((F.col("good") + s2 * F.col("rate1")) / (F.col("n") + s2)).alias("rate2"))
    hosts = salted(hosts, domains, "domain", ["host"])
    s3 = _spread(labelled(hosts), F.col("rate2"))
    a, size = F.col("good") + s3 * F.col("rate2"), F.col("n") + s3
    mean = a / size
    return hosts.select("host", (mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, least: float = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    host, path = url_parts(column(url).cast("string"))
    rated = reputation(pages, labels, page_id=page_id, url=url).select("host", F.when(F.round("bound", 9) >= least, "allow").otherwise("block").alias("rated"))
    rows = pages.select(column(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = salted(rows, rated, "host", ["page_id", "path"]).withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "rated").alias("verdict"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


_SPREAD = "CASE WHEN coalesce(sum(n) - sum(n * n::DOUBLE) / nullif(sum(n), 0), 0) = 0 OR coalesce(sum(r * (1 - r) * n), 0) = 0 THEN 10.0 WHEN (sum(n * (good / n - r) * (good / n - r)) - sum(r * (1 - r))) / (sum(n) - sum(n * n::DOUBLE) / sum(n)) <= sum(r * (1 - r) * n) / sum(n) / 1001 THEN 1000.0 ELSE greatest(1.0, round_even(sum(r * (1 - r) * n) / sum(n) / ((sum(n * (good / n - r) * (good / n - r)) - sum(r * (1 - r))) / (sum(n) - sum(n * n::DOUBLE) / sum(n))) - 1, 0)) END"
_FIT = "WHEN (host = '{1}' OR host LIKE '%.{1}') AND starts_with(path, '{2}') THEN "
_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), o AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
h AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
s1 AS (SELECT *, coalesce((SELECT sum(good) / nullif(sum(n), 0) FROM s), 0.5) AS r FROM s),
k1 AS (SELECT {_SPREAD} AS k FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (good + k * r) / (n + k) AS rate FROM s1, k1),
d1 AS (SELECT d.*, rate AS r FROM d JOIN s2 USING (suffix)),
k2 AS (SELECT {_SPREAD} AS k FROM d1 WHERE n > 0),
d2 AS (SELECT domain, (good + k * r) / (n + k) AS rate FROM d1, k2),
h1 AS (SELECT h.*, rate AS r FROM h JOIN d2 USING (domain)),
k3 AS (SELECT {_SPREAD} AS k FROM h1 WHERE n > 0),
h2 AS (SELECT host, (good + k * r) / (n + k) AS m, n + k AS t FROM h1, k3)
SELECT page_id, host, path, CASE {" ".join(_FIT.format(*r) + f"'{r[1] + r[2]}'" for r in _ORDERED)} END AS rule,
       CASE {" ".join(_FIT.format(*r) + f"'{r[0]}'" for r in _ORDERED)} WHEN round(m - {Z} * sqrt(m * (1 - m) / (t + 1)), 9) >= {LEAST} THEN 'allow' ELSE 'block' END AS verdict
FROM p JOIN h2 USING (host)
"""
