"""URL filters: rules first, then empirical-Bayes reputation of hosts, on DataFrame functions alone.

Pages that a rule judges are labelled outcomes: bad where it blocks, good where it allows. A page without a rule has no outcome
and changes nobody's verdict. A host's share of good outcomes is shrunk towards that of its registered domain, that one
towards its suffix, and a suffix towards all outcomes: at each level a beta prior has the parent's posterior mean. Its strength
comes from the spread of the children's shares (moments), but is never more than the outcomes that stand behind the
parent's mean, so what is not known above stays unknown below. A page without a rule is blocked if the upper
bound of its host's posterior is under one half. Labels of a path thus speak for the whole host, and those of its
neighbours for a host that has none; where neither host, domain nor suffix has labels the bound is wide and the page is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; pages
repeat as they come; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle
from lakemill.sources.tables import read_table

#: Host and path of a rule in one string, and what it says. A short list: each rule is one condition.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Public suffixes of two labels that are read as one suffix.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
#: Standard deviations of the bound, the share of good pages under which a host is blocked, and the
#: least and largest strength of a prior in pages.
Z = 1.645
LEAST_GOOD = 0.5
STRENGTHS = (2.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, under = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + under)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(wide, F.substring_index(host, ".", -3)).otherwise(two), F.when(wide, two).otherwise(F.substring_index(host, ".", -1))


def strength(children: DataFrame, mean: Column) -> Column:
    """Pages that a prior of this level counts for: mean * (1 - mean) / spread - 1, within bounds."""
    rate = F.col("good") / F.when(F.col("n") > 0, F.col("n"))
    row = children.agg(F.sum(F.col("n") * mean * (1 - mean)).alias("even"), F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread")).first()
    if not row["spread"]:
        return F.lit(STRENGTHS[1])
    return F.lit(float(min(max(row["even"] / row["spread"] - 1, STRENGTHS[0]), STRENGTHS[1])))


def reputation(judged: DataFrame) -> DataFrame:
    """(host, upper) from ``judged`` (host, good: 1, 0 or null): the posterior's upper bound for each host."""
    by_host = judged.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = settle(by_host.withColumns({"domain": domain, "suffix": suffix}))
    domains = settle(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = settle(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    mean, known = F.lit((total[1] + 1) / (total[0] + 2)), F.lit(float(total[0] + 2))
    above = posterior(suffixes, strength(suffixes, mean), mean, known)
    at_domain = settle(domains.join(above.select("suffix", "mean", "known"), "suffix"))
    above = posterior(at_domain, strength(at_domain, F.col("mean")), F.col("mean"), F.col("known"))
    at_host = settle(hosts.join(above.select("domain", "mean", "known"), "domain"))
    found = posterior(at_host, strength(at_host, F.col("mean")), F.col("mean"), F.col("known"))
    return found.select("host", (F.col("mean") + Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("known") + 1))).alias("upper"))


def posterior(children: DataFrame, strength: Column, mean: Column, known: Column) -> DataFrame:
    """``children`` with the mean of their posterior and the outcomes behind it, from the parent's (``mean``, ``known``)."""
    k = F.least(strength, known)
    return children.withColumns({"mean": (k * mean + F.col("good")) / (k + F.col("n")), "known": k + F.col("n")})


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each page: key, host, path, rule and verdict."""
    host, path = split_url(F.col(url))
    parsed = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, says = first_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "says": says})
    hosts = reputation(judged.select("host", (F.col("says") == "allow").cast("long").alias("good")))
    joined = judged.join(hosts, "host", "left")
    verdict = F.coalesce("says", F.when(F.col("upper") < LEAST_GOOD, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same judgement for DuckDB."""
    cases = {0: [], 1: []}
    for rule, says in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        at, slash, under = rule.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash + under}')"
        cases[0].append(f"WHEN {fits} THEN '{rule}'")
        cases[1].append(f"WHEN {fits} THEN '{says}'")
    wide = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    k = lambda t: f"(SELECT CASE WHEN coalesce(sum(n * (good / n - mean) ^ 2), 0) = 0 THEN {STRENGTHS[1]} ELSE least(greatest(sum(n * mean * (1 - mean)) / sum(n * (good / n - mean) ^ 2) - 1, {STRENGTHS[0]}), {STRENGTHS[1]}) END FROM {t} WHERE n > 0)"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (SELECT *, CASE {' '.join(cases[0])} END AS rule, CASE {' '.join(cases[1])} END AS says FROM h),
b AS (SELECT host, count(says)::DOUBLE AS n, count(*) FILTER (says = 'allow')::DOUBLE AS good, string_split(host, '.') AS p FROM j GROUP BY host),
w AS (SELECT *, array_to_string(p[-2:], '.') IN ({wide}) AS wide FROM b),
hosts AS (
  SELECT host, n, good, CASE WHEN wide THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN wide THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM w
),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM domains) AS mean, (SELECT sum(n) + 2 FROM domains) AS known FROM domains GROUP BY suffix),
s1 AS (SELECT suffix, (m * mean + good) / (m + n) AS mean, m + n AS known FROM (SELECT s0.*, least({k('s0')}, known) AS m FROM s0)),
d0 AS (SELECT d.*, mean, known FROM domains d JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (m * mean + good) / (m + n) AS mean, m + n AS known FROM (SELECT d0.*, least({k('d0')}, known) AS m FROM d0)),
h0 AS (SELECT h.*, mean, known FROM hosts h JOIN d1 USING (domain)),
h1 AS (SELECT host, (m * mean + good) / (m + n) AS mean, m + n AS known FROM (SELECT h0.*, least({k('h0')}, known) AS m FROM h0)),
r AS (SELECT host, mean + {Z} * sqrt(mean * (1 - mean) / (known + 1)) AS upper FROM h1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN upper < {LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN r USING (host)
"""


SQL = _sql()
