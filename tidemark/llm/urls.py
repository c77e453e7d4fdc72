"""URL filtering by host reputation.

Labelled page outcomes (1: bad) are counted by host, without user names and ports.  Host rates shrink to their
registered domain's, those to their suffix's, those to the overall rate: at each level a beta prior whose
mean is the parent's shrunken rate and whose strength comes from the data (the analysis-of-variance
estimate of the intra-class correlation of a beta-binomial).  A host is blocked where even the
lower bound of its posterior bad rate, mean less z deviations, lies above ``most``.  Explicit
rules come first: the longest rule that fits host (or a parent domain) and path decides.

A null url, or one without ``://``, has an empty host and path and the reputation of that host.
Hosts without outcomes have their domain's prior.  Of several labels of a page a bad one counts.
A registered domain is the suffix and the label before it; the suffix is the last label, or the longest of
``SUFFIXES`` (a parameter) that the host ends with.  A host that is a number or an address in brackets has no domain:
it is its own, under the suffix ``ip``.  Repeated rows count each.  Rules of equal length can't tie, since they would be
the same rule.  Very long urls are read whole.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
Z, MOST, RHO = 1.645, 0.3, (0.001, 0.5)
#: Suffixes of two labels under which names are registered; callers may give a longer list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za")
ADDRESS = "^([0-9]+(\\.[0-9]+){3}|\\[.*)$"
AUTHORITY = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.  The rules are a short list of the caller's."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(ADDRESS), F.lit("ip")).when(two.isin(*suffixes), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(ADDRESS), site).when(two.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(two)


def strength(children: DataFrame) -> float:
    """Prior strength 1 / rho - 1 from children's (n, k) and their parents' rate, rho within fixed bounds."""
    r = F.col("k") / F.col("n")
    one = children.where("n > 0").agg(
        F.count(F.lit(1)).alias("i"), F.countDistinct("parent").alias("p"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * (r - F.col("rate")) * (r - F.col("rate"))).alias("between"), F.sum(F.col("n") * r * (1 - r)).alias("within"),
    ).first()
    i, p, n = one["i"] or 0, one["p"] or 0, one["n"] or 0
    if i <= p or n <= i:
        return 1 / RHO[1] - 1
    msb, msw = one["between"] / (i - p), one["within"] / (n - i)
    n0 = (n - one["n2"] / n) / (i - p)
    total = msb + (n0 - 1) * msw
    rho = (msb - msw) / total if total > 0 else 0.0
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def reputations(outcomes: DataFrame, z: float = Z, most: float = MOST, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, k, rate, bound, reputation) from (host, bad); bad is null where a page has no label."""
    hosts = common.cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), suffixes))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains, suffixes = hosts.groupBy("suffix", "domain").agg(*sums), hosts.groupBy("suffix").agg(*sums)
    all_ = suffixes.agg(*sums).first()
    overall = ((all_["k"] or 0) + 1) / ((all_["n"] or 0) + 2)

    def shrunk(rows: DataFrame, s: float) -> Column:
        return (F.col("k") + s * F.col("rate")) / (F.col("n") + s)

    suffixes = suffixes.withColumn("rate", F.lit(overall)).withColumn("parent", F.lit(""))
    suffixes = suffixes.select("suffix", shrunk(suffixes, strength(suffixes)).alias("rate"))
    domains = common.cut(domains.join(suffixes, "suffix").withColumn("parent", F.col("suffix")))
    domains = domains.select("suffix", "domain", shrunk(domains, strength(domains)).alias("rate"))
    hosts = common.cut(hosts.join(domains, ["suffix", "domain"]).withColumn("parent", F.col("domain")))
    s = strength(hosts)
    mean = shrunk(hosts, s)
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + s + 1))
    return hosts.select("host", "n", "k", mean.alias("bad_rate"), bound.alias("bound"), F.when(bound > most, "block").otherwise("allow").alias("reputation"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the label of its id is toxic or of low quality."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = common.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    site = site_of(F.col("host")).alias("site")
    known = reputations(pages.join(labels, "page_id", "left").select(site.alias("host"), "bad")).withColumnRenamed("host", "site")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    out = pages.withColumn("site", site).join(known, "site")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation").alias("verdict"), F.round("bad_rate", 9).alias("bad_rate"), F.round("bound", 9).alias("bound"))


def _level(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN i <= p OR n <= i THEN 1.0 ELSE 1 / least(greatest(CASE WHEN b / (i - p) + ((n - n2 / n) / (i - p) - 1) * (w / (n - i)) > 0
      THEN (b / (i - p) - w / (n - i)) / (b / (i - p) + ((n - n2 / n) / (i - p) - 1) * (w / (n - i))) ELSE 0 END, {RHO[0]}), {RHO[1]}) - 1 END AS s
    FROM (SELECT CAST(count(*) AS DOUBLE) AS i, CAST(count(DISTINCT parent) AS DOUBLE) AS p, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS n2,
      sum(n * (k / n - rate) * (k / n - rate)) AS b, sum(n * (k / n) * (1 - k / n)) AS w FROM {rows} WHERE n > 0))"""


ORACLE = f"""
WITH pg AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{AUTHORITY}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(coalesce(url, ''), '{AUTHORITY}', 2) AS path FROM pages),
pq AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM pg),
lb AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT site AS host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM pq LEFT JOIN lb ON page_id = doc_id GROUP BY site),
hx AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two, regexp_matches(host, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*)$') AS address FROM h0),
h1 AS (SELECT *, CASE WHEN address THEN 'ip' WHEN two IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN two ELSE array_to_string(string_split(host, '.')[-1:], '.') END AS suffix,
    CASE WHEN address THEN host WHEN two IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain FROM hx),
x0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, '' AS parent FROM h1 GROUP BY suffix),
x1 AS (SELECT *, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM x0) AS rate FROM x0),
{_level("xs", "x1")},
x2 AS (SELECT suffix, (k + s * rate) / (n + s) AS rate FROM x1, xs),
d1 AS (SELECT d.*, d.suffix AS parent, rate FROM (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h1 GROUP BY suffix, domain) d JOIN x2 USING (suffix)),
{_level("ds", "d1")},
d2 AS (SELECT suffix, domain, (k + s * rate) / (n + s) AS rate FROM d1, ds),
h2 AS (SELECT h1.*, h1.domain AS parent, rate FROM h1 JOIN d2 USING (suffix, domain)),
{_level("hs", "h2")},
h3 AS (SELECT host, n, s, (k + s * rate) / (n + s) AS m FROM h2, hs),
h4 AS (SELECT host, m, m - {Z} * sqrt(m * (1 - m) / (n + s + 1)) AS bound FROM h3),
r AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{v}')" for t, v in RULES)}) AS t(rule, dom, start, what)),
f AS (SELECT host AS fh, path AS fp, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what
    FROM (SELECT DISTINCT host, path FROM pg) u JOIN r ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, pq.host, path, rule, coalesce(what, CASE WHEN bound > {MOST} THEN 'block' ELSE 'allow' END) AS verdict, round(m, 9) AS bad_rate, round(bound, 9) AS bound
FROM pq JOIN h4 ON pq.site = h4.host LEFT JOIN f ON pq.host = fh AND path = fp
"""
