"""Empirical-Bayes host reputation, on DataFrame functions alone.

Labelled outcomes of pages (1 good, 0 bad) are counted for each host, registered domain and
suffix. Each level is a beta-binomial whose prior mean is the posterior mean of the level above
(the corpus, the suffix, the domain) and whose prior strength is estimated by moments over all
units of the level: with r = (sum n (p - m)^2 - sum m (1 - m)) / sum m (1 - m) (n - 1), the
strength is 1 / r - 1. A host is blocked if the lower bound of its posterior, mean - Z standard
deviations, is under LEAST. Fixed rules over (host, path) come first; the longest that fits wins.

Pages of a host that holds a third of all pages are counted in each task before the shuffle;
verdicts come back to pages by a join on the host, which Spark splits where it is skewed.

Defined cases: a null url, or one without ://, has an empty host and path and is judged as the
empty host; a page with several labels has their rounded mean; pages without a label (or a null
id) count for nothing; hosts without labelled pages have their domain's posterior; repeated rows
count as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import ascii_lower, materialize

Z, LEAST = 1.645, 0.5
#: Strengths of priors are held within these.
WEAKEST, STRONGEST = 1.0, 1e6
#: Suffixes of two labels; all others have one.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parts_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; user names and ports are left out. An address of four numbers is
    a domain by itself, and all of them have one suffix, the empty one."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".")
    long = last(2).isin(*LONG_SUFFIXES)
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}\z")
    return F.when(address, bare).when(long, last(3)).otherwise(last(2)), F.when(address, "").when(long, last(2)).otherwise(last(1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def strength(units: DataFrame) -> float:
    """Prior strength of units (n, k, m) with n labelled pages, k good ones and prior mean m."""
    spread = F.col("m") * (1 - F.col("m"))
    r = units.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("s"), F.sum(spread).alias("a"), F.sum(spread * (F.col("n") - 1)).alias("b")).first()
    if not r.b:
        return STRONGEST
    rho = (r.s - r.a) / r.b
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def reputation(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", doc: str = "doc_id", label: str = "quality") -> DataFrame:
    """host, domain, suffix, `n` and `k` labelled and good pages, posterior `mean`, `bound`."""
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc).alias("p")).agg(F.round(F.avg(label)).cast("long").alias("good"))
    seen = pages.select(F.col(page).alias("p"), host_of(F.col(url)).alias("host")).join(known, "p", "left")
    hosts = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    domain, suffix = parts_of(F.col("host"))
    hosts = materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    mean = ((k or 0) + 1) / ((n or 0) + 2)
    above = hosts.select("suffix").distinct().withColumn("m", F.lit(mean))
    for level, up in (("suffix", "suffix"), ("domain", "suffix"), ("host", "domain")):
        keys = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain", "suffix"]}[level]
        units = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(above, up)
        s = strength(units)
        post = (F.lit(s) * F.col("m") + F.col("k")) / (s + F.col("n"))
        above = units.select(level, post.alias("m"))
    deviation = F.sqrt(post * (1 - post) / (s + F.col("n") + 1))
    return units.select(*keys, "n", "k", post.alias("mean"), (post - Z * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", rules=RULES, least: float = LEAST) -> DataFrame:
    """page, host, path, rule and verdict for every row of pages."""
    bad = reputation(pages, labels, page, url).select("host", F.when(F.col("bound") < least, "block").otherwise("allow").alias("own"))
    urls = pages.select(F.col(page), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return urls.join(bad, "host").select(page, "host", "path", name.alias("rule"), F.coalesce(verdict, "own").alias("verdict"))


#: The same in SQL.
SQL = """
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
l AS (SELECT doc_id, CAST(round(avg(quality)) AS BIGINT) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM p LEFT JOIN l ON l.doc_id = p.page_id GROUP BY host),
h1 AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS a, regexp_full_match(array_to_string(a, '.'), '[0-9]+([.][0-9]+){3}') AS address FROM h0),
h2 AS (SELECT *, array_to_string(a[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'net.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'co.za', 'com.cn', 'com.mx') AS l2 FROM h1),
h AS (SELECT host, n, k, CASE WHEN address THEN array_to_string(a, '.') WHEN l2 THEN array_to_string(a[-3:], '.') ELSE array_to_string(a[-2:], '.') END AS domain,
        CASE WHEN address THEN '' WHEN l2 THEN array_to_string(a[-2:], '.') ELSE a[-1] END AS suffix FROM h2),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) FROM h) AS m FROM h GROUP BY suffix),
s1 AS (SELECT sum(n * (k / n - m) ** 2) AS s, sum(m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS b FROM s0 WHERE n > 0),
s2 AS (SELECT CASE WHEN coalesce(b, 0) = 0 OR s <= a THEN 1e6 ELSE least(1e6, greatest(1.0, b / (s - a) - 1)) END AS g FROM s1),
s AS (SELECT suffix, (g * m + k) / (g + n) AS m FROM s0, s2),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN s USING (suffix) GROUP BY domain, h.suffix),
d1 AS (SELECT sum(n * (k / n - m) ** 2) AS s, sum(m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS b FROM d0 WHERE n > 0),
d2 AS (SELECT CASE WHEN coalesce(b, 0) = 0 OR s <= a THEN 1e6 ELSE least(1e6, greatest(1.0, b / (s - a) - 1)) END AS g FROM d1),
d AS (SELECT domain, (g * m + k) / (g + n) AS m FROM d0, d2),
u0 AS (SELECT host, n, k, m FROM h JOIN d USING (domain)),
u1 AS (SELECT sum(n * (k / n - m) ** 2) AS s, sum(m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS b FROM u0 WHERE n > 0),
u2 AS (SELECT CASE WHEN coalesce(b, 0) = 0 OR s <= a THEN 1e6 ELSE least(1e6, greatest(1.0, b / (s - a) - 1)) END AS g FROM u1),
u3 AS (SELECT host, (g * m + k) / (g + n) AS m, g + n + 1 AS z FROM u0, u2),
u AS (SELECT host, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / z) < 0.5 THEN 'block' ELSE 'allow' END AS own FROM u3),
r AS (SELECT p.*, own,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p JOIN u USING (host))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE own END AS verdict
FROM r
"""
