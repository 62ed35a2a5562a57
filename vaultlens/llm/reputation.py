"""URL filter by empirical-Bayes host reputation, by DataFrame functions alone.

Labelled pages give each host a count of outcomes and of bad ones. The bad rate is shrunk from host to registered
domain to suffix to all pages: each level's beta prior has the mean of its parent's posterior and a strength found by
moments of the beta-binomial over that level. A page is blocked if even the lower bound of its host's posterior,
mean - z * deviation, is above ``limit``. Hand-written rules, host suffix and path prefix, go first; the longest wins.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and shares the
reputation of the empty host. A host without labelled pages has the posterior of its domain, suffix or all pages.
Repeated pages are judged one by one; a page labelled several times counts each time. Rules of equal length: the longer
host wins, then block. A very long url is read whole. An empty table gives no rows, and without labels all are allowed but for rules. Columns of
``pages`` pass through whatever their names; those named like a column that ``judge`` adds are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, cut, unboxed

#: Second-level labels under which a country's suffix has two labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    rule: str  #: host suffix, then the path from its first slash
    verdict: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.rule.partition("/")
        return host, slash + path


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2)
    return ascii_lower(rest), path


def suffix(host: Column) -> Column:
    """The last label, or two of them such as co.uk; an address in digits is its own suffix."""
    two = rf"((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$"
    name = F.regexp_replace(host, r":\d*$", "")
    return F.when(name.rlike(r"^[\d.]+$"), name).when(name.rlike(rf"(?:^|\.){two}"), F.regexp_extract(name, two, 1)).otherwise(F.substring_index(name, ".", -1))


def domain(host: Column) -> Column:
    """The suffix and the label before it."""
    name, own = F.regexp_replace(host, r":\d*$", ""), suffix(host)
    labels = F.size(F.split(own, r"\.")) + 1
    return F.when(name == own, name).when(labels == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -3))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The list is configuration and part of the plan."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(r.rule)).alias("n"), F.lit(len(h)).alias("h"), F.lit(r.verdict).alias("verdict"), F.lit(r.rule).alias("rule")))
        for r in rules
        for h, p in [r.parts]
    ]
    return F.greatest(*fits, fits[0]) if fits else F.lit(None).cast("struct<n:int,h:int,verdict:string,rule:string>")


def _shrunk(own: DataFrame, parent: DataFrame, link: str, floor: float) -> DataFrame:
    """(.., n, bad, a, b): posterior beta of each row under the mean of its parent, which ``link`` names; the strength is one number for the level."""
    rows = own.join(parent.select(link, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")), link)
    return _posterior(rows, floor)


def _posterior(rows: DataFrame, floor: float) -> DataFrame:
    rows = cut(rows)
    var = F.col("prior") * (1 - F.col("prior"))
    level = rows.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) / F.col("n") / var).alias("s"), F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n1"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n2"),
    ).first()
    spread = floor if not level["k"] else (level["s"] - level["k"] + 1) / max(level["n1"] - level["n2"] - level["k"] + 1, 1.0)
    m = 1 / min(max(spread, floor), 1 - floor) - 1
    return rows.withColumn("a", F.col("bad") + m * F.col("prior")).withColumn("b", F.col("n") - F.col("bad") + m * (1 - F.col("prior"))).drop("prior")


def posteriors(labelled: DataFrame, floor: float = 1e-3) -> tuple[dict[str, DataFrame], tuple[float, float]]:
    """(key, p) of each labelled host, domain and suffix, p being struct(a, b) of its posterior; and a and b of all pages.

    ``labelled`` has url and bad (0 or 1). Counts are added up by host first; domains and suffixes are sums of hosts.
    """
    host, _ = host_path(F.col("url"))
    counted = labelled.groupBy(host.alias("host")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = cut(counted.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    top = hosts.agg(*sums).first()
    a, b = (top["bad"] or 0.0) + 0.5, (top["n"] or 0.0) - (top["bad"] or 0.0) + 0.5
    s = _posterior(suffixes.withColumn("prior", F.lit(a / (a + b))), floor)
    d = _shrunk(domains, s, "suffix", floor)
    h = _shrunk(hosts.drop("suffix"), d, "domain", floor)
    return {c: df.select(c, F.struct("a", "b").alias(f"{c}_p")) for c, df in (("host", h), ("domain", d), ("suffix", s))}, (a, b)


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule], limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the posterior's mean and bound.

    Distinct hosts are judged once, each by the nearest level that has labels; then pages join the table of hosts,
    which Spark broadcasts only below its size threshold.
    """
    host, path = host_path(F.col("row").getField("url"))
    parsed = boxed(pages).select("row", host.alias("host"), path.alias("path"))
    known, (a, b) = posteriors(labelled.filter("bad is not null"))
    hosts = parsed.select("host").distinct().withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))})
    for c, df in known.items():
        hosts = hosts.join(df, c, "left")
    p = F.coalesce("host_p", "domain_p", "suffix_p", F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))
    hosts = hosts.withColumn("p", p).select("host", (F.col("p.a") / (F.col("p.a") + F.col("p.b"))).alias("bad_rate"), (F.col("p.a") + F.col("p.b")).alias("weight"))
    bound = F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("weight") + 1))
    hosts = hosts.select("host", "bad_rate", bound.alias("bad_bound"))
    found = parsed.join(hosts, "host", "left").withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    found = found.withColumns({"rule": F.col("r.rule"), "verdict": verdict})
    return unboxed(found, **{c: c for c in ("host", "path", "bad_rate", "bad_bound", "rule", "verdict")})


SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM p),
x AS (SELECT *, regexp_replace(host, ':\d*$', '') AS name FROM h),
y AS (SELECT *, CASE WHEN regexp_matches(name, '^[\d.]+$') THEN name
        WHEN regexp_matches(name, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})$') THEN regexp_extract(name, '((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1)
        ELSE split_part(name, '.', -1) END AS suffix FROM x),
w AS (SELECT *, CASE WHEN name = suffix THEN name ELSE array_to_string(list_slice(string_split(name, '.'), -(len(string_split(suffix, '.')) + 1), NULL), '.') END AS domain FROM y),
l AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM w
      JOIN (SELECT doc_id, CAST(quality = 0 OR toxic = 1 AS INTEGER) AS bad FROM labels) b ON b.doc_id = w.page_id WHERE bad IS NOT NULL GROUP BY host),
ld AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM l GROUP BY ALL),
ls AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM ld GROUP BY ALL),
t AS (SELECT sum(bad) + 0.5 AS a, sum(n) - sum(bad) + 0.5 AS b FROM ls HAVING count(*) > 0),
s0 AS (SELECT ls.*, a / (a + b) AS prior FROM ls, t),
sm AS (SELECT 1 / least(greatest((sum((bad - n * prior) ** 2 / n / (prior * (1 - prior))) - count(*) + 1) / greatest(sum(n) - sum(n * n) / sum(n) - count(*) + 1, 1), 0.001), 0.999) - 1 AS m FROM s0),
s AS (SELECT suffix, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM s0, sm),
d0 AS (SELECT ld.*, a / (a + b) AS prior FROM ld JOIN s USING (suffix)),
dm AS (SELECT 1 / least(greatest((sum((bad - n * prior) ** 2 / n / (prior * (1 - prior))) - count(*) + 1) / greatest(sum(n) - sum(n * n) / sum(n) - count(*) + 1, 1), 0.001), 0.999) - 1 AS m FROM d0),
d AS (SELECT domain, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM d0, dm),
h0 AS (SELECT l.*, a / (a + b) AS prior FROM l JOIN d USING (domain)),
hm AS (SELECT 1 / least(greatest((sum((bad - n * prior) ** 2 / n / (prior * (1 - prior))) - count(*) + 1) / greatest(sum(n) - sum(n * n) / sum(n) - count(*) + 1, 1), 0.001), 0.999) - 1 AS m FROM h0),
hp AS (SELECT host, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM h0, hm),
f AS (SELECT w.page_id, w.host, w.path, coalesce(hp.a, d.a, s.a, (SELECT a FROM t), 0.5) AS a, coalesce(hp.b, d.b, s.b, (SELECT b FROM t), 0.5) AS b
      FROM w LEFT JOIN hp ON hp.host = w.host LEFT JOIN d ON d.domain = w.domain LEFT JOIN s ON s.suffix = w.suffix),
rules AS (SELECT * FROM (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')) v(rh, rp, rule, rv)),
r AS (SELECT page_id, host, path, arg_max(struct_pack(rule := rule, v := rv), length(rule)) AS r FROM (SELECT DISTINCT page_id, host, path FROM f) q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT f.page_id, f.host, f.path, r.r.rule AS rule, coalesce(r.r.v, CASE WHEN a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN r ON r.page_id IS NOT DISTINCT FROM f.page_id AND r.host = f.host AND r.path = f.path
"""
