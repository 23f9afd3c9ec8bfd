"""URL filter: fixed rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host.  Counts of a suffix are shrunk to the mean
of all pages, those of a registered domain to its suffix, and those of a host to its domain.  At
each level the beta-binomial prior has the parent's mean; its weight in pages comes from the
spread between the groups of that level (one-way analysis of variance).  A host is blocked when
its bad rate exceeds ``max_bad`` with posterior probability ``confidence``, that is, when the lower
posterior bound lies above the limit.  Everything is DataFrame functions.

The registered domain is the longest public suffix of the host and the label before it, without user name, port and final
dot.  Suffixes of several labels come from a bounded table, a parameter; any other last label is a suffix.  An IP address
is a domain of its own, and all of them share the suffix ``ADDRESS``.

Pages with a NULL or empty url share the empty host.  Urls of any length are taken whole.  Repeated rows get a row each, and an empty
table an empty result.  Other columns of ``pages`` are not read, so that they cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fellscape.llm.common import broadcast_if_small
from fellscape.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = 400


# Public suffixes of several labels, registries first, then shared hosting.
SUFFIXES = tuple("""ac.at ac.il ac.jp ac.kr ac.nz ac.uk ac.za co.at co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn
com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pl com.sa com.sg com.tr com.tw com.ua com.vn edu.au edu.cn edu.pl edu.tr gob.mx gov.au
gov.br gov.cn gov.in gov.uk govt.nz ne.jp net.au net.br net.cn net.in net.nz net.uk or.at or.jp or.kr org.au org.br org.cn org.in org.nz org.uk
org.za sch.uk
appspot.com azurewebsites.net blogspot.com cloudfront.net firebaseapp.com github.io gitlab.io herokuapp.com netlify.app pages.dev
readthedocs.io s3.amazonaws.com vercel.app web.app wordpress.com""".split())
ADDRESS = "(address)"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Production rules.
RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"),
         UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Reputation:
    max_bad: float = 0.5
    confidence: float = 0.95
    min_weight: float = 1.0
    max_weight: float = 1000.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[UrlRule], value: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits the columns ``host`` and ``path``, else NULL."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def name_of(host: Column) -> Column:
    """The host without user name, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^(\[.*|[0-9]{1,3}([.][0-9]{1,3}){3})$")


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest public suffix: one lookup in the table per number of labels."""
    name = name_of(host)
    out = F.substring_index(name, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(name, ".", -labels)
        out = F.when(end.isin([s for s in suffixes if s.count(".") + 1 == labels]), end).otherwise(out)
    return F.when(is_address(name), F.lit(ADDRESS)).otherwise(out)


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Registered domain: the public suffix and one label before it; a suffix or an address alone is its own."""
    name, suffix = name_of(host), suffix_of(host, suffixes)
    before = F.substring_index(F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1), ".", -1)
    return F.when(is_address(name) | (name == suffix), name).otherwise(F.concat(before, F.lit("."), suffix))


def prior_weight(groups: DataFrame, settings: Reputation) -> Column:
    """Aggregate expression: weight in pages of the prior of groups with counts ``n`` and ``b``."""
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    used = F.col("n") > 0
    m, total, squares = F.count(F.when(used, 1)), F.sum(n), F.sum(n * n)
    within = F.sum(F.when(used, b * (1 - b / n)))
    between = F.sum(F.when(used, b * b / n)) - F.sum(b) * F.sum(b) / total
    msb, msw = between / (m - 1), within / (total - m)
    n0 = (total - squares / total) / (m - 1)
    rho = (msb - msw) / (msb + (n0 - 1) * msw)
    weight = F.when((m > 1) & (total > m) & (rho > 0), (1 - rho) / rho).otherwise(F.lit(settings.max_weight))
    return F.greatest(F.lit(settings.min_weight), F.least(F.lit(settings.max_weight), weight))


def exceeds(a: str, b: str, limit: float) -> Column:
    """P(x > limit) for x of the distribution Beta(a, b), summed over ``STEPS`` steps of asin(sqrt(x)).

    The steps cover eight standard deviations either side of the mean, so that the sum is
    as good for ten pages as for a billion.
    """
    return F.expr(f"""
        element_at(transform(array(named_struct('t', asin(sqrt({a} / ({a} + {b}))), 's', 4 / sqrt({a} + {b}))), o ->
          element_at(transform(array(named_struct('lo', greatest(0D, o.t - o.s), 'hi', least(pi() / 2, o.t + o.s))), r ->
            aggregate(sequence(0, {STEPS - 1}), named_struct('all', 0D, 'above', 0D),
              (acc, i) -> element_at(transform(array(r.lo + (r.hi - r.lo) * (i + 0.5D) / {STEPS}), t ->
                element_at(transform(array(exp(
                    (2 * {a} - 1) * (ln(sin(t)) - ln(sin(greatest(o.t, 1e-9D)))) +
                    (2 * {b} - 1) * (ln(cos(t)) - ln(cos(least(o.t, pi() / 2 - 1e-9D)))))), w ->
                  named_struct('all', acc.all + w, 'above', acc.above + IF(sin(t) * sin(t) > {limit}D, w, 0D))), 1)), 1),
              acc -> acc.above / acc.all)), 1)), 1)""")


def hosts(pages: DataFrame, outcomes: DataFrame, settings: Reputation = Reputation(), suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``host, n, b, verdict``: every host with its labelled and bad pages.

    ``pages`` has ``page_id, host``; ``outcomes`` has ``page_id, bad`` (0 or 1), one row per page.
    """
    joined = pages.select("page_id", "host").join(outcomes, "page_id", "left")
    counts = cut(joined.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b"))
                 .withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    by_domain = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    top = by_suffix.agg(((F.sum("b") + 0.5) / (F.sum("n") + 1)).alias("mean"), prior_weight(by_suffix, settings).alias("k"))

    def shrunk(groups: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
        """Posterior mean of each group under its parent's mean (one row of ``mean, k`` by key)."""
        joined = groups.join(parent, key) if key else groups.join(F.broadcast(parent))
        return joined.withColumn("mean", (F.col("b") + F.col("k") * F.col("mean")) / (F.col("n") + F.col("k"))).drop("k")

    def with_weight(parent: DataFrame, groups: DataFrame) -> DataFrame:
        """The weight is one number per level: an aggregate of a single row."""
        return parent.join(F.broadcast(groups.agg(prior_weight(groups, settings).alias("k"))))

    suffixes = shrunk(by_suffix, top, [])
    domains = shrunk(by_domain, with_weight(suffixes.select("suffix", "mean"), by_domain), ["suffix"])
    prior = with_weight(domains.select("domain", "suffix", "mean"), counts)
    rated = cut(counts.join(prior, ["domain", "suffix"]).select(
        "host", "n", "b", (F.col("b") + F.col("k") * F.col("mean")).alias("bad"),
        (F.col("n") - F.col("b") + F.col("k") * (1 - F.col("mean"))).alias("good")))
    blocked = exceeds("bad", "good", settings.max_bad) >= settings.confidence
    return rated.select("host", "n", "b", F.when(blocked, "block").otherwise("allow").alias("host_verdict"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """A page is bad if any of its labels says low quality or toxic; rows without an id or label are left out."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).cast("int").alias("bad"))
            .where("bad is not null"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[UrlRule] = RULES, settings: Reputation = Reputation(),
          suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's labelled pages, a row per row of ``pages``.

    A NULL url, or one without ``://``, has an empty host and path; such pages share one reputation.
    Without labels no host is blocked, as the prior mean of one half never exceeds the limit surely.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rated = cut(hosts(urls, outcomes_of(labels), settings, suffixes))
    return (urls.join(broadcast_if_small(rated), "host")
            .select("page_id", "host", "path", rule_of(rules, "name").alias("rule"),
                    F.coalesce(rule_of(rules, "verdict"), "host_verdict").alias("verdict"),
                    F.col("n").alias("host_labelled"), F.col("b").alias("host_bad")))


SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS b, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name
      FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY host),
e AS (SELECT *, regexp_full_match(name, '\[.*|[0-9]{1,3}([.][0-9]{1,3}){3}') AS address, string_split(name, '.') AS labels FROM c),
f AS (SELECT *, CASE WHEN array_to_string(labels[-3:], '.') IN (@3) THEN 3 WHEN array_to_string(labels[-2:], '.') IN (@2) THEN 2 ELSE 1 END AS m FROM e),
h AS (SELECT host, n, b, CASE WHEN address THEN name ELSE array_to_string(labels[-(m + 1):], '.') END AS domain,
             CASE WHEN address THEN '(address)' ELSE array_to_string(labels[-m:], '.') END AS suffix FROM f),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM d GROUP BY ALL),
lv AS (SELECT 1 AS l, n, b FROM s UNION ALL SELECT 2, n, b FROM d UNION ALL SELECT 3, n, b FROM h),
mo AS (SELECT l, count(CASE WHEN n > 0 THEN 1 END) AS m, sum(n)::DOUBLE AS t, sum(n::DOUBLE * n) AS q, sum(b)::DOUBLE AS bb,
              sum(CASE WHEN n > 0 THEN b * (1 - b::DOUBLE / n) END) AS w, sum(CASE WHEN n > 0 THEN b::DOUBLE * b / n END) AS g FROM lv GROUP BY l),
va AS (SELECT l, m, t, (g - bb * bb / nullif(t, 0)) / nullif(m - 1, 0) AS msb, w / nullif(t - m, 0) AS msw,
              (t - q / nullif(t, 0)) / nullif(m - 1, 0) AS n0 FROM mo),
rh AS (SELECT l, m, t, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho FROM va),
k AS (SELECT l, greatest(1.0, least(1000.0, CASE WHEN m > 1 AND t > m AND rho > 0 THEN (1 - rho) / rho ELSE 1000.0 END)) AS k FROM rh),
g0 AS (SELECT (sum(b) + 0.5) / (sum(n) + 1) AS mean FROM s),
sm AS (SELECT suffix, (b + k * g0.mean) / (n + k) AS mean FROM s, g0, k WHERE l = 1),
dm AS (SELECT domain, d.suffix, (b + k * sm.mean) / (n + k) AS mean FROM d JOIN sm USING (suffix), k WHERE l = 2),
hm AS (SELECT host, n, b, b + k * dm.mean AS x, n - b + k * (1 - dm.mean) AS y FROM h JOIN dm USING (domain, suffix), k WHERE l = 3),
gr AS (SELECT host, n, b, x, y, asin(sqrt(x / (x + y))) AS t0,
              greatest(0, asin(sqrt(x / (x + y))) - 4 / sqrt(x + y)) AS lo, least(pi() / 2, asin(sqrt(x / (x + y))) + 4 / sqrt(x + y)) AS hi FROM hm),
pt AS (SELECT host, n, b, x, y, t0, lo + (hi - lo) * (i + 0.5) / 400 AS t FROM gr, range(400) r(i)),
wt AS (SELECT host, n, b, t, exp((2 * x - 1) * (ln(sin(t)) - ln(sin(greatest(t0, 1e-9)))) + (2 * y - 1) * (ln(cos(t)) - ln(cos(least(t0, pi() / 2 - 1e-9))))) AS w FROM pt),
v AS (SELECT host, n, b, CASE WHEN sum(CASE WHEN sin(t) * sin(t) > 0.5 THEN w ELSE 0 END) / sum(w) >= 0.95 THEN 'block' ELSE 'allow' END AS verdict FROM wt GROUP BY host, n, b),
ru AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE v.verdict END AS verdict,
       v.n AS host_labelled, v.b AS host_bad
FROM ru JOIN v USING (host)
"""
for _labels in (2, 3):
    SQL = SQL.replace(f"@{_labels}", ", ".join(f"'{x}'" for x in SUFFIXES if x.count(".") + 1 == _labels))
