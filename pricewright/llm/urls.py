"""URL filters: rules by host and path, and host reputations shrunk through beta-binomial priors. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Hosts broadcast at most; with more, the join is a shuffled one.
BROADCAST_HOSTS = 500_000
#: Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
#: The rules of the production query: action, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is blocked if the lower bound of its share of bad pages is above this many times the share of all labelled pages.
EXCESS = 1.1
#: Standard deviations from the posterior mean to the bound.
BOUND = 1.282


def host_and_path(url) -> tuple[Column, Column]:
    """Columns: the host, A-Z in lower case, and the path of a url; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules, host="host", path="path") -> Column:
    """Column: (rule, action) of the longest rule whose host is the url's or above it and whose path starts the url's, else null."""
    found = None
    for action, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))) & F.startswith(F.col(path), F.lit(start))
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,action:string>")


def registered(host="host") -> Column:
    """Column: the registered domain of a host; addresses and single labels are their own."""
    name = F.regexp_replace(host, r":\d*$", "")
    labels = F.split(name, r"\.")
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    out = F.when(name.rlike(r"^[\d.]*$|^\[") | (F.size(labels) <= 2), name)
    return out.when(tail(2).isin(*LONG_SUFFIXES) & (F.size(labels) >= 3), tail(3)).otherwise(tail(2))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad): labelled pages of each host (page_id is a label's doc_id) and those of low quality or toxic, one of a page's labels being enough."""
    bad = F.max(F.when((F.col("quality") <= 0) | (F.col("toxic") > 0), 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(bad.alias("bad"))
    return pages.join(marks, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


def overall(hosts: DataFrame):
    """Column: the share of bad pages among all labelled ones, one more of each kind counted in."""
    total = hosts.agg(F.sum("bad"), F.sum("n")).first()
    return F.lit(((total[0] or 0) + 1) / ((total[1] or 0) + 2))


def reputations(hosts: DataFrame, bound: float = BOUND) -> DataFrame:
    """(host, n, bad, mean, lower): for each of ``hosts`` (host, n, bad) the posterior mean and lower bound of its share of bad pages.

    A level's groups get beta priors around the posterior mean of the group above: all, suffix, registered domain,
    host. The strength of a level's priors comes from how far its groups scatter beyond binomial chance (moments,
    one aggregate of three numbers a level), kept from 1 to 1,000 pages. The bound is the posterior mean less
    ``bound`` standard deviations. The groups above are broadcast where hosts were counted and are few, so that a
    suffix that most hosts have is no key of a shuffle; beyond that Spark splits it.
    """
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    d = hosts.withColumn("domain", registered()).withColumn("suffix", F.regexp_replace("domain", r"^[^.]*\.", ""))
    mean, above = overall(hosts), None
    for level in ("suffix", "domain", "host"):
        keys = {"suffix": ["suffix"], "domain": ["suffix", "domain"], "host": ["suffix", "domain", "host"]}[level]
        groups = d.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if above is None:
            groups = groups.withColumn("m", mean)
        else:
            groups = groups.join(F.broadcast(above) if few else above, keys[:-1])
        groups = written(groups, "reputations")
        even = F.col("m") * (1 - F.col("m"))
        got = groups.agg(F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 - F.col("n") * even), F.sum(F.col("n") * (F.col("n") - 1) * even)).first()
        rho = min(0.5, max(1 / 1001, (got[0] or 0.0) / got[1] if got[1] else 0.0))
        strength = 1 / rho - 1
        a = F.col("m") * strength + F.col("bad")
        b = (1 - F.col("m")) * strength + F.col("n") - F.col("bad")
        if level != "host":
            above = groups.select(*keys, (a / (a + b)).alias("m"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return groups.select("host", "n", "bad", (a / (a + b)).alias("mean"), (a / (a + b) - bound * deviation).alias("lower"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, excess: float = EXCESS, bound: float = BOUND) -> DataFrame:
    """page_id, host, path, rule, verdict, and host_n, host_bad, host_mean, host_lower of every page.

    A fitting rule decides, else the host is blocked if the lower posterior bound of its share of bad pages is above
    ``excess`` times the share of all labelled pages. The host's labelled and bad pages, posterior mean and bound are
    given with the verdict. Counts are combined before hosts meet, so a hot host moves one row a task; the verdicts of
    hosts go back to pages by broadcast if they are few (counted), else by a join whose hot keys Spark splits.

    Null urls and urls without ``://`` have an empty host and path, and are judged as pages of the host ''.
    Repeated rows and null ids: a row for each. Empty tables: no rows, or no labels and nothing blocked beyond
    rules. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = p.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    hosts = hosts.unionByName(outcomes(p, labels)).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = written(hosts, "hosts")
    bad_host = F.col("lower") > excess * overall(hosts)
    known = reputations(hosts, bound).select("host", F.col("n").alias("host_n"), F.col("bad").alias("host_bad"), F.col("mean").alias("host_mean"), F.col("lower").alias("host_lower"), bad_host.alias("bad_host"))
    known = written(known, "verdicts")
    few = known.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    p = p.withColumn("r", fitting_rule(rules)).join(F.broadcast(known) if few else known, "host")
    verdict = F.coalesce("r.action", F.when(F.col("bad_host"), "block").otherwise("allow"))
    rest = [F.round(c, 6).alias(c) for c in ("host_mean", "host_lower")]
    return p.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "host_n", "host_bad", *rest)


def judged_sql(rules=RULES, excess: float = EXCESS, bound: float = BOUND) -> str:
    ruled = ", ".join(f"('{a}', '{h}', '{s}')" for a, h, s in rules)
    level = lambda name, keys, above, mean: f"""
{name}0 AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
{name}1 AS (SELECT x.*, {mean} AS m FROM {name}0 x {above}),
{name}2 AS (SELECT 1 / least(0.5, greatest(1 / 1001, CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN sum((bad - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 0 END)) - 1 AS k FROM {name}1),
{name} AS (SELECT x.*, m * k + bad AS a, (1 - m) * k + n - bad AS b FROM {name}1 x, {name}2)"""  # noqa: E731
    return f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
marks AS (SELECT doc_id, max(CASE WHEN quality <= 0 OR toxic > 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
n0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(host, ':[0-9]*$', '') AS name FROM p LEFT JOIN marks ON page_id = doc_id GROUP BY 1),
n1 AS (SELECT host, n, bad, name, string_split(name, '.') AS l FROM n0),
n2 AS (SELECT host, n, bad, CASE WHEN regexp_matches(name, '^[0-9.]*$|^\\[') OR len(l) <= 2 THEN name
   WHEN array_to_string(l[-2:], '.') IN {LONG_SUFFIXES} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM n1),
d AS (SELECT *, regexp_replace(domain, '^[^.]*\\.', '') AS suffix FROM n2),
o AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS share FROM d),
{level("s", "suffix", "", "(SELECT share FROM o)")},
{level("r", "suffix, domain", "JOIN s USING (suffix)", "s.a / (s.a + s.b)")},
{level("h", "suffix, domain, host", "JOIN r USING (suffix, domain)", "r.a / (r.a + r.b)")},
v AS (SELECT host, n::BIGINT AS host_n, bad::BIGINT AS host_bad, a / (a + b) AS mean, a / (a + b) - {bound} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM h),
rules(action, name, start) AS (VALUES {ruled}),
f AS (SELECT host, path, max_by(name || start, length(name || start)) AS rule, max_by(action, length(name || start)) AS action
      FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN lower > {excess} * share THEN 'block' ELSE 'allow' END) AS verdict,
  host_n, host_bad, round(mean, 6) AS host_mean, round(lower, 6) AS host_lower
FROM o, p JOIN v USING (host) LEFT JOIN f ON f.host = p.host AND f.path = p.path
"""
