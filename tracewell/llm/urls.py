"""URL filters: rules by host and path, and the reputation of hosts by empirical Bayes where no rule fits.

Outcomes of labelled pages are counted by host, registered domain and suffix. The bad share of each is a beta-binomial
around its parent's posterior mean, suffixes around that of all; the concentration of a level is estimated from all of its
members by moments. A host whose posterior bound exceeds the limit is blocked.

Defined cases: a url that is null or has no ``://`` has the empty host and path, no rule fits it, and its host is known by
the overall share alone; a host without labelled pages takes its domain's share, a domain without any its suffix's; without
any labelled page all shares are one half and nothing is blocked. Urls are taken whole, of any length. Repeated rows, also
of one page_id, each count and each get a row; a null page_id stays null. Of rules that fit, the longest (host and path
together) wins, of equal rules block. Empty tables give empty results. Extra columns of the pages are left out, whatever
their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import lookup, materialize, table

#: The contract's rules (fixed values): host and path, verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Suffixes of more than one label under which domains are registered; pass a longer list where one is at hand.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.tw")
LIMIT = 0.5
CONFIDENCE = 0.8
#: Rows of one host are dealt among the square root of so many groups.
SALT = 1 << 20
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column | str) -> Column:
    found = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as ``rule_host, rule_path, decision`` from ``host/path`` texts."""
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], v) for r, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, decision string")


def by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls with ``host, path`` and the longest rule that fits: ``rule, decision``, else null.

    Rules meet each different host once, through the host's last labels, as many as a rule's host has; a url then looks
    through its host's own rules only.
    """
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda k: F.when(k <= F.size(labels), F.concat_ws(".", F.slice(labels, -k, k)))), lambda e: e.isNotNull())
    # a stable order: longest first, block before allow
    order = F.struct(-(F.length("rule_host") + F.length("rule_path")), F.col("decision") == "allow", F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "decision")
    fitting = urls.select("host").distinct().withColumn("rule_host", F.explode(ends if depth else F.array(F.lit("")))).join(rules.distinct(), "rule_host")
    fitting = fitting.groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("_rules"))
    found = lookup(urls, "host", fitting, [c for c in urls.columns if c != "host"], SALT)
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return found.withColumn("_rule", first).withColumn("rule", F.col("_rule")["rule"]).withColumn("decision", F.col("_rule")["decision"]).drop("_rules", "_rule")


def domain_and_suffix(host: Column | str, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix; ports don't count, an address of digits is a domain of its own under no suffix."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    last = lambda k: F.substring_index(name, ".", -k)
    suffix = F.when(name.rlike(r"^[0-9.]*$"), "").when(last(2).isin(*suffixes), last(2)).otherwise(last(1))
    domain = F.when(name.rlike(r"^[0-9.]*$"), name).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))
    return domain, suffix


def concentration(members: DataFrame) -> float:
    """Of beta-binomial members (``n`` labelled, ``bad`` of them) around their ``parent`` means, by moments over all."""
    chance = F.col("parent") * (1 - F.col("parent"))
    over, pairs = members.agg(F.sum((F.col("bad") - F.col("n") * F.col("parent")) ** 2 - F.col("n") * chance), F.sum(F.col("n") * (F.col("n") - 1.0) * chance)).first()
    alike = min(max(over / pairs, 0.001), 0.999) if pairs else 0.5
    return 1 / alike - 1


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, confidence: float = CONFIDENCE) -> DataFrame:
    """Each host of ``outcomes(host, bad boolean or null)``: ``labelled, bad_share, bound``.

    ``bad_share`` is the posterior mean, ``bound`` lies that many standard deviations below it which Cantelli's inequality
    asks for: the share exceeds it with the given probability at least. A null outcome only names a host.
    """
    domain, suffix = domain_and_suffix("host", suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    hosts = materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    level = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("parent", F.lit(((total[1] or 0) + 1) / ((total[0] or 0) + 2)))

    def mean(members: DataFrame, *keys: str) -> DataFrame:
        k = concentration(members)
        return members.select(*keys, ((F.lit(k) * F.col("parent") + F.col("bad")) / (F.lit(k) + F.col("n"))).alias("parent"))

    domains = materialize(lookup(domains, "suffix", mean(level, "suffix"), ["domain"], SALT), "domains")
    means = mean(domains, "domain", "suffix").select(F.struct("domain", "suffix").alias("_place"), "parent")
    placed = hosts.select("host", "n", "bad", F.struct("domain", "suffix").alias("_place"))
    hosts = materialize(lookup(placed, "_place", means, ["host"], SALT), "placed")
    k = F.lit(concentration(hosts))
    weight = k + F.col("n")
    hosts = hosts.select("host", F.col("n").alias("labelled"), ((k * F.col("parent") + F.col("bad")) / weight).alias("bad_share"), weight.alias("_weight"))
    away = math.sqrt(confidence / (1 - confidence))
    return hosts.select("host", "labelled", "bad_share", (F.col("bad_share") - away * F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("_weight") + 1))).alias("bound"))


def judge(pages: DataFrame, rules: DataFrame, outcomes: DataFrame | None = None, limit: float = LIMIT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, labelled, bad_share, bound``, a row per page.

    ``outcomes`` (host, bad) are labelled pages; without them the pages that a rule judges are the labelled ones.
    """
    urls = materialize(by_rules(pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")), rules), "urls")
    known = urls.select("host", (F.col("decision") == "block").alias("bad"))
    if outcomes is not None:
        known = outcomes.select("host", "bad").unionByName(urls.select("host", F.lit(None).cast("boolean").alias("bad")))
    found = lookup(urls, "host", reputation(known, confidence=confidence), ["page_id", "path"], SALT)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("decision", own).alias("verdict"), "labelled", F.round("bad_share", 6).alias("bad_share"), F.round("bound", 6).alias("bound"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def _sql() -> str:
    rules = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    away = math.sqrt(CONFIDENCE / (1 - CONFIDENCE))
    concentration = "1 / coalesce(least(greatest(sum((bad - n * parent) ** 2 - n * parent * (1 - parent)) / nullif(sum(n * (n - 1.0) * parent * (1 - parent)), 0), 0.001), 0.999), 0.5) - 1"
    return f"""
    WITH urls AS (
      SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
    rules(h, p, decision) AS (VALUES {rules}),
    ruled AS (
      SELECT r, any_value(page_id) AS page_id, any_value(urls.host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, arg_max(decision, length(h || p)) AS decision
      FROM urls LEFT JOIN rules ON (urls.host = h OR ends_with(urls.host, '.' || h)) AND starts_with(path, p) GROUP BY r),
    hosts AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(decision) AS n, count(*) FILTER (decision = 'block') AS bad FROM ruled GROUP BY ALL),
    split AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]*$') AS digits FROM hosts),
    placed AS (
      SELECT host, n, bad, CASE WHEN digits THEN '' WHEN array_to_string(l[-2:], '.') IN ({listed}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
             CASE WHEN digits THEN name WHEN array_to_string(l[-2:], '.') IN ({listed}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM split),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS parent FROM placed GROUP BY suffix),
    s1 AS (SELECT suffix, (k * parent + bad) / (k + n) AS parent FROM s0, (SELECT {concentration} AS k FROM s0)),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(s1.parent) AS parent FROM placed JOIN s1 USING (suffix) GROUP BY ALL),
    d1 AS (SELECT domain, suffix, (k * parent + bad) / (k + n) AS parent FROM d0, (SELECT {concentration} AS k FROM d0)),
    h0 AS (SELECT host, n, bad, parent FROM placed JOIN d1 USING (domain, suffix)),
    h1 AS (SELECT host, n AS labelled, (k * parent + bad) / (k + n) AS share, k + n AS w FROM h0, (SELECT {concentration} AS k FROM h0)),
    h2 AS (SELECT *, share - {away!r} * sqrt(share * (1 - share) / (w + 1)) AS low FROM h1)
    SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN low > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, labelled, round(share, 6) AS bad_share, round(low, 6) AS bound
    FROM ruled JOIN h2 USING (host)"""


SQL = _sql()
