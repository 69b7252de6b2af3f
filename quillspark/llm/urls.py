"""URL filter: fixed rules first, empirical-Bayes host reputation for the rest.

Pages that a rule decides are the labelled outcomes. Each host's share of good pages has a
beta prior around its registered domain's, that around its suffix's, and that around the
share of all; the strength of each level's prior comes from the spread of the counts below
it (method of moments). A page without a rule is blocked if the upper bound of its host's
posterior stays below `floor`: only credible evidence blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules become one expression, so there may only be so many.
MAX_RULES = 500
#: Standard deviations of the bound, and the good share that it has to reach.
Z, FLOOR = 1.6449, 0.5
#: Bounds of the correlation of outcomes inside a group.
RHO = (0.001, 0.999)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


#: Second-level labels under which a country registers names, as in co.uk.
SECOND = "(?:ac|co|com|edu|gov|net|org)[.][a-z]{2}"
ADDRESS = r"^[0-9]+(?:[.][0-9]+){3}\z"
DOMAIN, SUFFIX = rf"(?:^|[.])([^.]*[.](?:{SECOND}|[^.]*))\z", rf"(?:^|[.])({SECOND}|[^.]*)\z"


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user, port and closing dot; an IPv4 address is both."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^(?s:.*)@", ""), r"[.]?(?::[0-9]*)?\z", "")
    part = lambda p: F.when(bare.rlike(ADDRESS), bare).otherwise(F.coalesce(F.nullif(F.regexp_extract(bare, p, 1), F.lit("")), bare))
    return part(DOMAIN), part(SUFFIX)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength from the spread of good pages around the mean that the level above gives."""
    m = F.col(mean)
    over, within, pairs = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * m, 2)), F.sum(F.col("n") * m * (1 - m)), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    ).first()
    rho = (over - within) / pairs if pairs else RHO[1]
    return 1 / min(RHO[1], max(RHO[0], rho)) - 1


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, z: float = Z, floor: float = FLOOR, outcomes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and good, n and upper (the host's outcomes and bound).

    outcomes: page_id and good (0/1) of labelled pages; without it, pages with a rule are
    labelled by the rule. A url that is null or without `://` has an empty host, which counts
    as one host of its own. Rows with null or repeated page_id each give a row; an empty table
    an empty result. Where nothing is labelled the share of good pages counts as one half.
    """
    ws = Workspace(spark)
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    label = (F.col("fit.verdict") == "allow").cast("long")
    seen = rows
    if outcomes is not None:
        known = outcomes.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min(F.col("good").cast("long")).alias("known"))
        seen, label = rows.join(known, "page_id", "left"), F.col("known")
    hosts = seen.groupBy("host").agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("good"))
    domain, suffix = registered(F.col("host"))
    hosts = ws.table("hosts", hosts.withColumns({"domain": domain, "suffix": suffix}))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    share = min(0.999, max(0.001, good / n)) if n else 0.5
    post = lambda s: (F.col("good") + s * F.col("above")) / (F.col("n") + s)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("above", F.lit(share))
    s = _strength(suffixes, "above")
    suffixes = suffixes.select("suffix", post(s).alias("above"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(suffixes, "suffix")
    s = _strength(domains, "above")
    domains = domains.select("domain", post(s).alias("above"))
    scored = hosts.join(domains, "domain")
    s = _strength(scored, "above")
    a, b = F.col("good") + s * F.col("above"), F.col("n") - F.col("good") + s * (1 - F.col("above"))
    scored = scored.select("host", "n", "good", a.alias("a"), b.alias("b"))
    t = F.col("a") + F.col("b")
    upper = F.col("a") / t + z * F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1)))
    scored = ws.table("scored", scored.select("host", "n", "good", upper.alias("upper")))
    out = rows.join(scored, "host")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("upper") < floor, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "good", "n", "upper")


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, source: str) -> str:
    return f"""
{name}_m AS (
  SELECT 1 / least({RHO[1]}, greatest({RHO[0]}, CASE WHEN sum(n * (n - 1) * above * (1 - above)) > 0
    THEN (sum(power(good - n * above, 2)) - sum(n * above * (1 - above))) / sum(n * (n - 1) * above * (1 - above)) ELSE {RHO[1]} END)) - 1 AS s FROM {source}
)"""


OP4_SQL = f"""
WITH raw AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM raw
), parts AS (
  SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts
), v AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS y FROM r
), bare AS (
  SELECT host, count(y) AS n, coalesce(sum(y), 0) AS good, regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), '[.]?(?::[0-9]*)?\\z', '') AS x FROM v GROUP BY host
), hosts AS (
  SELECT host, n, good, CASE WHEN regexp_matches(x, '{ADDRESS}') THEN x ELSE coalesce(nullif(regexp_extract(x, '{DOMAIN}', 1), ''), x) END AS domain,
    CASE WHEN regexp_matches(x, '{ADDRESS}') THEN x ELSE coalesce(nullif(regexp_extract(x, '{SUFFIX}', 1), ''), x) END AS suffix FROM bare
), share AS (
  SELECT CASE WHEN sum(n) > 0 THEN least(0.999, greatest(0.001, sum(good) / sum(n))) ELSE 0.5 END AS m FROM hosts
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS above FROM hosts, share GROUP BY suffix
), {_level("suffix", "suffixes")}, suffix_post AS (
  SELECT suffix, (good + s * above) / (n + s) AS above FROM suffixes, suffix_m
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(good) AS good, any_value(above) AS above FROM hosts JOIN suffix_post USING (suffix) GROUP BY suffix, domain
), {_level("domain", "domains")}, domain_post AS (
  SELECT domain, (good + s * above) / (n + s) AS above FROM domains, domain_m
), leaves AS (
  SELECT host, n, good, above FROM hosts JOIN domain_post USING (domain)
), {_level("host", "leaves")}, ab AS (
  SELECT host, good + s * above AS a, n - good + s * (1 - above) AS b FROM leaves, host_m
), bound AS (
  SELECT host, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM ab
)
SELECT page_id, host, path, rule, CASE y WHEN 1 THEN 'allow' WHEN 0 THEN 'block' ELSE CASE WHEN upper < {FLOOR} THEN 'block' ELSE 'allow' END END AS verdict
FROM v JOIN bound USING (host)
"""
