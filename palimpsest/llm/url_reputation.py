"""URL filters: rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (bad or good) are counted by host, registered domain and suffix.
Each level's rate is shrunk towards the level above through a beta prior whose strength
comes from the spread of the rates themselves (method of moments); the suffixes are
shrunk towards the overall rate.  A page is blocked if the lower bound of its host's
posterior bad rate is above the rate that is still accepted.

No list of public suffixes is at hand.  The suffix of a host is its last label, or its
last two where a country code follows one of `SECOND` (co.uk), and the registered domain
has one label more.  A user name, port or final dot is no part of either; an address in
numbers is a domain of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, salted_join, stored, table

#: (host, path, verdict) of the registered query; fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Labels under which countries register domains.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without a scheme or url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.?$", "")
    parts = F.split(name, r"\.")
    k = F.when(F.element_at(parts, -1).rlike("^[a-z]{2}$") & F.coalesce(F.get(parts, F.size(parts) - 2).isin(SECOND), F.lit(False)), 2).otherwise(1)
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")
    numbers = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(numbers, name).otherwise(last(k + 1)), F.when(numbers, "").otherwise(last(k))


def rules_of_hosts(hosts: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """host and rules (array of size, rule, verdict, path) of the hosts that any rule fits.

    hosts: host, distinct.  A host meets the rules of each of its domains by a join, so
    the list of rules may be of any length.
    """
    if not isinstance(rules, DataFrame):
        rules = hosts.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    size = (F.length("host") + F.length("path")).alias("size")
    named = rules.groupBy(F.col("host").alias("at")).agg(F.collect_set(F.struct(size, F.concat("host", "path").alias("rule"), "verdict", "path")).alias("rules"))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = salted_join(hosts.select("host", F.explode(F.array_distinct(above)).alias("at")), named, ["at"], "host")
    return met.where("rules is not null").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def _shrunk(groups: DataFrame, least: float) -> DataFrame:
    """alpha, beta and rate of each group (n, bad, prior); one prior strength for the level.

    Strength by moments: with rates r around priors p, var = mean (r - p)^2 exceeds the
    binomial part by p (1 - p) / (strength + 1).  Kept within [least, 1e6].
    """
    p = F.col("prior")
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2))
    noise = F.sum(p * (1 - p))
    total = F.sum(F.col("n") * p * (1 - p))
    seen = groups.where("n > 0").agg(spread.alias("spread"), noise.alias("noise"), total.alias("total"))
    excess = (F.col("spread") - F.col("noise")) / F.nullif(F.col("total") - F.col("noise"), F.lit(0.0))
    strength = F.coalesce(F.when(excess <= 1e-6, 1e6).otherwise(F.greatest(F.lit(least), 1 / F.least(excess, F.lit(1.0)) - 1)), F.lit(least))
    # one row: an aggregate without keys
    out = groups.crossJoin(F.broadcast(seen.select(strength.alias("strength"))))
    out = out.withColumns({"alpha": F.col("strength") * p + F.col("bad"), "beta": F.col("strength") * (1 - p) + F.col("n") - F.col("bad")})
    return out.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, least: float = 2.0) -> DataFrame:
    """host, n, bad, alpha, beta for every host of hosts (host).

    outcomes: host, bad (0 or 1), a row a labelled page; rows without outcome are ignored.
    Hosts without labels have their domain's rate as mean.  Each level is stored, so the
    tables above it are read once.
    """
    labelled = outcomes.where("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    every = hosts.select("host").distinct().join(labelled, "host", "left").fillna(0, ["n", "bad"])
    every = stored(every.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = stored(every.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    overall = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("prior"))
    rates = _shrunk(suffixes.crossJoin(F.broadcast(overall)), least).select("suffix", F.col("rate").alias("prior"))
    domains = stored(salted_join(domains, rates, ["suffix"], "domain"), "domains")
    rates = _shrunk(domains, least).select("domain", F.col("rate").alias("prior"))
    every = stored(salted_join(every, rates, ["domain"], "host"), "hosts")
    return _shrunk(every, least).select("host", "n", "bad", "alpha", "beta")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, accepted: float = 0.3, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound of every row of pages (page_id, url).

    outcomes: page_id, bad (0 or 1); several labels of one page count each, rows without a
    label are ignored.  rules: (host, path, verdict) as a list or table.  The bound is the
    posterior mean less z deviations.  A url that is null or has no `://` has an empty
    host, which is judged like any other; repeated pages give a row each; a null page_id
    meets no label; an empty table gives no rows; other columns are left out, whatever
    their names; a url of any length is one value of an expression.
    """
    host, path = split_url(F.col("url"))
    judged = stored(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    of_host = judged.join(outcomes.select("page_id", "bad"), "page_id").select("host", "bad")
    reputation = host_reputation(judged.select("host"), of_host)
    a, b = F.col("alpha"), F.col("beta")
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    reputation = stored(reputation.select("host", (a / (a + b)).alias("bad_rate"), bound.alias("bound")), "reputation")
    known = stored(reputation.join(rules_of_hosts(reputation.select("host"), rules), "host", "left"), "reputation")
    # page_id spreads the pages of a large host
    out = salted_join(judged, known, ["host"], "path")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    rule = hidden(out, "best_rule")
    out = out.withColumn(rule, F.array_max(fits))
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col("bound") > accepted, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col(f"{rule}.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bound")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the ids; a page is bad if labelled toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.coalesce("toxic", "quality").isNotNull(), 0).alias("bad"))
    out = judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)
    return out.withColumns({c: F.round(c, 9) for c in ("bad_rate", "bound")})


def _level(groups: str, name: str) -> str:
    """Tables {name}_p and {name}_r in SQL: prior strength, and alpha, beta and rate, of groups with n, bad, prior."""
    return f"""
{name}_m AS (SELECT sum(n * pow(bad / n - prior, 2)) AS spread, sum(prior * (1 - prior)) AS noise, sum(n * prior * (1 - prior)) AS total FROM {groups} WHERE n > 0),
{name}_e AS (SELECT (spread - noise) / nullif(total - noise, 0) AS excess FROM {name}_m),
{name}_p AS (SELECT coalesce(CASE WHEN excess <= 1e-6 THEN 1e6 ELSE greatest(2.0, 1 / least(excess, 1.0) - 1) END, 2.0) AS strength FROM {name}_e),
{name}_r AS (SELECT g.*, strength * prior + bad AS alpha, strength * (1 - prior) + n - bad AS beta FROM {groups} g, {name}_p)"""


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
o AS (SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN coalesce(toxic, quality) IS NOT NULL THEN 0 END AS bad FROM labels),
c AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY host),
x AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.?$', '') AS name FROM c),
y AS (SELECT *, string_split(name, '.') AS parts FROM x),
z AS (SELECT *, CASE WHEN regexp_matches(parts[-1], '^[a-z]{{2}}$') AND len(parts) > 1 AND parts[-2] IN ({", ".join(f"'{c}'" for c in SECOND)}) THEN 2 ELSE 1 END AS k, regexp_matches(name, '^[0-9.]+$|^\[') AS numbers FROM y),
h AS (SELECT host, n, bad, CASE WHEN numbers THEN name ELSE array_to_string(parts[greatest(1, len(parts) - k):], '.') END AS domain, CASE WHEN numbers THEN '' ELSE array_to_string(parts[greatest(1, len(parts) - k + 1):], '.') END AS suffix FROM z),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM h) AS prior FROM h GROUP BY suffix),
{_level("s", "s")},
d AS (SELECT domain, suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s_r.alpha / (s_r.alpha + s_r.beta)) AS prior FROM h JOIN s_r USING (suffix) GROUP BY domain, suffix),
{_level("d", "d")},
e AS (SELECT h.host, h.n, h.bad, d_r.alpha / (d_r.alpha + d_r.beta) AS prior FROM h JOIN d_r USING (domain)),
{_level("e", "e")},
t(rule_host, rule_path, verdict) AS (VALUES {_VALUES}),
best AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict FROM u JOIN t ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k),
v AS (SELECT u.*, rule, best.verdict AS said, alpha / (alpha + beta) AS rate, alpha / (alpha + beta) - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bound FROM u JOIN e_r USING (host) LEFT JOIN best USING (k))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 9) AS bad_rate, round(bound, 9) AS bound FROM v
"""
