"""URL filters: fixed host and path rules, then empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

# Labels that, before a country's two letters, make a public suffix of two labels (co.uk, com.au).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gob", "gov", "gouv", "go", "mil", "ne", "net", "nom", "or", "org"]
# Strengths of a prior (pseudo-counts) that are tried, from units that have little in common to equal ones.
STRENGTHS = [2.0**i for i in range(-2, 11)]

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path prefix); null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest ends up as the outermost test
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port is left out of both."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    second = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit(""))
    n = F.when((F.length(F.element_at(labels, -1)) == 2) & second.isin(SECOND_LEVEL), 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return F.when(n == 2, tail(3)).otherwise(tail(2)), F.when(n == 2, tail(2)).otherwise(tail(1))


def log_gamma(x: Column) -> Column:
    """Stirling's series behind six steps of the recurrence."""
    y = x + 6
    series = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def best_strength(units: DataFrame) -> float:
    """Of STRENGTHS the likeliest, from units (n, k, prior): k of n outcomes each, beta-binomial around its own prior rate."""
    n, k, s = F.col("n"), F.col("k"), F.col("s")
    a = s * F.col("prior")
    b = s - a
    likelihood = log_gamma(k + a) - log_gamma(a) + log_gamma(n - k + b) - log_gamma(b) - log_gamma(n + s) + log_gamma(s)
    tried = units.select("n", "k", "prior", F.explode(F.array(*map(F.lit, STRENGTHS))).alias("s"))
    found = tried.groupBy("s").agg(F.sum(likelihood).alias("l")).collect()  # one row a strength
    return max(((r["l"], -r["s"]) for r in found), default=(0.0, -1.0))[1] * -1


def shrunk(k: Column, n: Column, strength: float, prior: Column) -> Column:
    return (k + strength * prior) / (n + strength)


class Reputation:
    """Posteriors of hosts, registered domains and suffixes: tables (unit, a, b, mean) of their beta distributions.

    Three beta-binomial levels: a host is shrunk to its domain, a domain to its
    suffix, a suffix to the overall rate. The strength of each level's prior is
    the likeliest one over all its units. A unit's prior comes from the others
    above it only (its own outcomes are taken out), and n outcomes of one unit
    count above as n (s + 1) / (n + s), their worth as one draw of strength s: a
    hundred pages of one host say little of its neighbours unless hosts agree.
    a and b of a domain or suffix are those of a new unit below it.
    """

    def __init__(self, outcomes: DataFrame):
        scratch = Scratch(outcomes.sparkSession, "urls")
        domain, suffix = domain_of(F.col("host"))
        hosts = outcomes.where("host <> ''").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
        hosts = scratch.save(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
        total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
        overall = (total[1] + 1) / (total[0] + 2)
        keys = ["host", "domain", "suffix"]
        # First without strengths: what the rest of the level above says, each step smoothed by one outcome.
        sums = lambda by: hosts.groupBy(by).agg(F.sum("n").alias(f"n_{by}"), F.sum("k").alias(f"k_{by}"))
        rest = lambda of, by, up: (F.col(f"k_{by}") - F.col(f"k_{of}") + up) / (F.col(f"n_{by}") - F.col(f"n_{of}") + 1)
        domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_domain"), F.sum("k").alias("k_domain")).join(sums("suffix"), "suffix")
        domains = domains.withColumns({"n_all": F.lit(total[0]), "k_all": F.lit(total[1])}).withColumn("above", rest("suffix", "all", F.lit(overall)))
        domains = domains.withColumn("prior", rest("domain", "suffix", F.col("above")))
        first = hosts.join(domains.select("domain", "n_domain", "k_domain", F.col("prior").alias("above")), "domain")
        s_host = best_strength(first.select("n", "k", ((F.col("k_domain") - F.col("k") + F.col("above")) / (F.col("n_domain") - F.col("n") + 1)).alias("prior")))
        s_domain = best_strength(domains.select(F.col("n_domain").alias("n"), F.col("k_domain").alias("k"), "prior"))
        suffixes = domains.select("suffix", F.col("n_suffix").alias("n"), F.col("k_suffix").alias("k"), F.col("above").alias("prior")).distinct()
        s_suffix = best_strength(suffixes)
        # Then the worth of each unit's outcomes to the level above.
        worth = lambda n, s: (s + 1) / (F.col(n) + s)
        hosts = hosts.withColumn("w", worth("n", s_host)).withColumns({"n_e": F.col("n") * F.col("w"), "k_e": F.col("k") * F.col("w")})
        domains = hosts.groupBy("domain", "suffix").agg(F.sum("n_e").alias("n_d"), F.sum("k_e").alias("k_d"))
        domains = domains.withColumn("w", worth("n_d", s_domain)).withColumns({"n_e": F.col("n_d") * F.col("w"), "k_e": F.col("k_d") * F.col("w")})
        suffixes = domains.groupBy("suffix").agg(F.sum("n_e").alias("n_s"), F.sum("k_e").alias("k_s"))
        domains = scratch.save(domains.join(suffixes, "suffix"), "domains")
        top = F.lit(overall)
        # The domain's own share is taken out of its suffix's, and the host's out of its domain's.
        apart = shrunk(F.col("k_s") - F.col("k_e"), F.col("n_s") - F.col("n_e"), s_suffix, top)
        hosts = hosts.select("host", "domain", "n", "k", F.col("n_e").alias("n_h"), F.col("k_e").alias("k_h")).join(domains.select("domain", "n_d", "k_d", apart.alias("above")), "domain")
        prior = shrunk(F.col("k_d") - F.col("k_h"), F.col("n_d") - F.col("n_h"), s_domain, F.col("above"))
        self.hosts = hosts.select("host", "n", F.col("k").alias("bad"), (F.col("k") + s_host * prior).alias("a"), (F.col("n") - F.col("k") + s_host * (1 - prior)).alias("b"))
        below = lambda mean, s: [(s * mean).alias("a"), (s * (1 - mean)).alias("b")]
        self.domains = domains.select("domain", *below(shrunk(F.col("k_d"), F.col("n_d"), s_domain, apart), s_host))
        self.suffixes = domains.select("suffix", *below(shrunk(F.col("k_s"), F.col("n_s"), s_suffix, top), s_domain)).distinct()
        self.overall = (overall, s_suffix)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], *, max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_bound) for every row of pages; outcomes: rows (page_id, bad).

    A fitting rule decides (the longest wins); otherwise a host is blocked when
    even the lower posterior bound of its bad rate (mean - z standard deviations)
    is above max_bad. A host without outcomes has the posterior of a new host of
    its domain, one of an unknown domain that of a new domain of its suffix, and
    one of an unknown suffix that of a new suffix.

    Null url or none with ://: host and path empty, and no host to judge: allow.
    Repeated rows and null page ids: each row judged alone; repeated outcomes of
    a page: bad if one is. Very long urls: whole. Empty outcomes: only rules
    block. Empty pages: no rows. Other columns of pages are left out.
    """
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    found = Reputation(seen.join(known, "page_id").select("host", "bad"))
    domain, suffix = domain_of(F.col("host"))
    # One row a host, so that pages of one host, however many, are judged from a table of hosts.
    named = seen.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    rated = named.join(found.hosts.select("host", F.struct("a", "b").alias("own")), "host", "left")
    rated = rated.join(found.domains.select("domain", F.struct("a", "b").alias("up")), "domain", "left")
    rated = rated.join(found.suffixes.select("suffix", F.struct("a", "b").alias("top")), "suffix", "left")
    overall, s = found.overall
    beta = F.coalesce("own", "up", "top", F.struct(F.lit(s * overall).alias("a"), F.lit(s * (1 - overall)).alias("b")))
    mean = F.col("beta.a") / (F.col("beta.a") + F.col("beta.b"))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("beta.a") + F.col("beta.b") + 1))
    rated = rated.where("host <> ''").withColumn("beta", beta).select("host", mean.alias("bad_mean"), bound.alias("bad_bound"))
    rule, ruled = first_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))
    return seen.join(rated, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_bound")
