"""URL filters: fixed rules first, then Empirical-Bayes reputation of the host.

Labelled pages are counted per host. The bad rate of a host is shrunk towards that
of its registered domain, the domain towards its suffix, the suffix towards all
pages; each level is a beta prior whose strength is estimated from the spread of
the level below (method of moments of the beta-binomial). The chain starts from
Jeffreys' prior, so a few labels of one kind prove little, and each level's variance
holds that of its parent's mean, as far as the parent decides: with the total variance
a host without labels is never surer than what it was shrunk to. A host is blocked when
the lower bound of its posterior bad rate, mean - z * standard deviation, exceeds
a limit. Everything after the first count runs on one row per host.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule,
and is judged like a host that no label is known of; repeated rows are judged alike;
a table without labels leaves the prior mean 0.5 and blocks nothing; extra columns
pass through ``judge`` untouched (a column it adds replaces one of the same name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.llm.base import lower_ascii
from keepwell.session import settle

#: Public suffixes of two labels that count as one suffix (fixed values).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.mx", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits; of equal rules the first. Meant for a short list."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        action = F.when(fits, F.lit(rule.action)).otherwise(action)
    return text, action


def _strength(children: DataFrame, least: float, most: float) -> DataFrame:
    """One row: the prior strength that explains the spread of k/n around ``mu``."""
    v = F.col("mu") * (1 - F.col("mu"))
    excess = F.pow(F.col("k") / F.col("n") - F.col("mu"), 2) * F.col("n") - v
    rho = F.try_divide(F.sum(excess), F.sum((F.col("n") - 1) * v))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(1.0)), F.lit(1 / (most + 1))), F.lit(1 / (least + 1)))
    return children.where("n > 0").agg((1 / rho - 1).alias("m"))


def _beta_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def _shrunk(children: DataFrame, least: float, most: float) -> DataFrame:
    """Adds ``m``, ``rate`` (the posterior mean under the parent's mean ``mu``) and ``var``.

    The parent's mean has the variance ``mu_var``, of which the share m / (n + m) of the rate inherits.
    """
    own = children.withColumn("m", _strength(children, least, most).scalar())
    n, k, m, mu = (F.col(c) for c in ("n", "k", "m", "mu"))
    inherited = (m / (n + m)) * (m / (n + m)) * F.col("mu_var")
    return own.withColumns({"rate": (k + m * mu) / (n + m), "var": _beta_variance(k + m * mu, n - k + m * (1 - mu)) + inherited})


def reputation(observed: DataFrame, z: float = 1.64, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """Posterior of every host in ``observed`` (host, bad: 1, 0 or null where unlabelled).

    Returns host, n, k, mean, bound. Pages of one host meet only as partial counts.
    """
    hosts = settle(observed.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
                   .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    good, bad = F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)) + 0.5, F.coalesce(F.sum("k"), F.lit(0)) + 0.5
    root = suffixes.agg((bad / (bad + good)).alias("mu"), _beta_variance(bad, good).alias("mu_var"))
    suffixes = suffixes.withColumns({c: root.select(c).scalar() for c in ("mu", "mu_var")})
    passed_on = [F.col("rate").alias("mu"), F.col("var").alias("mu_var")]
    suffixes = _shrunk(suffixes, least, most).select("suffix", *passed_on)
    domains = _shrunk(domains.join(suffixes, "suffix"), least, most).select("domain", *passed_on)
    hosts = _shrunk(hosts.join(domains, "domain"), least, most)
    return hosts.select("host", "n", "k", F.col("rate").alias("mean"),
                        F.greatest(F.col("rate") - z * F.sqrt("var"), F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = 0.2, **prior: float) -> DataFrame:
    """``pages`` with host, path, rule, verdict, host_rate, host_bound.

    ``pages`` has ``url`` and ``page_key``; ``outcomes`` has ``page_key`` (unique) and
    ``bad`` (1 or 0). The host table is small beside the pages, but no bound is
    assumed: the engine joins it by its measured size and splits a hot host.
    """
    at = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    seen = at.select("host", "page_key").join(outcomes.select("page_key", "bad"), "page_key", "left")
    known = reputation(seen, **prior).select(
        "host", F.col("mean").alias("host_rate"), F.col("bound").alias("host_bound"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("host_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    clashing = [c for c in ("host_rate", "host_bound") if c in at.columns]
    return at.drop(*clashing).join(known, "host", "left").withColumns(
        {"rule": rule, "verdict": F.coalesce(action, own)})
