"""URL filters: fixed rules first, else a host's reputation by empirical Bayes.

Outcomes of labelled pages are counted per host. Each level - all, public suffix, registered domain, host - has a beta
prior centred on the posterior mean of the level above, so a host with few labels is judged by its domain and a domain with
few labels by its suffix; a host without labels has the posterior of its domain, else of its suffix, else of all. User and port
belong to the host, not to its domain; an address is its own domain and suffix. A host is blocked when even the lower bound of its posterior share of bad pages is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the fixed rules; the longest that fits decides.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Strength of each prior in pages, the bound in standard deviations, and the share of bad pages that blocks.
STRENGTH, DEVIATIONS, LIMIT = 20.0, 2.0, 0.5
#: Public suffixes of more than one label; every other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if null or without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(host, r"(?s)^.*@|\.?(:[0-9]*)?\z", "")


def _address(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^(([0-9]+\.){3}[0-9]+\z|\[)"))


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """Public suffix of the host's name; an address is its own."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_address(name), name).when(two.isin(*long_suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """Registered domain: the suffix and one label more; an address is its own."""
    name = name_of(host)
    long = F.substring_index(name, ".", -2).isin(*long_suffixes)
    return F.when(_address(name), name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain of it and the start of the path;
    of equally long ones the first in text order. Null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_reputation(outcomes: DataFrame, strength: float = STRENGTH, deviations: float = DEVIATIONS) -> DataFrame:
    """host, rate, bound of every host in rows of (host, bad) with bad 0, 1 or null.

    Counts are summed per host first (combined before the shuffle), so a host with a third of all pages is one row from
    there on. A null outcome counts for nothing but names its host, which is judged by the levels above. Null hosts go.
    """
    hosts = (outcomes.where(F.col("host").isNotNull())
             .groupBy("host").agg(F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("b"), F.count("bad").cast("double").alias("n"))
             .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("b").alias("b_d"), F.sum("n").alias("n_d"))
    suffixes = domains.groupBy("suffix").agg(F.sum("b_d").alias("b_s"), F.sum("n_d").alias("n_s"))
    share = suffixes.agg(((F.sum("b_s") + 1) / (F.sum("n_s") + 2)).alias("share")).scalar()

    def mean(bad: str, n: str, prior: Column) -> Column:
        return (F.col(bad) + prior * strength) / (F.col(n) + strength)
    by_suffix = suffixes.withColumn("m_s", mean("b_s", "n_s", share))
    by_domain = domains.join(by_suffix.select("suffix", "m_s"), "suffix").withColumn("m_d", mean("b_d", "n_d", F.col("m_s")))
    judged = hosts.join(by_domain.select("domain", "suffix", "m_d"), ["domain", "suffix"])
    a = F.col("b") + F.col("m_d") * strength
    size = F.col("n") + F.lit(strength)
    rate = a / size
    return judged.select("host", rate.alias("rate"),
                         (rate - F.lit(deviations) * F.sqrt(rate * (F.lit(1.0) - rate) / (size + F.lit(1.0)))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """All columns of `pages` with `_host`, `_path`, `_rule`, `_verdict`, `_bound`.

    `outcomes` has (page_id, bad). A null url or one without :// has empty host and path, fits no rule, has no bound and is
    allowed. Every other host has a bound, with labels or without. Repeated pages are judged alike; a page labelled twice counts twice.
    """
    placed = pages.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    labelled = placed.select("page_id", F.col("_host").alias("host")).where(F.col("host") != "").join(
        outcomes.select("page_id", "bad"), "page_id", "left").select("host", "bad")
    reputation = host_reputation(labelled).select(F.col("host").alias("_rep_host"), F.col("bound").alias("_bound"))
    ruled = placed.withColumn("_fit", rule_of(F.col("_host"), F.col("_path"), rules))
    # one row per host on the right; Spark broadcasts it while it is small and splits a hot host beyond that
    return (ruled.join(reputation, F.col("_host") == F.col("_rep_host"), "left")
            .withColumns({"_rule": F.col("_fit.rule"),
                          "_verdict": F.coalesce("_fit.verdict", F.when(F.col("_bound") > limit, "block").otherwise("allow"))})
            .drop("_fit", "_rep_host"))


def verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, bound. The page of a label is the one with its number; toxic or low-quality pages are bad."""
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), F.lit(1) - F.coalesce("quality", F.lit(1)))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge(pages.select("page_id", "url"), outcomes).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
