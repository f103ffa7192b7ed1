"""URL filters: rules, and an empirical Bayes reputation of hosts for pages that no rule fits.

Labelled pages are draws from their host: a page is good if its quality is 1 and it isn't toxic.
The share of good pages of a host has a beta prior whose mean is the estimate for its registered
domain; that of a domain has the estimate for its suffix, and that of a suffix the one for all
pages. The strength of each prior comes from the spread between the groups of its level, by the
method of moments. A host is blocked if even the upper bound of its posterior is below a floor, a
share of the mean over all pages.

A null url, or one without ``://``, has an empty host and path; the empty host is a host like any
other. Labels that are null in both columns are ignored; where a page has several, it's good only
if each says so. Without labels every host keeps the uniform prior and is allowed. Repeated pages
are judged row by row, and count once for each row. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import materialize

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of more than one label under which domains are registered; every other suffix is one label.
SUFFIXES: tuple[str, ...] = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr",
    "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za", "github.io", "blogspot.com",
)
#: Posterior standard deviations to the upper bound; the share of the mean over all pages that the bound must reach.
#: So a host is blocked that is worse than all pages together, by more than its posterior leaves open.
DEVIATIONS, FLOOR = 1.0, 1.0
#: Bounds of the correlation inside a group, from which the strength of a prior follows.
LEAST_RHO, MOST_RHO = 0.001, 0.9


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    host = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(at > 0, lowered).otherwise("")


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end; else empty."""
    at = F.locate("://", url)
    path = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise("")


def domain_levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix; a host that is no more than a suffix is its own domain."""
    long = F.lit(False)
    for suffix in suffixes:
        long = long | (host == suffix) | host.endswith(f".{suffix}")
    last = [F.substring_index(host, ".", -n) for n in (1, 2, 3)]
    return F.when(long, last[2]).otherwise(last[1]), F.when(long, last[1]).otherwise(last[0])


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; nulls where none fits.

    Rules are configuration and part of the plan, so keep them to hundreds.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in reversed(ordered):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def page_outcomes(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """page_id, good (0 or 1), one row per page."""
    marked = labels.where("quality is not null or toxic is not null")
    good = (F.coalesce("quality", F.lit(1)) > 0) & (F.coalesce("toxic", F.lit(0)) <= 0)
    return marked.groupBy(F.col(id_col).alias("page_id")).agg(F.min(good.cast("int")).alias("good"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Adds the prior's ``strength`` to groups with n, k and the parent's mean ``prior``; one row for all is broadcast."""
    free = F.col("prior") * (1 - F.col("prior"))
    over = F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - F.col("n") * free
    rho = F.try_divide(F.sum(over), F.sum(F.col("n") * (F.col("n") - 1) * free))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(MOST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    one = groups.agg(rho.alias("rho")).select((1 / F.col("rho") - 1).alias("strength"))
    mean = (F.col("strength") * F.col("prior") + F.col("k")) / (F.col("strength") + F.col("n"))
    return groups.crossJoin(F.broadcast(one)).withColumn("mean", mean)


def host_reputations(
    pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, url_col: str = "url", id_col: str = "page_id"
) -> DataFrame:
    """Per host of ``pages``: host, n, k, mean and deviation of the posterior of its share of good pages.

    Pages are counted by host in their tasks before any shuffle; the levels above are sums of sums.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"))
    counts = rows.join(outcomes, "page_id", "left").groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")
    )
    domain, suffix = domain_levels(F.col("host"), suffixes)
    hosts = materialize(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = tops.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    tops = _shrunk(tops.crossJoin(F.broadcast(whole))).select("suffix", F.col("mean").alias("prior"))
    domains = _shrunk(domains.join(tops, "suffix")).select("domain", F.col("mean").alias("prior"))
    judged = _shrunk(hosts.drop("suffix").join(domains, "domain"))
    size = F.col("strength") + F.col("n")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return judged.select("host", "n", "k", "mean", spread.alias("deviation"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, deviations: float = DEVIATIONS,
    floor: float = FLOOR, suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict; the rule's verdict, else the reputation's.

    And what that rests on: n_labelled and n_good pages of the host, mean and upper bound of its posterior.
    """
    found = host_reputations(pages, page_outcomes(labels), suffixes)
    found = found.select(
        "host", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), "mean",
        (F.col("mean") + deviations * F.col("deviation")).alias("bound"),
    )
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    every = ((F.sum("n_good") + 1) / (F.sum("n_labelled") + 2) * floor).alias("floor")
    found = found.crossJoin(F.broadcast(found.agg(every)))
    other = F.when(F.col("bound") < F.col("floor"), "block").otherwise("allow")
    return rows.join(found, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), "n_labelled", "n_good",
        F.round("mean", 9).alias("mean"), F.round("bound", 9).alias("bound"),
    )
