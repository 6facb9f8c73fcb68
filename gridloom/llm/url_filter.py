"""URL filtering by explicit rules and, where none fits, by empirical-Bayes host reputation.

Labelled pages give each host a count of bad outcomes. A host's rate is shrunk towards its registered
domain, the domain's towards its suffix, and the suffix's towards the whole: at each level the posterior
mean of the parent is the mean of a beta prior, whose strength is fitted by moments to how much the groups
of that level differ. A host is blocked when the lower bound of its posterior bad rate exceeds a limit, so
few labels never suffice. Rules win over reputation; the longest fitting rule wins.

A page's outcome is the label row of its id: bad if the quality is 0 or the page is toxic. Pages are counted by
host once, with map-side combining, into a written table that all levels are summed from; the three prior
strengths are three rows on the driver. Verdicts return to the pages by a broadcast of the hosts if their count is
within its bound, else by an equi-join whose hot hosts adaptive execution may split, as nothing above it needs the
pages of a host together.

Defined edge cases: a null url, or one without ``://``, has empty host and path, no rule, and the reputation
of the empty host; labels whose two marks are null do not count; several label rows of one page count as one, bad if
any is; without labels nothing is blocked by reputation; repeated pages count repeatedly; rules of equal length are
taken in the order of their text; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import few, written

# Common public suffixes of two labels.
LONG_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.co", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "edu.tw", "go.jp", "gob.mx", "gov.au",
    "gov.br", "gov.cn", "gov.in", "gov.uk", "govt.nz", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as Columns."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.when(at > 0, F.translate(raw, _UPPER, _LOWER)).otherwise(""), F.when(at > 0, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Iterable[UrlRule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column, long_suffixes: Iterable[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """The registered domain is one label more than the suffix; the suffix is the last label, or a listed pair."""
    pair = F.substring_index(host, ".", -2)
    long = pair.isin(list(long_suffixes)) if list(long_suffixes) else F.lit(False)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(pair), F.when(long, pair).otherwise(F.substring_index(host, ".", -1))


def outcomes(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(page_id, bad 0/1), one row a page."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    return labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col(doc_id).alias("page_id")).agg(F.max(bad).alias("bad"))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """The prior strength of a level from its groups' (n, k), by moments, between 1 and 1e6; and the share of bad ones."""
    t = groups.where("n > 0").agg(
        F.count(F.lit(1)).cast("double").alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("m"),
        F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("b"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("q"),
        F.coalesce(F.sum(F.col("k") * F.col("k") / F.col("n")), F.lit(0.0)).alias("r"),
    )
    p = F.expr("b / nullif(m, 0)")
    t = t.withColumn("p", p)
    # spread: sum n (k/n - p)^2; its expectation is p (1 - p) ((g - 1) + rho (m - q / m - (g - 1)))
    rho = F.expr("((r - b * p) / nullif(p * (1 - p), 0) - (g - 1)) / nullif(m - q / nullif(m, 0) - (g - 1), 0)")
    rho = F.greatest(F.least(F.coalesce(rho, F.lit(0.0)), F.lit(0.5)), F.lit(1e-6))
    return tuple(t.select(F.lit(1.0) / rho - 1.0, F.coalesce("p", F.lit(0.0))).first())


def reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645, long_suffixes: Iterable[str] = LONG_SUFFIXES) -> DataFrame:
    """(host, n, k, rate, bound) for every host of ``pages`` (page_id, host): posterior mean and lower bound."""
    hosts = pages.join(outcomes(labels), "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"), long_suffixes)
    hosts = written(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (s_host, _), (s_domain, _), (s_suffix, p) = _strength(hosts), _strength(domains), _strength(suffixes)
    mean = lambda s, prior: (F.col("k") + s * prior) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", mean(s_suffix, F.lit(p)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", mean(s_domain, F.col("suffix_rate")).alias("domain_rate"))
    hosts = hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", mean(s_host, F.col("domain_rate")).alias("rate"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + s_host + 1))
    return hosts.select("host", "n", "k", "rate", (F.col("rate") - z * spread).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Iterable[UrlRule], limit: float = 0.5, z: float = 1.645, long_suffixes: Iterable[str] = LONG_SUFFIXES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, rate, bound."""
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = few(written(reputation(seen.select("page_id", "host"), labels, z, long_suffixes).select("host", "rate", "bound"), "reputation"), "host")
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise("allow")
    return seen.join(known, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "rate", "bound")
