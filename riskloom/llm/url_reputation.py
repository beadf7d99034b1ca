"""URL filter: host reputation by empirical Bayes.

Outcomes of labelled pages are counted per host. A host's share of good pages is shrunk towards its registered domain's,
a domain's towards its suffix's, and a suffix's towards the share of all labelled pages, by beta-binomial priors. A page
passes if the lower bound of its host's posterior is at least a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, stored

#: Suffixes of two labels below which domains are registered.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Shrinkage:
    """strength: the weight of a parent, in pages, where the counts can't tell; most: its upper limit.

    z: standard deviations below the posterior mean; threshold: the least bound of an allowed host.
    """

    strength: float = 10.0
    most: float = 1000.0
    z: float = 1.64
    threshold: float = 0.8


def host_of(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end, A-Z as a-z; empty without `://` or url."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*double), last).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more."""
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*double), F.substring_index(host, ".", -3)).otherwise(last)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    below = (host == rule.host) | host.endswith("." + rule.host)
    return below & path.startswith(rule.path)


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds `rule` and `rule_verdict` of the longest rule that fits; null where none does."""
    host, path = F.col("host"), F.col("path")
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # a longer one overrides
        hit = fits(rule, host, path)
        name, verdict = F.when(hit, rule.name).otherwise(name), F.when(hit, rule.verdict).otherwise(verdict)
    return pages.withColumns({"rule": name, "rule_verdict": verdict})


def prior_weight(setting: Shrinkage) -> Column:
    """Weight of the parent level, by moments: an aggregate over groups with good, bad and the parent's mean.

    With n pages in a group, the variance of its share around the mean m is m (1 - m) (1 + (n - 1) rho) / n for a
    beta-binomial of correlation rho; summed over groups this gives rho, and the weight is 1 / rho - 1.
    """
    n = F.col("good") + F.col("bad")
    spread = F.col("parent_mean") * (1 - F.col("parent_mean"))
    off = F.col("good") / n - F.col("parent_mean")
    excess = F.sum(n * off * off - spread)
    scale = F.sum((n - 1) * spread)
    rho = F.when(scale > 0, excess / scale)
    weight = F.when(rho.isNull(), setting.strength).when(rho <= 0, setting.most).otherwise(1 / rho - 1)
    return F.least(F.greatest(weight, F.lit(1.0)), F.lit(setting.most))


def shrunk(groups: DataFrame, setting: Shrinkage) -> DataFrame:
    """Adds the posterior's a, b and mean. Groups without an outcome don't tell the weight."""
    known = groups.where(F.col("good") + F.col("bad") > 0)
    weight = known.agg(prior_weight(setting).alias("weight")).first()[0]
    weight = F.lit(setting.strength if weight is None else weight)
    a = F.col("good") + weight * F.col("parent_mean")
    b = F.col("bad") + weight * (1 - F.col("parent_mean"))
    return groups.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def parents(groups: DataFrame, key: str) -> DataFrame:
    return groups.select(key, F.col("mean").alias("parent_mean"))


def reputation(outcomes: DataFrame, setting: Shrinkage = Shrinkage()) -> DataFrame:
    """Posterior of every host among `outcomes` (host, good as 0 or 1): host, a, b, mean, bound.

    Rows are counted per host first, so a host that holds most of them is one row from there on. Null outcomes don't
    count; a host with none of its pages labelled gets what its domain says.
    """
    good = F.col("good").cast("double")
    hosts = stored(
        outcomes.groupBy("host")
        .agg(F.coalesce(F.sum(good), F.lit(0.0)).alias("good"), F.count(good).cast("double").alias("n"))
        .select("host", "good", (F.col("n") - F.col("good")).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}),
        "hosts",
    )
    counts = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    pages = F.col("good") + F.col("bad")
    overall = hosts.agg(((F.sum("good") + 1) / (F.sum(pages) + 2)).alias("share")).first()[0]
    suffixes = shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("parent_mean", F.lit(overall).cast("double")), setting)
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    domains = shrunk(domains.join(parents(suffixes, "suffix"), "suffix"), setting)
    hosts = shrunk(hosts.join(parents(domains, "domain"), "domain"), setting)
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "a", "b", "mean", (F.col("mean") - setting.z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, setting: Shrinkage = Shrinkage()) -> DataFrame:
    """Verdict on every page of `pages` (page_id, url).

    `outcomes` holds page_id and good (0 or 1) of labelled pages; a page with several outcomes counts with each. Returns
    page_id, host, path, rule, verdict, mean and bound. A rule that fits decides; else the bound of the host does. A null
    url and one without `://` have an empty host, which has a reputation like any other. Repeated rows are judged one by
    one. Other columns of the inputs are ignored.
    """
    url = pages.select("page_id", F.col("url").cast("string").alias("url"))
    seen = url.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = seen.join(outcomes.select("page_id", "good"), "page_id", "left").select("host", "good")
    judged = with_rule(seen, rules).join(reputation(labelled, setting), "host", "left")
    verdict = F.coalesce(
        F.col("rule_verdict"), F.when(F.col("bound") >= setting.threshold, "allow").otherwise("block")
    )
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mean", "bound")
