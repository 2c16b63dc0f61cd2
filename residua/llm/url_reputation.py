"""URL filter: explicit rules first, an empirical-Bayes host reputation for the rest. DataFrame functions only.

Labelled pages are Bernoulli outcomes (1: good). Each level of host names, from the whole table to public
suffix, registered domain and host, has a beta posterior whose prior is centred on the level above (without
the child's own outcomes). The prior's strength at a level is fitted to all children of that level by moments of the beta-binomial.
A page is blocked when the upper posterior bound of its host's good rate is below ``min_good``: few bad
pages under a good domain don't block a host, many do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: (verdict, host, path) of the fixed rule list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels under which names are registered; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn")
STRENGTH_RANGE = (1.0, 1000.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The list is part of the plan: keep it to some hundreds."""
    rule = verdict = F.lit(None).cast("string")
    for said, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def name_levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(host, r":\d*$", "")
    last_two = F.substring_index(name, ".", -2)
    two = last_two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(two, F.substring_index(name, ".", -3)).otherwise(last_two), F.when(two, last_two).otherwise(F.substring_index(name, ".", -1))


def fitted_strength(children: DataFrame) -> DataFrame:
    """One row with the prior strength of a level, from (n, k, mean): n outcomes, k good, mean of the level above.

    For a beta-binomial of mean m and strength s, E (k - nm)^2 = n m (1 - m) (s + n) / (s + 1). Summed over
    all children this is linear in 1 / (s + 1).
    """
    v = F.col("mean") * (1 - F.col("mean"))
    sums = children.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("mean"), 2)).alias("seen"),
        F.sum(F.col("n") * v).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * v).alias("spread"),
    )
    rho = (F.col("seen") - F.col("binomial")) / F.col("spread")
    low, high = STRENGTH_RANGE
    s = F.when((F.col("spread") > 0) & (rho > 0), F.least(F.greatest(1 / rho - 1, F.lit(low)), F.lit(high))).otherwise(F.lit(high))
    return sums.select(s.alias("strength"))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, good 0/1) to one row per host: n, k, the posterior's mean, its lower and upper bound (normal, z)."""
    domain, suffix = name_levels(F.col("host"))
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    hosts = Scratch(outcomes.sparkSession).table(hosts.withColumns({"domain": domain, "suffix": suffix}))
    # One row: good rate of the whole table with one good and one bad outcome added.
    top = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mean"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n_s"), F.sum("k").alias("k_s")).withColumn("mean_s", top.scalar())
    s_s = fitted_strength(suffixes.select(F.col("n_s").alias("n"), F.col("k_s").alias("k"), F.col("mean_s").alias("mean"))).scalar()
    suffixes = suffixes.withColumn("s_s", s_s)
    # A child's prior is its parent's posterior without the child's own outcomes, so that none counts twice.
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n_d"), F.sum("k").alias("k_d")).join(suffixes, "suffix")
    domains = domains.withColumn("mean_d", (F.col("k_s") - F.col("k_d") + F.col("s_s") * F.col("mean_s")) / (F.col("n_s") - F.col("n_d") + F.col("s_s")))
    s_d = fitted_strength(domains.select(F.col("n_d").alias("n"), F.col("k_d").alias("k"), F.col("mean_d").alias("mean"))).scalar()
    domains = domains.withColumn("s_d", s_d).select("domain", "n_d", "k_d", "mean_d", "s_d")
    own = hosts.join(domains, "domain").withColumn("mean", (F.col("k_d") - F.col("k") + F.col("s_d") * F.col("mean_d")) / (F.col("n_d") - F.col("n") + F.col("s_d")))
    own = own.withColumn("strength", fitted_strength(own).scalar())
    a, b = F.col("k") + F.col("strength") * F.col("mean"), F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("mean"))
    sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return own.withColumn("posterior", a / (a + b)).select("host", "n", "k", "posterior", (F.col("posterior") - z * sd).alias("lower"), (F.col("posterior") + z * sd).alias("upper"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_good: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's posterior mean and upper bound.

    ``outcomes`` has (host, good): labelled pages, good null or missing where unlabelled. Verdict: the longest
    fitting rule's; else ``block`` if the host's upper posterior bound is below ``min_good``, else ``allow``.
    A host without labels (the empty host of a null or malformed url too) has no bound and is allowed.
    Repeated pages are judged alike; null ids are kept; other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    known = host_reputation(outcomes, z).select("host", "posterior", "upper")
    judged = parts.withColumns({"rule": rule, "said": said}).join(known, "host", "left")
    verdict = F.coalesce("said", F.when(F.col("upper") < min_good, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("posterior").alias("host_good"), F.col("upper").alias("host_good_upper"))


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url", doc_id_pattern: str = r"/(\d+)[^/]*$") -> DataFrame:
    """(host, good) of the pages whose document has a label: the document's id is the number that ends the url's path.

    A document with several labels counts as good if its largest label is 1; null labels count as none.
    """
    host, path = url_parts(F.col(url_col))
    by_doc = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("quality").alias("good"))
    keyed = pages.select(host.alias("host"), F.regexp_extract(path, doc_id_pattern, 1).try_cast("long").alias("doc"))
    return keyed.filter(F.col("doc").isNotNull()).join(by_doc, "doc").select("host", "good")
