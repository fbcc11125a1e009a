"""Judge urls by rules and by empirical-Bayes host reputation; DataFrame functions only.

A host's share of bad pages is shrunk towards its registered domain, that towards its suffix, that towards all
pages. At each level the prior is a beta distribution whose mean is the parent's posterior mean; its strength
comes from the spread of the level's groups around their parents beyond binomial chance (method of moments).
A page is blocked where even the lower posterior bound of its host, mean minus ``z`` deviations, reaches ``cut``.

Outcomes are counted per host before anything is joined, so a host with a third of all pages is one row; the
join that takes reputations back to pages is an equi-join that the adaptive skew join can split.

Nulls and edge cases: a null url or one without ``://`` has an empty host and path, no rule, and the reputation
of the empty host (allowed unless its own labelled pages speak against it); outcomes that are null are not counted;
a page labelled twice counts twice; without any outcome nothing is blocked; repeated pages are judged each for
itself; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.cn")
LEVELS = ("suffix", "domain", "host")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, says in reversed(longest):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def with_levels(df: DataFrame) -> DataFrame:
    """Add suffix and registered domain to rows with a host."""
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*TWO_LABEL_SUFFIXES)
    return df.withColumn("suffix", F.when(two, last(2)).otherwise(last(1))).withColumn("domain", F.when(two, last(3)).otherwise(last(2)))


def reputation(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", bad: str = "bad", z: float = 1.0) -> DataFrame:
    """Posterior of every host of ``pages``: host, n, mean, low.

    ``outcomes`` holds page_id and a 0/1 column ``bad``.
    """
    own = pages.select(F.col(page_id).alias("id"), url_host(F.col(url)).alias("host"))
    marks = outcomes.select(F.col(page_id).alias("id"), F.col(bad).cast("int").alias("bad")).filter("bad IS NOT NULL")
    counted = own.join(marks, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = with_levels(counted)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    level = hosts.crossJoin(F.broadcast(total.select(((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("prior"))))  # one row
    for name in LEVELS:
        # Sums of the level's groups, each beside its parent's posterior mean.
        group = level.groupBy(name).agg(F.sum("n").alias("gn"), F.sum("k").alias("gk"), F.first("prior").alias("m"))
        var = F.col("m") * (1 - F.col("m"))
        spread = F.sum(F.pow(F.col("gk") - F.col("gn") * F.col("m"), 2)) - F.sum(F.col("gn") * var)
        rho = F.least(F.greatest(F.coalesce(spread / F.nullif(F.sum(F.col("gn") * (F.col("gn") - 1) * var), F.lit(0.0)), F.lit(0.0)), F.lit(0.001)), F.lit(0.5))
        strength = group.agg((1 / rho - 1).alias("s"))
        post = group.crossJoin(F.broadcast(strength))  # one row
        post = post.select(name, "gn", "gk", "m", "s", ((F.col("gk") + F.col("s") * F.col("m")) / (F.col("gn") + F.col("s"))).alias("post"))
        if name == "host":
            a, b = F.col("gk") + F.col("s") * F.col("m"), F.col("gn") - F.col("gk") + F.col("s") * (1 - F.col("m"))
            sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
            return post.select("host", F.col("gn").alias("n"), F.col("post").alias("mean"), (F.col("post") - z * sd).alias("low"))
        level = level.drop("prior").join(post.select(name, F.col("post").alias("prior")), name)
    raise AssertionError


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, cut: float = 0.5, z: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior mean and lower bound."""
    ranked = reputation(pages, outcomes, url, page_id, z=z).select("host", "mean", "low")
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    method = F.when(F.col("low") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(ranked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "mean", "low")


def allowed(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, cut: float = 0.5, z: float = 1.0) -> DataFrame:
    """The pages themselves, without the blocked ones. Every row is judged by its own url, so ids may be null or repeated."""
    host = url_host(pages[url])
    said = fitting_rule(host, url_path(pages[url]), rules)[1]
    bad = reputation(pages, outcomes, url, page_id, z=z).filter(F.col("low") >= cut).select(F.col("host").alias("bad_host"))
    return pages.filter(F.coalesce(said, F.lit("allow")) != "block").join(bad, said.isNull() & (host == bad["bad_host"]), "left_anti")
