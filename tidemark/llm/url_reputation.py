"""Verdicts on urls: explicit rules first, else the host's reputation.

Reputation is an empirical-Bayes estimate of how often a host's pages are bad, from labelled pages.  A host's
rate is shrunk towards its registered domain's, that towards its suffix's, that towards the overall
rate; each step is a beta-binomial prior whose strength is estimated from how much the children of
a level scatter around their parents (moments of the beta-binomial distribution).  A host is blocked
if the lower bound of its posterior bad rate is above a limit, so little evidence blocks nothing.

Pages meet counts per host, never each other; a hot host is one row of the reputation table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: (verdict, host, path)
Rule = tuple[str, str, str]

MAX_BAD = 0.5
Z = 1.645  # one-sided 95 %
#: least and largest share of a rate's variance that lies between the children of a parent
LEAST_SCATTER, MOST_SCATTER = 0.001, 0.9
LEVELS = ("suffix", "domain", "host")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands behind the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def matched(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of two that are equally long block wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), r[0] == "block", rule_name(r))):
        says, of, start = rule
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, rule_name(rule)).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def scatter(rates: DataFrame) -> float:
    """Strength of the prior at one level: rates has n, bad and the parent's rate `centre` of each child."""
    spread = F.col("centre") * (1 - F.col("centre"))
    off = F.col("bad") / F.col("n") - F.col("centre")
    sums = rates.agg(
        F.sum(F.col("n") * off * off).alias("seen"), F.sum(spread).alias("chance"), F.sum((F.col("n") - 1) * spread).alias("room")
    ).first()
    share = (sums["seen"] - sums["chance"]) / sums["room"] if sums["room"] else LEAST_SCATTER
    share = min(MOST_SCATTER, max(LEAST_SCATTER, share))
    return (1 - share) / share


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, bad, bad_rate, bad_bound of every host of hosts.

    outcomes: host, bad (0 or 1), one row per labelled page; rows with a null in them are left out.  A host
    without labelled pages has the rate of its domain and a wide bound; without any outcome at all
    every rate is one half.  bad_bound is the lower bound: mean - z * standard deviation.
    """
    seen = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
    seen = written(seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "outcomes")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (total["bad"] + 1) / (total["n"] + 2)

    def named(df: DataFrame) -> DataFrame:
        host = F.col("host")
        return df.withColumns({"suffix": last_labels(host, 1), "domain": last_labels(host, 2)})

    all_hosts = named(hosts.select("host").where("host is not null").distinct())
    counted = named(seen)
    # rate of each parent, level by level; the chain is joined to hosts at the end
    rates, parent = None, None
    result = all_hosts.withColumn("centre", F.lit(overall))
    for level in LEVELS:
        children = counted.groupBy(level, *([parent] if parent else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if rates is None:
            children = children.withColumn("centre", F.lit(overall))
        else:
            children = children.join(rates.select(parent, F.col("rate").alias("centre")), parent)
        strength = scatter(children)
        rate = (F.col("bad") + strength * F.col("centre")) / (F.col("n") + strength)
        rates = written(children.withColumn("rate", rate), "rates")
        known = rates.select(F.col(level).alias("_level"), F.col("n").alias("_n"), F.col("bad").alias("_bad"))
        result = result.join(known, result[level] == known["_level"], "left")
        n, bad = F.coalesce("_n", F.lit(0)), F.coalesce("_bad", F.lit(0))
        result = result.select(
            "host",
            "suffix",
            "domain",
            n.alias("n"),
            bad.alias("bad"),
            ((bad + strength * F.col("centre")) / (n + strength)).alias("centre"),
            (n + strength).alias("weight"),
        )
        parent = level
    sd = F.sqrt(F.col("centre") * (1 - F.col("centre")) / (F.col("weight") + 1))
    return result.select("host", "n", "bad", F.col("centre").alias("bad_rate"), (F.col("centre") - z * sd).alias("bad_bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), max_bad: float = MAX_BAD, z: float = Z
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_bound of every row of pages.

    The longest rule that fits the host, or a domain above it, and the start of the path decides; without one
    a host whose bad_bound is above max_bad is blocked and any other allowed.  rules is a written list,
    part of the plan.  A null url, or one without ://, has an empty host and path, and an empty host is
    judged like any other.  Repeated rows are judged each; an empty table gives an empty result;
    columns besides page_id and url are not read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = written(reputations(rows, outcomes, z).select(F.col("host").alias("_host"), "bad_rate", "bad_bound"), "reputations")
    rule, says = matched(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    judged = rows.join(known, rows["host"] == known["_host"], "left")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "bad_rate", "bad_bound"
    )
