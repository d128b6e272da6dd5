"""URL filters: explicit host/path rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and suffix. The
mean of each level is shrunk towards the level above by a beta prior whose strength is estimated
by moments from the spread of the level's own by moments from the spread of the level's own means; a host passes if the lower posterior bound
of its good share reaches the threshold. Counts are aggregated before anything is joined and written
once; the only values that reach the driver are a few sums for each of the three levels.

The registered domain is one label more than the suffix, which is the last label or, where the last two
are in `suffixes`, those two. User and port are no part of a domain; an IP address is a domain of its own,
below no suffix.

Defined results: a null url or one without :// has empty host and path and fits no rule; hosts
without outcomes are judged by their domain, suffix and the overall mean; without any outcome,
everything that no rule blocks is allowed; null labels are ignored; every repeated row counts. Urls of
any length are handled by built-in functions, a row at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ._spark import cut, with_ascii_lower

#: Rules are literals of the plan; longer lists belong in a joined table.
MOST_RULES = 1000
#: Second-level suffixes that registrars sell below (fixed values); a longer list can be given.
TWO_PART_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    return with_ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and the dot of the root."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r"(?<!:):[0-9]*$", ""), r"\.$", "")


def _is_address(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[[0-9a-f:.]*\])$"))


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null. rules: (allow or block, host/path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} literal rules")
    fits = []
    for _, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = rule.partition("/")
        fits.append(F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _strength(sums: Row) -> tuple[float, float, float]:
    """(outcomes, mean, prior strength) of one level, by moments."""
    n, k, sq, groups = sums["n"], sums["k"], sums["sq"], sums["groups"]
    if not n:
        return 0.0, 0.5, 2.0
    mean = k / n
    within = mean * (1 - mean)
    between = sq / n - mean * mean  # the weighted variance of the groups' means
    excess = between - within * groups / n
    return float(n), mean, 1000.0 if excess <= 0 else min(1000.0, max(1.0, (within - between) / excess))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """host, n, mean and bound for each of `hosts` (distinct host). outcomes: host, good (0/1)."""
    counts = outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("k"))
    counts = cut(counts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "counts")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    moments = [F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("sq"), F.count("*").alias("groups")]
    levels = [df.agg(*moments).withColumn("level", F.lit(name)) for name, df in (("suffix", by_suffix), ("domain", domains), ("host", counts))]
    found = {r["level"]: _strength(r) for r in levels[0].union(levels[1]).union(levels[2]).collect()}
    total, mean, for_suffix = found["suffix"]
    for_domain, for_host = found["domain"][2], found["host"][2]

    def level(df: DataFrame, key: str, own: DataFrame, prior: str, strength: float, name: str) -> DataFrame:
        own = own.select(F.col(key), F.col("n").alias("_n"), F.col("k").alias("_k"))
        df = df.join(own, key, "left").fillna(0.0, ["_n", "_k"])
        return df.withColumn(name, (F.col("_k") + strength * F.col(prior)) / (F.col("_n") + strength))

    above = hosts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")).withColumn("m0", F.lit(mean))
    s = level(above, "suffix", by_suffix, "m0", for_suffix, "m1").drop("_n", "_k")
    d = level(s, "domain", domains.select("domain", "n", "k"), "m1", for_domain, "m2").drop("_n", "_k")
    h = level(d, "host", counts, "m2", for_host, "mean")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_n") + for_host + 1))
    bound = F.col("mean") - z * spread if total else F.lit(1.0)
    return h.select("host", F.col("_n").cast("long").alias("n"), "mean", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url: str = "url", threshold: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of these names, and `bound`, are replaced.
    outcomes: url, good."""
    pages = pages.drop(*({"host", "path", "rule", "verdict", "bound"} - {url}))
    parts = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    named = outcomes.select(host_of(F.col("url")).alias("host"), F.col("good"))
    # Written, so that pages meet it as a broadcast while it is small, and a hot host can be split beyond.
    scores = cut(reputation(parts.select("host").distinct(), named, z, suffixes).select("host", "bound"), "scores")
    action = F.create_map(*[F.lit(x) for a, r in rules for x in (r, a)])
    judged = parts.join(scores, "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce(F.try_element_at(action, F.col("rule")), by_host)).drop("bound")
