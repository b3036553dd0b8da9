"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's rate
is a beta posterior whose prior mean is the level above and whose prior weight comes from how
much that level's rates vary (a beta-binomial fit by moments). A host is blocked when the
lower posterior bound of its bad rate exceeds a limit, so a few bad pages do not block a host
of a good domain, and a host without labels is judged by its domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.session import staged

#: (action, host, path) by which a page is judged before reputation; the longest fitting wins.
Rule = tuple[str, str, str]

LIMIT = 0.5
BOUND = 1.645
PRIOR_WEIGHT = (1.0, 1000.0)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    found = F.instr(url, "://")
    return F.when(found > 0, F.substring(url, found + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels, without a port; a host of fewer labels, or an address, is its own."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$|^\["), F.lit("")).otherwise(F.substring_index(domain, ".", -1))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; null where none fits."""
    text = action = None
    for act, on, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        text = F.when(fits, F.lit(on + under)) if text is None else text.when(fits, F.lit(on + under))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, action)


def _weight(groups: DataFrame) -> float:
    """Prior weight from the spread of rates between groups of ``n, bad``.

    With rho the correlation of outcomes within a group (analysis of variance), a beta prior
    weighs ``1 / rho - 1``. One row reaches the driver.
    """
    s = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"),
    ).first()
    low, high = PRIOR_WEIGHT
    if not s.g or s.g < 2 or s.n <= s.g:
        return high
    between = (s.bb - s.bad * s.bad / s.n) / (s.g - 1)
    within = (s.bad - s.bb) / (s.n - s.g)
    typical = (s.n - s.nn / s.n) / (s.g - 1)
    spread = between + (typical - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return min(max(1 / rho - 1, low), high) if rho > 0 else high


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, rate, bound`` for every host of ``pages``.

    Args:
        pages: ``page_id, host``.
        outcomes: ``page_id, bad`` (boolean); a page is bad if one of its outcomes is; null
            outcomes count as missing.

    Counts are combined before each shuffle, per host, then per domain from hosts, then per
    suffix from domains, so a host with most of the rows is a few rows by then. The empty host
    is judged by the overall rate. Stores the host table while the plan is being built.
    """
    seen = outcomes.where("bad is not null and page_id is not null").groupBy("page_id").agg(
        F.max(F.col("bad").cast("int")).alias("bad")
    )
    counted = pages.join(seen, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    domain = domain_of(F.col("host"))
    hosts = staged(counted.withColumn("domain", domain).withColumn("suffix", suffix_of(domain)), "hosts")
    named = hosts.where("host <> ''")
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    # One page of each outcome stands in for the prior of an unlabelled table.
    base = ((overall.bad or 0) + 1.0) / ((overall.n or 0) + 2.0)
    weights = [_weight(t) for t in (suffixes, domains, named)]

    def mean(prior: Column | float, weight: float) -> Column:
        return (F.col("bad") + weight * prior) / (F.col("n") + weight)

    suffixes = suffixes.select("suffix", mean(F.lit(base), weights[0]).alias("prior"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", mean(F.col("prior"), weights[1]).alias("prior"))
    judged = hosts.join(domains, ["suffix", "domain"], "left").withColumn(
        "prior", F.when(F.col("host") == "", F.lit(base)).otherwise(F.coalesce("prior", F.lit(base)))
    )
    good = F.col("n") - F.col("bad") + weights[2] * (1 - F.col("prior"))
    bad = F.col("bad") + weights[2] * F.col("prior")
    rate = bad / (good + bad)
    deviation = F.sqrt(rate * (1 - rate) / (good + bad + 1))
    return judged.select("host", rate.alias("rate"), (rate - BOUND * deviation).alias("bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], *,
    page_id: str = "page_id", url: str = "url", limit: float = LIMIT,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, bound`` for every row of ``pages``.

    A fitting rule decides, else the host's bound. A null url, or one without ``://``, has an
    empty host and path, fits no rule and is judged by the overall rate. Repeated rows are
    each judged; other columns are not read.
    """
    parsed = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    known = staged(reputation(parsed.select("page_id", "host"), outcomes), "reputation")
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    return parsed.join(known, "host").select(
        F.col("page_id").alias(page_id), "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
        "rate", "bound",
    )
