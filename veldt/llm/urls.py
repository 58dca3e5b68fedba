"""URL filters: host rules and empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain and public suffix. Each
level is a beta-binomial whose prior has the posterior mean of its parent and a strength that is
fitted to the table, by moments: where children differ from their parents by no more than chance,
they are shrunk hard, where they scatter, hardly. A host is blocked where even an upper quantile of
the Beta posterior of its rate of good pages is under a threshold, so a host with little evidence is
kept unless its domain or suffix speaks clearly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import checkpointed

#: verdict, host, path prefix; fixed by the contract of the url query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: public suffixes of more than one label that are told apart; any other suffix is the last label
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.jp", "co.kr", "co.in",
    "com.br", "com.cn", "com.mx", "com.tr", "github.io", "gitlab.io", "blogspot.com", "wordpress.com",
)
#: strength of a prior, in pages: bounds, and the value where no child has two labelled pages
LEAST_STRENGTH, MOST_STRENGTH, STRENGTH = 1.0, 1000.0, 20.0
#: normal quantile that the upper bound of 95 % belongs to
Z = 1.645
#: hosts whose upper bound of the good rate is below this are blocked
LEAST_GOOD = 0.5


def url_parts(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_columns(rules=RULES) -> tuple[F.Column, F.Column]:
    """Text and verdict of the longest rule that fits columns host and path; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def registered(suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """Pattern of a host's registered domain, one label and the suffix; group 2 is the suffix."""
    return r"([^.]*\.)?(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r"|[^.]*)$"


def fitted_strength(children: DataFrame) -> float:
    """Strength of the prior that columns n, good and m (the parent's rate) of the children ask for.

    The excess of squared deviations over binomial ones estimates the correlation r of two pages of
    a child; the strength is 1/r - 1. One row reaches the driver.
    """
    excess = F.sum((F.col("good") - F.col("n") * F.col("m")) ** 2 - F.col("n") * F.col("m") * (1 - F.col("m")))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    r = children.where("n > 1").agg(F.when(scale > 0, excess / scale).alias("r")).first()["r"]
    if r is None:
        return STRENGTH
    return MOST_STRENGTH if r <= 1 / (MOST_STRENGTH + 1) else max(LEAST_STRENGTH, 1 / r - 1)


def beta_upper(a: F.Column, b: F.Column, z: float = Z) -> F.Column:
    """Upper quantile of Beta(a, b) by the closed form 26.5.22 of Abramowitz and Stegun.

    It needs a and b of 1 or more; smaller ones count as 1, which only raises the bound. It is within
    0.03 of the true quantile, nearer for larger a and b, and rather above than below it.
    """
    a, b, y = F.greatest(a, F.lit(1.0)), F.greatest(b, F.lit(1.0)), -z
    lam = (y * y - 3) / 6
    h = 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1))
    w = y * F.sqrt(h + lam) / h - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * (lam + 5 / 6 - 2 / (3 * h))
    return a / (a + b * F.exp(2 * w))


def reputation(outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per host: host, n, good, mean, upper.

    outcomes: host, good (1, 0, or null for a page without a label). Counts are pre-aggregated per
    host and written to the shared checkpoint folder before anything else, so a host with most pages
    is one row from then on, and the pages are counted once.
    """
    name = registered(suffixes)
    counted = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = checkpointed(counted).select(
        "*", F.regexp_extract("host", name, 0).alias("domain"), F.regexp_extract("host", name, 2).alias("suffix")
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    every = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    tops = tops.withColumn("m", F.lit((every["good"] + 1.0) / (every["n"] + 2.0)))

    def shrunk(s: float) -> F.Column:
        return (F.col("good") + s * F.col("m")) / (F.col("n") + s)

    domains = domains.join(tops.select("suffix", shrunk(fitted_strength(tops)).alias("m")), "suffix")
    hosts = hosts.join(domains.select("domain", "suffix", shrunk(fitted_strength(domains)).alias("m")), ["domain", "suffix"])
    s = fitted_strength(hosts)
    upper = beta_upper(F.col("good") + s * F.col("m"), F.col("n") - F.col("good") + s * (1 - F.col("m")), z)
    return hosts.select("host", "n", "good", shrunk(s).alias("mean"), upper.alias("upper"))


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame | None = None,
    rules=RULES,
    least_good: float = LEAST_GOOD,
    broadcast_bound: int = 100_000,
) -> DataFrame:
    """Verdict for every page: its longest rule's, else that of its host's reputation.

    pages: page_id, url (other columns are ignored). outcomes: host, good; by default the pages
    that a rule allows are good outcomes and those that a rule blocks are bad ones. Returns page_id,
    host, path, rule, verdict, n_labelled, good_rate, upper_bound. A null url, or one without ://,
    is host "" and path "", has no rule, and is judged as the host "". Repeated rows are judged
    alike, each with a row of its own; an empty table gives no rows. Reputations are broadcast only
    if they are at most `broadcast_bound` rows, else joined by host with skewed partitions split.
    """
    host, path = url_parts()
    rule, verdict = rule_columns(rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", rule).withColumn("_verdict", verdict)
    if outcomes is None:
        good = F.when(F.col("_verdict").isNotNull(), (F.col("_verdict") == "allow").cast("int"))
        outcomes = parts.select("host", good.alias("good"))
        hosts = reputation(outcomes)
    else:
        every = parts.select("host", F.lit(None).cast("int").alias("good"))
        hosts = reputation(outcomes.select("host", F.col("good").cast("int")).unionByName(every))
    few = hosts.limit(broadcast_bound + 1).count() <= broadcast_bound
    judged = parts.join(F.broadcast(hosts) if few else hosts, "host")
    own = F.when(F.col("upper") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_verdict", own).alias("verdict"),
        F.col("n").alias("n_labelled"),
        F.col("mean").alias("good_rate"),
        F.col("upper").alias("upper_bound"),
    )
