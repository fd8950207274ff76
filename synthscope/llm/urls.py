"""URL filters: host and path rules, and trust propagated over the link graph of hosts.

Everything is a DataFrame or SQL expression. Rules decide where one fits; the other hosts
are judged by two personalised PageRanks over host edges: trust flows along links from the
hosts that rules allow, distrust flows against them from the hosts that rules block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 1.0
#: Absolute and protocol-relative targets of links.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fit(host: Column, path: Column, rules: Sequence[tuple], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tested first
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def rule_of(host: Column, path: Column, rules: Sequence[tuple] = RULES) -> Column:
    """The longest rule that fits, as host and path, or null."""
    return _first_fit(host, path, rules, lambda r: r[1] + r[2])


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts, from the absolute links of each page."""
    targets = F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))))
    return pages.where("html is not null").select("host", targets.alias("to")).select(F.col("host").alias("src"), ascii_lower(F.col("to")).alias("dst")).where("src <> '' and src <> dst").distinct()


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank (host, score) after ``rounds`` steps from seeds (host, seed) that add up to 1.

    Weight that reaches a host without links is dropped. Each round joins scores to edges and
    sums by target before the shuffle; the state is stored every four rounds.
    """
    edges = stored(links.join(links.groupBy("src").agg(F.count("*").alias("n")), "src"))
    score = seeds.select("host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = edges.join(score, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.lit(damping) * F.col("score") / F.col("n")).alias("score"))
        score = moved.union(seeds.select("host", ((1 - damping) * F.col("seed")).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            score = stored(score)
    return score


def host_scores(parts: DataFrame, pages: DataFrame, rules: Sequence[tuple] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of hosts in the link graph and of seed hosts.

    ``parts`` has host and rule verdict (``ruled``) of each page; a host's seed weight is its
    number of pages with that verdict.
    """
    links = stored(host_links(pages))
    counts = stored(parts.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"), F.count(F.when(F.col("ruled") == "block", 1)).alias("block")).where("allow + block > 0"))

    def seeds(kind: str) -> DataFrame:
        total = counts.agg(F.sum(kind).alias("all"))
        return counts.where(F.col(kind) > 0).join(F.broadcast(total)).select("host", (F.col(kind) / F.col("all")).alias("seed"))  # one row

    trust, distrust = seeds("allow"), seeds("block")
    if links.isEmpty():  # nothing to flow along: what each round keeps at the seeds
        steady = lambda s: s.select("host", ((1 - damping) * F.col("seed")).alias("score"))
        good, bad = steady(trust), steady(distrust)
    else:
        good = propagate(links, trust, damping, rounds)
        bad = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), distrust, damping, rounds)
    both = good.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(bad.select("host", F.lit(0.0), "score"))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The rule's verdict if one fits; else ``block`` if the host's distrust is above
    ``threshold`` times its trust, else ``allow``. Null urls and those without ``://`` have
    empty host and path, fit no rule and are allowed; null html has no links; repeated rows each get
    their row; other columns are ignored; an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = stored(parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), _first_fit(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("ruled")))
    scores = stored(host_scores(parts, pages.select(host_of(url).alias("host"), F.col("html").cast("string").alias("html")), rules, damping, rounds)).withColumnRenamed("host", "of")
    judged = parts.join(scores, F.col("host") == F.col("of"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust > F.lit(threshold) * trust, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
