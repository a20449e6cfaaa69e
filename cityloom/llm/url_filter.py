"""URL verdicts by rules and, where no rule fits, by link-graph propagation.

A rule names a host and a path prefix and fits the host, all its subdomains and
paths that start with the prefix; the longest fitting rule decides.  Hosts of
whose ruled pages more are allowed than blocked are trusted seeds, those with
more blocked than allowed distrusted ones.  Trust flows along links
(personalised PageRank), distrust against them: who links to blocked hosts is
suspect.  Both restart from a distribution over their seeds, and what reaches a
host without outgoing edges returns to the seeds, so that each is a distribution
whatever the numbers of seeds.  A host is blocked where its distrust exceeds its
trust and LEAST of a seed's restart; without a rule or a reached seed it is
allowed.

Null URLs and those without "://" have empty host and path, no rule fits them
and they are allowed.  Links count once per page and target host; links within a
host count for nothing.  Rows are judged one by one, repeated rows alike, and
count as often for their host; hosts with as many blocked as allowed pages seed
nothing, and equal trust and distrust allow.  An empty table gives no rows.
Columns to keep that are named like one of the results are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.session import cut, fresh, maybe_broadcast, stored

#: Ranks have mass 1; they have settled when a round moves at most TOLERANCE of it.
DAMPING, TOLERANCE = 0.85, 1e-4
#: A host is blocked where distrust > THRESHOLD x trust and distrust is at least LEAST of what a distrusted seed restarts with.
THRESHOLD, LEAST = 1.0, 0.01
#: A link's host; a tag is read no further than the next one begins, so that no page is read twice.
LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(r: Rule, host: Column, path: Column) -> Column:
    return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)


def matched(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule (of equal ones a blocking one); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        out = F.when(fits(r, host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts, one a page and target."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(source), F.lit(LINK), F.lit(1)), ascii_lower))
    each = pages.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
    return each.filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): the stationary distribution of following links and, with 1 - damping or at a dead end, restarting from the seeds.

    edges (src, dst, links), seeds (host, seed), whose weights are normalised.
    Shares are summed before they are shuffled; each round is written to the
    shared checkpoint folder.  A round shrinks what is still moving by damping at
    least, so the rounds needed are known; more of them are an error.
    """
    mass = seeds.agg(F.sum("seed").alias("m")).first()["m"]
    base = cut(seeds.select("host", (F.col("seed") / F.lit(float(mass or 1.0))).alias("rank")))
    if not mass:
        return base
    total = edges.groupBy("src").agg(F.sum("links").alias("all"))
    share = cut(edges.join(total, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share")))
    rank = base
    for _ in range(2 + math.ceil(math.log(tolerance / 2) / math.log(damping))):
        flow = rank.join(share, rank["host"] == share["src"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
        flow = cut(flow)
        moved = flow.agg(F.sum("rank").alias("m")).first()["m"] or 0.0
        new = cut(flow.union(base.select("host", F.col("rank") * (1.0 - moved))).groupBy("host").agg(F.sum("rank").alias("rank")))
        change = new.join(rank.withColumnRenamed("rank", "was"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("d")).first()["d"]
        rank = new
        if change <= tolerance:
            return rank
    raise RuntimeError("ranks didn't settle")


def seed_hosts(ruled: DataFrame) -> DataFrame:
    """(host, good, bad) of every host with a ruled page; ruled has host and verdict (null: no rule)."""
    known = ruled.filter("host <> '' AND verdict IS NOT NULL")
    return known.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))


def host_verdicts(ruled: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that a seed reaches."""
    seeds = stored(seed_hosts(ruled), "url-seeds")
    one = F.lit(1.0).alias("seed")
    trusted, distrusted = seeds.filter("good > bad").select("host", one), seeds.filter("bad > good").select("host", one)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust, distrust = propagated(edges, trusted), propagated(against, distrusted)
    least = LEAST / max(1, distrusted.count())
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    known = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return known.withColumn("blocked", (F.col("distrust") >= least) & (F.col("distrust") > THRESHOLD * F.col("trust")))


RESULTS = ["host", "path", "rule", "verdict", "by"]


def judged(pages: DataFrame, rules: list[Rule], keep: list[str], url: str = "url", source: str = "html") -> DataFrame:
    """keep, host, path, rule, verdict and by (rule or graph) for every page."""
    keep = [c for c in keep if c not in RESULTS]
    m, v, b, h = fresh(pages, "_match", "_verdict", "_blocked", "_of")
    kept = [F.col(f"`{c}`") for c in keep]
    read = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = read.withColumn(m, matched(rules, F.col("host"), F.col("path"))).select(*kept, "host", "path", F.col(m)["rule"].alias("rule"), F.col(m)["verdict"].alias(v))
    edges = stored(host_edges(pages, url, source), "url-edges")
    blocked = stored(host_verdicts(ruled.select("host", F.col(v).alias("verdict")), edges).filter("blocked").select(F.col("host").alias(h)), "url-blocked")
    # a row a blocked host: measured, and beyond the limit pages are joined by host, which adaptive execution splits
    out = ruled.join(maybe_broadcast(blocked.withColumn(b, F.lit(True)), 80), F.col("host") == F.col(h), "left")
    method = F.when(F.col(b), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*kept, "host", "path", "rule", F.coalesce(v, method).alias("verdict"), F.when(F.col(v).isNotNull(), "rule").otherwise("graph").alias("by"))
