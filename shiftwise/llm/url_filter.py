"""URL filter: rules first, then trust and distrust propagated over the host graph.

The graph's edges are links from one host to another, counted over all pages.
Trust is personalised PageRank from the trusted seeds along the links, multiplied
by the number of seeds, so that 1 is what a seed has by itself.  Distrust runs
from the blocked seeds against the links: who links to a blocked host earns
distrust.  It is told as a share of what a host would get if all its links
led to blocked hosts: a blocked seed has 1, another host ``damping`` times the mean
of what its links lead to.  So it doesn't fade when many hosts link to the same
blocked one, as it would if a blocked host dealt out one unit among them.

A seed is a host whose pages are, by half or more, allowed (trusted) or else
blocked by the rules.  A host is blocked if its distrust reaches ``threshold``
(0.4: by and large, half of its links lead to blocked hosts) and exceeds its trust.

Edges are summed per pair of hosts before they are joined, so a page or host
with many links is one row for each other host; every iteration is a join on
the host and a partial sum, and the scores are written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.staging import stage


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # begins with a slash

    @property
    def text(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Links that name a host; relative links stay on their own.
LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], what: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, what))).otherwise(out)
    return out


def host_edges(links: DataFrame) -> DataFrame:
    """(source, target, n) of ``links`` (host, targets): how many links lead from a host to another."""
    links = links.select(F.col("host").alias("source"), F.explode("targets").alias("target"))
    links = links.withColumn("target", lower_ascii(F.col("target"))).where("source <> target")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, hosts: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) of every host.

    ``edges`` (source, target, n); ``hosts`` (host, trusted, blocked).  Trust that
    reaches a host without links to others goes back to the seeds.  Iterates
    until no score changes by more than ``tolerance``.  A round shrinks all
    changes by ``damping`` (trust: their sum, at first no more than twice the
    seeds), which bounds the rounds by the logarithm of the number of seeds.
    """
    out = edges.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("all"))
    shares = stage(edges.join(out, F.col("source") == F.col("s")).select("source", "target", (F.col("n") / F.col("all")).alias("share")), "edges")
    # both kinds use a host's shares: trust hands them out, distrust takes the mean of what they lead to
    both = stage(shares.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "share").unionByName(
        shares.select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "share")), "edges")
    known = hosts.select("host", "trusted", "blocked").unionByName(
        both.select(F.col("to").alias("host"), F.lit(False).alias("trusted"), F.lit(False).alias("blocked")).distinct())
    known = known.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked"))
    ends = shares.select(F.col("source").alias("s")).distinct().withColumn("linked", F.lit(True))
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed"))))
    nodes = known.join(ends, F.col("host") == F.col("s"), "left").select("host", F.col("linked").isNotNull().alias("linked"), kinds.alias("x"))
    nodes = stage(nodes.select("x.kind", "host", F.col("x.seed").cast("double").alias("seed"), "linked"), "nodes")
    trust = F.col("kind") == "trust"
    seeds = nodes.where(trust).agg(F.sum("seed")).first()[0] or 0.0
    scores = nodes.withColumn("score", F.col("seed"))
    most = math.ceil(math.log(tolerance / (2 * max(1.0, seeds))) / math.log(damping)) + 1
    for _ in range(most):
        lost = scores.where(trust & ~F.col("linked")).agg(F.sum("score")).first()[0] or 0.0
        got = both.join(scores.select("kind", F.col("host").alias("from"), "score"), ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = scores.join(got, ["kind", "host"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        ranked = (1 - damping) * F.col("seed") + damping * (F.col("got") + F.col("seed") * F.lit(lost / seeds if seeds else 0.0))
        new = new.withColumn("new", F.when(trust, ranked).otherwise(F.when(F.col("seed") > 0, F.col("seed")).otherwise(damping * F.col("got"))))
        new = stage(new.select("kind", "host", "seed", "linked", F.col("score").alias("old"), F.col("new").alias("score")), "scores")
        change = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        scores = new.drop("old")
        if change is None or change <= tolerance:
            break
    return scores.groupBy("host").agg(F.max(F.when(trust, F.col("score"))).alias("trust"), F.max(F.when(~trust, F.col("score"))).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.4, tolerance: float = 1e-6) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``pages`` needs ``page_id``, ``url`` and ``html`` and may have any other
    columns.  A null url, or one without ``://``, has an empty host and path; an
    empty host is no node of the graph and is allowed.  A null html has no
    links.  Repeated rows are judged each by itself; an empty table gives no
    rows.  Html is read whole, once, however long it is.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.regexp_extract_all("html", F.lit(LINK), 1).alias("targets"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "text")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    rows = stage(rows, "links")
    share = {v: F.avg((F.coalesce("ruled", F.lit("")) == v).cast("double")) for v in ("allow", "block")}
    hosts = rows.where("host <> ''").groupBy("host").agg(share["allow"].alias("allowed"), share["block"].alias("blocked"))
    trusted = F.col("allowed") >= 0.5
    hosts = stage(hosts.select("host", trusted.alias("trusted"), (~trusted & (F.col("blocked") >= 0.5)).alias("blocked")), "hosts")
    scores = propagate(host_edges(rows.where("host <> ''").select("host", "targets")), hosts, tolerance=tolerance)
    bad = scores.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("found"))
    out = rows.select("page_id", "host", "path", "rule", "ruled").join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict"))
