"""Verdicts for page addresses: rules first, then trust and distrust that spread over the links between hosts.

Trust starts at hosts that an allow rule names and follows links (personalised PageRank); distrust starts at hosts that a block rule
names and follows links backwards, to those that link there. A host with pages of both kinds starts the kind that more of its ruled
pages have, with its net share of them. A host is blocked when its distrust passes a threshold and its trust.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, null without one. A block rule wins a tie."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "block", r.name)):  # the last one tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, action = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.action).otherwise(action)
    return name, action


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of host ``src`` that link to host ``dst``. Links without a host stay on their own host and say nothing."""
    link = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(link), F.lit(1)), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))))
    each = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return each.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def starts(split: DataFrame) -> DataFrame:
    """(kind, host, weight) of the hosts of ``split`` (host, action): the difference of blocked and allowed pages as a share of the ruled
    ones. A host of one action has weight one, a host with as many of both none. Shares settle as a host grows, so seeds stay at every size."""
    net = F.sum(F.when(F.col("action") == "block", 1.0).otherwise(-1.0)) / F.count(F.lit(1))
    hosts = split.where(F.col("action").isNotNull() & (F.col("host") != "")).groupBy("host").agg(net.alias("net")).where("net <> 0")
    return hosts.select(F.when(F.col("net") < 0, "trust").otherwise("distrust").alias("kind"), "host", F.abs("net").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, close: float = 1e-6) -> DataFrame:
    """(kind, host, value) of both propagations at once, kind 'trust' or 'distrust'. ``seeds`` has kind and host, and may have a weight; each
    kind starts with one in total, dealt by weight. What a host without links would pass on is lost. Goes on until no
    host can still change by ``close``: a round passes on ``damping`` of what the last one moved, so all later rounds together move at most
    the last move times damping / (1 - damping). Each round is written to the shared folder."""
    seeds = settle((seeds if "weight" in seeds.columns else seeds.withColumn("weight", F.lit(1.0))).distinct())
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("n"))
    seeds = settle(seeds.join(sums, "kind").select("kind", "host", (F.col("weight") / F.col("n")).alias("seed")))
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight"))
    out = both.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    edges = settle(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("total")).alias("share")))
    # what a host keeps whether there are links or not: adding links elsewhere changes nothing for it
    value = settle(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("value")))
    if edges.isEmpty():
        return value
    while True:
        moved = edges.join(value, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("value") * damping).alias("value"))
        start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("value"))
        after = settle(moved.unionByName(start).groupBy("kind", "host").agg(F.sum("value").alias("value")))
        change = after.unionByName(value.select("kind", "host", (-F.col("value")).alias("value"))).groupBy("kind", "host").agg(F.sum("value").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
        value = after
        if (change or 0.0) * damping / (1 - damping) < close:
            return value


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html; other columns are ignored).

    A null url, or one without ``://``, has empty host and path and is allowed, unless a rule fits; a null html has no links. Repeated rows each
    come back. Without a rule a page is blocked when its host's distrust is greater than its trust and at least ``threshold`` shares, where a share is what
    every host would keep if all were seeds of one weight without links: (1 - damping) / number of hosts. A host that nothing reaches is allowed. An empty
    table gives an empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("action", action)
    hosts = settle(split.where("host <> ''").groupBy("host").count())
    number = float(hosts.count())
    share = (1 - damping) / max(number, 1.0)
    close = max(1e-3 * threshold * share, 1e-14)  # far under what blocks a host, but above rounding
    value = propagate(settle(host_links(pages)), starts(split), damping, close)
    split_value = value.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("value"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("value"))).alias("distrust"))
    bad = settle(split_value.where((F.coalesce("distrust", F.lit(0.0)) / share >= threshold - 1e-9) & (F.col("distrust") > F.coalesce("trust", F.lit(0.0)))).select("host", F.lit("block").alias("spread")))
    open_ = split.where(F.col("action").isNull()).join(bad, "host", "left")
    done = split.where(F.col("action").isNotNull()).select("page_id", "host", "path", "rule", F.col("action").alias("verdict"))
    return done.unionByName(open_.select("page_id", "host", "path", "rule", F.coalesce("spread", F.lit("allow")).alias("verdict")))
