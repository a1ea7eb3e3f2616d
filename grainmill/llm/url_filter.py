"""Verdicts on urls by rules, and for other hosts by trust and distrust that spread over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.plans.shared import drop_table, materialise

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none fits."""
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: absolute links from one host's pages to another host, by number of links."""
    links = pages.select(split_url(pages["url"])[0].alias("src"), F.explode(F.regexp_extract_all(pages["html"], F.lit(LINK), 1)).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    edges = links.select("src", split_url(link)[0].alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def host_trust(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """``(host, trust, distrust)`` by personalised PageRank.

    ``seeds(host, trusted, blocked)``: trust starts at trusted hosts and follows links; distrust starts at blocked
    hosts and follows links backwards, to those who link to them. Each kind starts with one unit, shared evenly by
    its seeds. Rounds go on until a kind's masses change by less than ``tolerance`` in total; each round shrinks the
    change by ``damping`` at least, so that takes about log(tolerance) / log(damping) rounds, 128, whatever the graph.
    """
    kinds = F.explode(F.expr("filter(array(if(trusted, 'trust', null), if(blocked, 'distrust', null)), k -> k is not null)"))
    start = seeds.select("host", kinds.alias("kind"))
    share = start.groupBy("kind").agg((1 / F.count("*")).alias("seed"))
    start = materialise(start.join(F.broadcast(share), "kind"), "seeds")  # two rows are broadcast
    ways = edges.select("src", "dst", "weight", F.lit("trust").alias("kind")).union(edges.select(F.col("dst"), F.col("src"), "weight", F.lit("distrust")))
    out = ways.groupBy("src", "kind").agg(F.sum("weight").alias("total"))
    ways = materialise(ways.join(out, ["src", "kind"]).select(F.col("src").alias("host"), "kind", "dst", (F.col("weight") / F.col("total")).alias("part")), "ways")
    rank = materialise(start.select("host", "kind", F.col("seed").alias("mass")), "rank")
    base = start.select("host", "kind", ((1 - damping) * F.col("seed")).alias("mass"))
    moved = 0.0 if ways.isEmpty() else 1.0  # if nothing spreads, every round would give the seeds back
    while moved >= tolerance:
        flow = rank.join(ways, ["host", "kind"]).select(F.col("dst").alias("host"), "kind", (damping * F.col("mass") * F.col("part")).alias("mass"))
        terms = flow.unionByName(base).withColumn("old", F.lit(0.0)).unionByName(rank.select("host", "kind", F.lit(0.0).alias("mass"), F.col("mass").alias("old")))
        following = materialise(terms.groupBy("host", "kind").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), "rank")
        moved = following.agg(F.coalesce(F.sum(F.abs(F.col("mass") - F.col("old"))), F.lit(0.0))).first()[0]
        drop_table(rank)
        rank = following.select("host", "kind", "mass")
        rank._grainmill_path = following._grainmill_path
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(value("trust"), value("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.0, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    A rule decides where one fits. Other urls go by their host: blocked if its distrust exceeds its trust by more than
    ``threshold``, else allowed. Seeds are the hosts that rules speak of: trusted if more of a host's urls are allowed
    than blocked, blocked if more are blocked. A url without a host is allowed; null html has no links; null ids, equal
    rows and other columns are no matter; an empty table gives no rows.
    """
    host, path = split_url(pages["url"])
    urls = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), said.alias("said"))
    votes = urls.where("host <> '' and said is not null").groupBy("host").agg(F.sum(F.when(F.col("said") == "allow", 1).otherwise(-1)).alias("vote"))
    scores = host_trust(votes.select("host", (F.col("vote") > 0).alias("trusted"), (F.col("vote") < 0).alias("blocked")), host_edges(pages), damping, tolerance)
    bad = scores.where(F.col("distrust") - F.col("trust") > threshold).select(F.col("host").alias("bad_host"))
    judged = urls.join(bad, urls["host"] == bad["bad_host"], "left")
    verdict = F.coalesce("said", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
