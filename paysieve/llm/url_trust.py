"""URL filter: explicit rules, and trust and distrust that spread over the graph of hosts.

A rule names a host (with its subdomains) and a start of the path; of the rules that fit a url the longest decides.
Where none fits, the host decides: trust starts at hosts with allowed pages and flows along links (personalised
PageRank), distrust starts at hosts with blocked pages and flows against links, to whoever links there.  A host is
blocked if distrust makes up more than ``MAX_SHARE`` of both.

Links are counted per pair of hosts before they are shuffled.  Besides links, a host and its parent (the host less its
first label, where that host has pages or links too) are linked both ways.  Both flows are one table keyed by (flow,
host), so a round is one join and one sum; every few rounds it is checkpointed.  Mass at hosts without links is dropped.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; null html has
no links; repeated pages weigh twice and are judged one by one; without seeds of a kind its flow is 0; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import lower_ascii, saved

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""
DAMPING, ROUNDS, KEPT_ROUNDS, MAX_SHARE = 0.85, 12, 4, 0.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.  The list is a parameter of bounded length."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts (scheme-relative and absolute ones; relative links stay at home)."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return links.select("src", F.regexp_replace(lower_ascii(F.col("dst")), r"^[^@]*@|:\d*$", "").alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _with_parents(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    known = hosts.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    child = known.select(F.col("host").alias("child"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("host")).where("host <> ''")
    pairs = child.join(known, "host").select(F.inline(F.array(F.struct(F.col("child").alias("src"), F.col("host").alias("dst")), F.struct(F.col("host").alias("src"), F.col("child").alias("dst")))))
    return edges.unionByName(pairs.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust after ROUNDS rounds; seeds has host, n_allow, n_block.  Each flow's seeds sum to 1."""
    both = edges.select(F.lit("trust").alias("flow"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("flow"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("flow", "src").agg(F.sum("n").alias("of"))
    steps = saved(both.join(out, ["flow", "src"]).select("flow", "src", "dst", (F.col("n") / F.col("of") * DAMPING).alias("share")))
    sums = seeds.agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).first()
    start = seeds.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("flow"), (F.col("n_allow") / max(1, sums.a or 0)).alias("mass")), F.struct(F.lit("distrust").alias("flow"), (F.col("n_block") / max(1, sums.b or 0)).alias("mass"))))).where("mass > 0")
    start = saved(start.select("flow", "host", "mass"))
    base = start.select("flow", "host", (F.col("mass") * (1 - DAMPING)).alias("mass"))
    state = start
    for i in range(ROUNDS):
        moved = steps.join(state.withColumnRenamed("host", "src"), ["flow", "src"]).select("flow", F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
        state = moved.unionByName(base).groupBy("flow", "host").agg(F.sum("mass").alias("mass"))
        if (i + 1) % KEPT_ROUNDS == 0:
            state = saved(state)
    mass = lambda flow: F.coalesce(F.sum(F.when(F.col("flow") == flow, F.col("mass"))), F.lit(0.0)).alias(flow)
    return state.groupBy("host").agg(mass("trust"), mass("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's distrust share (null if it has neither)."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("found"))
    is_ = lambda v: F.sum((F.coalesce(F.col("found.verdict"), F.lit("")) == v).cast("long"))
    hosts = saved(urls.where("host <> ''").groupBy("host").agg(is_("allow").alias("n_allow"), is_("block").alias("n_block")))
    edges = saved(_with_parents(host_edges(pages), hosts))
    shares = spread(edges, hosts).select(F.col("host").alias("_host"), F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9).alias("distrust_share"))
    out = urls.join(shares, urls["host"] == shares["_host"], "left")
    by_host = F.when(F.coalesce("distrust_share", F.lit(0.0)) > max_share, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_host).alias("verdict"), "distrust_share")
