"""Verdicts on page addresses by rules, and beyond them by trust along links (operator 10).

Rules name a host, with its subdomains, and a path. Where no rule fits a page, its host decides.
Trust flows from hosts with allowed pages along links between hosts; distrust flows from hosts with blocked
pages against the links, so that who links to them loses. Both are personalised PageRanks.
Hosts are linked by addresses in their pages, and to the domain above them. Ranks are sums over walks: in each round
what is on its way goes one link on, until less than TOLERANCE of it is left. A host is blocked if
its distrust exceeds its trust by TOLERANCE and is at least `least`, both in shares of an average host.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.tables import as_dealt, cut, dealt, partitions, swept

LINK = r"""(?i)(?:href|src)[\t-\r ]*=[\t-\r ]*["']?(?:https?:)?//([^/"'\t-\r <>?#]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Of all trust, and of all distrust, less than this is still on its way at the end.
TOLERANCE = 1e-3
#: Rounds between two cuts of the lineage.
ROUNDS = 11
#: Up to so many hosts their verdicts are sent to every task of the last join.
MOST_SENT = 100_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, in lower case; empty without that."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): addresses on the pages of src to hosts dst, and both ways between a host and the domain above it."""
    linked = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    found = linked.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst"))
    above = pages.select("host").distinct().select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("above")).where("above <> ''")
    pairs = found.unionByName(above.selectExpr("host as src", "above as dst")).unionByName(above.selectExpr("above as src", "host as dst"))
    return pairs.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of walks from seeds (host, trust, distrust), every host once, sums of 1.

    A walk goes on with a chance of damping. Each round is one join of links with what is on its way, and one sum by host
    that also carries what has arrived; the lineage is cut every few, and rounds end when less than tolerance of what
    set out is on its way. Walks end at hosts without links. Links are dealt and sorted by host once, so a round
    shuffles what is on its way, and no link; what a host with very many links receives is summed before it travels.
    """
    n = partitions(links.sparkSession)
    out, into = links.groupBy("src").agg(F.sum("n").alias("all_out")), links.groupBy("dst").agg(F.sum("n").alias("all_in"))
    shares = links.join(out, "src").join(into, "dst")
    arcs = shares.selectExpr("src as host", "dst as next", "n / all_out as t", "0D as d", "0D as ends").unionByName(shares.selectExpr("dst as host", "src as next", "0D as t", "n / all_in as d", "0D as ends"))
    arcs = dealt(arcs.unionByName(seeds.selectExpr("host", "host as next", "0D as t", "0D as d", "1D as ends")), n, "host", in_order=True)  # of each host one where its own sums go on
    state = seeds.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.col("trust").alias("t_way"), F.col("distrust").alias("d_way"))
    ends = F.col("ends")
    while True:
        for _ in range(ROUNDS):
            moved = arcs.join(state, "host").select(
                F.col("next").alias("host"),
                (ends * (F.col("trust") + F.col("t_way") * (1 - damping))).alias("trust"), (ends * (F.col("distrust") + F.col("d_way") * (1 - damping))).alias("distrust"),
                (F.col("t") * F.col("t_way") * damping).alias("t_way"), (F.col("d") * F.col("d_way") * damping).alias("d_way"),
            )
            state = moved.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "t_way", "d_way")))
        state = as_dealt(state)
        t, d = state.agg(F.sum("t_way"), F.sum("d_way")).first()
        if max(t or 0.0, d or 0.0) < tolerance:
            return state.select("host", "trust", "distrust")
        swept(links.sparkSession)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], least: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page.

    A null url, or one without `://`, has empty host and path, fits no rule and is allowed with no
    trust or distrust. Repeated rows are judged each; other columns are left out; an empty table gives
    an empty one. Trust and distrust are those of the host, in shares of an average host.
    """
    host = host_of(F.col(url_col))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path_of(F.col(url_col)).alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    links = cut(host_links(pages.select(host.alias("host"), F.col(html_col).alias("html")), "html"))
    counted = rows.where("host <> ''").groupBy("host").agg(*(F.sum((F.coalesce(F.col("verdict"), F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))))
    outside = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    hosts = cut(counted.unionByName(outside).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    n, trust, distrust = hosts.agg(F.count(F.lit(1)), F.sum("trust"), F.sum("distrust")).first()
    seeds = hosts.select("host", (F.col("trust") / (trust or 1.0)).alias("trust"), (F.col("distrust") / (distrust or 1.0)).alias("distrust"))
    ranks = propagate(links, seeds).select("host", (F.col("trust") * n).alias("trust"), (F.col("distrust") * n).alias("distrust"))
    blocked = (F.col("distrust") > F.col("trust") + TOLERANCE) & (F.col("distrust") >= least)
    joined = rows.join(F.broadcast(ranks) if n <= MOST_SENT else ranks, "host", "left")
    own = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    told = reduce(lambda df, c: df.withColumn(c, F.coalesce(c, F.lit(0.0))), ("trust", "distrust"), joined.withColumn("verdict", F.coalesce("verdict", own)))
    return told.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "trust", "distrust")
