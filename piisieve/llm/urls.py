"""URL filters by propagation over the link graph of hosts.

Pages link hosts by the absolute links in their HTML. Trust is a personalised PageRank over
links from the hosts of pages that a rule allows; distrust runs from hosts that a rule blocks
as a whole, against the links, to those who link there. A rule's verdict on a page stands;
other pages are blocked where their host's distrust exceeds its trust. Every seed starts with the same
rank, so a verdict depends on the links near a host and not on how many seeds there are elsewhere.

Host edges are aggregated before they are shuffled, ranks and edges meet in equi-joins, and
each round's ranks are a staged table. Rounds end when no host's rank moves by ``TOLERANCE``;
the damping bounds their number. No table is broadcast by hand.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null HTML has no links; links within a host and to hosts without pages count in the
graph but for self-links; without seeds or links only rules block; repeated rows are judged
each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged

#: fixed values: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
TOLERANCE = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def fitting(rules: list[tuple[str, str, str]]) -> tuple[Column, Column, Column]:
    """Rule text, verdict and path of the longest rule that fits columns host and path, else null."""
    text, verdict, whole = (F.lit(None).cast("string") for _ in range(3))
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):      # the longest is tested first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
        whole = F.when(fits, F.lit(path)).otherwise(whole)
    return text, verdict, whole


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between different hosts; shares of a source add up to one."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
    counted = staged(links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> dst")
                     .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "links")
    total = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return staged(counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "edges")


def reversed_edges(e: DataFrame) -> DataFrame:
    """The edges turned round, with shares by the new source."""
    total = e.groupBy("dst").agg(F.sum("share").alias("total"))
    return staged(e.join(total, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                              (F.col("share") / F.col("total")).alias("share")), "reversed")


def propagated(e: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank over ``e`` from ``seeds`` (host, weight), times the sum of weights.

    A seed of weight one starts ``1 - damping``, however many others there are. Rank at hosts without links ends there.
    """
    start = staged(seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank")), "seeds")
    rank = start
    for _ in range(100):          # what is left to move falls by the damping each round
        passed = e.join(rank, e.src == rank.host).select(
            F.col("dst").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank"))
        new = staged(start.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        moved = new.alias("a").join(rank.alias("b"), "host", "left").agg(
            F.max(F.abs(F.col("a.rank") - F.coalesce("b.rank", F.lit(0.0)))).alias("m")).first()["m"] or 0.0
        rank = new
        if moved < tolerance:
            break
    return rank


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, damping: float = DAMPING,
           tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    text, verdict, whole = fitting(RULES if rules is None else rules)
    rows = rows.select("*", text.alias("rule"), verdict.alias("ruled"), whole.alias("whole"))
    # weights are host shares, not page counts: a large host is no better a seed
    found = staged(rows.groupBy("host").agg(
        F.max((F.col("ruled") == "allow").cast("double")).alias("allowed"),
        F.max(((F.col("ruled") == "block") & (F.col("whole") == "/")).cast("double")).alias("blocked")), "hosts")
    e = edges(rows.select("host", "html"))
    trust = propagated(e, found.where("allowed > 0").select("host", F.col("allowed").alias("weight")), damping, tolerance)
    distrust = propagated(reversed_edges(e), found.where("blocked > 0").select("host", F.col("blocked").alias("weight")), damping, tolerance)
    scores = staged(found.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left")
                    .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"]),
                    "scores")
    out = rows.drop("html").join(scores, "host")
    by_host = F.when((F.col("host") != "") & (F.col("distrust") > F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")
