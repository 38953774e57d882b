"""URL filters: seed rules, and trust and distrust spread over the links between hosts.

Trust starts at hosts most of whose pages are allowed by rules and follows links
(a personalised PageRank); distrust starts at hosts most of whose pages are
blocked and goes against the links, since who links to a blocked host shares in
it. Seeds weigh as many as they have such pages. A host is blocked if its
distrust is over its trust, and over `threshold` times an even share of all
distrust (1 / the number of hosts), which means the same however many hosts
there are. Pages that a rule fits get the rule's verdict, the others that of
their host.

The graph has one row for each pair of hosts, however many pages link them;
links are summed before they are shuffled, a hub's scores are one row, and each
round is cut by a checkpoint. Rounds go on until all scores together change by
less than a hundredth of the least distrust that blocks, however long the chains. Only DataFrame functions are used.

Defined cases: null urls and urls without `://` have empty host and path and are
allowed; null html has no links; repeated pages are judged alike and weigh as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, plain

#: Fixed seed rules: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does. The rules are a short fixed list."""
    if len(rules) > 200:
        raise ValueError("a list of over 200 rules is for a join, not for an expression")
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(order):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


#: A tag that may link, up to its end or that of the page; what it has matched isn't tried again, so a page takes one pass.
TAG = r"(?i)<(?:a|area|link)\b[^>]*+"
#: The host of a tag's first link to another place.
TARGET = r"""(?i)\bhref\s*+=\s*+["']?(?:https?:)?//([^/?#"'\s>]*)"""


def links(pages: DataFrame) -> DataFrame:
    """Links between different hosts in the pages' html: src, dst, n. A tag that isn't closed reaches to the next `>` and is one link."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAG), F.lit(0))
    targets = F.transform(tags, lambda t: F.regexp_extract(t, TARGET, 1))
    return (
        pages.select("host", F.explode(targets).alias("to"))
        .select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank: (host, score) from seeds (host, seed) over edges (src, dst, share), by power iteration until a round changes all scores together by at most `tolerance`."""
    score = seeds.select("host", F.col("seed").alias("score"))
    kept = seeds.select("host", ((1 - damping) * F.col("seed")).alias("score"), F.lit(0.0).alias("was"))
    bound = 2.0  # a round changes the scores by at most damping times what the one before it did
    while bound > tolerance:
        moved = edges.join(score, edges.src == score.host).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"), F.lit(0.0).alias("was"))
        before = score.select("host", F.lit(0.0).alias("score"), F.col("score").alias("was"))
        after = cut(moved.unionByName(kept).unionByName(before).groupBy("host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")))
        bound = min(bound * damping, after.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0)
        score = after.select("host", "score")
    return score


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 1e-3) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    pages = plain(pages, "page_id", "url", "html").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))

    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    hosts = cut(hosts)
    even = 1.0 / max(hosts.count(), 1)
    edges = cut(links(pages))
    scores = hosts.select("host")
    linked = not edges.isEmpty()
    if linked:  # without links nothing spreads beyond the seeds
        by_source = edges.groupBy("src").agg(F.sum("n").alias("all"))
        forward = edges.join(by_source, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        by_target = back.groupBy("src").agg(F.sum("n").alias("all"))
        back = back.join(by_target, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    for name, seeded in (("trust", "allowed"), ("distrust", "blocked")):
        seeds = hosts.where(2 * F.col(seeded) > F.col("pages"))
        total = seeds.agg(F.sum(seeded)).first()[0] or 0
        seeds = seeds.select("host", (F.col(seeded) / F.lit(float(max(total, 1)))).alias("seed"))
        found = seeds.select("host", F.col("seed").alias("score")) if not linked else spread(cut(forward if name == "trust" else back), seeds, damping, 0.01 * threshold * even)
        scores = scores.join(found.select("host", F.col("score").alias(name)), "host", "left")
    scores = cut(scores.select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]))
    result = judged.join(scores, "host", "left")
    blocked = (F.col("distrust") > threshold * even) & (F.col("distrust") > F.col("trust"))
    return result.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
