"""URL filters: rules on hosts and paths, and trust and distrust that spread over the graph of hosts.

Trust is personalised PageRank from the hosts of allowed pages along links; distrust is the same from the hosts of blocked pages against the links'
direction. Both run over host edges in Spark, counted once per pair of hosts, until they stand still.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, meet, settle

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, LIFT = 0.85, 1.0
#: Propagation ends when the last rounds have moved less than CLOSE of all rank, or after ROUNDS.
CLOSE, ROUNDS = 1e-3, 64
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host, or a domain above it, and a path; null if none does."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule is laid over a shorter one
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        best, verdict = F.when(fits, h + p).otherwise(best), F.when(fits, what).otherwise(verdict)
    return best, verdict


def edges(pages: DataFrame, host_: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, w): links between different hosts, with their number, and an edge each way between a host and the domain it is part of
    (all but the first label, while that has a dot), if that is not itself shared by the whole top level."""
    link = pages.select(F.col(host_).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    link = link.select("src", lower_ascii(F.col("dst")).alias("dst"))
    up = pages.select(F.col(host_).alias("src")).distinct().withColumn("dst", F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1))
    up = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = link.unionByName(up).filter("src <> '' and dst <> '' and src <> dst")
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """(host, trust, distrust), each summing to 1, for seeds (host, trust, distrust; weights) and links (src, dst, w).

    What reaches a host without onward edges is given back to the seeds: leaving it out and scaling at the end gives the same ranks.
    Either sum is 0 if it has no seeds. Ends once `close` to still; after ROUNDS, what is left to move is below damping to their power."""
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    scale = lambda c, s: F.col(c) / (s or 1.0)
    base = settle(seeds.select("host", scale("trust", sums["t"]).alias("trust"), scale("distrust", sums["d"]).alias("distrust")).filter("trust > 0 or distrust > 0"), "url-seeds")
    out = links.groupBy("src").agg(F.sum("w").alias("o"))
    into = links.groupBy("dst").agg(F.sum("w").alias("i"))
    flow = links.join(out, "src").join(into, "dst")
    zero = F.lit(0.0)
    step = settle(
        flow.select(F.col("src").alias("a"), F.col("dst").alias("z"), (F.col("w") / F.col("o")).alias("ft"), zero.alias("fd")).unionByName(
            flow.select(F.col("dst").alias("a"), F.col("src").alias("z"), zero.alias("ft"), (F.col("w") / F.col("i")).alias("fd"))
        ),
        "url-flow",
    )
    # dealt by the host that the rank flows from once, and held so: a round moves ranks alone. What is lost is read again from the settled table
    step = step.repartition(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a").persist(StorageLevel.DISK_ONLY)
    rank = last = base
    for r in range(rounds):
        moved = rank.join(step, rank["host"] == step["a"]).select(F.col("z").alias("host"), (F.col("trust") * F.col("ft") * damping).alias("trust"), (F.col("distrust") * F.col("fd") * damping).alias("distrust"))
        again = base.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        rank = moved.unionByName(again).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if r % 4 == 3 or r == rounds - 1:
            rank = settle(rank, "url-rank")
            both = rank.join(last.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "left").na.fill(0.0)
            moved = both.agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))).alias("by"), F.sum(F.col("trust") + F.col("distrust")).alias("all")).first()
            if (moved["by"] or 0.0) <= close * (moved["all"] or 0.0):
                break
            last = rank
    step.unpersist()
    sums = rank.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    return rank.select("host", scale("trust", sums["t"]).alias("trust"), scale("distrust", sums["d"]).alias("distrust"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, lift: float = LIFT) -> DataFrame:
    """A row for each row of pages: key, host, path, rule, verdict, trust and distrust of the host.

    A page's verdict is its longest rule's. Where no rule fits, a host is blocked if its distrust is `lift` or more times its share of the pages and above
    its trust; a host that the graph says nothing of, or an empty one, is allowed. Null urls and html count as empty; equal rows stay separate.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"), F.col(f"`{html}`").alias("html"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    links = settle(edges(rows), "url-edges")
    by = settle(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("said") == "allow").cast("double")).alias("trust"), F.sum((F.col("said") == "block").cast("double")).alias("distrust")).na.fill(0.0, ["trust", "distrust"]), "url-hosts")
    total = by.agg(F.sum("n")).first()[0] or 1
    rank = propagate(by.filter("host <> ''"), links)
    known = by.select("host", "n").join(rank, "host", "left").na.fill(0.0, ["trust", "distrust"])
    known = known.withColumn("bad", (F.col("host") != "") & (F.col("distrust") >= lift * F.col("n") / total) & (F.col("distrust") > F.col("trust")) & (F.col("distrust") > 0)).drop("n")
    out = meet(settle(rows.drop("html"), "url-pages"), known, "host", how="left")  # a host may have a third of all pages
    return out.select("key", "host", "path", "rule", F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
