"""Searches that look at what earlier matches of a log have used, each as of its own iteration, for several iterations in one plan.

A log's state is one table, provenance(): the match that filled a pixel says as of which iterations it is filled, and the pixel that was copied is used from the next one on. So a state as of an iteration is a comparison, and
nothing is replayed. `asked` has a row (iter, tx, ty) for each target that is searched for; they are few, and broadcast, as are their patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patches, search


def patches_as_of(replayed: DataFrame, asked: DataFrame, r: int) -> DataFrame:
    """(image_id, iter, x, y, dx, dy, hole, v, src_x, src_y): the pixels within r of each target as they are before the match `iter` is painted; replayed: paint.replay()'s grid. v and the source are those of
    the end where the pixel is a hole still."""
    ask = asked.select(F.col("iter").alias("_at"), "tx", "ty")
    near = F.col("x").between(F.col("tx") - r, F.col("tx") + r) & F.col("y").between(F.col("ty") - r, F.col("ty") + r)
    got = replayed.join(F.broadcast(ask), near)
    hole = F.col("hole") | F.coalesce(F.col("iter") >= F.col("_at"), F.lit(False))
    return got.select("image_id", F.col("_at").alias("iter"), "x", "y", (F.col("x") - F.col("tx")).alias("dx"), (F.col("y") - F.col("ty")).alias("dy"), hole.alias("hole"), "v", "src_x", "src_y")


def scores_as_of(px: DataFrame, replayed: DataFrame, asked: DataFrame, r: int, diff: Column | None = None) -> DataFrame:
    """(image_id, iter, cx, cy, d, n): the mean of `diff` (squares, if none is given) between each source patch of px and each target, by what is valid in the target as of its iteration."""
    t = patches_as_of(replayed, asked, r).filter(~F.col("hole")).select("image_id", "iter", "dx", "dy", F.col("v").alias("t_v"))
    return patches.differences(px, t, r, patches.ssd(["v"]) if diff is None else diff, None, ("iter",))


def holes_as_of(replayed: DataFrame, asked: DataFrame, r: int) -> DataFrame:
    """(image_id, iter, holes)"""
    return patches_as_of(replayed, asked, r).groupBy("image_id", "iter").agg(F.count_if("hole").alias("holes"))


def used_as_of(made: DataFrame, asked: DataFrame, r: int) -> DataFrame:
    """(image_id, iter, cx, cy, used): the pixels of the patch about each centre that matches before `iter` have copied, where there are any; made: paint.provenance()."""
    since = made.groupBy("image_id", "src_x", "src_y").agg(F.min("iter").alias("since"))
    off = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    at = since.withColumn("dx", off).withColumn("dy", off).groupBy("image_id", (F.col("src_x") - F.col("dx")).alias("cx"), (F.col("src_y") - F.col("dy")).alias("cy"), "since").agg(F.count("*").alias("k"))
    return at.join(F.broadcast(asked.select("iter")), F.col("since") < F.col("iter")).groupBy("image_id", "iter", "cx", "cy").agg(F.sum("k").alias("used"))


def limit_reuse(scored: DataFrame, used: DataFrame, holes: DataFrame) -> DataFrame:
    """Candidates (image_id, iter, cx, cy) whose patch has fewer copied pixels than half of the target's holes, rounded down. A target with fewer than two holes has none."""
    got = scored.join(used, ["image_id", "iter", "cx", "cy"], "left").join(F.broadcast(holes), ["image_id", "iter"])
    return got.filter(F.coalesce("used", F.lit(0)) < F.floor(F.col("holes") / 2)).drop("used", "holes")


def used_locally(replayed: DataFrame, asked: DataFrame, r: int, times: float = 3.0) -> DataFrame:
    """(image_id, iter, cx, cy, used): how many pixels under the holes of the target a candidate has that the surroundings of the target, of `times` its patch's side, hold already: valid pixels themselves, and what painted ones were copied
    from. Only what is near a target moves."""
    around = patches_as_of(replayed, asked, int((2 * r + 1) / 2 * times)).filter(~F.col("hole")).select("image_id", "iter", "src_x", "src_y").distinct()
    under = patches_as_of(replayed, asked, r).filter("hole").select("image_id", "iter", "dx", "dy")
    return around.join(F.broadcast(under), ["image_id", "iter"]).groupBy("image_id", "iter", (F.col("src_x") - F.col("dx")).alias("cx"), (F.col("src_y") - F.col("dy")).alias("cy")).agg(F.count("*").alias("used"))


def limit_local_reuse(scored: DataFrame, used: DataFrame, holes: DataFrame, ratio: float, step: int = 10) -> DataFrame:
    """Candidates with at most `ratio` times the target's holes (rounded down) used; where a target has none, its limit is raised by steps until it has."""
    got = scored.join(used, ["image_id", "iter", "cx", "cy"], "left").join(F.broadcast(holes), ["image_id", "iter"]).withColumns({"used": F.coalesce("used", F.lit(0)), "limit": F.floor(F.col("holes") * ratio)})
    raised = got.groupBy("image_id", "iter").agg((F.greatest(F.lit(0), F.ceil((F.min("used") - F.min("limit")) / step)) * step).alias("more"))  # a row for each target
    return got.join(F.broadcast(raised), ["image_id", "iter"]).filter(F.col("used") <= F.col("limit") + F.col("more")).drop("used", "holes", "limit", "more")


def no_reuse(scored: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates that no match before `iter` has taken as its source."""
    taken = matches.groupBy(F.col("sx").alias("cx"), F.col("sy").alias("cy")).agg(F.min("iter").alias("since"))
    return scored.join(taken, ["cx", "cy"], "left").filter(F.coalesce(F.col("since") >= F.col("iter"), F.lit(True))).drop("since")


def nearest(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each target, with rn; ties go to the smaller cy, cx."""
    return search.top(scored, k, ["cy", "cx"], ["image_id", "iter"])
