"""Histograms of patches and what is ranked by them.

A feature table is long: (part, ch, f), where part is the target or a candidate, ch a channel (or a channel and a quadrant). Comparisons sum +n and -n by bin, so
no outer join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(f: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin, of equal widths; the top edge is in the last, what is outside in the first or last."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((f - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)))
    return F.coalesce(b, F.lit(0)).cast("int")


def ranges(target: DataFrame) -> DataFrame:
    return target.groupBy("ch").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))


def counts(feats: DataFrame, limits: DataFrame, bins: int, outside: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ch, bin, n). outside: values beyond the limits count in the end bins; else they do not count."""
    got = feats.join(F.broadcast(limits), "ch")
    got = got if outside else got.filter(F.col("f").between(F.col("lo"), F.col("hi")))
    return got.groupBy(*keys, "ch", bin_of(F.col("f"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").cast("double").alias("n"))


def normalised(hist: DataFrame, keys: tuple[str, ...] = (), by_channel: bool = False) -> DataFrame:
    """n as a share of its histogram's sum: all channels appended, or each channel's own."""
    on = [*keys, *(["ch"] if by_channel else [])]
    if not on:
        return hist.join(F.broadcast(hist.agg(F.sum("n").alias("_t")))).withColumn("n", F.col("n") / F.col("_t")).drop("_t")
    return hist.join(hist.groupBy(*on).agg(F.sum("n").alias("_t")), on).withColumn("n", F.col("n") / F.col("_t")).drop("_t")


def difference(target: DataFrame, cands: DataFrame, ids: DataFrame, out: str = "d") -> DataFrame:
    """(cx, cy, d): sum over bins of |target - candidate|. ids (cx, cy): the candidates, which are few."""
    t = ids.select("cx", "cy").join(F.broadcast(target)).select("cx", "cy", "ch", "bin", "n")
    both = t.unionByName(cands.select("cx", "cy", "ch", "bin", (-F.col("n")).alias("n")))
    return both.groupBy("cx", "cy", "ch", "bin").agg(F.abs(F.sum("n")).alias("n")).groupBy("cx", "cy").agg(F.sum("n").alias(out))


def correlation(target: DataFrame, cands: DataFrame, ids: DataFrame, bins: int, channels: int) -> DataFrame:
    """(cx, cy, d): Pearson's correlation of the histograms over all bins, empty ones included."""
    every = ids.select("cx", "cy", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch")).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    got = every.join(F.broadcast(target.withColumnRenamed("n", "t")), ["ch", "bin"], "left").join(cands.withColumnRenamed("n", "s"), ["cx", "cy", "ch", "bin"], "left").na.fill(0.0, ["t", "s"])
    return got.groupBy("cx", "cy").agg(F.corr("t", "s").alias("d"))


def new_bins(target: DataFrame, cands: DataFrame, ids: DataFrame) -> DataFrame:
    """(cx, cy, d): number of joint bins that a candidate has and the target has not; target (bin), cands (cx, cy, bin)."""
    fresh = cands.distinct().join(target.select("bin").distinct(), "bin", "left_anti").groupBy("cx", "cy").agg(F.count("*").cast("double").alias("d"))
    return ids.select("cx", "cy").join(fresh, ["cx", "cy"], "left").na.fill(0.0, ["d"])


def greatest_between(part: DataFrame, limits: tuple[float, float], bins: int) -> DataFrame:
    """(most): of a patch's part (dx, dy, ch, f), the greatest difference between the histograms, as shares, of two of its quadrants that have pixels; 0 with fewer than two of them."""
    q = F.when(F.col("dx") >= 0, 2).otherwise(0) + F.when(F.col("dy") >= 0, 1).otherwise(0)
    n = part.groupBy(q.alias("q"), "ch", bin_of(F.col("f"), F.lit(limits[0]), F.lit(limits[1]), bins).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    n = normalised(n, ("q",))
    some = n.select("q").distinct()
    pairs = some.select(F.col("q").alias("a")).join(some.select(F.col("q").alias("b")), F.col("a") < F.col("b"))  # six at most
    d = pairs.join(n, (F.col("q") == F.col("a")) | (F.col("q") == F.col("b"))).groupBy("a", "b", "ch", "bin").agg(F.abs(F.sum(F.when(F.col("q") == F.col("a"), F.col("n")).otherwise(-F.col("n")))).alias("d"))
    return d.groupBy("a", "b").agg(F.sum("d").alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("most"))
