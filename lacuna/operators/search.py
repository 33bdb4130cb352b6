"""Search: argmin, top-k, thresholds and staged searches over scored candidates.

A scored table has the query's columns, if any, and d; `ties` orders equal scores, so that every result is determined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import grid


def best(scored: DataFrame, ties: list[str], by: list[str] | None = None, score: str = "d") -> DataFrame:
    """The row of the least score, for each group of `by` if given."""
    pick = F.min_by(F.struct(*scored.columns), F.struct(score, *ties)).alias("b")
    return (scored.groupBy(*by) if by else scored.groupBy()).agg(pick).filter("b is not null").select("b.*")


def numbered(few: DataFrame, order: list[str]) -> DataFrame:
    """`few`, of a number of rows that the caller bounds, numbered by rn."""
    return few.withColumn("rn", F.row_number().over(Window.partitionBy().orderBy(*order)))


def ranked(scored: DataFrame, ties: list[str], by: list[str] | None = None, score: str = "d") -> DataFrame:
    """scored with rn, each row's rank: within its group of `by`, or in the whole table. There rows are dealt out by ranges of score and ties together, so that neither the table nor its rows of one score are one task's, and
    written with their range; a rank is the rank within a range and the number of rows in the ranges before. Nulls come first, NaN last."""
    if by:
        return scored.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(score, *ties)))
    scored = grid.through(scored.repartitionByRange(score, *ties).withColumn("_b", F.spark_partition_id()), "ranked")
    sizes = scored.groupBy("_b").agg(F.count("*").alias("_k"))  # a row for each partition
    below = sizes.select("_b", (F.sum("_k").over(Window.partitionBy().orderBy("_b")) - F.col("_k")).alias("_below"))
    return scored.join(F.broadcast(below), "_b").withColumn("rn", F.row_number().over(Window.partitionBy("_b").orderBy(score, *ties)) + F.col("_below")).drop("_b", "_below")


def top(scored: DataFrame, k: int, ties: list[str], by: list[str] | None = None, radius: float | None = None, score: str = "d") -> DataFrame:
    """The k best with d below `radius`, numbered by rn: each partition keeps k rows before any is moved."""
    got = scored if radius is None else scored.filter(F.col(score) < radius)
    if by:
        return ranked(got, ties, by, score).filter(F.col("rn") <= k)
    return numbered(got.orderBy(score, *ties).limit(k), [score, *ties])


def top_or_fail(scored: DataFrame, k: int, ties: list[str], score: str = "d") -> DataFrame:
    """The k best; an error if there are fewer."""
    got = top(scored, k, ties, None, None, score)
    count = F.count("*").over(Window.partitionBy())  # of k rows at most
    return got.withColumn("_n", count).filter(F.coalesce(F.assert_true(F.col("_n") >= k, F.lit("fewer candidates than k")).isNull(), F.lit(True))).drop("_n")


def strided(scored: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Every n-th candidate in order, the n-th being the first taken."""
    return ranked(scored, order[1:], None, order[0]).filter(F.col("rn") % n == 0).drop("rn")


def below_or_all(scored: DataFrame, threshold: float, score: str = "d") -> DataFrame:
    """All below the threshold; if there are none, all."""
    some = scored.agg(F.coalesce(F.max(F.col(score) < threshold), F.lit(False))).scalar()
    return scored.filter((F.col(score) < threshold) | ~some)


def limit_reuse(scored: DataFrame, copied: DataFrame, limit: float, on: list[str]) -> DataFrame:
    """Candidates with fewer than `limit` copied pixels (copied: candidate, used)."""
    return scored.join(copied, on).filter(F.col("used") < limit).drop("used")


def limit_local_reuse(scored: DataFrame, used: DataFrame, limit: float, on: list[str], step: int = 10) -> DataFrame:
    """Candidates with at most `limit` used pixels, the limit raised by steps until there is one: the steps follow from the least use."""
    both = scored.join(used, on)
    raise_ = F.greatest(F.lit(0.0), F.ceil((both.agg(F.min("used")).scalar() - limit) / step)) * step
    return both.filter(F.col("used") <= F.lit(limit) + raise_).drop("used")


def without(scored: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return scored.join(used, on, "left_anti")


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def staged(scored: DataFrame, k: int, second: str, ties: list[str], first: str = "d") -> DataFrame:
    """The best by `second` among the k best by `first`; equal second scores go by the first stage's order."""
    return best(top(scored, k, ties, None, None, first), ["rn"], None, second)


def resorted(scored: DataFrame, k: int, second: str, ties: list[str], first: str = "d") -> DataFrame:
    got = top(scored, k, ties, None, None, first).withColumnRenamed("rn", "rn1")
    return numbered(got, [second, "rn1"])


def near(px: DataFrame, cx: int, cy: int, radius: int) -> Column:
    return (F.abs(F.col("cx") - cx) <= radius) & (F.abs(F.col("cy") - cy) <= radius)


def band_join(points: DataFrame, queries: DataFrame, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (x, y) and queries (qx, qy) within a square of `radius`, and of equal columns `by`: an equi-join on tiles of that size, each query standing in the nine about it."""
    tile = lambda c: F.floor(F.col(c) / radius)
    off = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    p = points.withColumns({"_tx": tile("x"), "_ty": tile("y")})
    q = queries.withColumn("_i", off).withColumn("_j", off).withColumns({"_tx": tile("qx") + F.col("_i"), "_ty": tile("qy") + F.col("_j")}).drop("_i", "_j")
    got = p.join(q, [*by, "_tx", "_ty"]).filter((F.abs(F.col("x") - F.col("qx")) <= radius) & (F.abs(F.col("y") - F.col("qy")) <= radius))
    return got.drop("_tx", "_ty")
