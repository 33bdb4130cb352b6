"""An exact metric index: vectors in the cells of vantage points, each with its distance to the cell's point.

By the triangle inequality a vector v of vantage point p cannot be nearer to q than |d(q, p) - d(v, p)|, nor farther than d(q, p) + d(v, p). So a search reads
the distances first, which are single numbers, and vectors only where the bounds leave a choice. The index is a plain table: written with partitionBy("cell"), whole
cells are skipped. Inserting is a union, erasing an anti-join. Distances are sums of absolute differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as fn
from ..sources import grid
from . import search

#: Vantage points at most, and vectors among which they are chosen; both are held by the driver.
POINTS, SAMPLE = 32, 512
#: Relative slack of the bounds, for sums in another order.
SLACK = 1e-9


def vantage_points(vectors: DataFrame, key: str = "id", vector: str = "a", points: int = POINTS, sample: int = SAMPLE) -> list[list[float]]:
    """Vectors far from each other, among `sample` of them by a hash of their keys: each next one is the farthest from those before. Only speed depends on them."""
    some = vectors.filter(F.col(vector).isNotNull()).select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).collect()
    a = np.array([r[vector] for r in some], float)
    if not len(a):
        return []
    chosen, apart = [0], np.abs(a - a[0]).sum(1)
    while len(chosen) < min(points, len(a)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, np.abs(a - a[chosen[-1]]).sum(1))
    return a[chosen].tolist()


def _literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def index(vectors: DataFrame, points: list[list[float]], vector: str = "a") -> DataFrame:
    """vectors with cell, the number of the nearest point, and dp, the distance to it. A null vector is in no cell and is left out; without points nothing is in the index."""
    all_ = F.array(*[F.struct(_literal(p).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(points)]) if points else F.expr("cast(array() as array<struct<p: array<double>, i: int>>)")
    near = F.array_min(F.transform(all_, lambda e: F.struct(fn.absolute(F.col(vector), e["p"]).alias("d"), e["i"].alias("i"))))
    return vectors.filter(F.col(vector).isNotNull()).withColumn("_n", near).withColumns({"cell": F.col("_n.i"), "dp": F.col("_n.d")}).drop("_n").filter("cell is not null")


def insert(indexed: DataFrame, new: DataFrame, points: list[list[float]], vector: str = "a") -> DataFrame:
    return indexed.unionByName(index(new, points, vector))


def erase(indexed: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return indexed.join(keys, key, "left_anti")


def _to_points(points: list[list[float]], q: list[float]) -> Column:
    """The query's distance to the row's vantage point."""
    return F.get(_literal([sum(abs(a - b) for a, b in zip(p, q, strict=True)) for p in points]), F.col("cell"))


def within(indexed: DataFrame, points: list[list[float]], q: list[float], radius: float, vector: str = "a") -> DataFrame:
    """The rows at a distance of `radius` or less, with d."""
    if not points:
        return indexed.withColumn("d", F.lit(0.0)).filter(F.lit(False))
    slack = SLACK * (1 + radius)
    at = _to_points(points, q)
    left = indexed.filter(F.abs(at - F.col("dp")) <= radius + slack * (1 + at))
    return left.withColumn("d", fn.absolute(F.col(vector), _literal(q))).filter(F.col("d") <= radius)


def nearest(indexed: DataFrame, points: list[list[float]], q: list[float], k: int, key: str = "id", vector: str = "a", by: str | None = None) -> DataFrame:
    """The k nearest rows, or those of each group of `by` (one tree a graph), with d and rn; ties go to the smaller key. The k rows of least upper bound give the radius, which is
    k-th distance or more: then what lies within it is searched exactly. With `by`, each group has its own radius."""
    if not points:
        return indexed.withColumn("d", F.lit(0.0)).withColumn("rn", F.lit(0)).filter(F.lit(False))
    at, groups = _to_points(points, q), [by] if by else None
    exact = fn.absolute(F.col(vector), _literal(q))
    bounded = indexed.withColumn("_u", at + F.col("dp"))
    if not by:
        first = bounded.orderBy("_u", key).limit(k).agg(F.count("*").alias("n"), F.max(exact).alias("d")).first()
        radius = first["d"] if first["n"] == k else float("inf")
        left = indexed if radius == float("inf") else indexed.filter(F.abs(at - F.col("dp")) <= radius + SLACK * (1 + radius) * (1 + at))
    else:
        first = search.top(bounded, k, [key], groups, None, "_u").groupBy(by).agg(F.when(F.count("*") == k, F.max(exact)).alias("_r"))
        left = indexed.join(first, by).filter(F.col("_r").isNull() | (F.abs(at - F.col("dp")) <= F.col("_r") + SLACK * (1 + F.col("_r")) * (1 + at))).drop("_r")
    return search.top(left.withColumn("d", exact), k, [key], groups)


#: Vectors of the two sides in a task's group.
SIDE = 512


def best_point(vectors: DataFrame, order: Column, share: float = 0.1, key: str = "id", vector: str = "a") -> DataFrame:
    """(pivot, spread): of a share of the vectors (and one more), the first by `order` (ties: by key), the one whose distances to all other vectors spread most, as population standard deviation; ties go to the smaller key. The tried
    and all vectors meet in blocks of SIDE by SIDE, in tasks that send on a row of sums for each vector tried. Null vectors take no part; without vectors there is no row."""
    v = grid.through(vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("a"), order.alias("o")), "points")
    n = v.count()
    tried = search.ranked(v, ["key"], None, "o") if n > SIDE else search.numbered(v, ["o", "key"])
    tried = tried.filter(F.col("rn") <= int(n * share) + 1).select("key", "a")
    rows, columns = max(1, -(-int(n * share + 1) // SIDE)), max(1, -(-n // SIDE))
    part = lambda k: F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"pivot": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "mean": np.zeros(0), "m2": np.zeros(0)})
        b, out = np.stack(right["a"].to_numpy()), []
        for k, x in zip(left["key"], left["a"], strict=True):
            d = np.abs(b - x).sum(1)[right["key"].to_numpy() != k]
            if len(d):
                out.append((k, len(d), d.mean(), ((d - d.mean()) ** 2).sum()))
        return pd.DataFrame(out, columns=["pivot", "n", "mean", "m2"])

    a = tried.select("key", "a", part(rows).alias("i"), every(columns).alias("j"))
    b = v.select("key", "a", every(rows).alias("i"), part(columns).alias("j"))
    got = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(sums, "pivot long, n long, mean double, m2 double")
    # variances within the blocks, and of their means about the mean of all
    got = got.groupBy("pivot").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    got = got.select("pivot", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))).alias("spread"))
    return got.groupBy().agg(F.max_by(F.struct("pivot", "spread"), F.struct("spread", -F.col("pivot"))).alias("b")).filter("b is not null").select("b.*")


# ---- many queries at once ------------------------------------------------------------------------------------------

#: Vectors in a block, unless there would be more blocks than BLOCKS (and RINGS for each point); queries in a task's group, and numbers that a task compares at once.
BLOCK, BLOCKS, RINGS, QUERIES, AT_ONCE = 1024, 4096, 64, 512, 1 << 22
#: Bounds of queries and blocks that a task holds at once, and queries with their vectors that it sends on together.
BOUNDS, SENT = 1 << 19, 1 << 14
#: Queries and vectors that meet in a task after the first block: at least, at most, and the tiles that either side has unless they would be smaller or greater.
LEAST, TILE, TILES = 1024, 32768, 6
#: The greatest sum of differences in levels, and a mark above all; numbers of levels that a step holds; levels from which they tell vectors apart.
TOP, MARK, HELD, FINE = 32000, 32767, 1 << 16, 15


def sound(vectors: DataFrame, vector: str = "a") -> DataFrame:
    """The vectors that are not null, hold no null or NaN and are as long as most are (the longer, if there are as many of two lengths)."""
    some = vectors.filter(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    most = some.groupBy(F.size(vector).alias("n")).count().agg(F.max(F.struct("count", "n"))["n"].alias("n")).first()["n"]
    return some.filter(F.size(vector) == (most or 0))


def _placed(df: DataFrame, points: list[list[float]], key: str, vector: str) -> DataFrame:
    """(key, a, far): the distances to all points."""
    p = np.array(points, float)

    def far(batches):
        for pdf in batches:
            a = np.stack(pdf["a"].to_numpy()) if len(pdf) else np.zeros((0, p.shape[1]))
            yield pd.DataFrame({"key": pdf["key"].to_numpy(), "a": list(a), "far": list(np.stack([np.abs(a - x).sum(1) for x in p], 1))})

    whole = F.col(vector).isNotNull() & (F.size(vector) == p.shape[1]) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    got = df.filter(whole).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("a"))
    return got.mapInPandas(far, "key long, a array<double>, far array<double>")


def blocks(vectors: DataFrame, points: list[list[float]], key: str = "id", vector: str = "a", size: int = BLOCK) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(table, counts, least, most): the vectors (key, a, far, block), written once, in blocks of about `size`, or more where there would be too many; and each block's number of vectors and least and greatest distances to
    every point. A point's cell is cut into rings about it, by approximate quantiles; a ring of many equal distances is dealt by a hash of the keys. Vectors of another length than the points', or with a null or NaN, are left out."""
    v = grid.through(_placed(vectors, points, key, vector).withColumn("_n", F.array_min(F.transform("far", lambda d, i: F.struct(d.alias("d"), i.alias("i"))))).select("key", "a", "far", F.col("_n.i").alias("cell"), F.col("_n.d").alias("dp")), "knn-vectors")
    cells = v.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dp", [i / RINGS for i in range(1, RINGS)], 1000).alias("q")).collect()  # a row for each point at most
    size = max(size, sum(r["n"] for r in cells) // BLOCKS)
    cuts = [[]] * len(points)
    for r in cells:
        rings = min(RINGS, -(-r["n"] // size))
        cuts[r["cell"]] = sorted({r["q"][i * RINGS // rings - 1] for i in range(1, rings)})
    ring = F.size(F.filter(F.get(F.array(*[_literal(c) if c else F.expr("cast(array() as array<double>)") for c in cuts]), F.col("cell")), lambda c: c < F.col("dp")))
    v = v.withColumn("ring", ring)
    parts = v.groupBy("cell", "ring").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))  # RINGS for each point at most
    v = v.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    ends = [f(F.col("far")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(len(points))]
    found = sorted(v.groupBy("cell", "ring", "part").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: tuple(r[:3]))  # a row for each block
    number = v.sparkSession.createDataFrame([(r["cell"], r["ring"], r["part"], i) for i, r in enumerate(found)], "cell int, ring int, part long, block int").coalesce(1)
    table = v.join(F.broadcast(number), ["cell", "ring", "part"]).select("key", "a", "far", "block")
    m = np.array([r[3:] for r in found], float).reshape(len(found), 1 + 2 * len(points))
    return table, m[:, 0].astype(int), m[:, 1 : 1 + len(points)], m[:, 1 + len(points) :]


def _gaps(far: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """[queries, blocks] lower bounds of a query's distance to any vector of a block, by the triangle inequality over all points."""
    out = np.zeros((len(far), len(least)))
    for i in range(far.shape[1]):
        d = far[:, i][:, None]
        np.maximum(out, np.maximum(d - most[:, i], least[:, i] - d), out=out)
    return out


def _homes(far: np.ndarray, least: np.ndarray, most: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """For each query, the block that its bounds show to be nearest, of those with enough vectors, if there are any; some queries at a time."""
    out, step = np.zeros(len(far), np.int32), max(1, BOUNDS // len(least))
    for lo in range(0, len(far), step):
        gap = _gaps(far[lo : lo + step], least, most)
        out[lo : lo + step] = (np.where(enough, gap, np.inf) if enough.any() else gap).argmin(1)
    return out


def _within(far: np.ndarray, radius: np.ndarray, home: np.ndarray, least: np.ndarray, most: np.ndarray):
    """(queries, blocks) of the blocks but a query's own that its radius reaches, SENT of them at most at a time."""
    step = max(1, BOUNDS // len(least))
    for lo in range(0, len(far), step):
        part = slice(lo, lo + step)
        near = _gaps(far[part], least, most) <= (radius[part] + SLACK * (1 + radius[part]))[:, None]
        near[np.arange(len(near)), home[part]] = False
        i, j = np.nonzero(near)
        for at in range(0, len(i), SENT):
            yield i[at : at + SENT] + lo, j[at : at + SENT]


def _levels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Both sides' numbers in whole levels that all are equally wide, and that width; sums of differences fit 16 bits and are off by less than a level for each number, and one more. None where numbers are not finite, all equal or too many for that."""
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    count = TOP // a.shape[1]
    width = (high - low) / count if count >= FINE else 0.0
    if not (np.isfinite(width) and width > 1e-300 and max(abs(low), abs(high)) < 1e9 * (high - low)):  # wide enough for rounding not to count
        return None
    return np.rint((a - low) / width).astype(np.int16), np.rint((b - low) / width).astype(np.int16), float(width)


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a to rows j of b, some at a time."""
    out, step = np.zeros(len(i)), max(1, AT_ONCE // 16 // a.shape[1])
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.abs(a[i[lo : lo + step]] - b[j[lo : lo + step]]).sum(1)
    return out


def _cut(i: np.ndarray, keys: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of least d (ties: of least key) for each i, in order."""
    order = np.lexsort((keys, d, i))
    i, keys, d = i[order], keys[order], d[order]
    use = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[use], keys[use], d[use]


def _nearest(a: np.ndarray, queries: np.ndarray, b: np.ndarray, keys: np.ndarray, k: int, apart: bool, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, keys, d): the k nearest of b, whose keys ascend, for each row of a, but none beyond its limit. Sums of differences in levels rule most pairs out; the rest are compared exactly."""
    both, (n, m), out = _levels(a, b) if a.size and b.size else None, (len(a), len(b)), []
    dims = a.shape[1]
    lo, hi = (np.searchsorted(keys, queries, side) for side in ("left", "right")) if apart else (np.zeros(n, int), np.zeros(n, int))
    step = max(1, (HELD if both else AT_ONCE // max(1, dims)) // max(1, m))
    if both:
        la, lb, width = both[0], np.ascontiguousarray(both[1].T), both[2]
        held = np.empty((2, min(step, n), m), np.int16)
    for at in range(0, n, step):
        to = min(n, at + step)
        own = np.flatnonzero(hi[at:to] > lo[at:to])
        if both:
            s, t = held[0, : to - at], held[1, : to - at]
            s[:] = 0
            for x in range(dims):
                np.subtract(lb[x], la[at:to, x, None], out=t)
                np.abs(t, out=t)
                np.add(s, t, out=s)
            for r in own:
                s[r, lo[at + r] : hi[at + r]] = MARK
            bound = np.full(to - at, MARK - 1, np.int64)
            if m > k:  # both sums may be off
                bound = np.minimum(bound, np.partition(s, k - 1, axis=1)[:, k - 1].astype(np.int64) + 2 * (dims + 1))
            if limit is not None:
                bound = np.minimum(bound, np.minimum(limit[at:to] * (1 + SLACK) / width + dims + 1, MARK - 1).astype(np.int64))
            use = np.flatnonzero(s <= bound.astype(np.int16)[:, None])
            i, j = use // m + at, use % m
            d = _exact(a, b, i, j)
        else:
            s = np.abs(a[at:to, None, :] - b[None]).sum(2)
            for r in own:
                s[r, lo[at + r] : hi[at + r]] = np.inf
            j = np.argsort(s, axis=1, kind="stable")[:, :k]
            i, d, j = np.repeat(np.arange(at, to), j.shape[1]), np.take_along_axis(s, j, 1).ravel(), j.ravel()
        fit = np.isfinite(d) if limit is None else np.isfinite(d) & (d <= limit[i] * (1 + SLACK))
        out.append(_cut(i[fit], keys[j[fit]], d[fit], k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ranked(q: pd.DataFrame, v: pd.DataFrame, k: int, apart: bool) -> pd.DataFrame:
    """(query, id, d): the k nearest of the vectors for each query; ties go to the smaller key."""
    if not len(q) or not len(v):
        return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "d": np.zeros(0)})
    v = v.sort_values("key", ignore_index=True)
    queries = q["key"].to_numpy()
    i, keys, d = _nearest(np.stack(q["a"].to_numpy()), queries, np.stack(v["a"].to_numpy()), v["key"].to_numpy(), k, apart)
    return pd.DataFrame({"query": queries[i], "id": keys, "d": d})


def _in_tile(q: pd.DataFrame, v: pd.DataFrame, k: int, apart: bool, points: np.ndarray, least: np.ndarray, most: np.ndarray) -> pd.DataFrame:
    """(query, id, d, met): the k nearest for each query (key, a, block, radius) among the vectors (key, a, block) of the blocks that its radius reaches, but for its own block, and no farther than the radius, which shrinks from block
    to block. met: in a row without id, the vectors that were compared with the query."""
    if not len(q) or not len(v):
        return pd.DataFrame({"query": np.zeros(0, np.int64), "id": pd.array([], "Int64"), "d": np.zeros(0), "met": np.zeros(0, np.int64)})
    v = v.sort_values(["block", "key"], ignore_index=True)
    a, b, queries, keys, blocks_, home = np.stack(q["a"].to_numpy()), np.stack(v["a"].to_numpy()), q["key"].to_numpy(), v["key"].to_numpy(), v["block"].to_numpy(), q["block"].to_numpy()
    far = np.stack([np.abs(a - x).sum(1) for x in points], 1)
    radius, met = q["radius"].fillna(np.inf).to_numpy().copy(), np.zeros(len(a), np.int64)
    best, ids = np.full((len(a), k), np.inf), np.zeros((len(a), k), np.int64)
    here, first = np.unique(blocks_, return_index=True)
    gaps = _gaps(far, least[here], most[here])
    for x in np.argsort(gaps.mean(0), kind="stable"):  # the nearer blocks first
        rows = np.flatnonzero((gaps[:, x] <= radius + SLACK * (1 + radius)) & (home != here[x]))
        lo, hi = first[x], first[x + 1] if x + 1 < len(first) else len(b)
        if not len(rows):
            continue
        met[rows] += hi - lo
        i, new, d = _nearest(a[rows], queries[rows], b[lo:hi], keys[lo:hi], k, apart, radius[rows])
        if len(i):
            some = np.unique(i)
            at = rows[some]
            old = np.isfinite(best[at])
            i, new, d = _cut(np.concatenate([np.searchsorted(some, i), np.nonzero(old)[0]]), np.concatenate([new, ids[at][old]]), np.concatenate([d, best[at][old]]), k)
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best[at[i], place], ids[at[i], place] = d, new
            radius[at] = np.minimum(radius[at], best[at, k - 1])
    i, j = np.nonzero(np.isfinite(best))
    rows = pd.DataFrame({"query": queries[i], "id": pd.array(ids[i, j], "Int64"), "d": best[i, j], "met": 0})
    return pd.concat([rows, pd.DataFrame({"query": queries, "id": pd.array([None] * len(a), "Int64"), "d": np.nan, "met": met})])


def _met(q: DataFrame, v: DataFrame, k: int, apart: bool) -> DataFrame:
    """(query, id, d) of queries (key, a, block) and vectors within each block. A block of many queries is met in chunks of them, its vectors repeated for each."""
    many = grid.through(q.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks")), "knn-chunks")  # a row for each block
    q = q.join(F.broadcast(many), "block").select("key", "a", "block", F.pmod(F.xxhash64("key"), "chunks").cast("int").alias("chunk"))
    v = v.select(*[F.col(c).alias(c) for c in ("key", "a", "block")])  # may be the queries themselves
    v = v.join(F.broadcast(many), "block").select("key", "a", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return q.groupBy("block", "chunk").cogroup(v.groupBy("block", "chunk")).applyInPandas(lambda a, b: _ranked(a, b, k, apart), "query long, id long, d double")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vector: str = "a", apart: bool = True, size: int = BLOCK) -> DataFrame:
    """(query, id, d, rn, compared): the k nearest vectors of every query, exactly; ties go to the smaller key. compared: the vectors whose distances were worked out for the query.

    Every query first meets the block of vectors that its bounds show to be nearest; the k-th distance there is a radius, and only blocks that no vantage point's distances put beyond it are met after, where tiles of queries meet tiles of
    vectors: what is sent grows with the square of the table over TILE, and of a tile only a query's k nearest leave. apart: a vector of the
    query's own key does not count. Queries without k vectors have fewer rows. Queries and vectors that are null, of another length than the rest, or with a null or NaN take no part; an empty side gives no rows. Keys are
    whole numbers; those of queries are unique."""
    spark = vectors.sparkSession
    vectors = sound(vectors, vector)
    points = vantage_points(vectors, key, vector)
    if not points:
        return spark.createDataFrame([], "query long, id long, d double, rn int, compared long")
    v, counts, least, most = blocks(vectors, points, key, vector, size)
    v = grid.through(v, "knn-blocks")
    enough = counts > k

    def home(batches):
        for pdf in batches:
            yield pdf.assign(block=_homes(np.stack(pdf["far"].to_numpy()), least, most, enough) if len(pdf) else np.zeros(0, np.int32))

    q = grid.through(_placed(queries, points, key, vector).mapInPandas(home, "key long, a array<double>, far array<double>, block int"), "knn-queries")
    first = grid.through(_met(q, v, k, apart), "knn-first")
    radius = first.groupBy("query").agg(F.when(F.count("*") == k, F.max("d")).alias("radius")).withColumnRenamed("query", "key")
    # tiles of vectors are blocks that follow each other, those of queries the ones whose first blocks do; they meet where a query of the one reaches a block of the other
    deal = lambda n: ((np.cumsum(n) - n) // min(TILE, max(LEAST, -(-int(n.sum()) // TILES)))).astype(np.int32)
    homes = np.zeros(len(counts), int)
    for r in q.groupBy("block").count().collect():  # a row for each block at most
        homes[r["block"]] = r["count"]
    tile, of = deal(counts), deal(homes)
    chunks = np.maximum(1, -(-homes // TILE))
    table = F.broadcast(spark.createDataFrame([(i, int(n), int(t), int(o), int(c)) for i, (n, t, o, c) in enumerate(zip(counts, tile, of, chunks, strict=True))], "block int, n long, tile int, of int, chunks int").coalesce(1))

    def others(batches):
        for pdf in batches:
            last, most_of = -1, int(tile[-1]) + 1
            if len(pdf):
                far, reach = np.stack(pdf["far"].to_numpy()), pdf["radius"].fillna(np.inf).to_numpy()
                for i, j in _within(far, reach, pdf["block"].to_numpy(), least, most):
                    code = np.unique(i.astype(np.int64) * most_of + tile[j])
                    code = code[code > last]  # a query's blocks may come in two parts
                    if len(code):
                        last = code[-1]
                        yield pdf.iloc[code // most_of][["key", "a", "block", "radius", "of", "chunk"]].assign(tile=(code % most_of).astype(np.int32))

    q = q.join(table.select("block", "of", "chunks"), "block").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    more = q.join(radius, "key", "left").select("key", "a", "far", "block", "radius", "of", "chunk")
    more = grid.through(more.mapInPandas(others, "key long, a array<double>, block int, radius double, of int, chunk int, tile int"), "knn-more")
    units = grid.through(more.select("of", "chunk", "tile").distinct(), "knn-units")
    sent = v.join(table.select("block", "tile"), "block").join(F.broadcast(units), "tile").select("key", "a", "block", "of", "chunk", "tile")
    p, unit = np.array(points, float), ["of", "chunk", "tile"]
    met = more.groupBy(*unit).cogroup(sent.groupBy(*unit)).applyInPandas(lambda a, b: _in_tile(a, b, k, apart, p, least, most), "query long, id long, d double, met long")
    met = grid.through(met, "knn-met")
    seen = q.join(table.select("block", "n"), "block").select(F.col("key").alias("query"), F.col("n").alias("met")).unionByName(met.filter("met > 0").select("query", "met")).groupBy("query").agg(F.sum("met").alias("compared"))
    return search.top(first.unionByName(met.filter("id is not null").select("query", "id", "d")), k, ["id"], ["query"]).join(seen, "query")
