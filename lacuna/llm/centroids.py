"""Centroid clustering: Lloyd's rounds with exponion search.

A vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to all others. A round first lets the bounds follow the centroids' moves; while the lower one is
above the upper one, nothing is looked at. Else the upper bound is made exact, and then only centroids within a ball around the vector's own centroid are scanned, of radius twice the upper bound
and the distance to the nearest other centroid: they head the list of centroids in order of their distance from it. The radius is inclusive, so ties stay in sight. All vectors are whole numbers and distances exact;
only the bounds are floating point, rounded away from what they bound. Vectors and bounds are a table that each round writes anew; only sums per cluster reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _remove, own_folder

CLUSTERS, DIMS, SCALE, ROUNDS, SEED = 40, 64, 256, 5, 2
#: Components beyond this have squared distances that a long does not hold.
LARGEST = 1 << 27
#: Relative room of the bounds for the rounding of square roots and sums.
ROOM = 1e-9


def whole(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(key, v): floor(scale * x) of vectors of `dims` components. Vectors that are null, of another length, or hold null, non-finite or too large components (above LARGEST) are left out."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    return df.select(F.col(f"`{key}`").alias("key"), x.alias("x")).filter((F.size("x") == dims) & sound).select("key", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[n, k] exact squared distances of whole vectors."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * 4 * x.shape[1] < 1 << 52:  # all sums are whole numbers that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + ROOM)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - ROOM)


class Centres:
    """The centroids of a round, with each one's others in order of distance. k * k numbers, held by each task."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, k = c, len(c)
        d2 = squared(c, c)
        self.order = np.argsort(d2, axis=1, kind="stable")
        # a centroid heads its own list even where another equals it
        self.order = np.stack([np.concatenate([[j], row[row != j]]) for j, row in enumerate(self.order)])
        self.dist = _below(np.take_along_axis(d2, self.order, 1))
        self.next_below = self.dist[:, 1] if k > 1 else np.full(k, np.inf)
        self.next_above = _above(np.take_along_axis(d2, self.order, 1)[:, 1]) if k > 1 else np.zeros(k)
        self.moved = np.zeros(k) if before is None else _above(((c - before) ** 2).sum(1))
        top = np.sort(self.moved)[::-1]
        self.most_of_others = np.where(np.arange(k) == np.argmax(self.moved), top[1] if k > 1 else 0.0, top[0])

    def two_best(self, x: np.ndarray, numbers: np.ndarray):
        """Among centroids of these ascending numbers: the nearest one's number (ties: the smallest), its squared distance and that of the next."""
        d2 = squared(x, self.c[numbers])
        at = d2.argmin(1)
        best = d2[np.arange(len(x)), at]
        d2[np.arange(len(x)), at] = np.iinfo(np.int64).max
        return numbers[at], best, d2.min(1)

    def first(self, x: np.ndarray):
        """(centroid, upper, lower, scanned) without knowledge."""
        a, d, e = self.two_best(x, np.arange(len(self.c)))
        return a, _above(d), _below(e), np.full(len(x), len(self.c))

    def follow(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray):
        a, u, low, scanned = a.copy(), (u + self.moved[a]) * (1 + ROOM), low - self.most_of_others[a], np.zeros(len(x), np.int64)
        low -= np.abs(low) * ROOM
        open_ = np.flatnonzero(np.maximum(low, self.next_below[a] / 2) <= u)
        diff = x[open_] - self.c[a[open_]]
        u[open_] = _above((diff * diff).sum(1))
        scanned[open_] += 1
        open_ = open_[np.maximum(low[open_], self.next_below[a[open_]] / 2) <= u[open_]]
        own = a[open_]
        for j in np.unique(own):
            rows = open_[own == j]
            inside = np.searchsorted(self.dist[j], (2 * u[rows] + self.next_above[j]) * (1 + ROOM), "right")  # on the ball's edge counts as inside
            level = np.ceil(np.log2(np.maximum(inside, 2))).astype(int)  # lists of 2, 4, 8, ... centroids: rows share products
            for f in np.unique(level):
                some = rows[level == f]
                numbers = np.sort(self.order[j][: 1 << f])
                a[some], d, e = self.two_best(x[some], numbers)
                u[some], low[some] = _above(d), _below(e)
                scanned[some] += len(numbers)
        return a, u, low, scanned


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _round(centres: Centres, dims: int):
    def run(batches):
        for b in batches:
            x = _matrix(b, dims)
            if "a" in b.schema.names:
                was = b.column("a").to_numpy()
                a, u, low, n = centres.follow(x, was, b.column("u").to_numpy(), b.column("low").to_numpy())
                n = n + b.column("scanned").to_numpy()
            else:
                was = np.full(len(x), -1)
                a, u, low, n = centres.first(x)
            d = x - centres.c[a]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), *(pa.array(y, t) for y, t in ((a, pa.int32()), (was, pa.int32()), (u, pa.float64()), (low, pa.float64()), (n, pa.int64()), ((d * d).sum(1), pa.int64())))], names=["key", "v", "a", "was", "u", "low", "scanned", "distance"])

    return run


def _shift(k: int, dims: int):
    """Partial sums of what came to and left each cluster: k rows for a task at most."""

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x, a, was = _matrix(b, dims), b.column("a").to_numpy(), b.column("was").to_numpy()
            for j in np.unique(np.concatenate([a, was])):
                if j >= 0:
                    for rows, sign in (((a == j) & (was != j), 1), ((was == j) & (a != j), -1)):
                        n[j] += sign * int(rows.sum())
                        total[j] += sign * x[rows].sum(0)
        at = np.flatnonzero(n.astype(bool) | total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["a", "n", "total"])

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """A row for each row of vectors (key, v: `dims` whole numbers): key, cluster, distance (squared, to the last centroid), cluster_inertia, inertia, centroid_sha256 and scanned (distances worked out
    for it over all rounds).

    Centroids start as the k vectors of smallest sha256 of `<seed>:<key>`, in that order (ties: by the vector; a null key is spelled as nothing); with fewer vectors there are fewer centroids. Each round assigns
    every vector to the nearest centroid, the smaller number among equals, and then puts the floor of its vectors' mean in place of each centroid that has vectors. Vectors are assigned once more at the end.
    Equal rows are separate rows. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    kind = dict(vectors.dtypes)["key"]
    out = f"key {kind}, v array<int>, a int, was int, u double, low double, scanned long, distance long"
    if not first:
        return spark.createDataFrame([], f"key {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long")
    c = np.array([r["v"] for r in first], np.int64)
    k = len(c)
    count, total, before, path, state = [0] * k, [[0] * dims for _ in range(k)], None, None, vectors.select("key", "v")
    for i in range(rounds + 1):
        old, path = path, own_folder(spark, "clusters")
        state.mapInArrow(_round(Centres(c, before), dims), out).write.parquet(path)
        state = spark.read.schema(out).parquet(path)
        if old:
            _remove(old, spark)
        if i == rounds:
            break
        moved = state.filter("a <> was").select("v", "a", "was").mapInArrow(_shift(k, dims), "a int, n long, total array<long>")
        moved = moved.select("a", F.posexplode(F.concat(F.array("n"), "total"))).groupBy("a", "pos").agg(F.sum(F.col("col").cast("decimal(28,0)")).alias("s")).collect()  # k * (dims + 1) rows
        for r in moved:
            if r["pos"]:
                total[r["a"]][r["pos"] - 1] += int(r["s"])
            else:
                count[r["a"]] += int(r["s"])
        before, c = c, np.array([[s // count[j] for s in total[j]] if count[j] else c[j].tolist() for j in range(k)], np.int64)
    sums = {r["a"]: int(r["s"]) for r in state.groupBy("a").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}  # k rows
    named = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in range(k)]
    named = spark.createDataFrame(named, "a int, cluster_inertia long, inertia long, centroid_sha256 string").coalesce(1)
    return state.join(F.broadcast(named), "a").select("key", F.col("a").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Plain Lloyd in SQL, a pair of steps for each round."""
    steps = f"""
q as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::hugeint) as v from embeddings
  where embedding is not null and len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {DIMS}),
p as (select vec_id, i, v[i] as x from q, range(1, {DIMS + 1}) t(i)),
s as (select vec_id, row_number() over (order by sha256('{SEED}:' || vec_id::varchar)) - 1 as c from q qualify c < {k}),
c0 as (select c, i, x from p join s using (vec_id))"""
    near = "select vec_id, c, d from (select vec_id, c, sum((p.x - m.x) * (p.x - m.x)) as d from p join {m} m using (i) group by vec_id, c) qualify row_number() over (partition by vec_id order by d, c) = 1"
    for r in range(rounds):
        steps += f""",
a{r} as materialized ({near.format(m=f"c{r}")}),
c{r + 1} as materialized (select m.c, m.i, coalesce(y.x, m.x) as x from c{r} m left join (select c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x from p join a{r} using (vec_id) group by c, i) y using (c, i))"""
    return f"""
with {steps.strip()},
z as materialized ({near.format(m=f"c{rounds}")}),
names as (select c, sha256(string_agg(x::varchar, ',' order by i)) as h from c{rounds} group by c)
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256 from z join names using (c)"""
