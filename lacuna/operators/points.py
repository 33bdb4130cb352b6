"""Points in space: neighbours within a radius, normals, and point-feature histograms (33 bins).

Neighbours meet in an equi-join on cells as wide as the radius, each point standing in the 27 about its own, and normals are sums over these pairs. Features are sums over the neighbours three times over (covariances, simple histograms, weighted
histograms), and pairs grow with the square of the density: there the points meet in blocks of cells with a halo, a task sums over its pairs, and no pair leaves it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import grid

AXES = ("px", "py", "pz")
#: Bins of each of the three angles.
BINS = 11
#: Cells along a block's side; points of a block, and of it and its halo, that meet at once; rows in a task's group, and candidate pairs looked at together.
CELLS, OWN, NEAR, PACK, AT_ONCE = 4, 32768, 32768, 20_000, 1 << 18
#: Candidate pairs from which a cell is looked at by itself.
DENSE = 1 << 14
#: Cosines that differ by no more are equal: only the order of their sums tells them apart. Squared sines under THIN are not taken from cosines.
TIE, THIN = 1e-9, 1e-3


def sound(points: DataFrame) -> DataFrame:
    """Points (id, px, py, pz) that have all coordinates."""
    for a in AXES:
        points = points.filter(F.col(a).isNotNull() & (F.abs(a) < float("inf")) & ~F.isnan(a))
    return points


def neighbours(points: DataFrame, radius: float) -> DataFrame:
    """(id, other, d2, ex, ey, ez): the ordered pairs of different points no farther apart than the radius, and the difference other - point. A cell's points meet those of 27 cells, so pairs grow with the points in a ball, not with
    the square of all; points that lie in one place meet, too, at a distance of 0."""
    p = grid.through(sound(points).select("id", *AXES, *[F.floor(F.col(a) / radius).alias(f"_{a}") for a in AXES]), "points")
    off = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    q = p.select(F.col("id").alias("other"), *[F.col(a).alias(f"q{a[1]}") for a in AXES], *[F.col(f"_{a}").alias(f"_c{a}") for a in AXES])
    for a in AXES:
        q = q.withColumn("_o", off).withColumn(f"_{a}", F.col(f"_c{a}") + F.col("_o")).drop("_o", f"_c{a}")
    e = {f"e{a[1]}": F.col(f"q{a[1]}") - F.col(a) for a in AXES}
    met = p.join(q, [f"_{a}" for a in AXES]).filter("id <> other").select("id", "other", *[c.alias(n) for n, c in e.items()])
    return met.withColumn("d2", F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")).filter(F.col("d2") <= radius * radius)


def _cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def least_eigenvector(df: DataFrame, out: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """df with the unit eigenvector of the least eigenvalue of the symmetric matrix (xx, xy, xz, yy, yz, zz); null where it is not one line (two least eigenvalues that are equal, to 12 digits of the trace)."""
    m = F.col("_q")
    df = df.withColumn("_q", (F.col("xx") + F.col("yy") + F.col("zz")) / 3)
    b = [[(F.col("".join(sorted((i, j)))) - (m if i == j else 0.0)) for j in "xyz"] for i in "xyz"]
    p2 = sum((b[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) / 6
    df = df.withColumn("_p", F.sqrt(p2))
    det = _dot([b[0][j] for j in range(3)], _cross(tuple(b[1]), tuple(b[2])))
    half = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / (2 * F.nullif(F.col("_p") * F.col("_p") * F.col("_p"), F.lit(0.0)))))
    df = df.withColumn("_a", F.acos(half) / 3)
    df = df.withColumn("_l", m + 2 * F.col("_p") * F.cos(F.col("_a") + 2 * math.pi / 3))  # the least of the three
    rows = [[F.col("".join(sorted((i, j)))) - (F.col("_l") if i == j else 0.0) for j in "xyz"] for i in "xyz"]
    made = []
    for i, j in ((0, 1), (0, 2), (1, 2)):  # rows of the matrix less its eigenvalue: the longest of their products is the surest
        c = _cross(tuple(rows[i]), tuple(rows[j]))
        made.append(F.struct(_dot(c, c).alias("s"), *[x.alias(n) for x, n in zip(c, "xyz", strict=True)]))
    df = df.withColumn("_v", F.greatest(*made))
    length = F.sqrt(F.col("_v.s"))
    flat = length > 1e-12 * m * m
    return df.withColumns({n: F.when(flat, F.col(f"_v.{a}") / length) for n, a in zip(out, "xyz", strict=True)}).drop("_q", "_p", "_a", "_l", "_v")


def normals(points: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """(id, px, py, pz, k, nx, ny, nz): the number of neighbours, and the direction in which a point and its neighbours spread least, turned towards the origin. Null with fewer than `least` points, the point itself included, or where they
    lie on a line."""
    e = {"x": F.col("ex"), "y": F.col("ey"), "z": F.col("ez")}
    sums = {a: F.sum(c) for a, c in e.items()} | {a + b: F.sum(e[a] * e[b]) for i, a in enumerate("xyz") for b in "xyz"[i:]}
    return _spread(points, pairs.groupBy("id").agg(F.count("*").alias("k"), *[c.alias(f"s{n}") for n, c in sums.items()]), least)


def _spread(points: DataFrame, sums: DataFrame, least: int) -> DataFrame:
    """normals() by the sums of the neighbours' differences and of their products: (id, k, sx, sy, sz, sxx, sxy, sxz, syy, syz, szz)."""
    n = F.col("k") + 1  # the point itself lies at (0, 0, 0)
    cov = {a + b: F.col(f"s{a}{b}") / n - F.col(f"s{a}") * F.col(f"s{b}") / (n * n) for i, a in enumerate("xyz") for b in "xyz"[i:]}
    s = least_eigenvector(sums.select("id", "k", *[c.alias(m) for m, c in cov.items()]))
    got = sound(points).select("id", *AXES).join(s.select("id", "k", "nx", "ny", "nz"), "id", "left").na.fill(0, ["k"])
    away = _dot([F.col(c) for c in ("nx", "ny", "nz")], [-F.col(a) for a in AXES]) < 0
    return got.withColumns({c: F.when(F.col("k") + 1 >= least, F.when(away, -F.col(c)).otherwise(F.col(c))) for c in ("nx", "ny", "nz")})


# ---- sums over neighbours ------------------------------------------------------------------------------------------


def _near(left: pd.DataFrame, right: pd.DataFrame, radius: float):
    """(rows of left, rows of right, differences, squared distances) of the pairs of neighbours in the same unit, for some of left's rows after the others; all pairs of a row come together unless its candidates alone are more than
    AT_ONCE. Rows of left lie inside their blocks and ascend by unit and cell: a cell of many candidates is compared as a matrix, others pair by pair."""
    if not len(left) or not len(right):
        return
    units = np.unique(right["unit"].to_numpy())
    side = CELLS + 2
    unit = np.searchsorted(units, left["unit"].to_numpy())
    known = (unit < len(units)) & (units[np.minimum(unit, len(units) - 1)] == left["unit"].to_numpy())
    place = lambda u, df: ((u * side + df["cx"].to_numpy()) * side + df["cy"].to_numpy()) * side + df["cz"].to_numpy()
    cell = place(np.searchsorted(units, right["unit"].to_numpy()), right)
    order = np.lexsort((right["id"].to_numpy(), cell))
    cell, own = cell[order], place(unit, left)
    # the three cells along an axis follow each other: nine runs for each row
    runs = (own[:, None] + np.array([(i * side + j) * side for i in (-1, 0, 1) for j in (-1, 0, 1)])).ravel()
    lo, hi = np.searchsorted(cell, runs - 1, "left"), np.searchsorted(cell, runs + 1, "right")
    size = np.where(np.repeat(known, 9), hi - lo, 0)
    p, q, a, b = left[list(AXES)].to_numpy(), right[list(AXES)].to_numpy()[order], left["id"].to_numpy(), right["id"].to_numpy()[order]
    ends, held = np.cumsum(size), np.empty((2, DENSE))

    def by_pair(at: int, stop: int):
        while at < stop:
            to = min(stop, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right"))))
            n = size[at:to]
            i = np.repeat(np.arange(at, to) // 9, n)
            j = np.arange(int(n.sum())) + np.repeat(lo[at:to] - (np.cumsum(n) - n), n)
            e = q[j] - p[i]
            d2 = e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2]
            use = np.flatnonzero((d2 <= radius * radius) & (a[i] != b[j]))
            if len(use):
                yield i[use], order[j[use]], e[use], d2[use]
            at = to

    def by_cell(first: int, last: int, each: int):
        j = np.concatenate([np.arange(lo[r], hi[r]) for r in range(9 * first, 9 * first + 9)])
        near, ids = [np.ascontiguousarray(q[j, x]) for x in range(3)], b[j]
        step = max(1, len(held[0]) // each)
        for at in range(first, last, step):
            to = min(last, at + step)
            d2, t = (h[: (to - at) * each].reshape(to - at, each) for h in ((held[0], held[1]) if each <= len(held[0]) else np.empty((2, each))))
            d2[:] = 0
            for x in range(3):
                np.subtract(near[x], p[at:to, x, None], out=t)
                np.multiply(t, t, out=t)
                np.add(d2, t, out=d2)
            use = np.flatnonzero(d2.ravel() <= radius * radius)
            i, k = use // each + at, use % each
            use, i, k = (x[a[i] != ids[k]] for x in (use, i, k))
            if len(use):
                yield i, order[j[k]], np.stack([n[k] for n in near], 1) - p[i], d2.ravel()[use]

    heads = np.flatnonzero(np.diff(np.where(known, own, -1), prepend=-2))
    tails = np.append(heads[1:], len(own))
    each = size.reshape(-1, 9).sum(1)
    after = 0
    for first, last in zip(heads, tails, strict=True):
        if (last - first) * each[first] >= DENSE:
            yield from by_pair(9 * after, 9 * first)
            yield from by_cell(first, last, int(each[first]))
            after = last
    yield from by_pair(9 * after, len(size))


def _summed(left: DataFrame, right: DataFrame, radius: float, width: int, f, of) -> DataFrame:
    """(id, n, h): for each row of left (id, px, py, pz, ...), sums over its neighbours in right: f(of(left), of(right), rows of left from the first of these, their number, rows of left, rows of right, differences,
    squared distances) has those of some pairs as [rows of left, 1 + width]. Rows without neighbours are left out, or have zeros.

    A row of right goes to its block of CELLS³ cells and to those next to it that it may have neighbours in; a block of many points is met in parts, OWN by NEAR."""
    wide = radius * (1 + 1e-9)
    at = {a: F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col(f"p{a}") / wide))) for a in "xyz"}

    def dealt(df: DataFrame, halo: bool) -> DataFrame:
        df = df.withColumns({f"_g{a}": c for a, c in at.items()})
        for a in "xyz":
            here = F.floor(F.col(f"_g{a}") / CELLS)
            near = F.explode(F.sequence(F.floor((F.col(f"_g{a}") - 1) / CELLS), F.floor((F.col(f"_g{a}") + 1) / CELLS))) if halo else here
            df = df.withColumn(f"_b{a}", near)
        # the halo has the cells 0 and CELLS + 1
        return df.withColumns({f"c{a}": (F.col(f"_g{a}") - F.col(f"_b{a}") * CELLS + 1).cast("int") for a in "xyz"}).drop(*[f"_g{a}" for a in "xyz"])

    block = [f"_b{a}" for a in "xyz"]
    own, near = dealt(left, False), dealt(right.select(*[F.col(c).alias(c) for c in right.columns]), True)  # may be the same table
    # parts of the blocks that have more than one: few, as each has many points
    many = own.groupBy(*block).agg(F.count("*").alias("m"), F.lit(0).cast("long").alias("n")).unionByName(near.groupBy(*block).agg(F.lit(0).cast("long").alias("m"), F.count("*").alias("n")))
    many = many.groupBy(*block).agg(F.ceil(F.sum("m") / OWN).alias("rows"), F.ceil(F.sum("n") / NEAR).alias("columns")).filter("rows > 1 or columns > 1")
    many = grid.through(many, "point-parts")
    rows, columns = F.greatest(F.lit(1), F.coalesce("rows", F.lit(1))), F.greatest(F.lit(1), F.coalesce("columns", F.lit(1)))
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = own.join(F.broadcast(many), block, "left").withColumn("_r", part(rows)).withColumn("_c", every(columns))
    near = near.join(F.broadcast(many), block, "left").withColumn("_c", part(columns)).withColumn("_r", every(rows))
    packs = max(1, near.count() // PACK)

    def unit(df: DataFrame, like: DataFrame) -> DataFrame:
        key = F.xxhash64(*block, "_r", "_c")
        return df.select(*like.columns, "cx", "cy", "cz", key.alias("unit"), F.pmod(key, F.lit(packs)).alias("pack"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(["unit", "cx", "cy", "cz", "id"], ignore_index=True)
        out, own, other = np.zeros((len(a), 1 + width)), of(a), of(b)
        for x in _near(a, b, radius):
            lo, hi = x[0][0], x[0][-1] + 1
            out[lo:hi] += f(own, other, x[0] - lo, hi - lo, *x)
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": out[:, 0].astype(np.int64), "h": pd.Series(list(out[:, 1:]), dtype=object)})  # a group may have rows of right alone

    got = unit(own, left).groupBy("pack").cogroup(unit(near, right).groupBy("pack")).applyInPandas(run, "id long, n long, h array<double>")
    return got.groupBy("id").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("h")[i]) for i in range(width)]).alias("h"))


def _sums(i: np.ndarray, n: int, *xs: np.ndarray) -> np.ndarray:
    """[n, 1 + columns]: the number of pairs of each row, and sums of the columns over them."""
    return np.stack([np.bincount(i, minlength=n), *[np.bincount(i, weights=x, minlength=n) for x in xs]], 1)


def _products(a, b, i, n, ai, bj, e, d2) -> np.ndarray:
    x, y, z = e.T
    return _sums(i, n, x, y, z, x * x, x * y, x * z, y * y, y * z, z * z)


def _angles(n1: np.ndarray, n2: np.ndarray, e: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three angles f1, f2, f3 of two points' normals in the frame of the one whose normal lies closer to the line between them (the first, if they are equal up to rounding, as
    with points of the same neighbours); 0 where that normal is the line itself."""
    far = np.sqrt(d2)
    a1, a2, c = np.einsum("ij,ij->i", n1, e) / far, np.einsum("ij,ij->i", n2, e) / far, np.einsum("ij,ij->i", n1, n2)
    (x1, y1, z1), (x2, y2, z2), (x, y, z) = n1.T, n2.T, e.T
    volume = (x * (y1 * z2 - z1 * y2) + y * (z1 * x2 - x1 * z2) + z * (x1 * y2 - y1 * x2)) / far
    swap = np.abs(a2) > np.abs(a1) + TIE
    # the frame's normal u and the other one t, by their cosines with the line from the frame's own point: v = e x u / m and w = u x v, so w t = (e t - (u e)(u t)) / m and v t = e (u x t) / m
    ue, te = np.where(swap, -a2, a1), np.where(swap, -a1, a2)
    m2 = 1 - ue * ue
    thin = np.flatnonzero(m2 < THIN)
    m = np.sqrt(np.maximum(m2, THIN))
    f1, f2, f3 = np.arctan2((te - ue * c) / m, c), volume / m, ue
    if len(thin):
        s = swap[thin, None]
        u, t, e = np.where(s, n2[thin], n1[thin]), np.where(s, n1[thin], n2[thin]), np.where(s, -e[thin], e[thin])
        v = np.cross(e, u)
        m = np.sqrt((v * v).sum(1))
        none = m == 0
        v /= np.where(none, 1, m)[:, None]
        f1[thin], f2[thin] = np.where(none, 0, np.arctan2((np.cross(u, v) * t).sum(1), (u * t).sum(1))), np.where(none, 0, (v * t).sum(1))
        f3[thin] = np.where(none, 0, f3[thin])
    return f1, f2, f3


def _histograms(a, b, i, n, ai, bj, e, d2) -> np.ndarray:
    """The number of pairs that do not lie in one place, and in each bin."""
    use = d2 > 0
    i = i[use]
    out = [np.bincount(i, minlength=n)[:, None]]
    f = _angles(a[ai[use]], b[bj[use]], e[use], d2[use])
    for x, lo, width in zip(f, (-math.pi, -1.0, -1.0), (2 * math.pi, 2.0, 2.0), strict=True):
        bin_ = np.clip(np.floor(BINS * (x - lo) / width), 0, BINS - 1).astype(np.int64)
        out.append(np.bincount(i * BINS + bin_, minlength=n * BINS).reshape(n, BINS))
    return np.concatenate(out, 1)


def _weighted(a, b, i, n, ai, bj, e, d2) -> np.ndarray:
    """The number of pairs that do not lie in one place, and their simple histograms' sums, by one over the squared distance."""
    use = d2 > 0
    i, w = i[use], 1 / d2[use]
    rows = b[bj[use]] * w[:, None]
    out = np.zeros((n, 3 * BINS))
    first = np.flatnonzero(np.diff(i, prepend=-1))  # rows ascend
    if len(i):
        out[i[first]] = np.add.reduceat(rows, first, axis=0)
    return np.concatenate([np.bincount(i, minlength=n)[:, None], out], 1)


def point_features(points: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """(id, px, py, pz, k, nx, ny, nz, fpfh): each point's features: three histograms of BINS bins, each of sum 100. A point's simple histograms are those of the angles between its normal and its neighbours'; its features are its neighbours'
    simple histograms, weighted by one over their squared distance. Null where a point has no normal or no neighbour with one. Points without all coordinates are left out; an empty table gives an empty one. ids are unique."""
    points = grid.through(sound(points).select("id", *AXES), "points")
    names = ["sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
    sums = _summed(points, points, radius, len(names), _products, len).select("id", F.col("n").alias("k"), *[F.col("h")[i].alias(c) for i, c in enumerate(names)])
    oriented = grid.through(_spread(points, sums, least), "normals")
    whole = oriented.filter("nx is not null").select("id", *AXES, "nx", "ny", "nz")
    simple = _summed(whole, whole, radius, 3 * BINS, _histograms, lambda p: p[["nx", "ny", "nz"]].to_numpy()).filter("n > 0").select("id", F.transform("h", lambda c: c * 100.0 / F.col("n")).alias("h"))
    simple = grid.through(whole.select("id", *AXES).join(simple, "id"), "simple")
    got = _summed(simple.drop("h"), simple, radius, 3 * BINS, _weighted, lambda p: np.stack(p["h"].to_numpy()) if "h" in p and len(p) else None).filter("n > 0")
    total = F.array(*[F.aggregate(F.slice("h", i * BINS + 1, BINS), F.lit(0.0), lambda a, x: a + x) for i in range(3)])
    share = got.withColumn("t", total).select("id", F.transform("h", lambda x, i: x * 100.0 / F.get("t", F.floor(i / BINS).cast("int"))).alias("fpfh"))
    return oriented.join(share, "id", "left")
