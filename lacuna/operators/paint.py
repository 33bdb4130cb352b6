"""Replay of logs, checks, targets that lie apart, and the plain version of the filling loop.

fill() works on a single grid in memory and is what tests hold loop.inpaint() against, which does the same over tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import grid
from . import patches, priority, search, windows
from .patches import values


def check_match(px: DataFrame, tx: int, ty: int, sx: int, sy: int, r: int) -> DataFrame:
    """(source_valid, target_on_boundary); an error unless both hold."""
    s = patches.sources(px, r).filter(f"cx = {sx} and cy = {sy}").agg((F.count("*") == 1).alias("source_valid"))
    t = patches.boundary(px).filter(f"x = {tx} and y = {ty}").agg((F.count("*") == 1).alias("target_on_boundary"))
    both = s.join(F.broadcast(t))
    return both.filter(F.coalesce(F.assert_true(F.col("source_valid") & F.col("target_on_boundary"), F.lit("not a valid match")).isNull(), F.lit(True)))


def _placed(matches: DataFrame, r: int, *columns: str) -> DataFrame:
    """Each match's (2r+1)² offsets: the match's columns, x, y of the target's pixel and src_x, src_y of the source's."""
    off = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    at = matches.withColumn("dx", off).withColumn("dy", off)
    return at.select(*columns, *[(F.col(c) + F.col(d)).cast("int").alias(n) for c, d, n in (("tx", "dx", "x"), ("ty", "dy", "y"), ("sx", "dx", "src_x"), ("sy", "dy", "src_y"))])


def provenance(px: DataFrame, matches: DataFrame, r: int) -> DataFrame:
    """(image_id, x, y, iter, src_x, src_y, origin_x, origin_y): for each hole pixel that a log of matches (iter, tx, ty, sx, sy, and image_id unless it holds for every image) fills, the match that fills it, the
    pixel it is copied from, and the pixel that its value comes from in the end, where what is copied was itself painted before.

    The first match that covers a hole pixel with a source pixel within the image fills it (of one iter: the smallest ty, tx, sy, sx), which is one join and a minimum for the whole log. Chains of copies are
    then followed twice as far in each round, so a log of any length takes some log2(longest chain) joins. A source pixel that is still a hole when it is copied gives the value that stands there.
    """
    of = ["image_id"] if "image_id" in matches.columns else []
    cover = _placed(matches, r, *of, F.struct("iter", "ty", "tx", "sy", "sx").alias("m"))
    cover = cover.join(px.filter("hole").select("image_id", "x", "y"), [*of, "x", "y"])
    cover = cover.join(px.select("image_id", F.col("x").alias("src_x"), F.col("y").alias("src_y")), ["image_id", "src_x", "src_y"], "left_semi")
    first = cover.groupBy("image_id", "x", "y").agg(F.min(F.struct("m", "src_x", "src_y")).alias("f"))
    first = grid.through(first.select("image_id", "x", "y", "f.m", "f.src_x", "f.src_y"), "filled")
    there = first.select("image_id", F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.col("m").alias("before"))
    # open: the source was painted by an earlier match, so the chain goes on there
    now = first.join(there, ["image_id", "src_x", "src_y"], "left").select("image_id", "x", "y", F.col("src_x").alias("ox"), F.col("src_y").alias("oy"), F.coalesce(F.col("before") < F.col("m"), F.lit(False)).alias("open"))
    now = grid.through(now, "chains")
    while now.filter("open").take(1):
        then = now.select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("ox").alias("nx"), F.col("oy").alias("ny"), F.col("open").alias("more"))
        moved = now.filter("open").join(then, ["image_id", "ox", "oy"]).select("image_id", "x", "y", F.col("nx").alias("ox"), F.col("ny").alias("oy"), F.col("more").alias("open"))
        now = grid.through(now.filter("not open").unionByName(moved), "chains")
    return first.join(now, ["image_id", "x", "y"]).select("image_id", "x", "y", F.col("m.iter").alias("iter"), "src_x", "src_y", F.col("ox").alias("origin_x"), F.col("oy").alias("origin_y"))


def replay(px: DataFrame, matches: DataFrame, r: int) -> DataFrame:
    """px with all matches of a log painted in the order of iter: filled pixels are no holes any more; src_x, src_y: the pixel that each was copied from (a valid pixel itself, -1 for a hole that is left), iter: the match's
    (null for what was not painted). See provenance()."""
    vs = [c for c in values(px) if c not in ("src_x", "src_y", "iter")]
    made = provenance(px, matches, r)
    made = made.join(px.select("image_id", F.col("x").alias("origin_x"), F.col("y").alias("origin_y"), *[F.col(c).alias(f"_n_{c}") for c in vs]), ["image_id", "origin_x", "origin_y"]).drop("origin_x", "origin_y")
    out = px.drop("src_x", "src_y", "iter").join(made, ["image_id", "x", "y"], "left")
    fill = F.col("src_x").isNotNull()
    own = lambda c: F.when(fill, F.col(f"src_{c}")).when(F.col("hole"), -1).otherwise(F.col(c)).cast("int")
    return out.withColumns({c: F.when(fill, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in vs} | {"src_x": own("x"), "src_y": own("y"), "hole": F.col("hole") & ~fill}).drop(*[f"_n_{c}" for c in vs])


def apart(queue: DataFrame, n: int, distance: int) -> DataFrame:
    """(image_id, x, y, priority): the n nodes that are chosen of a queue if each image's node of the highest priority is taken (ties: the smaller y, then x) and the nodes no farther from it than `distance`, along both axes, go, and so on.

    Nodes that no node near them surpasses are taken all at once, and what is near them goes, in rounds; the nodes so taken, in order of priority, are those of the choice one by one. Rounds end as soon as n taken nodes
    surpass all that is left. Nodes that are not valid take no part; with fewer than n there are fewer rows."""
    node = F.struct("priority", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    left = grid.through(queue.filter("valid").select("image_id", "x", "y", "priority").withColumn("o", node), "queue")
    taken = None
    while left.take(1):
        q = left.select("image_id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("o").alias("qo"))
        beaten = search.band_join(left, q, distance, ("image_id",)).filter(F.col("qo") > F.col("o")).select("image_id", "x", "y").distinct()
        won = grid.through(left.join(beaten, ["image_id", "x", "y"], "left_anti"), "won")
        taken = won if taken is None else taken.unionByName(won)
        w = won.select("image_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
        near = search.band_join(left, w, distance, ("image_id",)).select("image_id", "x", "y").distinct()
        left = grid.through(left.join(near, ["image_id", "x", "y"], "left_anti"), "queue")
        best = left.groupBy("image_id").agg(F.max("o").alias("b"))
        sure = taken.join(best, "image_id", "left").groupBy("image_id").agg(F.count_if(F.col("b").isNull() | (F.col("o") > F.col("b"))).alias("k"), F.max("b").isNull().alias("done"))
        if not sure.filter(f"not done and k < {n}").take(1):
            break
    if taken is None:
        return left.drop("o")
    return search.top(taken.withColumn("_p", -F.col("priority")), n, ["y", "x"], ["image_id"], None, "_p").select("image_id", "x", "y", "priority")


def forward_look(px: DataFrame, n: int, r: int, distance: int | None = None) -> DataFrame:
    """(image_id, tx, ty, cx, cy, d): of n targets of high priority that lie apart, each image's one with the best match. distance: targets are farther apart than this along an axis; patches that do not overlap (2r), if none is given.
    Ties go to the smaller ty, tx, cy, cx."""
    targets = apart(priority.initial_queue(px, r).withColumn("priority", F.round("priority", 9)), n, 2 * r if distance is None else distance)
    targets = targets.select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"))  # n of an image
    off = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    at = targets.withColumn("dx", off).withColumn("dy", off).withColumns({"x": F.col("tx") + F.col("dx"), "y": F.col("ty") + F.col("dy")})
    t = px.filter(~F.col("hole")).select("image_id", "x", "y", F.col("v").alias("t_v")).join(F.broadcast(at), ["image_id", "x", "y"]).select("image_id", "tx", "ty", "dx", "dy", "t_v")  # n patches
    scored = patches.differences(px, t, r, patches.ssd(["v"]), None, ("tx", "ty"))
    return search.best(scored, ["ty", "tx", "cy", "cx"], ["image_id"])


def _sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over the (2r+1)² cells about each one, cropped."""
    c = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    c[1:, 1:] = a.cumsum(0).cumsum(1)
    y0, y1 = (np.clip(np.arange(a.shape[0]) + k, 0, a.shape[0]) for k in (-r, r + 1))
    x0, x1 = (np.clip(np.arange(a.shape[1]) + k, 0, a.shape[1]) for k in (-r, r + 1))
    return c[np.ix_(y1, x1)] - c[np.ix_(y0, x1)] - c[np.ix_(y1, x0)] + c[np.ix_(y0, x0)]


def _matches(v: np.ndarray, hole: np.ndarray, can: np.ndarray, ty: int, tx: int, r: int) -> np.ndarray:
    """(y, x, mean squared, mean absolute difference) of the candidate centres, best first."""
    cy, cx = np.nonzero(can)
    d, a, m = np.zeros(len(cy)), np.zeros(len(cy)), 0
    for y in range(max(0, ty - r), min(v.shape[0], ty + r + 1)):
        for x in range(max(0, tx - r), min(v.shape[1], tx + r + 1)):
            if not hole[y, x]:
                e = v[cy + y - ty, cx + x - tx] - v[y, x]
                d += e * e
                a += np.abs(e)
                m += 1
    got = np.stack([cy, cx, np.round(d / max(1, m), 12), np.round(a / max(1, m), 12)], 1)
    return got[np.argsort(got[:, 2], kind="stable")]


def _moved(a: np.ndarray, k: int, axis: int, fill: float) -> np.ndarray:
    """a's cells k farther along an axis, at the place of each; `fill` beyond the edge."""
    a = np.moveaxis(a, axis, 0)
    out = np.full(a.shape, fill)
    if abs(k) < len(a):
        out[max(0, -k) : len(a) - max(0, k)] = a[max(0, k) : len(a) + min(0, k)]
    return np.moveaxis(out, 0, axis)


def _slope(v: np.ndarray, hole: np.ndarray, axis: int) -> np.ndarray:
    """The masked derivative along an axis, averaged with a Gaussian's weights across it, as by windows.gaussian; 0 where there is none."""
    seen = np.where(hole, np.nan, v)
    a, b = _moved(seen, -1, axis, np.nan), _moved(seen, 1, axis, np.nan)
    d = np.where(hole, np.nan, np.where(np.isnan(a), b - seen, np.where(np.isnan(b), seen - a, (b - a) / 2)))
    weights = windows.kernel(11, 3.0)
    part, used = np.zeros(v.shape), np.zeros(v.shape)
    for k, w in enumerate(weights, -(len(weights) // 2)):
        at = _moved(d, k, 1 - axis, np.nan)
        part += np.where(np.isnan(at), 0, at * w)
        used += np.where(np.isnan(at), 0, w)
    return np.where(hole | (used == 0), 0, part / np.where(used == 0, 1, used))


def _blurred(v: np.ndarray, there: np.ndarray, variance: float, radius: int = 3) -> np.ndarray:
    """The Gaussian mean over the cells that are there, as by windows.convolved; 0 where none is near."""
    total, weight = np.where(there, v, 0.0), there.astype(float)
    for axis in (1, 0):
        total, weight = (sum(_moved(x, k, axis, 0.0) * np.exp(-k * k / (2 * variance)) for k in range(-radius, radius + 1)) for x in (total, weight))
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0)


def _data_term(v: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """|isophote . normal| / 255, as in priority.criminisi, for a grid of one channel."""
    ix, iy = -_slope(v, hole, 0), _slope(v, hole, 1)
    m = _blurred(np.where(hole, 0.0, 1.0), np.ones(hole.shape, bool), 2.0)
    pad = np.pad(m, 1, mode="edge")
    nx, ny = (pad[1:-1, 2:] - pad[1:-1, :-2]) / 2, (pad[2:, 1:-1] - pad[:-2, 1:-1]) / 2
    length = np.hypot(nx, ny)
    return np.abs(ix * nx + iy * ny) / np.where(length > 0, length, 1) / 255


def _histogram_scores(f: np.ndarray, hole: np.ndarray, best: np.ndarray, ty: int, tx: int, r: int, bins: int = 30) -> np.ndarray:
    """For each candidate, the sum of differences between its histogram of f and the target's, both as shares: the target by its valid cells, a candidate by all of its patch, in bins over
    the target's range; what lies beyond counts in the end bins."""
    y0, y1, x0, x1 = max(0, ty - r), ty + r + 1, max(0, tx - r), tx + r + 1
    t = f[y0:y1, x0:x1][~hole[y0:y1, x0:x1]]
    lo, width = t.min(), np.ptp(t)

    def shares(x: np.ndarray) -> np.ndarray:
        place = np.clip(np.floor((x - lo) / width * bins), 0, bins - 1).astype(int) if width > 0 else np.zeros(x.shape, int)
        return np.bincount(place.ravel(), minlength=bins) / x.size

    own = shares(t)
    return np.round([np.abs(shares(f[y - r : y + r + 1, x - r : x + r + 1]) - own).sum() for y, x in best[:, :2].astype(int)], 9)


#: What a second stage may rank the first stage's k best by.
SECOND = ("absolute", "histogram", "gradient_histogram")


def _ranked_again(second: str, v: np.ndarray, f: np.ndarray, hole: np.ndarray, best: np.ndarray, ty: int, tx: int, r: int) -> np.ndarray:
    """The candidates by the second stage's score; equal ones keep the first stage's order."""
    if second == "absolute":
        score = best[:, 3]
    else:
        score = _histogram_scores(f if second == "gradient_histogram" else v, hole, best, ty, tx, r)
    return best[np.argsort(score, kind="stable")]


def fill(v: np.ndarray, hole: np.ndarray, r: int, neighborhood: int | None = None, accept: float | None = None, k: int = 1, order: str = "confidence", blur: float | None = None, second: str | None = None, strict: bool = False):
    """Values, source positions and the step of each filled cell, for a grid v [y, x] and its holes: the boundary cell of the highest priority is
    filled from the patch of least mean squared difference, until no hole is left.

    order: the priority, the patch's `confidence`, or with the data term, `criminisi`. blur: patches are compared in the grid blurred with this variance, which is painted along with
    the grid itself. neighborhood: candidates lie in a square about the target, or anywhere if none does. second: the k best are ranked again, by one of SECOND, and the first of them
    is taken; gradients are those of the grid before the filling, 0 in its holes. accept: a match of that mean squared difference or more is not taken; the whole grid is searched where the search was
    local, and of the k best the one of the least mean absolute difference is taken, in place of a person's choice; or, if strict, it is an error. Ties go to the smaller y, then x."""
    if order not in ("confidence", "criminisi") or second not in (None, *SECOND):
        raise ValueError(f"no such order or second stage: {order}, {second}")
    v, hole, before = v.copy(), hole.copy(), hole.copy()
    h, w = v.shape
    seen = v if blur is None else _blurred(v, ~hole, blur)
    f = np.hypot(_slope(v, hole, 1), _slope(v, hole, 0)) if second == "gradient_histogram" else v
    yy, xx = np.mgrid[0:h, 0:w]
    sx, sy, step = np.where(hole, -1, xx), np.where(hole, -1, yy), np.where(hole, 0, -1)
    conf = np.where(hole, 0.0, 1.0)
    area = _sum(np.ones((h, w)), r)
    source = (area == (2 * r + 1) ** 2) & (np.rint(_sum(before.astype(float), r)) == 0)
    n = 0
    while hole.any():
        edge = ~hole & (np.rint(_sum(hole.astype(float), 1)) > 0)
        if not edge.any():
            break
        term = _sum(np.where(hole, 0, conf), r) / area
        pr = np.where(edge, np.round(term * _data_term(v, hole) if order == "criminisi" else term, 9), -1)
        ty, tx = np.unravel_index(int(pr.argmax()), pr.shape)
        can = source
        if neighborhood is not None:
            near = np.zeros_like(source)
            near[max(0, ty - neighborhood) : ty + neighborhood + 1, max(0, tx - neighborhood) : tx + neighborhood + 1] = True
            can = source & near if (source & near).any() else source
        best = _matches(seen, hole, can, ty, tx, r)
        if not len(best):
            break
        chosen = _ranked_again(second, v, f, hole, best[:k], ty, tx, r)[0] if second else best[0]
        if accept is not None and chosen[2] >= accept:
            if strict:
                raise ValueError(f"the match at x = {tx}, y = {ty} is not accepted: {chosen[2]}")
            if neighborhood is not None:
                best = _matches(seen, hole, source, ty, tx, r)
            chosen = min(best[:k], key=lambda b: b[3])
        py, px = int(chosen[0]), int(chosen[1])
        c = term[ty, tx]
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                y, x = ty + dy, tx + dx
                if 0 <= y < h and 0 <= x < w and hole[y, x]:
                    v[y, x], sy[y, x], sx[y, x], step[y, x] = v[py + dy, px + dx], sy[py + dy, px + dx], sx[py + dy, px + dx], n
                    if blur is not None:
                        seen[y, x] = seen[py + dy, px + dx]
                    if second == "gradient_histogram":
                        f[y, x] = f[py + dy, px + dx]
                    hole[y, x], conf[y, x] = False, c
        n += 1
    return v, sx, sy, step
