"""Histograms of all patches at once, from integral images in halo tiles.

For every channel and bin, a tile holds the number of pixels in that bin above and to the left of each place. Any rectangle's histogram is four lookups then, whatever its size, so the parts of a patch (its valid or hole
offsets, its quadrants) are compared as a few rectangles each, for every centre of the tile. What comes out is one number for each centre.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patches import dealt_in_tiles


def rectangles(offsets: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Disjoint (x0, x1, y0, y1), inclusive, that cover the offsets (dx, dy): runs along lines, joined over lines where they are equal."""
    open_: dict[tuple[int, int], int] = {}
    out, before = [], None
    for y in sorted({y for _, y in offsets}):
        xs = sorted(x for x, v in offsets if v == y)
        cuts = [i for i in range(1, len(xs)) if xs[i] != xs[i - 1] + 1]
        runs = {(xs[a], xs[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(xs)], strict=True)}
        for run in [k for k in open_ if k not in runs or before != y - 1]:
            out.append((*run, open_.pop(run), before))
        for run in runs:
            open_.setdefault(run, y)
        before = y
    return out + [(*run, y0, before) for run, y0 in open_.items()]


class Integral:
    """Sums over rectangles about every cell of a grid [h, w]; what lies outside counts as 0."""

    def __init__(self, a: np.ndarray):
        self.h, self.w = a.shape
        self.s = np.zeros((self.h + 1, self.w + 1), np.int32)
        self.s[1:, 1:] = a.cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)

    def about(self, cy: np.ndarray, cx: np.ndarray, rect: tuple[int, int, int, int]) -> np.ndarray:
        x0, x1, y0, y1 = rect
        top, bottom = np.clip(cy + y0, 0, self.h), np.clip(cy + y1 + 1, 0, self.h)
        left, right = np.clip(cx + x0, 0, self.w), np.clip(cx + x1 + 1, 0, self.w)
        return self.s[bottom, right] - self.s[top, right] - self.s[bottom, left] + self.s[top, left]


class Part:
    """What is compared of a patch: the offsets, the channels (columns) and their bins, and the target's histogram [channels, bins] over them; normal: as shares of the whole histogram."""

    def __init__(self, offsets: set[tuple[int, int]], limits: list[tuple[float, float]], target: np.ndarray):
        self.rects, self.limits, self.target = rectangles(offsets), limits, np.asarray(target, float)


def _bins(f: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """As hist.bin_of."""
    with np.errstate(invalid="ignore"):
        b = np.clip(np.floor((f - lo) / (hi - lo) * bins), 0, bins - 1) if hi != lo else np.zeros(f.shape)
    return np.where(np.isnan(b), 0, b).astype(int)


def differences(px: DataFrame, columns: list[str], parts: list[Part], r: int, bins: int, normal: bool = True) -> DataFrame:
    """(image_id, cx, cy, d): for every source patch, the sum over the bins of |target - candidate|, of all parts' histograms appended; normal: both as shares of their sums. Pixels whose feature is null (the features of holes) count in no bin; source patches
    have none. An empty grid gives no rows. Parts are a few rectangles and channels times bins numbers each, and a task holds one integral image at a time."""
    whole = sum(p.target.sum() for p in parts)
    own = [p.target / whole if normal and whole else p.target for p in parts]
    full = (-r, r, -r, r)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["x"].min(), pdf["y"].min()
        x, y = (pdf["x"] - x0).to_numpy(), (pdf["y"] - y0).to_numpy()
        shape = (y.max() + 1, x.max() + 1)
        there, hole, f = np.zeros(shape, int), np.zeros(shape, int), {c: np.full(shape, np.nan) for c in columns}
        there[y, x], hole[y, x] = 1, pdf["hole"]
        for c in columns:
            f[c][y, x] = pdf[c]
        mine = pdf["_own"].to_numpy()
        cy, cx = y[mine], x[mine]
        source = (Integral(there).about(cy, cx, full) == (2 * r + 1) ** 2) & (Integral(hole).about(cy, cx, full) == 0)
        cy, cx = cy[source], cx[source]
        n = [np.zeros((len(cy), *p.target.shape), np.float64) for p in parts]
        for got, p in zip(n, parts, strict=True):
            for i, (c, (lo, hi)) in enumerate(zip(columns, p.limits, strict=True)):
                at = np.where(np.isnan(f[c]), -1, _bins(f[c], lo, hi, bins))
                for b in range(bins):
                    some = Integral(at == b)
                    for rect in p.rects:
                        got[:, i, b] += some.about(cy, cx, rect)
        total = sum(g.sum((1, 2)) for g in n)
        scale = np.where(total > 0, total, 1)[:, None, None] if normal else 1.0
        d = sum(np.abs(g / scale - t).sum((1, 2)) for g, t in zip(n, own, strict=True))
        return pd.DataFrame({"image_id": key[0], "cx": cx + x0, "cy": cy + y0, "d": d})

    dealt = dealt_in_tiles(px.select("image_id", "x", "y", "hole", *columns), r)
    return dealt.groupBy("image_id", "_i", "_j").applyInPandas(one, "image_id long, cx int, cy int, d double")


def target_parts(px: DataFrame, columns: list[str], tx: int, ty: int, r: int, bins: int, quadrants: bool = False, fixed: tuple[float, float] | None = None, image: int = 0) -> list[Part]:
    """The valid pixels of the target's patch as one part, or as a part for each quadrant (dx < 0 or not, dy < 0 or not), in bins over each one's own range or over `fixed`. A patch of (2r+1)² rows comes to the driver."""
    near = (F.col("image_id") == image) & F.col("x").between(tx - r, tx + r) & F.col("y").between(ty - r, ty + r) & ~F.col("hole")
    rows = px.filter(near).select((F.col("x") - tx).alias("dx"), (F.col("y") - ty).alias("dy"), *columns).collect()
    out = []
    for q in range(4) if quadrants else (None,):
        some = [row for row in rows if q is None or (row["dx"] >= 0) * 2 + (row["dy"] >= 0) == q]
        if some:
            values = [np.array([row[c] for row in some], float) for c in columns]
            limits = [fixed or (float(v.min()), float(v.max())) for v in values]
            out.append(Part({(row["dx"], row["dy"]) for row in some}, limits, np.array([np.bincount(_bins(v, *lim, bins), minlength=bins) for v, lim in zip(values, limits, strict=True)])))
    return out
