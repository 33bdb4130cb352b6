"""The best source patches of many targets at once, exactly, by lower bounds.

A patch is cut into blocks. By the sums over the blocks that are wholly valid in the target, the squared difference of two patches is at least the sum of the squared differences of these sums, each over its block's size. So a halo tile first bounds all its
centres by few sums each, at one scale after the other; the exact differences of the centres of least bound give each target a radius, of which the k-th best over all tiles counts; and in a second pass only what no scale
puts beyond the radius is compared pixel by pixel. Tiles meet targets in chunks, so that neither side has to fit anywhere whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import grid
from . import search
from .integral import Integral
from .patches import dealt_in_tiles

#: Blocks along a patch's side, scale by scale; targets in a chunk.
SCALES, CHUNK = (2, 4), 1024
#: Relative slack of the bounds, for sums in another order.
SLACK = 1e-9


class Sums:
    """Sums over rectangles of a grid of numbers."""

    def __init__(self, v: np.ndarray):
        self.s = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
        self.s[1:, 1:] = v.cumsum(0).cumsum(1)

    def about(self, cy: np.ndarray, cx: np.ndarray, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return self.s[cy + y1 + 1, cx + x1 + 1] - self.s[cy + y0, cx + x1 + 1] - self.s[cy + y1 + 1, cx + x0] + self.s[cy + y0, cx + x0]


def _cuts(r: int, n: int) -> list[tuple[int, int]]:
    parts = np.array_split(np.arange(-r, r + 1), min(n, 2 * r + 1))
    return [(int(p[0]), int(p[-1])) for p in parts]


class Tile:
    """A tile's pixels and the centres of its own source patches."""

    def __init__(self, pdf: pd.DataFrame, r: int):
        self.r, self.x0, self.y0 = r, pdf["x"].min(), pdf["y"].min()
        x, y = (pdf["x"] - self.x0).to_numpy(), (pdf["y"] - self.y0).to_numpy()
        shape = (y.max() + 1, x.max() + 1)
        self.v, there, hole = np.zeros(shape), np.zeros(shape, int), np.zeros(shape, int)
        self.v[y, x], there[y, x], hole[y, x] = pdf["v"].fillna(0.0), 1, pdf["hole"]
        own = pdf["_own"].to_numpy()
        cy, cx = y[own], x[own]
        full = (-r, r, -r, r)
        ok = (Integral(there).about(cy, cx, full) == (2 * r + 1) ** 2) & (Integral(hole).about(cy, cx, full) == 0)
        order = np.lexsort((cx[ok], cy[ok]))
        self.cy, self.cx = cy[ok][order], cx[ok][order]
        sums = Sums(self.v)
        self.blocks = [{(x0, x1, y0, y1): sums.about(self.cy, self.cx, x0, x1, y0, y1) for y0, y1 in _cuts(r, n) for x0, x1 in _cuts(r, n)} for n in SCALES]

    def bounds(self, t: np.ndarray, valid: np.ndarray, at: np.ndarray, scale: int) -> np.ndarray:
        """Lower bounds of the summed squared differences of the centres `at` to a target t [2r+1, 2r+1]."""
        out, r = np.zeros(len(at)), self.r
        for (x0, x1, y0, y1), s in self.blocks[scale].items():
            part = slice(y0 + r, y1 + r + 1), slice(x0 + r, x1 + r + 1)
            if valid[part].all():
                d = s[at] - t[part].sum()
                out += d * d / valid[part].size
        return out * (1 - SLACK)

    def exact(self, t: np.ndarray, valid: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean squared differences."""
        dy, dx = np.nonzero(valid)
        e = np.zeros(len(at))
        for i, j in zip(dy.tolist(), dx.tolist(), strict=True):
            d = self.v[self.cy[at] + i - self.r, self.cx[at] + j - self.r] - t[i, j]
            e += d * d
        return e / len(dy)


def _search(tile: Tile, t: np.ndarray, valid: np.ndarray, k: int, radius: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(centres, exact differences, number of those compared): with a radius, all centres that may lie within it; without, the k of least bound."""
    n, at = int(valid.sum()), np.arange(len(tile.cy))
    if radius is None:
        low = tile.bounds(t, valid, at, len(SCALES) - 1)
        at = at[np.argsort(low, kind="stable")[:k]]
    else:
        for scale in range(len(SCALES)):
            at = at[tile.bounds(t, valid, at, scale) <= radius * n * (1 + SLACK)]
    return at, tile.exact(t, valid, at), len(at)


def nearest_patches(px: DataFrame, targets: DataFrame, k: int, r: int) -> DataFrame:
    """(image_id, tx, ty, cx, cy, d, rn, survivors): the k source patches of least mean squared difference for each target (image_id, tx, ty), by the target's valid pixels; ties go to the smaller cy, cx. survivors: the candidates that
    were compared pixel by pixel for the target in the second pass. Targets without a valid pixel have no rows; those with fewer candidates than k fewer. Values are in the column v, and null only in holes."""
    off = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    asked = targets.select("image_id", "tx", "ty").distinct()
    at = asked.withColumn("dy", off).withColumn("dx", off).withColumns({"x": F.col("tx") + F.col("dx"), "y": F.col("ty") + F.col("dy")})
    whole = at.join(px.filter(~F.col("hole")).select("image_id", "x", "y", "v"), ["image_id", "x", "y"]).groupBy("image_id", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("dy", "dx", "v"))).alias("t"))
    whole = grid.through(whole, "targets")
    chunks = max(1, -(-whole.count() // CHUNK))
    whole = whole.withColumn("chunk", F.pmod(F.xxhash64("image_id", "tx", "ty"), F.lit(chunks)).cast("int"))
    dealt = dealt_in_tiles(px.select("image_id", "x", "y", "v", "hole"), r)
    tiles = grid.through(dealt.filter("_own").select("image_id", "_i", "_j").distinct(), "tiles")
    every = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(radii: DataFrame | None) -> DataFrame:
        first_pass = radii is None
        t = whole.withColumn("radius", F.lit(None).cast("double")) if radii is None else whole.join(radii, ["image_id", "tx", "ty"])

        def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(b) and a["_own"].any():
                tile = Tile(a, r)
                for tx, ty, cells, radius in zip(b["tx"], b["ty"], b["t"], b["radius"], strict=True):
                    t, valid = np.zeros((2 * r + 1, 2 * r + 1)), np.zeros((2 * r + 1, 2 * r + 1), bool)
                    for c in cells:
                        t[c["dy"] + r, c["dx"] + r], valid[c["dy"] + r, c["dx"] + r] = c["v"], True
                    rows, d, n = _search(tile, t, valid, k, None if first_pass else radius)
                    best = np.argsort(d, kind="stable")[:k]
                    out.append(pd.DataFrame({"image_id": key[0], "tx": tx, "ty": ty, "cx": tile.cx[rows[best]] + tile.x0, "cy": tile.cy[rows[best]] + tile.y0, "d": d[best], "compared": 0}))
                    out.append(pd.DataFrame({"image_id": [key[0]], "tx": tx, "ty": ty, "cx": -1, "cy": -1, "d": np.nan, "compared": n}))
            form = {"image_id": "int64", "tx": "int32", "ty": "int32", "cx": "int32", "cy": "int32", "d": "float64", "compared": "int64"}
            return pd.concat(out).astype(form) if out else pd.DataFrame({c: np.zeros(0, t) for c, t in form.items()})

        keys = ["image_id", "_i", "_j", "chunk"]
        return every.groupBy(*keys).cogroup(t.join(tiles, "image_id").groupBy(*keys)).applyInPandas(one, "image_id long, tx int, ty int, cx int, cy int, d double, compared long")

    first = search.top(run(None).filter("cx >= 0"), k, ["cy", "cx"], ["image_id", "tx", "ty"])
    # the k-th of what was compared; without k of them nothing is beyond it
    radii = grid.through(first.groupBy("image_id", "tx", "ty").agg(F.when(F.count("*") == k, F.max("d")).otherwise(float("inf")).alias("radius")), "radii")
    second = grid.through(run(radii), "compared")
    kept = second.groupBy("image_id", "tx", "ty").agg(F.sum("compared").alias("survivors"))
    return search.top(second.filter("cx >= 0"), k, ["cy", "cx"], ["image_id", "tx", "ty"]).drop("compared").join(kept, ["image_id", "tx", "ty"])
