"""The greedy filling loop over a table of images, a few jobs a step.

A step fills each image's boundary cell of the highest priority from its best source patch, all images at once. The grid itself is written once, as rows of tiles (arrays of a tile's cells, halo included, and the centres of its
source patches): a step reads them, compares the step's targets, which are a patch for each image, and sends on a tile's best. What changes is a small table, the holes: values, confidence and origin of their cells; priorities are worked out
on the holes and the rim of cells about them. So a step's search is spread over the tiles of an image of any size, its other work goes with the holes, and a lost executor costs a step's tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import grid
from . import priority, search, windows
from .integral import Integral
from .paint import SECOND
from .patches import box, dealt_in_tiles, one, tiled

#: Images of a step whose targets are broadcast to the tiles (a patch each); more are joined by image.
IMAGES = 10_000
#: How far priorities look.
REACH = 6


def _tile_rows(px: DataFrame, r: int) -> DataFrame:
    """(image_id, x0, y0, width, seen, g, cy, cx): a row for each tile that has source patches."""

    def one_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
        x, y = (pdf["x"] - x0).to_numpy(), (pdf["y"] - y0).to_numpy()
        shape = (y.max() + 1, x.max() + 1)
        there, hole, seen, g = np.zeros(shape, int), np.zeros(shape, int), np.zeros(shape), np.zeros(shape)
        there[y, x], hole[y, x], seen[y, x], g[y, x] = 1, pdf["hole"], pdf["seen"].fillna(0.0), pdf["g"].fillna(0.0)
        own = pdf["_own"].to_numpy()
        cy, cx = y[own], x[own]
        full = (-r, r, -r, r)
        ok = (Integral(there).about(cy, cx, full) == (2 * r + 1) ** 2) & (Integral(hole).about(cy, cx, full) == 0)
        order = np.lexsort((cx[ok], cy[ok]))
        form = {"image_id": key[0], "x0": x0, "y0": y0, "width": shape[1], "seen": [seen.tobytes()], "g": [g.tobytes()], "cy": [cy[ok][order].astype(np.int32).tobytes()], "cx": [cx[ok][order].astype(np.int32).tobytes()]}
        return pd.DataFrame(form).iloc[: int(ok.any())]

    dealt = dealt_in_tiles(px.select("image_id", "x", "y", "hole", "seen", "g"), r)
    return dealt.groupBy("image_id", "_i", "_j").applyInPandas(one_tile, "image_id long, x0 int, y0 int, width int, seen binary, g binary, cy binary, cx binary")


def _shares(x: np.ndarray, lo: float, width: float, bins: int) -> np.ndarray:
    """[rows, bins] histograms of rows, as shares; what lies beyond the range counts in the end bins."""
    place = np.clip(np.floor((x - lo) / width * bins), 0, bins - 1).astype(int) if width > 0 else np.zeros(x.shape, int)
    return np.bincount((np.arange(len(x))[:, None] * bins + place).ravel(), minlength=len(x) * bins).reshape(len(x), bins) / x.shape[1]


def _compared(tile, target, r: int, k: int, neighborhood: int | None, second: str | None, bins: int = 30) -> pd.DataFrame:
    """The tile's k best centres for a target: of all, and of those near it."""
    shape = (-1, tile.width)
    seen, g = np.frombuffer(tile.seen).reshape(shape), np.frombuffer(tile.g).reshape(shape)
    cy, cx = np.frombuffer(tile.cy, np.int32).astype(int), np.frombuffer(tile.cx, np.int32).astype(int)
    d, a = np.zeros(len(cy)), np.zeros(len(cy))
    for c in target.cells:
        e = seen[cy + c["dy"], cx + c["dx"]] - c["seen"]
        d += e * e
        a += np.abs(e)
    n = len(target.cells)
    d, a = np.round(d / n, 12), np.round(a / n, 12)
    near = (np.abs(cx + tile.x0 - target.tx) <= neighborhood) & (np.abs(cy + tile.y0 - target.ty) <= neighborhood) if neighborhood is not None else np.zeros(len(cy), bool)
    out = []
    for flag, some in ((False, np.arange(len(cy))), (True, np.flatnonzero(near))):
        best = some[np.argsort(d[some], kind="stable")[:k]]
        score = a[best]
        if second in ("histogram", "gradient_histogram") and len(best):
            t = np.array([c["g"] for c in target.cells])
            lo, width = t.min(), np.ptp(t)
            off = np.arange(-r, r + 1)
            cells = g[cy[best][:, None, None] + off[:, None], cx[best][:, None, None] + off].reshape(len(best), -1)
            score = np.round(np.abs(_shares(cells, lo, width, bins) - _shares(t[None], lo, width, bins)).sum(1), 9)
        out.append(pd.DataFrame({"cx": cx[best] + tile.x0, "cy": cy[best] + tile.y0, "d": d[best], "a": a[best], "score": score, "near": flag}))
    return pd.concat(out).assign(image_id=target.image_id)


def _chosen(found: DataFrame, k: int, second: str | None, accept: float | None, strict: bool) -> DataFrame:
    """(image_id, cx, cy) of what tiles sent on: from near the target, if anything is; the first of the k best, or the best of them by the second stage. What is not accepted is chosen among the k best of all by absolute differences."""
    by = ["image_id"]
    if k == 1 and accept is None and not second:  # one aggregation: near ones first, then the least difference
        return search.best(found.withColumn("far", ~F.col("near")), ["d", "cy", "cx"], by, "far").select("image_id", "cx", "cy")
    wide = search.top(found.filter(~F.col("near")), k, ["cy", "cx"], by)
    close = search.top(found.filter("near"), k, ["cy", "cx"], by)
    pool = close.unionByName(wide.join(close.select("image_id").distinct(), "image_id", "left_anti"))
    got = search.best(pool, ["rn"], by, "score" if second else "rn")
    if accept is None:
        return got.select("image_id", "cx", "cy")
    refused = F.col("d") >= accept
    if strict:
        sound = F.assert_true(~refused, F.concat(F.lit("a match is not accepted: "), F.col("d").cast("string")))
        return got.filter(F.coalesce(sound.isNull(), F.lit(True))).select("image_id", "cx", "cy")
    other = search.best(wide, ["rn"], by, "a").select("image_id", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    return got.join(other, "image_id").select("image_id", F.when(refused, F.col("ox")).otherwise(F.col("cx")).alias("cx"), F.when(refused, F.col("oy")).otherwise(F.col("cy")).alias("cy"))


def inpaint(px: DataFrame, r: int, neighborhood: int | None = None, accept: float | None = None, k: int = 1, order: str = "confidence", blur: float | None = None, second: str | None = None, strict: bool = False, most: int | None = None) -> DataFrame:
    """(image_id, x, y, v, iter, src_x, src_y): each image of px (image_id, x, y, v, hole) filled; iter: the step that filled a cell, -1 if it was valid, null if it is a hole still. The settings and results are those of paint.fill(), which
    is the plain version for a single grid in memory. most: steps at most. Images without holes stay as they are, as do those without a source patch; an empty table stays empty."""
    if order not in ("confidence", "criminisi") or second not in (None, *SECOND):
        raise ValueError(f"no such order or second stage: {order}, {second}")

    def prepared(t: DataFrame) -> DataFrame:
        t = windows.masked_blur(t, "v", "seen", blur, 3).withColumn("seen", F.coalesce("seen", F.lit(0.0))) if blur is not None else t.withColumn("seen", F.col("v"))
        if second != "gradient_histogram":
            return t.withColumn("g", F.col("v"))
        return windows.gradient(t, "v", "_gx", "_gy").withColumn("g", F.hypot(F.coalesce("_gx", F.lit(0.0)), F.coalesce("_gy", F.lit(0.0)))).drop("_gx", "_gy")

    # how near the next hole is says what belongs to the rim
    rim_of = max(r, REACH) + 1
    base = tiled(px.select("image_id", "x", "y", "v", "hole"), max(rim_of, 5), lambda t: box(prepared(t), rim_of, _near=one(F.col("hole"))))
    base = grid.through(base, "fill-grid")
    tiles = grid.through(_tile_rows(base, r), "fill-tiles")
    rim = base.filter(~F.col("hole") & (F.col("_near") > 0)).select("image_id", "x", "y", "v", "seen", "g", F.lit(1.0).alias("confidence"), "hole")
    rim = grid.through(rim, "fill-rim")
    cells = base.select("image_id", F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.col("v").alias("_v"), F.col("seen").alias("_s"), F.col("g").alias("_g"))
    none = F.lit(None).cast("int")
    holes = base.filter("hole").select("image_id", "x", "y", "v", "seen", "g", F.lit(0.0).alias("confidence"), "hole", none.alias("iter"), F.lit(-1).alias("src_x"), F.lit(-1).alias("src_y"))
    holes = grid.through(holes, "fill-holes")
    sizes = holes.groupBy("image_id").count().agg(F.count("*").alias("images"), F.coalesce(F.sum("count"), F.lit(0)).alias("holes")).first()
    few, left, step = sizes["images"] <= IMAGES, sizes["holes"], 0
    while left and (most is None or step < most):
        now = rim.unionByName(holes.select(rim.columns))

        def terms(t: DataFrame) -> DataFrame:
            t = priority.confidence(t, r)
            return box(windows.boundary_normals(windows.gradient(t, "v", "_sx", "_sy")) if order == "criminisi" else t, 1, _h=one(F.col("hole")))

        edge = tiled(now, max(r, 5), terms).filter(~F.col("hole") & (F.col("_h") > 0))
        data = F.abs(-F.coalesce("_sy", F.lit(0.0)) * F.col("nx") + F.coalesce("_sx", F.lit(0.0)) * F.col("ny")) / 255 if order == "criminisi" else F.lit(1.0)
        edge = edge.withColumn("p", F.round(F.col("term") * data, 9))
        top = edge.groupBy("image_id").agg(F.max_by(F.struct("x", "y", "term"), F.struct("p", -F.col("y"), -F.col("x"))).alias("t")).select("image_id", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), "t.term")
        inside = (F.abs(F.col("x") - F.col("tx")) <= r) & (F.abs(F.col("y") - F.col("ty")) <= r)
        t = now.filter(~F.col("hole")).join(top, "image_id").filter(inside).groupBy("image_id", "tx", "ty", "term").agg(F.array_sort(F.collect_list(F.struct((F.col("y") - F.col("ty")).alias("dy"), (F.col("x") - F.col("tx")).alias("dx"), "seen", "g"))).alias("cells"))
        t = grid.through(t, "fill-targets")  # a patch for each image

        def compare(batches):
            form = {"image_id": "int64", "cx": "int32", "cy": "int32", "d": "float64", "a": "float64", "score": "float64", "near": "bool"}
            for pdf in batches:
                for tile in pdf.itertuples(index=False):
                    yield _compared(tile, tile, r, k, neighborhood, second)[list(form)].astype(form)

        found = tiles.join(F.broadcast(t) if few else t, "image_id").mapInPandas(compare, "image_id long, cx int, cy int, d double, a double, score double, near boolean")
        match = t.select("image_id", "tx", "ty", "term").join(_chosen(found, k, second, accept, strict), "image_id")
        at = holes.join(F.broadcast(match) if few else match, "image_id", "left").withColumn("_in", F.coalesce(F.col("hole") & inside, F.lit(False)))
        fresh = at.filter("_in").select("image_id", "x", "y", "term", (F.col("x") - F.col("tx") + F.col("cx")).alias("src_x"), (F.col("y") - F.col("ty") + F.col("cy")).alias("src_y"))
        fresh = fresh.join(cells, ["image_id", "src_x", "src_y"])
        fresh = fresh.select("image_id", "x", "y", F.col("_v").alias("v"), F.col("_s").alias("seen"), F.col("_g").alias("g"), F.col("term").alias("confidence"), F.lit(False).alias("hole"), F.lit(step).alias("iter"), "src_x", "src_y")
        fresh = grid.through(fresh, "fill-step")  # a patch for each image at most
        holes = grid.through(holes.join(fresh.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_anti").unionByName(fresh), "fill-holes")
        filled = fresh.count()
        left, step = left - filled, step + 1
        if not filled:
            break
    still = base.filter(~F.col("hole")).select("image_id", "x", "y", "v", F.lit(-1).alias("iter"), F.col("x").alias("src_x"), F.col("y").alias("src_y"))
    return still.unionByName(holes.select("image_id", "x", "y", "v", "iter", "src_x", "src_y"))
