"""Neighbourhood operators over a grid with holes: derivatives, gradients, blurs, morphology, boundary terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import luminance, rotated
from .patches import boundary, box, in_tiles, line, one


@in_tiles(lambda *_, **__: 1)
def derivative(px: DataFrame, axis: str, value: str, out: str, diff=None) -> DataFrame:
    """px with the derivative along an axis: central if both neighbours are valid, one-sided if one is, 0 if none, null in holes."""
    diff = diff or (lambda a, b: a - b)
    w = line(axis)
    v = F.when(~F.col("hole"), F.col(value))
    px = px.withColumns({"_a": F.lag(v).over(w), "_b": F.lead(v).over(w)})
    a, b, m = F.col("_a"), F.col("_b"), F.col(value)
    d = F.when(a.isNotNull() & b.isNotNull(), diff(b, a) / 2).when(b.isNotNull(), diff(b, m)).when(a.isNotNull(), diff(m, a)).otherwise(F.lit(0.0))
    return px.withColumn(out, F.when(~F.col("hole"), d)).drop("_a", "_b")


@in_tiles(lambda axis, value, out, weights: max(1, len(weights) // 2))
def across(px: DataFrame, axis: str, value: str, out: str, weights: list[float]) -> DataFrame:
    """Differences as by derivative (those without any neighbour count as missing), weighted over the lines beside, the weights of those present summed if over 1."""
    px = derivative(px, axis, value, "_d")
    w = line(axis)
    some = F.lag(F.when(~F.col("hole"), 1)).over(w).isNotNull() | F.lead(F.when(~F.col("hole"), 1)).over(w).isNotNull()
    px = px.withColumn("_d", F.when(some, F.col("_d")))
    other, r = "y" if axis == "x" else "x", len(weights) // 2
    o = line(other)
    part, used = F.lit(0.0), F.lit(0.0)
    for k, weight in zip(range(-r, r + 1), weights, strict=True):
        d = F.col("_d") if k == 0 else (F.lead("_d", k).over(o) if k > 0 else F.lag("_d", -k).over(o))
        part = part + F.coalesce(d * weight, F.lit(0.0))
        used = used + F.when(d.isNotNull(), weight).otherwise(0.0)
    px = px.withColumns({"_p": part, "_u": used})
    return px.withColumn(out, F.when(~F.col("hole"), F.when(F.col("_u") > 1, F.col("_p") / F.col("_u")).otherwise(F.col("_p")))).drop("_d", "_p", "_u")


def prewitt(px: DataFrame, axis: str, value: str, out: str) -> DataFrame:
    return across(px, axis, value, out, [1.0, 1.0, 1.0])


def sobel(px: DataFrame, axis: str, value: str, out: str) -> DataFrame:
    return across(px, axis, value, out, [1.0, 2.0, 1.0])


def kernel(n: int, variance: float) -> list[float]:
    w = [math.exp(-((i - n // 2) ** 2) / (2 * variance)) for i in range(n)]
    return [x / sum(w) for x in w]


@in_tiles(lambda axis, value, out, variance=3.0, length=11, ref_quirk=False: max(1, length // 2))
def gaussian(px: DataFrame, axis: str, value: str, out: str, variance: float = 3.0, length: int = 11, ref_quirk: bool = False) -> DataFrame:
    """Differences weighted by a Gaussian across the axis. ref_quirk: a weight counts twice where it has a difference, which about halves the result."""
    px = derivative(px, axis, value, "_d")
    w = line(axis)
    some = F.lag(F.when(~F.col("hole"), 1)).over(w).isNotNull() | F.lead(F.when(~F.col("hole"), 1)).over(w).isNotNull()
    px = px.withColumn("_d", F.when(some, F.col("_d")))
    o = line("y" if axis == "x" else "x")
    part, used, r = F.lit(0.0), F.lit(0.0), length // 2
    for k, weight in zip(range(-r, r + 1), kernel(length, variance), strict=True):
        d = F.col("_d") if k == 0 else (F.lead("_d", k).over(o) if k > 0 else F.lag("_d", -k).over(o))
        part = part + F.coalesce(d * weight, F.lit(0.0))
        used = used + F.when(d.isNotNull(), 2 * weight if ref_quirk else weight).otherwise(0.0)
    px = px.withColumns({"_p": part, "_u": used})
    return px.withColumn(out, F.when(~F.col("hole"), F.when(F.col("_u") > 0, F.col("_p") / F.col("_u")).otherwise(0.0))).drop("_d", "_p", "_u")


@in_tiles(lambda *_, **__: 5)
def gradient(px: DataFrame, value: str, gx: str = "gx", gy: str = "gy") -> DataFrame:
    return gaussian(gaussian(px, "x", value, gx), "y", value, gy)


def zip_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, x, y, gx, gy) of two scalar grids (v); an error unless they are of the same size."""
    both = a.select("image_id", "x", "y", F.col("v").alias("gx"), F.lit(True).alias("_a")).join(b.select("image_id", "x", "y", F.col("v").alias("gy"), F.lit(True).alias("_b")), ["image_id", "x", "y"], "full")
    ok = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit("the grids differ in size"))
    return both.filter(F.coalesce(ok.isNull(), F.lit(True))).drop("_a", "_b")


@in_tiles(lambda *_, **__: 5)
def isophotes(px: DataFrame, channels: tuple[str, str, str] = ("c0", "c1", "c2")) -> DataFrame:
    """px with ix, iy: the luminance gradient, turned by a quarter."""
    px = gradient(px.withColumn("_l", luminance(*[F.col(c) for c in channels])), "_l", "_gx", "_gy")
    ix, iy = rotated(F.col("_gx"), F.col("_gy"))
    return px.withColumns({"ix": ix, "iy": iy}).drop("_l", "_gx", "_gy")


@in_tiles(lambda value, out, variance, radius: radius)
def convolved(px: DataFrame, value: Column, out: str, variance: float, radius: int) -> DataFrame:
    """Gaussian mean over what is not null, by two passes of windows; nulls have no weight."""
    w = [math.exp(-(k * k) / (2 * variance)) for k in range(-radius, radius + 1)]
    px = px.withColumns({"_s": F.coalesce(value, F.lit(0.0)), "_k": F.when(value.isNotNull(), 1.0).otherwise(0.0)})
    for axis in ("x", "y"):
        o = line(axis)

        def at(c: str, k: int, o=o) -> Column:
            return F.col(c) if k == 0 else F.coalesce(F.lead(c, k).over(o) if k > 0 else F.lag(c, -k).over(o), F.lit(0.0))

        sums = {c: sum((at(c, k) * w[k + radius] for k in range(-radius, radius + 1)), F.lit(0.0)) for c in ("_s", "_k")}
        px = px.withColumns(sums)
    return px.withColumn(out, F.when(F.col("_k") > 0, F.col("_s") / F.col("_k"))).drop("_s", "_k")


def masked_blur(px: DataFrame, value: str, out: str, variance: float = 2.0, radius: int = 3) -> DataFrame:
    return convolved(px, F.when(~F.col("hole"), F.col(value)), out, variance, radius)


@in_tiles(lambda variance=2.0, radius=3: radius + 1)
def boundary_normals(px: DataFrame, variance: float = 2.0, radius: int = 3) -> DataFrame:
    """px with nx, ny: the unit gradient of the blurred mask on boundary pixels, 0 elsewhere."""
    px = convolved(px, F.when(F.col("hole"), 0.0).otherwise(1.0), "_m", variance, radius)
    for axis, out in (("x", "_gx"), ("y", "_gy")):
        o = line(axis)
        px = px.withColumn(out, (F.coalesce(F.lead("_m").over(o), F.col("_m")) - F.coalesce(F.lag("_m").over(o), F.col("_m"))) / 2)
    px = box(px, 1, _h=one(F.col("hole")))
    length = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    on = ~F.col("hole") & (F.col("_h") > 0) & (length > 0)
    return px.withColumns({"nx": F.when(on, F.col("_gx") / length).otherwise(0.0), "ny": F.when(on, F.col("_gy") / length).otherwise(0.0)}).drop("_m", "_gx", "_gy", "_h")


def boundary_energy(px: DataFrame, value: str = "v") -> DataFrame:
    """(energy): mean over boundary pixels of |mean of hole neighbours - mean of valid ones|; an error if there is no boundary."""
    v, h = F.col(value), F.col("hole")
    px = box(px, 1, _hs=F.when(h, v).otherwise(0.0), _hn=one(h), _vs=F.when(~h, v).otherwise(0.0), _vn=one(~h))
    on = px.filter(~h & (F.col("_hn") > 0))
    # the pixel itself is not its own neighbour
    valid = (F.col("_vs") - v) / F.nullif(F.col("_vn") - 1, F.lit(0))
    e = on.agg(F.avg(F.abs(F.col("_hs") / F.col("_hn") - valid)).alias("energy"), F.count("*").alias("_n"))
    return e.filter(F.coalesce(F.assert_true(F.col("_n") > 0, F.lit("there is no boundary")).isNull(), F.lit(True))).drop("_n")


@in_tiles(lambda *_: 1)
def laplacian(px: DataFrame, value: str, out: str) -> DataFrame:
    """Sum over the valid ones of the four neighbours of their difference to the pixel; null in holes."""
    v = F.when(~F.col("hole"), F.col(value))
    total = F.lit(0.0)
    for axis in ("x", "y"):
        for shift in (F.lag, F.lead):
            total = total + F.coalesce(shift(v).over(line(axis)) - F.col(value), F.lit(0.0))
    return px.withColumn(out, F.when(~F.col("hole"), total))


def dilated(px: DataFrame, r: int, out: str = "dilated") -> DataFrame:
    return box(px, r, _s=one(F.col("hole"))).withColumn(out, F.col("_s") > 0).drop("_s")


def eroded(px: DataFrame, r: int, out: str = "eroded") -> DataFrame:
    return box(px, r, _s=one(~F.col("hole"))).withColumn(out, F.col("_s") == 0).drop("_s")


def rind(px: DataFrame, r: int, out: str = "rind") -> DataFrame:
    """The band of width r around the holes."""
    return dilated(px, r, "_d").withColumn(out, F.col("_d") & ~F.col("hole")).drop("_d")


def across_hole(px: DataFrame, starts: DataFrame, reach: int) -> DataFrame:
    """(image_id, x, y, ox, oy): for starts (image_id, x, y, ix, iy), a valid pixel's first valid one beyond a hole, in the direction of (ix, iy) or else against it."""
    ray = starts.select("image_id", "x", "y", "ix", "iy", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    length = F.sqrt(F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy"))
    step = lambda a, c: F.round(F.col(a) + F.col("sign") * F.col("k") * F.col(c) / length).cast("int")
    ray = ray.filter(length > 0).withColumns({"px": step("x", "ix"), "py": step("y", "iy")})
    seen = ray.join(px.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), "hole"), ["image_id", "px", "py"])
    w = Window.partitionBy("image_id", "x", "y", "sign").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    out = seen.withColumn("crossed", F.max("hole").over(w)).filter(~F.col("hole") & F.col("crossed"))
    return out.groupBy("image_id", "x", "y").agg(F.min_by(F.struct("px", "py"), F.struct("k", -F.col("sign"))).alias("o")).select("image_id", "x", "y", F.col("o.px").alias("ox"), F.col("o.py").alias("oy"))


def gradient_change(px: DataFrame, painted: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, x, y, change): squared norm of the difference of gradients before and after painting."""
    a = gradient(px, value).select("image_id", "x", "y", F.coalesce("gx", F.lit(0.0)).alias("ax"), F.coalesce("gy", F.lit(0.0)).alias("ay"))
    b = gradient(painted, value).select("image_id", "x", "y", F.coalesce("gx", F.lit(0.0)).alias("bx"), F.coalesce("gy", F.lit(0.0)).alias("by"))
    d = a.join(b, ["image_id", "x", "y"])
    fold = lambda x, y: (F.when(F.col(x) < 0, -F.col(y)).otherwise(F.col(y)))
    dx, dy = F.abs(F.col("ax")) - F.abs(F.col("bx")), fold("ax", "ay") - fold("bx", "by")
    return d.select("image_id", "x", "y", (dx * dx + dy * dy).alias("change"))


def mask_boundary_energy(px: DataFrame, painted: DataFrame, value: str = "v") -> DataFrame:
    """(energy): mean change of the gradient on the mask's boundary; 0 if there is none."""
    return gradient_change(px, painted, value).join(boundary(px).select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("energy"))


def patch_boundary_energy(px: DataFrame, painted: DataFrame, tx: int, ty: int, r: int, value: str = "v") -> DataFrame:
    """(energy): the same on the valid pixels of the patch's rim."""
    rim = (F.greatest(F.abs(F.col("x") - tx), F.abs(F.col("y") - ty)) == r) & ~F.col("hole")
    return gradient_change(px, painted, value).join(px.filter(rim).select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("energy"))
