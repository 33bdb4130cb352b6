"""Patches: regions, status, offsets, differences between patches, and painting."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.pixel import total


#: Pixels along a tile's side.
SIDE = 128


def tiled(px: DataFrame, reach: int, f: Callable[[DataFrame], DataFrame], side: int = SIDE) -> DataFrame:
    """f(px), computed in tiles of side by side pixels (_i, _j): each pixel goes to its own tile and, as halo, to those within `reach` of it, and what f makes of halos is dropped. So a task has some
    (side + 2 reach)² pixels, however long a line or a column is, and pixels move once for all windows of f, which see the columns _i and _j. Within f further calls add no tiles: the outermost reach
    has to cover what they look at together. A pixel without a position is in no tile and is dropped; an empty grid stays empty."""
    if "_i" in px.columns:
        return f(px)
    # one key for a tile: the windows' keys hold it, also where an image's number is a constant that the optimizer leaves out
    dealt = dealt_in_tiles(px, reach, side).withColumn("_t", F.xxhash64("image_id", "_i", "_j")).repartition("_t")
    return f(dealt).filter("_own").drop("_i", "_j", "_own", "_t")


def dealt_in_tiles(px: DataFrame, reach: int, side: int = SIDE) -> DataFrame:
    """px with _i, _j and _own: a row for a pixel's own tile, and for each other one within `reach`."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    px = px.withColumn("_i", near("x")).withColumn("_j", near("y"))
    return px.withColumn("_own", (F.floor(F.col("x") / side) == F.col("_i")) & (F.floor(F.col("y") / side) == F.col("_j")))


def line(axis: str) -> WindowSpec:
    """A tile's pixels along an axis."""
    return Window.partitionBy("_t", "image_id", "_i", "_j", "y" if axis == "x" else "x").orderBy(axis)


def in_tiles(reach):
    """Makes f(px, ...) run in tiles; reach: of f's other arguments."""

    def wrap(f):
        @functools.wraps(f)
        def run(px: DataFrame, *a, **k) -> DataFrame:
            return tiled(px, reach(*a, **k), lambda t: f(t, *a, **k))

        return run

    return wrap


@in_tiles(lambda r, **_: r)
def box(px: DataFrame, r: int, **sums: Column) -> DataFrame:
    """px with the sums of expressions over the (2r+1)² pixels about each one, as far as there are any: two passes of one-dimensional windows in tiles."""
    px = px.withColumns({f"_{k}": F.sum(e).over(line("x").rangeBetween(-r, r)) for k, e in sums.items()})
    return px.withColumns({k: F.sum(f"_{k}").over(line("y").rangeBetween(-r, r)) for k in sums}).drop(*[f"_{k}" for k in sums])


def one(c: Column) -> Column:
    return c.cast("int")


def with_status(px: DataFrame, r: int, invalid: Column | None = None) -> DataFrame:
    """px with inside, fully_valid and status of the patch about each pixel: SOURCE_NODE if inside the image and without holes, else TARGET_NODE if it has a
    valid pixel, else INVALID."""
    px = box(px, r, _n=F.lit(1), _h=one(F.col("hole")))
    inside, valid = F.col("_n") == (2 * r + 1) ** 2, F.col("_h") == 0
    status = F.when(inside & valid, "SOURCE_NODE").when(F.col("_h") < F.col("_n"), "TARGET_NODE").otherwise("INVALID")
    return px.withColumns({"inside": inside, "fully_valid": valid, "status": status}).drop("_n", "_h")


def sources(px: DataFrame, r: int) -> DataFrame:
    """(image_id, cx, cy): centres of source patches."""
    return with_status(px, r).filter("status = 'SOURCE_NODE'").select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"))


def boundary(px: DataFrame) -> DataFrame:
    """Valid pixels with a hole among their eight neighbours."""
    return box(px, 1, _h=one(F.col("hole"))).filter(~F.col("hole") & (F.col("_h") > 0)).drop("_h")


def patch(px: DataFrame, tx: int, ty: int, r: int) -> DataFrame:
    """The pixels of a target patch, with dx and dy; cropped at the image's edge."""
    return px.filter(F.col("x").between(tx - r, tx + r) & F.col("y").between(ty - r, ty + r)).withColumns({"dx": F.col("x") - tx, "dy": F.col("y") - ty})


def values(px: DataFrame) -> list[str]:
    return [c for c in px.columns if c not in ("image_id", "x", "y", "hole")]


def differences(px: DataFrame, target: DataFrame, r: int, diff: Column, only: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, cx, cy, d, n), and the columns `by` that tell several targets apart: mean of `diff` between each source patch and the target's pixels (dx, dy, t_<value>) at their offsets; targets with an image_id meet their own image alone.

    A pixel meets each offset of the target once (the target has (2r+1)² rows at most and is broadcast) and adds to the centre that lies so
    far from it: one aggregation with partial sums, and no join of the grid with itself. `only` restricts the centres."""
    met = px.join(F.broadcast(target), ["image_id"] if "image_id" in target.columns else None).select("image_id", *by, (F.col("x") - F.col("dx")).alias("cx"), (F.col("y") - F.col("dy")).alias("cy"), diff.alias("e"))
    keep = sources(px, r) if only is None else only
    return met.groupBy("image_id", *by, "cx", "cy").agg(F.avg("e").alias("d"), F.count("*").alias("n")).join(keep, ["image_id", "cx", "cy"], "left_semi")


def target_values(px: DataFrame, tx: int, ty: int, r: int, valid: bool = True) -> DataFrame:
    p = patch(px, tx, ty, r)
    p = p.filter(~F.col("hole")) if valid else p
    return p.select("image_id", "dx", "dy", *[F.col(c).alias(f"t_{c}") for c in values(px)])


def ssd(names: list[str]) -> Column:
    return sum(((F.col(c) - F.col(f"t_{c}")) * (F.col(c) - F.col(f"t_{c}")) for c in names), F.lit(0.0))


def sad(names: list[str]) -> Column:
    return sum((F.abs(F.col(c) - F.col(f"t_{c}")) for c in names), F.lit(0.0))


def vectorised(px: DataFrame, r: int, value: str = "v") -> DataFrame:
    """(image_id, cx, cy, pixels): each source patch's values as one array, by line and column. Lines of 2r+1 values and then 2r+1 such lines are gathered by windows in tiles, beside the counts that tell source patches: pixels move
    once, and no row is made for each pixel of each patch."""
    near = lambda axis: line(axis).rangeBetween(-r, r)

    def gathered(t: DataFrame) -> DataFrame:
        t = t.withColumns({"_n": F.count("*").over(near("x")), "_h": F.sum(one(F.col("hole"))).over(near("x")), "_l": F.collect_list(F.struct(F.col(value).alias("v"))).over(near("x"))})
        t = t.withColumn("_l", F.transform("_l", lambda s: s["v"]))
        t = t.withColumns({"_n": F.sum("_n").over(near("y")), "_h": F.sum("_h").over(near("y")), "pixels": F.collect_list("_l").over(near("y"))})
        return t.filter((F.col("_n") == (2 * r + 1) ** 2) & (F.col("_h") == 0))

    got = tiled(px.select("image_id", "x", "y", value, "hole"), r, gathered)
    return got.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.flatten("pixels").alias("pixels"))


def correspondence(px: DataFrame, cands: DataFrame, tx: int, ty: int, r: int) -> DataFrame:
    """Target and candidates' pixels side by side: image_id, cx, cy, dx, dy, thole, t_<value>, s_<value>; cands (cx, cy, and image_id unless they
    are sought in each image) are few, and only offsets that both patches have remain."""
    t = patch(px, tx, ty, r).select("image_id", "dx", "dy", F.col("hole").alias("thole"), *[F.col(c).alias(f"t_{c}") for c in values(px)])
    of = [c for c in cands.columns if c == "image_id"]
    at = cands.select(*of, "cx", "cy").join(F.broadcast(t), of or None).withColumns({"x": F.col("cx") + F.col("dx"), "y": F.col("cy") + F.col("dy")})
    return px.select("image_id", "x", "y", F.col("hole").alias("shole"), *[F.col(c).alias(f"s_{c}") for c in values(px)]).join(F.broadcast(at), ["image_id", "x", "y"])


def paint(px: DataFrame, tx: int, ty: int, sx: int, sy: int, r: int) -> DataFrame:
    """px with the target patch's hole pixels taken from the source patch at the same offsets, no longer holes, and (src_x, src_y) of
    where each came from."""
    at = patch(px, sx, sy, r).select("image_id", (F.col("dx") + tx).alias("x"), (F.col("dy") + ty).alias("y"), *[F.col(c).alias(f"_n_{c}") for c in values(px) if not c.startswith("src_")], F.lit(True).alias("_in"))
    out = px.join(F.broadcast(at), ["image_id", "x", "y"], "left")
    fill = F.col("hole") & F.col("_in").isNotNull()
    moved = {c: F.when(fill, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in values(px) if not c.startswith("src_")}
    sx_, sy_ = F.col("x") - tx + sx, F.col("y") - ty + sy
    before = ("src_x", "src_y") if "src_x" in px.columns else (None, None)
    was = (lambda c, o: F.col(c)) if before[0] else (lambda c, o: F.when(F.col("hole"), -1).otherwise(F.col(o)))
    moved |= {"src_x": F.when(fill, sx_).otherwise(was("src_x", "x")).cast("int"), "src_y": F.when(fill, sy_).otherwise(was("src_y", "y")).cast("int")}
    return out.withColumns(moved | {"hole": F.col("hole") & ~fill}).drop("_in", *[c for c in out.columns if c.startswith("_n_")])


def mean_of(a: Column) -> Column:
    return total(a) / F.size(a)
