"""Fill priorities of boundary pixels, and the queue as a table (image_id, x, y, priority, valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows
from .patches import boundary, box, one, tiled


def with_confidence(px: DataFrame) -> DataFrame:
    return px.withColumn("confidence", F.when(F.col("hole"), 0.0).otherwise(1.0))


def confidence(px: DataFrame, r: int) -> DataFrame:
    """px with term: the sum of the valid pixels' confidence over the number of pixels of the (cropped) patch."""
    px = px if "confidence" in px.columns else with_confidence(px)
    px = box(px, r, _c=F.when(~F.col("hole"), F.col("confidence")).otherwise(0.0), _n=F.lit(1))
    return px.withColumn("term", F.col("_c") / F.col("_n")).drop("_c", "_n")


def _of_boundary(px: DataFrame, priority: Column, reach: int = 1, f=lambda t: t) -> DataFrame:
    """(image_id, x, y, priority, valid) of boundary pixels, from columns that f adds, which looks no farther than `reach`: one pass over tiles."""
    on = tiled(px, max(1, reach), lambda t: box(f(t), 1, _h=one(F.col("hole")))).filter(~F.col("hole") & (F.col("_h") > 0))
    return on.select("image_id", "x", "y", priority.alias("priority"), F.lit(True).alias("valid"))


def initial_queue(px: DataFrame, r: int) -> DataFrame:
    return _of_boundary(px, F.col("term"), r, lambda t: confidence(t, r))


def update_confidence(px: DataFrame, tx: int, ty: int, r: int) -> DataFrame:
    """The target's term goes to the pixels of its patch whose confidence is exactly 0."""
    near = px.filter(F.col("x").between(tx - r, tx + r) & F.col("y").between(ty - r, ty + r))
    c = near.groupBy("image_id").agg((F.sum(F.when(~F.col("hole"), F.col("confidence")).otherwise(0.0)) / F.count("*")).alias("_t"))
    inside = F.col("x").between(tx - r, tx + r) & F.col("y").between(ty - r, ty + r)
    return px.join(F.broadcast(c), "image_id", "left").withColumn("confidence", F.when(inside & (F.col("confidence") == 0), F.col("_t")).otherwise(F.col("confidence"))).drop("_t")


def _by_terms(px: DataFrame, r: int, priority: Column) -> DataFrame:
    """Confidence, isophotes and normals: each looks at the grid itself, not at what another made, so their reaches do not add up."""
    return _of_boundary(px, priority, max(r, 5), lambda t: windows.boundary_normals(windows.isophotes(confidence(t, r))))


def criminisi(px: DataFrame, r: int) -> DataFrame:
    """Confidence times |isophote · normal| / 255."""
    data = F.abs(F.coalesce("ix", F.lit(0.0)) * F.col("nx") + F.coalesce("iy", F.lit(0.0)) * F.col("ny")) / 255.0
    return _by_terms(px, r, F.col("term") * data)


def improved(px: DataFrame, r: int) -> DataFrame:
    """The isophote's norm, times the cosine of its angle to the normal where that is under 20 degrees."""
    length = F.sqrt(F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy"))
    cos = F.when(length > 0, (F.col("ix") * F.col("nx") + F.col("iy") * F.col("ny")) / length).otherwise(0.0)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))
    return _by_terms(px, r, F.when(F.degrees(angle) < 20, length * cos).otherwise(length))


def from_column(px: DataFrame, value: str) -> DataFrame:
    return boundary(px).select("image_id", "x", "y", F.col(value).alias("priority"), F.lit(True).alias("valid"))


def depth(px: DataFrame, value: str, reach: int, radius: int = 2, space: float = 10.0, tone: float = 10.0) -> DataFrame:
    """|isophote · isophote across the hole| of the smoothed depth; 0 where nothing is seen across. The smoothing is bilateral: pixels about one weigh by
    distance and by difference of depth."""
    off = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    sent = px.filter(~F.col("hole")).select("image_id", "x", "y", F.col(value).alias("_v")).withColumn("_dx", off).withColumn("_dy", off)
    sent = sent.select("image_id", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), "_v", (F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).alias("_s"))
    got = px.join(sent, ["image_id", "x", "y"])
    w = F.exp(-F.col("_s") / (2 * space * space) - (F.col("_v") - F.col(value)) * (F.col("_v") - F.col(value)) / (2 * tone * tone))
    smooth = got.groupBy("image_id", "x", "y", "hole").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("_z"))
    g = windows.gradient(smooth, "_z").withColumns({"ix": -F.col("gy"), "iy": F.col("gx")})
    on = boundary(g).select("image_id", "x", "y", "ix", "iy")
    over = windows.across_hole(px, on, reach)
    far = g.select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("ix").alias("jx"), F.col("iy").alias("jy"))
    met = on.join(over, ["image_id", "x", "y"], "left").join(far, ["image_id", "ox", "oy"], "left")
    return met.select("image_id", "x", "y", F.coalesce(F.abs(F.col("ix") * F.col("jx") + F.col("iy") * F.col("jy")), F.lit(0.0)).alias("priority"), F.lit(True).alias("valid"))


def manual(queue: DataFrame, chosen: Column, bonus: float = 1e4) -> DataFrame:
    return queue.withColumn("priority", F.col("priority") + F.when(chosen, bonus).otherwise(0.0))


def random(px: DataFrame, seed: int) -> DataFrame:
    """A number of 0 to 1 from a hash of the position and the seed."""
    return _of_boundary(px, F.conv(F.substring(F.md5(F.concat_ws(",", "x", "y", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32))


def push_or_update(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: new priorities win, and make their nodes valid."""
    both = queue.select("image_id", "x", "y", "priority", "valid", F.lit(0).alias("_o")).unionByName(new.select("image_id", "x", "y", "priority", F.lit(True).alias("valid"), F.lit(1).alias("_o")))
    return both.groupBy("image_id", "x", "y").agg(F.max_by(F.struct("priority", "valid"), "_o").alias("b")).select("image_id", "x", "y", "b.priority", "b.valid")


def invalidate(queue: DataFrame, which: Column) -> DataFrame:
    return queue.withColumn("valid", F.col("valid") & ~which)


def top(queue: DataFrame) -> DataFrame:
    """Each image's valid node of the highest priority; ties go to the smaller y, then x."""
    return queue.filter("valid").groupBy("image_id").agg(F.max_by(F.struct("x", "y", "priority"), F.struct("priority", -F.col("y"), -F.col("x"))).alias("b")).select("image_id", "b.*")


def dump(queue: DataFrame) -> DataFrame:
    return queue.filter("valid").orderBy(F.desc("priority"), "y", "x")
