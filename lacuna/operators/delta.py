"""What one paint changes, and nothing else.

A paint touches the target's patch, and the priorities of nodes that can see it. So the patch's rows are made anew from two patches, the windows of a priority run over a square about the target alone, whatever the size of
the grid, and both are merged into what was there. The result equals the computation over the whole grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import grid
from . import patches, priority


def about(tx: int, ty: int, r: int) -> Column:
    return F.col("x").between(tx - r, tx + r) & F.col("y").between(ty - r, ty + r)


def patch_after(px: DataFrame, tx: int, ty: int, sx: int, sy: int, r: int) -> DataFrame:
    """The target's patch after the paint, of px's columns (confidence included) and src_x, src_y: hole pixels have the source's values and the target's confidence, and are holes no more. Two patches are read."""
    two = px.filter(about(tx, ty, r) | about(sx, sy, r))
    known = priority.update_confidence(two, tx, ty, r).select("image_id", "x", "y", F.col("confidence").alias("_c"))
    made = patches.paint(two.drop("confidence"), tx, ty, sx, sy, r).join(known, ["image_id", "x", "y"]).withColumnRenamed("_c", "confidence")
    return made.filter(about(tx, ty, r))


def merged(px: DataFrame, rows: DataFrame, tx: int, ty: int, r: int) -> DataFrame:
    """px with the rows in place of the patch: a filter and a union, no join of the grid."""
    return px.filter(~about(tx, ty, r)).unionByName(rows.select(px.columns))


def queue_after(queue: DataFrame, after: DataFrame, tx: int, ty: int, r: int, reach: int, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The queue of the grid `after` the paint: nodes within `reach` of the patch by rank() over a square about it, all others as they were. reach: how far from a node its priority looks."""
    near = about(tx, ty, r + reach)
    return queue.filter(~near).unionByName(rank(after.filter(about(tx, ty, r + 2 * reach + 1))).filter(near))


def effects(px: DataFrame, queue: DataFrame, tx: int, ty: int, sx: int, sy: int, r: int, reach: int, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(image_id, effect, x, y, v, src_x, src_y, confidence, priority): all that a paint changes: the source patch is `used`; hole pixels are `filled`, with value, origin and confidence; centres whose patches have no hole any more are new `source`s;
    nodes are `queued` with a priority that is new or not what it was, to nine digits; and `dropped` where no hole is near any more. px has confidence; a target without holes changes nothing but what is used."""
    blank = {"v": "double", "src_x": "int", "src_y": "int", "confidence": "double", "priority": "double"}

    def row(df: DataFrame, effect: str, **have) -> DataFrame:
        return df.select("image_id", F.lit(effect).alias("effect"), "x", "y", *[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()])

    made = grid.through(patch_after(px, tx, ty, sx, sy, r), "patch")  # a patch's rows
    after = merged(px, made, tx, ty, r)
    was_hole = px.filter("hole").filter(about(tx, ty, r)).select("image_id", "x", "y")
    filled = made.filter(~F.col("hole")).join(was_hole, ["image_id", "x", "y"], "left_semi")
    wide = about(tx, ty, 3 * r + 1)  # patches that the target's patch meets, whole
    centres = patches.sources(after.filter(wide), r).join(patches.sources(px.filter(wide), r), ["image_id", "cx", "cy"], "left_anti").withColumnsRenamed({"cx": "x", "cy": "y"})
    near = about(tx, ty, r + reach)
    old = queue.filter(near).select("image_id", "x", "y", F.col("priority").alias("_p"))
    new = queue_after(queue, after, tx, ty, r, reach, rank).filter(near).select("image_id", "x", "y", "priority")
    both = grid.through(new.join(old, ["image_id", "x", "y"], "full"), "queue")  # nodes about the target
    queued = both.filter(F.col("priority").isNotNull() & (F.col("_p").isNull() | (F.round("_p", 9) != F.round("priority", 9))))
    used = px.filter((F.col("x") == sx) & (F.col("y") == sy)).select("image_id", "x", "y")
    out = row(used, "used").unionByName(row(filled, "filled", **{c: F.col(c) for c in ("v", "src_x", "src_y", "confidence")}))
    return out.unionByName(row(centres, "source")).unionByName(row(queued, "queued", priority=F.col("priority"))).unionByName(row(both.filter(F.col("priority").isNull()), "dropped"))
