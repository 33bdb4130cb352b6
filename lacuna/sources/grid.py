"""Scans: grids of pixels from array tables, images, masks and match logs.

A grid is a DataFrame (image_id, x, y, value columns, hole). A table of arrays is a grid with a row of pixels per record.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def scalar_grid(rows: DataFrame, y: str = "vec_id", values: str = "embedding", hole: Column | None = None) -> DataFrame:
    """(image_id, x, y, v, hole): pixel x of line y is component x of its array."""
    px = rows.select(F.lit(0).cast("long").alias("image_id"), F.col(y).cast("int").alias("y"), F.posexplode(values).alias("x", "v"))
    return px.select("image_id", "x", "y", F.col("v").cast("double").alias("v"), (F.lit(False) if hole is None else hole).alias("hole"))


def channel_grid(rows: DataFrame, channels: int = 3, y: str = "vec_id", values: str = "embedding", hole: Column | None = None) -> DataFrame:
    """(image_id, x, y, c0.., hole): pixel x has the components channels * x and on; components left over at a line's end are not used."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.size(values) / channels).cast("int") - 1))
    px = rows.select(F.lit(0).cast("long").alias("image_id"), F.col(y).cast("int").alias("y"), F.col(values).alias("a"), at.alias("x"))
    cs = [F.get("a", F.col("x") * channels + i).cast("double").alias(f"c{i}") for i in range(channels)]
    return px.select("image_id", "x", "y", *cs, (F.lit(False) if hole is None else hole).alias("hole"))


def rect(x0: int, x1: int, y0: int, y1: int) -> Column:
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


#: The mask of the scalar grid and of the three-channel grid.
M1, M3 = (20, 29, 100, 119), (8, 11, 100, 109)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_grid(embeddings(spark, sf_dir), hole=rect(*M1))


def pixels3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_grid(embeddings(spark, sf_dir), hole=rect(*M3))


def image_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, x, y, c0, c1, c2) of image files, by Spark's image source; image_id is a hash of the file's name. Channels come in the file's order (BGR)."""
    img = spark.read.format("image").load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.width", "image.height", "image.nChannels", F.col("image.data").alias("d"))
    px = img.select("*", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("d", F.col("i") * F.col("nChannels") + F.least(F.lit(k), F.col("nChannels") - 1) + 1, 1)), 16, 10).cast("double")
    return px.select("image_id", F.expr("i % width").cast("int").alias("x"), F.expr("i div width").cast("int").alias("y"), *[byte(k).alias(f"c{k}") for k in range(3)])


def mask_files(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(image_id, x, y, hole) of the mask files under path: each has one line `hole valid file`, and the image of that name in `folder` (the masks' own, if none) says by its levels which
    pixels are holes. image_id is that of the mask image's file; levels that are neither value are an error."""
    header = mask_header(spark.read.text(path)).withColumn("file", F.concat(F.lit((folder or path.rsplit("/", 1)[0]) + "/"), "file"))
    images = [r["file"] for r in header.select("file").distinct().collect()]  # names of files, which must be listed to be read
    level = image_files(spark, images).select("image_id", "x", "y", F.col("c0").cast("int").alias("level"))
    names = spark.read.format("image").load(images).select(F.xxhash64("image.origin").alias("image_id"), F.element_at(F.split("image.origin", "/"), -1).alias("name"))
    header = header.withColumn("name", F.element_at(F.split("file", "/"), -1)).drop("file")
    got = level.join(names, "image_id").join(header, "name")
    sound = F.assert_true(F.col("level").isin(F.col("hole_value"), F.col("valid_value")), F.lit("a level of the mask is neither hole nor valid"))
    return got.filter(F.coalesce(sound.isNull(), F.lit(True))).select("image_id", "x", "y", (F.col("level") == F.col("hole_value")).alias("hole"))


def mask_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """(hole_value, valid_value, file) of mask files' header lines: `hole valid file`."""
    parts = F.split(F.trim(value), r"\s+")
    return lines.filter(F.trim(value) != "").select(parts[0].cast("int").alias("hole_value"), parts[1].cast("int").alias("valid_value"), parts[2].alias("file"))


def apply_mask(px: DataFrame, levels: DataFrame, header: DataFrame) -> DataFrame:
    """px with hole: where the mask image `levels` (x, y, level) has the header's hole value."""
    of = [c for c in levels.columns if c == "image_id"]  # else one mask is meant for all images
    return px.drop("hole").join(levels.join(F.broadcast(header.limit(1))).select(*of, "x", "y", (F.col("level") == F.col("hole_value")).alias("hole")), [*of, "x", "y"])


def match_log(lines: DataFrame, order: str, value: str = "value", source_first: bool = True) -> DataFrame:
    """(iter, sx, sy, tx, ty) of lines `a b : c d` in the order of column `order`; the pair before the colon is the source, or the target."""
    n = F.regexp_extract_all(F.col(value), F.lit(r"(-?\d+)"), F.lit(1))
    a, b = ("s", "t") if source_first else ("t", "s")
    return lines.select(F.col(order).alias("iter"), *[n[i].cast("int").alias(c) for i, c in enumerate((f"{a}x", f"{a}y", f"{b}x", f"{b}y"))])


def match_lines(matches: DataFrame) -> DataFrame:
    """The log's text: `sx sy : tx ty`."""
    return matches.select("iter", F.concat_ws(" ", "sx", "sy", F.lit(":"), "tx", "ty").alias("value"))


def write_log(matches: DataFrame, path: str) -> None:
    match_lines(matches).orderBy("iter").select("value").write.mode("overwrite").text(path)


def write_grid(px: DataFrame, path: str, by: str | None = None) -> None:
    """The grid as Parquet, in one folder or one for each value of `by` (an iteration, an image)."""
    out = px.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, named in spark.checkpoint.dir; where none is named, a temporary one serves on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lacuna-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def through(px: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """px written by write_grid and read again: the sink's content, in the shared folder."""
    spark = px.sparkSession
    path = shared_path(spark, label)
    write_grid(px, path, by)
    return spark.read.parquet(path)
