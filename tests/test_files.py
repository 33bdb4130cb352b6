"""Image and mask files, written here byte by byte."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lacuna.operators import loop
from lacuna.sources import grid


def png(path, rows):
    """rows: [y][x] of (r, g, b), or of gray levels."""
    gray = isinstance(rows[0][0], int)
    raw = b"".join(b"\0" + bytes(row if gray else [c for p in row for c in p]) for row in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0 if gray else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    rows = [[(x * 10, y * 20, 255 - x) for x in range(7)] for y in range(5)]
    png(tmp_path / "a.png", rows)
    png(tmp_path / "b.png", [[x + y for x in range(3)] for y in range(2)])
    got = grid.image_files(spark, str(tmp_path / "a.png")).collect()
    assert {(r["x"], r["y"]): (r["c2"], r["c1"], r["c0"]) for r in got} == {(x, y): tuple(map(float, rows[y][x])) for y in range(5) for x in range(7)}
    both = grid.image_files(spark, str(tmp_path / "*.png"))
    assert both.count() == 41 and both.select("image_id").distinct().count() == 2
    gray = grid.image_files(spark, str(tmp_path / "b.png")).collect()
    assert all(r["c0"] == r["c1"] == r["c2"] == r["x"] + r["y"] for r in gray)


def test_mask_files_and_a_fill(spark, tmp_path):
    rows = [[(x * 30 + y) % 200 for x in range(8)] for y in range(16)]
    hole = [[3 <= x <= 4 and 4 <= y <= 5 for x in range(8)] for y in range(16)]
    png(tmp_path / "image.png", rows)
    png(tmp_path / "m.png", [[0 if h else 255 for h in line] for line in hole])
    (tmp_path / "a.mask").write_text("0 255 m.png\n")
    mask = grid.mask_files(spark, str(tmp_path / "a.mask"))
    assert {(r["x"], r["y"]) for r in mask.filter("hole").collect()} == {(x, y) for y in range(16) for x in range(8) if hole[y][x]}
    px = grid.image_files(spark, str(tmp_path / "image.png")).select("image_id", "x", "y", F.col("c0").alias("v")).join(mask.drop("image_id"), ["x", "y"])
    out = grid.through(loop.inpaint(px, 1), "filled")
    assert out.count() == 128 and out.filter("iter >= 0").count() == 4
    (tmp_path / "b.mask").write_text("0 254 m.png\n")
    with pytest.raises(Exception, match="neither hole nor valid"):
        grid.mask_files(spark, str(tmp_path / "b.mask")).collect()


def test_iterations_are_folders(spark, tmp_path):
    px = spark.range(12).select(F.lit(0).alias("image_id"), F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(1.0).alias("v"), (F.col("id") % 3).alias("iter"))
    grid.write_grid(px, str(tmp_path / "out"), "iter")
    assert sorted(p.name for p in (tmp_path / "out").glob("iter=*")) == ["iter=0", "iter=1", "iter=2"]
    assert spark.read.parquet(str(tmp_path / "out")).filter("iter = 1").count() == 4
