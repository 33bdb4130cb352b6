"""XML structured grids (.vts) with raw appended data, as a Spark data source: a row for each point of the grid, with one of its named arrays.

The header, which ends where the appended bytes begin, is read by the driver; a slice of points is a partition that seeks to its own tuples. Writing puts each task's tuples at their places in a file of the full size. The path is a file that
driver and executors share. Arrays in text or base64, compressed ones and grids of several pieces are an error.

    spark.dataSource.register(vts.StructuredGrid)
    spark.read.format("vts").option("array", "embedding").load(path)                     # i, j, k, value: array<double>
    points.write.format("vts").options(array="embedding", components=64, nx=1, ny=500).mode("overwrite").save(path)
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from .mha import SLICE, Done, Lines

#: Element types of the format and what they are in numpy. Fixed values.
TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}
#: A header is shorter than this.
HEADER = 1 << 20


class Header:
    def __init__(self, path: str, array: str):
        with open(path, "rb") as f:
            head = f.read(HEADER)
        at = head.find(b"<AppendedData")
        begin = head.find(b"_", head.find(b">", at))
        if at < 0 or b'encoding="raw"' not in head[at:begin]:
            raise ValueError(f"{path}: not a structured grid with raw appended data")
        root = ET.fromstring(head[:at].decode("utf-8") + "</VTKFile>")
        pieces = root.findall("./StructuredGrid/Piece")
        if root.get("type") != "StructuredGrid" or len(pieces) != 1 or root.get("compressor"):
            raise ValueError(f"{path}: not one uncompressed piece of a structured grid")
        x0, x1, y0, y1, z0, z1 = (int(v) for v in pieces[0].get("Extent").split())
        self.origin, self.shape = (x0, y0, z0), (x1 - x0 + 1, y1 - y0 + 1, z1 - z0 + 1)
        found = [a for a in pieces[0].findall("./PointData/DataArray") + pieces[0].findall("./Points/DataArray") if a.get("Name") == array]
        if not found or found[0].get("format") != "appended":
            raise ValueError(f"{path}: no appended array named {array}")
        order = ">" if root.get("byte_order") == "BigEndian" else "<"
        self.components, self.type = int(found[0].get("NumberOfComponents", 1)), np.dtype(order + TYPES[found[0].get("type")])
        # a block begins with its size
        self.start = begin + 1 + int(found[0].get("offset")) + np.dtype(TYPES[root.get("header_type", "UInt32")]).itemsize
        self.points, self.tuple = int(np.prod(self.shape, dtype=np.int64)), self.components * self.type.itemsize


class Reader(DataSourceReader):
    def __init__(self, path: str, array: str, size: int):
        self.path, self.array, self.size = path, array, size

    def partitions(self):
        h = Header(self.path, self.array)
        step = max(1, self.size // h.tuple)
        return [Lines(a, min(h.points, a + step)) for a in range(0, h.points, step)] or [Lines(0, 0)]

    def read(self, partition):
        h = Header(self.path, self.array)
        n = partition.last - partition.first
        with open(self.path, "rb") as f:
            f.seek(h.start + partition.first * h.tuple)
            data = f.read(n * h.tuple)
        if len(data) < n * h.tuple:
            raise ValueError(f"{self.path} ends within point {partition.first + len(data) // h.tuple}")
        p = np.arange(partition.first, partition.last)
        k, rest = np.divmod(p, max(1, h.shape[0] * h.shape[1]))
        j, i = np.divmod(rest, max(1, h.shape[0]))
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.components), pa.array(np.frombuffer(data, h.type).astype(np.float64)))
        yield pa.RecordBatch.from_arrays([*[pa.array((a + o).astype(np.int32)) for a, o in zip((i, j, k), h.origin, strict=True)], values], names=["i", "j", "k", "value"])


class Writer(DataSourceWriter):
    """Points (i, j, k, value) into a file; an error where one lies outside, its value has another length, or the file would not have each point once. Positions are the points' numbers."""

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.shape = path, tuple(int(options.get(n, 1)) for n in ("nx", "ny", "nz"))
        kind, self.components, self.type = options.get("type", "Float64"), int(options["components"]), np.dtype("<" + TYPES[options.get("type", "Float64")])
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        n = int(np.prod(self.shape, dtype=np.int64))
        extent = " ".join(f"0 {s - 1}" for s in self.shape)
        size = n * self.components * self.type.itemsize
        name = options["array"].replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
        head = f"""<?xml version="1.0"?>
<VTKFile type="StructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">
<StructuredGrid WholeExtent="{extent}"><Piece Extent="{extent}">
<PointData><DataArray type="{kind}" Name="{name}" NumberOfComponents="{self.components}" format="appended" offset="0"/></PointData>
<Points><DataArray type="Float32" Name="Points" NumberOfComponents="3" format="appended" offset="{8 + size}"/></Points>
</Piece></StructuredGrid>
<AppendedData encoding="raw">_""".encode()
        tail = b"\n</AppendedData></VTKFile>\n"
        self.part, self.start = f"{path}.part", len(head) + 8
        self.places = self.start + size + 8
        with open(self.part, "wb") as f:
            f.write(head + np.uint64(size).tobytes())
            f.seek(self.start + size)
            f.write(np.uint64(n * 12).tobytes())
            f.seek(self.places + n * 12)
            f.write(tail)
        self.points = n

    def write(self, rows):
        n, wait, (nx, ny, nz) = 0, [], self.shape

        def flush(fd: int) -> None:
            at = np.array([(r[2] * ny + r[1]) * nx + r[0] for r in wait], np.int64)
            values = np.array([r[3] for r in wait], np.float64).astype(self.type).reshape(len(wait), self.components)
            place = np.array([tuple(r)[:3] for r in wait], "<f4")
            order = np.argsort(at, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(at[order]) != 1) + 1):  # neighbours in one piece
                first = int(at[run[0]])
                os.pwrite(fd, values[run].tobytes(), self.start + first * self.components * self.type.itemsize)
                os.pwrite(fd, place[run].tobytes(), self.places + first * 12)
            wait.clear()

        fd = os.open(self.part, os.O_WRONLY)
        try:
            for r in rows:
                if not all(0 <= r[a] < s for a, s in enumerate(self.shape)) or len(r[3]) != self.components:
                    raise ValueError(f"point {tuple(r)[:3]} lies outside of {self.shape} or has not {self.components} components")
                wait.append(r)
                n += 1
                if len(wait) == 1 << 14:
                    flush(fd)
            if wait:
                flush(fd)
            os.fsync(fd)
        finally:
            os.close(fd)
        return Done(n)

    def commit(self, messages):
        n = sum(m.pixels for m in messages if m)
        if n != self.points:
            self.abort(messages)
            raise ValueError(f"{n} points for {self.shape}")
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class StructuredGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vts"

    def schema(self) -> str:
        return "i int, j int, k int, value array<double>"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options["array"], int(self.options.get("slice", SLICE)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options, overwrite)


def read_points(spark, path: str, array: str, slice_bytes: int = SLICE) -> DataFrame:
    """(i, j, k, value) of a file's named array."""
    spark.dataSource.register(StructuredGrid)
    return spark.read.format("vts").option("array", array).option("slice", slice_bytes).load(path)


def write_points(points: DataFrame, path: str, array: str, components: int, shape: tuple[int, int, int], kind: str = "Float64") -> None:
    """points (i, j, k, value) as one piece; each point of `shape` once."""
    points.sparkSession.dataSource.register(StructuredGrid)
    nx, ny, nz = shape
    points.select("i", "j", "k", "value").write.format("vts").options(array=array, components=components, nx=nx, ny=ny, nz=nz, type=kind).mode("overwrite").save(path)
