"""MetaImage files (.mha) as a Spark data source: a header of text lines, then the pixels of all channels, line by line.

Reading cuts the file's lines into slices of some bytes, each a partition that seeks to its own; only the header is read by the driver. Writing puts each task's pixels at their places in a file of the full size, which gets its
name when all are there, so that a task may run twice. The path is a file that driver and executors share.

    spark.dataSource.register(mha.MetaImage)
    spark.read.format("mha").load(path)                                            # x, y, c0, c1, ...
    px.select("x", "y", "c0").write.format("mha").option("width", 64).option("height", 500).mode("overwrite").save(path)
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Element types of the format and what they are in numpy. Fixed values.
TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
#: Bytes of a slice.
SLICE = 8 << 20


class Header:
    """What a file's header says; an error where the pixels are not in the file itself, are compressed or of an unknown type."""

    def __init__(self, path: str):
        fields, at = {}, 0
        with open(path, "rb") as f:
            while "ElementDataFile" not in fields:
                line = f.readline(4096)
                if b"=" not in line:
                    raise ValueError(f"{path}: not a MetaImage header: {line[:80]!r}")
                k, v = line.decode("ascii").split("=", 1)
                fields[k.strip()] = v.strip()
            at = f.tell()
        size = [int(x) for x in fields["DimSize"].split()]
        self.width, self.height = size[0], int(np.prod(size[1:], dtype=np.int64))  # slices of a volume are stacked
        self.channels, self.start = int(fields.get("ElementNumberOfChannels", 1)), at
        if fields["ElementDataFile"] != "LOCAL" or fields.get("CompressedData", "False") == "True" or fields["ElementType"] not in TYPES:
            raise ValueError(f"{path}: pixels that are compressed, in another file or of type {fields['ElementType']} are not read")
        order = ">" if "True" in (fields.get("ElementByteOrderMSB"), fields.get("BinaryDataByteOrderMSB")) else "<"
        self.type = np.dtype(order + TYPES[fields["ElementType"]])
        self.line = self.width * self.channels * self.type.itemsize


class Lines(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        h = Header(self.path)
        step = max(1, self.size // max(1, h.line))
        return [Lines(a, min(h.height, a + step)) for a in range(0, h.height, step)] or [Lines(0, 0)]

    def read(self, partition):
        h = Header(self.path)
        n = partition.last - partition.first
        with open(self.path, "rb") as f:
            f.seek(h.start + partition.first * h.line)
            data = f.read(n * h.line)
        if len(data) < n * h.line:
            raise ValueError(f"{self.path} ends within line {partition.first + len(data) // max(1, h.line)}")
        a = np.frombuffer(data, h.type).reshape(n * h.width, h.channels)
        y, x = np.divmod(np.arange(n * h.width), max(1, h.width))
        names = ["x", "y", *[f"c{i}" for i in range(h.channels)]]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array((y + partition.first).astype(np.int32)), *[pa.array(a[:, i].astype(np.float64)) for i in range(h.channels)]], names=names)


class Done(WriterCommitMessage):
    def __init__(self, pixels: int):
        self.pixels = pixels


class Writer(DataSourceWriter):
    """Pixels (x, y, channels) into a file; an error where one lies outside, is null, or the file would not have each pixel once."""

    def __init__(self, path: str, schema: StructType, options: dict, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.fieldNames(), overwrite
        self.width, self.height = int(options["width"]), int(options["height"])
        kind = options.get("type", "MET_DOUBLE")
        self.type, channels = np.dtype("<" + TYPES[kind]), len(self.names) - 2
        if self.names[:2] != ["x", "y"] or channels < 1:
            raise ValueError("the columns are x, y and one for each channel")
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        head = {"ObjectType": "Image", "NDims": 2, "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "CompressedData": "False", "DimSize": f"{self.width} {self.height}", "ElementNumberOfChannels": channels, "ElementType": kind, "ElementDataFile": "LOCAL"}
        self.head = "".join(f"{k} = {v}\n" for k, v in head.items()).encode("ascii")
        self.part = f"{path}.part"
        with open(self.part, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + self.width * self.height * channels * self.type.itemsize)

    def write(self, rows):
        n, size, wait = 0, self.type.itemsize * (len(self.names) - 2), []

        def flush(fd: int) -> None:
            at = np.array([r[1] * self.width + r[0] for r in wait], np.int64)
            values = np.array([tuple(r)[2:] for r in wait], np.float64).astype(self.type)
            order = np.argsort(at, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(at[order]) != 1) + 1):  # neighbours in one piece
                os.pwrite(fd, values[run].tobytes(), len(self.head) + int(at[run[0]]) * size)
            wait.clear()

        fd = os.open(self.part, os.O_WRONLY)
        try:
            for r in rows:
                if not (0 <= r[0] < self.width and 0 <= r[1] < self.height):
                    raise ValueError(f"pixel {r[0]}, {r[1]} lies outside of {self.width} by {self.height}")
                wait.append(r)
                n += 1
                if len(wait) == 1 << 16:
                    flush(fd)
            if wait:
                flush(fd)
            os.fsync(fd)
        finally:
            os.close(fd)
        return Done(n)

    def commit(self, messages):
        n = sum(m.pixels for m in messages if m)
        if n != self.width * self.height:
            self.abort(messages)
            raise ValueError(f"{n} pixels for {self.width} by {self.height}")
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class MetaImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mha"

    def schema(self) -> str:
        return "x int, y int, " + ", ".join(f"c{i} double" for i in range(Header(self.options["path"]).channels))

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("slice", SLICE)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, self.options, overwrite)


def read_image(spark, path: str, image_id: int = 0, slice_bytes: int = SLICE) -> DataFrame:
    """(image_id, x, y, c0, ...) of a file."""
    spark.dataSource.register(MetaImage)
    px = spark.read.format("mha").option("slice", slice_bytes).load(path)
    return px.select(F.lit(image_id).cast("long").alias("image_id"), *px.columns)


def write_image(px: DataFrame, path: str, columns: list[str], width: int, height: int, kind: str = "MET_DOUBLE") -> None:
    """One image's columns as channels; px has each pixel of 0 to width - 1, 0 to height - 1 once."""
    px.sparkSession.dataSource.register(MetaImage)
    px.select("x", "y", *columns).write.format("mha").options(width=width, height=height, type=kind).mode("overwrite").save(path)
