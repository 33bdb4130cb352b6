"""What the corpus operators share: durable tables, words, and hashing of words in numpy."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the controls 0x09 to 0x0D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (local runs)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _own["dir"] = tempfile.mkdtemp(prefix="lacuna-")
    return where.rstrip("/")


_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def own_folder(spark: SparkSession, label: str) -> str:
    """A folder's path in the shared folder that nothing else uses; removed when the process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it is computed once, its lineage is cut, its size is
    known to the planner, and a lost executor does not lose it. Removed when the process ends."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that settle() wrote, before the process ends; nothing may read it any more."""
    folders = {path for _, path in _written}
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if any(path.endswith(x.rpartition("/")[2]) for x in folders):
            _remove(path, df.sparkSession)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within, each query's shuffle files are removed as it ends, not when the driver comes to collect its garbage. For queries whose results are settled or small."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most: with texts of thousands of words, Spark's own limit of 10,000 rows makes a batch as large as a task's whole share of memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Keys of more than HOT rows, and more than one in MANY of all, are hot.
HOT, MANY = 1000, 100_000


def meet(left: DataFrame, right: DataFrame, on: str, many: int = MANY, how: str = "inner") -> DataFrame:
    """Inner (or left) join of `left`, a settled table with a non-null key that few values may fill, with `right`, which has a row for each key at most. Rows of hot keys stay where
    they are and meet theirs of `right` in a broadcast: there can be no more than `many` such keys. No other key has more rows than a task should take."""
    total = left.count()
    if total <= HOT:
        return left.join(right, on, how)
    hot = left.groupBy(on).agg(F.count("*").alias("__k")).filter(F.col("__k") > max(HOT, total // many)).select(on).collect()  # many rows at most
    if not hot:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(on).schema).coalesce(1))
    there = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, how)
    return there.unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def _remove(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(path, spark)
        except Exception:  # the session may have ended before; the folder is the cluster's to clean then
            return


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; empty for null and for white space only."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE, -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


# ---- words of many texts at once, in numpy -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        m = max(n, 1 << 16)
        for k, b in (("p", _P), ("q", _PINV)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow["p"], _pow["q"]


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts (bytes; text i ends at ends[i]): first byte, past-the-last byte and text of each."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(ends, start, "right")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * q[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts, most: int = 1 << 18):
    """(first, past-the-last, bytes, ends) of runs of texts of about `most` bytes each; null counts as empty. A longer text is a
    run of its own, so memory follows the longest text, not the batch."""
    first, got, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if got and size + len(b) > most:
            yield first, i, np.frombuffer(b"".join(got), np.uint8), np.cumsum([len(x) for x in got])
            first, got, size = i, [], 0
        got.append(b)
        size += len(b)
    if got:
        yield first, first + len(got), np.frombuffer(b"".join(got), np.uint8), np.cumsum([len(x) for x in got])


def low(data: np.ndarray) -> np.ndarray:
    return _LOW[data]
