"""Mixing sources to target weights.

Each source's words form one stream, packed into blocks of a fixed number of words. Each output shard draws a multinomial count of
block slots per source; a source's slots, numbered over all shards, run through a pseudorandom permutation of its blocks, epoch after
epoch, and slots meet blocks in a join on (source, block). Only sums per source and per shard reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, word_count

WEIGHTS, SHARE, MOST, BLOCK, SHARDS, SEED = (5, 2, 1), 1.5, 2.0, 128, 256, 17
#: A source's stream is ordered within hash ranges, RANGES or as many as there are times PER_RANGE rows, so that no task orders a whole source; copies of a row are dealt out COPIES at a time.
RANGES, PER_RANGE, COPIES = 1024, 1 << 18, 4096
#: Sources at most: SHARDS numbers for each are drawn by the driver.
SOURCES = 50_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source (in code-point order, null last; weights repeat). Targets stop at `most` times the size; what is
    above is shared anew among the others by weight until none is above."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = most * np.array([n for _, n in sizes], float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * sum(n for _, n in sizes)
    while free.any():
        want = left * w / w[free].sum()
        above = free & (want > cap)
        if not above.any():
            out[free] = want[free]
            break
        out[above] = cap[above]
        left -= cap[above].sum()
        free &= ~above
    return out.tolist()


def _round(b: np.ndarray, k: np.ndarray, mask: np.ndarray) -> np.ndarray:
    f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
    f ^= f >> np.uint64(29)
    f *= np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def _walk(x: np.ndarray, half: np.ndarray, keys: list[np.ndarray], back: bool = False) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    a, b = x >> half, x & mask
    for k in reversed(keys) if back else keys:
        a, b = (b ^ _round(a, k, mask), a) if back else (b, a ^ _round(b, k, mask))
    return (a << half) | b


def _keys(seed: np.ndarray) -> list[np.ndarray]:
    return [(seed + np.uint64(r + 1)) * np.uint64(0xD6E8FEB86659FD93) for r in range(4)]


def permute(i: np.ndarray, n: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """Position i's image under a pseudorandom permutation of range(n), or its origin: a Feistel network on the next even number of
    bits, walked until the value is below n."""
    x, n, seed = i.astype(np.uint64), n.astype(np.uint64), seed.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    keys = _keys(seed)
    x = _walk(x, half, keys, back)
    while (far := x >= n).any():
        x[far] = _walk(x[far], half[far], [k[far] for k in keys], back)
    return x.astype(np.int64)


def _slots(size: int, target: float, block: int, seed: int) -> tuple[int, int]:
    """Number of slots whose blocks hold round(target) words, and the words that the last slot takes (0: all of its block)."""
    want = int(round(target))
    if size == 0 or want == 0:
        return 0, 0
    n = -(-size // block)
    epochs, rest = divmod(want, size)
    if rest == 0:
        return epochs * n, 0
    at = int(permute(*(np.array([v]) for v in (n - 1, n, seed)), back=True)[0])  # the last block, which may be short
    short = size - (n - 1) * block
    if rest <= at * block:
        full, cut = divmod(rest, block)
    elif rest < at * block + short:
        full, cut = at, rest - at * block
    else:
        full, cut = divmod(rest - short, block)
        full += 1
    return epochs * n + full + (cut > 0), cut


def draw(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shards, sources] slot counts: a multinomial draw for each shard, then moved by the least number of slots, evenly over the
    shards, so that each source's sum is its number of slots."""
    total = int(slots.sum())
    if total == 0:
        return np.zeros((shards, len(slots)), np.int64)
    rng = np.random.default_rng(seed)
    each = np.diff(np.arange(shards + 1) * total // shards)
    got = np.stack([rng.multinomial(k, slots / total) for k in each]).astype(np.int64)
    over = np.maximum(got.sum(0) - slots, 0)
    lost = np.zeros(shards, np.int64)
    for s in np.flatnonzero(over):
        run = np.concatenate([[0], np.cumsum(got[:, s])])
        cut = np.diff([int(c) * int(over[s]) // int(run[-1]) for c in run])
        got[:, s] -= cut
        lost += cut
    j = 0
    for s in np.flatnonzero((need := np.maximum(slots - got.sum(0), 0))):
        left = int(need[s])
        while left:
            if lost[j] == 0:
                j += 1
                continue
            k = min(left, int(lost[j]))
            got[j, s] += k
            lost[j] -= k
            left -= k
    return got


def content_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns (those of maps cannot be hashed), which tells nulls and their places apart."""
    return F.xxhash64(*[x for c, kind in docs.dtypes if "map<" not in kind for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED):
    """(rows, pieces): rows has a row for each row of docs: key, th (hash of all its columns but maps), copy (its number among those of equal key, th and source), size, source, source_size, target and
    at (its first word's place in the source's stream); pieces has source id `sid`, at, shard, slot, epoch and the words [lo, hi) of the text that the slot takes.

    Size: the number of words (null text: 0). A null source is a source. Rows without words have no piece. Equal rows are separate
    rows, each with its place; they are counted before rows move, so one that is a third of all is no task's burden. An empty table gives empty results. Other columns only tell rows apart.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{key}`").alias("key"), content_hash(docs).alias("th"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    # the one read of the texts
    base = settle(base.groupBy("key", "th", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    ranges = max(RANGES, base.count() // PER_RANGE)
    base = base.withColumn("rng", F.pmod(F.xxhash64("key", "th"), F.lit(ranges)).cast("int"))
    sums = base.groupBy("source", "rng").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    found = [(r["source"], int(r["n"])) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).limit(SOURCES + 1).collect()]  # a row for each source
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: their targets and draws are worked out by the driver")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets(found, weights, share, most)
    rows = [(i, s, n, g, -(-n // block), *_slots(n, g, block, seed + i)) for i, ((s, n), g) in enumerate(zip(found, goal, strict=True))]
    src = F.broadcast(spark.createDataFrame(rows, "sid int, source string, source_size long, target double, blocks long, slots long, cut long").coalesce(1))
    offsets = settle(sums.withColumn("start", F.sum("n").over(Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1))).select("source", "rng", F.coalesce("start", F.lit(0)).alias("start")), "mix-offsets")
    w = Window.partitionBy("source", "rng").orderBy("key", "th", "size")
    words = F.col("size") * F.col("copies")
    placed = base.withColumn("run", F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, 0)) - words)
    placed = placed.join(offsets.withColumnsRenamed({"source": "s2", "rng": "r2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("rng") == F.col("r2")))
    placed = placed.join(src.withColumnRenamed("source", "s3").select("sid", "s3", "source_size", "target"), F.col("source").eqNullSafe(F.col("s3")))
    placed = placed.select("key", "th", "size", "source", "sid", "source_size", "target", "copies", (F.col("start") + F.col("run")).alias("first"), F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")).alias("from"))
    many = placed.filter("copies > 1").repartition("sid", "first", "from")
    placed = placed.filter("copies = 1").unionByName(many).withColumn("copy", F.explode(F.expr(f"sequence(from, least(from + {COPIES} - 1, copies - 1))")))
    placed = settle(placed.select("key", "th", "copy", "size", "source", "sid", "source_size", "target", (F.col("first") + F.col("copy") * F.col("size")).alias("at")), "mix-rows")

    count = draw(np.array([r[5] for r in rows], np.int64), shards, seed)
    first = np.concatenate([np.zeros((1, len(rows)), np.int64), np.cumsum(count, 0)])[:-1]
    drawn = pd.DataFrame({"shard": np.repeat(np.arange(shards), len(rows)), "sid": np.tile(np.arange(len(rows)), shards), "lo": first.ravel(), "n": count.ravel()})
    drawn = spark.createDataFrame(drawn[drawn.n > 0], "shard int, sid int, lo long, n long")

    @F.pandas_udf("long")
    def shuffled(i: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n.to_numpy(), s.to_numpy()))

    step = 1 << 14
    slot = drawn.withColumn("from", F.explode(F.expr(f"sequence(lo, lo + n - 1, {step}L)"))).withColumn("to", F.expr(f"least(from + {step} - 1, lo + n - 1)"))
    slot = slot.repartition(max(8, spark.sparkContext.defaultParallelism, int(sum(r[5] for r in rows) >> 17)), "sid", "from")
    slot = slot.select("shard", "sid", F.explode(F.expr("sequence(from, to)")).alias("slot")).join(src.select("sid", "blocks", "slots", "cut"), "sid")
    slot = slot.withColumn("epoch", F.expr("slot div blocks").cast("int")).withColumn("block", shuffled(F.col("slot") % F.col("blocks"), "blocks", F.col("sid") + F.lit(seed)))
    slot = slot.select("sid", "block", "shard", "slot", "epoch", F.when((F.col("slot") == F.col("slots") - 1) & (F.col("cut") > 0), F.col("cut")).otherwise(block).alias("takes"))
    part = placed.filter("size > 0").select("sid", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    lo, hi = F.greatest(F.lit(0), F.col("block") * block - F.col("at")), F.least(F.col("size"), F.col("block") * block + F.col("takes") - F.col("at"))
    pieces = part.join(slot, ["sid", "block"]).select("sid", "at", "shard", "slot", "epoch", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).filter("hi > lo")
    return placed, pieces


def taken(docs: DataFrame, **how) -> DataFrame:
    """A row for each row of docs: key, source, size, source_size, target and taken, the words that the mix takes, repeats counted."""
    rows, pieces = plan(docs, **how)
    sums = pieces.groupBy("sid", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    full = rows.filter("size > 0").join(sums, ["sid", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    none = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(none.select(full.columns)).select("key", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None, **how) -> DataFrame:
    """The mix itself, with docs' columns: a row for each text and epoch that takes words of it, the text cut to the words taken
    where the epoch takes a part (whole texts stay as they are; `length`, if given, holds characters and is set anew). A text that no slot takes, or
    without words, is not part of the mix. Rows that are equal in all columns are drawn apart, but read once; columns of maps are not compared."""
    rows, pieces = plan(docs, key=key, text=text, source=source, **how)
    got = pieces.groupBy("sid", "at", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    got = rows.join(got, ["sid", "at"]).select("key", "th", "source", "copy", F.struct((F.col("words") == F.col("size")).alias("whole"), "cuts").alias("e"))
    got = got.groupBy("key", "th", "source", "copy").agg(F.collect_list("e").alias("es"))  # at most two or three epochs for a text
    same = ["__k", "__h", "__s"]
    side = docs.withColumns({"__k": F.col(f"`{key}`"), "__h": content_hash(docs), "__s": F.col(f"`{source}`").cast("string")})
    if rows.filter("copy > 0").take(1):  # equal rows are one here, summed up before they move
        side = side.groupBy(*same).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__r")).select(*same, "__r.*")
    got = got.select(F.col("key").alias("__key"), F.col("th").alias("__th"), F.col("source").alias("__source"), F.col("es").alias("__es"))  # docs may have columns of these names
    on = F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__th")) & F.col("__s").eqNullSafe(F.col("__source"))
    out = side.join(got.hint("shuffle_hash"), on).withColumn("__e", F.explode("__es"))
    tokens = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})"), F.lit(1))
    cut = F.concat_ws(" ", F.flatten(F.transform("__e.cuts", lambda c: F.slice(tokens, (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")))))
    out = out.withColumn(text, F.when(F.col("__e.whole"), F.col(f"`{text}`")).otherwise(cut))
    if length:
        out = out.withColumn(length, F.char_length(f"`{text}`").cast(dict(docs.dtypes)[length]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
