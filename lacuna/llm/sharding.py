"""Extendible hashing: shards are prefixes of a key's hash bits, as short as the byte limit allows.

All of it is DataFrame operations. One pass sums bytes per hash prefix, long enough for the data's size; the directory
comes from these sums alone. A second pass looks every row up in the directory by its leading bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Hash bits that one round can use, and rows of a directory that may be broadcast (about 60 bytes each).
BITS = 60
BROADCAST_ROWS = 1 << 16
#: A round's sums go this many bits beyond the shortest directory that could fit, for uneven buckets.
SLACK = 5
LIMIT = 16 << 20
#: The registered query's number of shards, at least, on tables that would fit fewer of LIMIT bytes.
SHARDS = 64


def key_bits(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text (null: the text `\\N`), as a long."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def limit_for(docs: DataFrame, shards: int, text: str = "text", most: int = LIMIT) -> int:
    """The byte limit at which docs' texts fill at least `shards` shards, as far as single rows and keys allow: their bytes by `shards`, rounded up, or `most` if that is less."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    return max(1, min(most, -(-total // shards)))


def shard(docs: DataFrame, key: list[str] | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with `shard`, `shard_depth`, `shard_bytes` and `shard_rows`.

    shard: the bucket's hash prefix in binary; the empty string if one bucket holds all. Buckets split on one more bit until
    their texts' UTF-8 bytes fit `limit`; a bucket of one row is final however large, as a text is never cut. Null and empty texts have 0 bytes, and null
    keys share one hash. Rows of a key whose bits run out have no shard of their own: with those of other such keys they are split on by content, and equal
    rows by their ordinal, into shards that read `+/prefix`, so that no key, however hot, overflows a shard. A key whose bits lead to no other shard is
    in those. An empty table gives an empty result. Columns of
    docs with one of the four names are replaced; all others stay.
    """
    key = key or ["doc_id"]
    kept = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes", "shard_rows")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r"), key_bits(*[F.col(f"`{k}`") for k in key]).alias("h"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("b"))
    done, at, base = [], "", 0
    while True:
        placed, left = _round(rows, limit, base)
        done.append(placed.select("r", F.concat(F.lit(at), "shard").alias("shard"), "shard_depth", "shard_bytes", "shard_rows"))
        if left is None:
            break
        rows, base, at = _renumber(left), base + BITS, at + "+/"
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("r.*", "shard", "shard_depth", "shard_bytes", "shard_rows")


def _round(rows: DataFrame, limit: int, base: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows placed by the 60 bits of h, and those of buckets that are still too large with all of them."""
    spark = rows.sparkSession
    placed, prefix_bits, above = None, 0, None
    while True:
        part = rows if above is None else rows.join(above, F.shiftright("h", BITS - prefix_bits) == F.col("over"), "left_semi")
        total = part.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n")).first()["n"]
        more = min(BITS - prefix_bits, max(1, math.ceil(math.log2(total / limit + 1))) + SLACK)
        if above is not None and more < BITS - prefix_bits:
            more = min(BITS - prefix_bits, max(more, 16))
        bits = prefix_bits + more
        sums = part.groupBy(F.shiftright("h", BITS - bits).alias("p")).agg(F.sum("b").alias("b"), F.count("*").alias("n"))
        sums = settle(sums, "shard-sums")
        nodes = settle(
            sums.select(F.explode(F.sequence(F.lit(prefix_bits), F.lit(bits))).alias("d"), "p", "b", "n")
            .select("d", F.expr(f"shiftright(p, {bits} - d)").alias("p"), "b", "n")
            .groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n")),
            "shard-nodes",
        )
        inner = nodes.filter((F.col("b") > limit) & (F.col("n") > 1))
        tops = nodes.filter(F.col("d") == prefix_bits).select("d", "p")
        born = inner.filter(F.col("d") < bits).select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
        leaves = settle(
            nodes.join(tops.unionByName(born), ["d", "p"], "left_semi").join(inner.select("d", "p"), ["d", "p"], "left_anti"), "shard-buckets"
        )
        depth = leaves.agg(F.max("d").alias("d")).first()["d"]
        over = inner.filter(F.col("d") == bits).select(F.col("p").alias("over"))
        more_over = bool(over.take(1))
        if depth is not None:
            directory = leaves.select(
                F.explode(F.expr(f"transform(sequence(0L, shiftleft(1L, {depth} - d) - 1), x -> shiftleft(p, {depth} - d) + x)")).alias("entry"),
                F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("right(lpad(bin(p), 64, '0'), d)")).alias("shard"),
                (F.col("d") + base).cast("int").alias("shard_depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"),
            )
            if depth <= int(math.log2(BROADCAST_ROWS)):  # 2 ** depth rows at most
                directory = F.broadcast(directory)
            here = part.join(directory, F.shiftright("h", BITS - depth) == F.col("entry")).select("r", "h", "b", "shard", "shard_depth", "shard_bytes", "shard_rows")
            placed = here if placed is None else placed.unionByName(here)
        if not more_over:
            return placed if placed is not None else _nothing(part), None
        over = settle(over, "shard-over")
        if bits == BITS:
            left = part.join(over, F.col("h") == F.col("over"), "left_semi")
            return placed if placed is not None else _nothing(part.filter("false")), left
        rows, above, prefix_bits = part, over, bits


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.select("r", "h", "b", F.lit("").alias("shard"), F.lit(0).alias("shard_depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"))


def _renumber(rows: DataFrame) -> DataFrame:
    """New bits for rows of equal key: by content, and for equal rows by ordinal. Equal rows are counted, then dealt out again from
    the count, so no task numbers a group row by row."""
    counted = rows.withColumn("c", F.md5(F.to_json("r"))).groupBy("h", "c").agg(F.first("r").alias("r"), F.first("b").alias("b"), F.count("*").alias("n"))
    step = 4096
    dealt = (
        counted.select("r", "h", "b", "c", "n", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)")).alias("lo"))
        .repartition(F.col("h"), F.col("c"), F.col("lo"))
        .select("r", "h", "b", "c", F.explode(F.expr(f"sequence(lo, least(lo + {step} - 1, n - 1))")).alias("i"))
    )
    return settle(dealt.select("r", key_bits(F.col("h"), F.col("c"), F.col("i")).alias("h"), "b"), "shard-equal")


def directory(shards: DataFrame) -> DataFrame:
    """One row per bucket of a result of shard(): what a reader needs to find a key's shard."""
    return shards.groupBy("shard", "shard_depth", "shard_bytes", "shard_rows").agg(F.count("*").alias("rows_found"))


#: The buckets in DuckDB's SQL: sums at every depth, then the shortest prefix that fits.
_ORACLE = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT k, h >> (60 - k) AS p, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM d, generate_series(0, 60) g(k) GROUP BY ALL),
i AS (SELECT doc_id, n_bytes, h, min(k) AS k FROM d, n WHERE h >> (60 - k) = p AND (b <= %s OR n = 1) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN k = 0 THEN '' ELSE right(lpad(bin(n.p), 64, '0'), k::INT) END AS shard, k::INT AS shard_depth, n.b AS shard_bytes, n.n AS shard_docs
FROM i JOIN n USING (k) WHERE h >> (60 - k) = n.p
"""


def oracle(limit: int | str) -> str:
    return _ORACLE % limit


ORACLE = oracle(f"(SELECT greatest(1, least({LIMIT}, (sum(n_bytes)::BIGINT + {SHARDS - 1}) // {SHARDS})) FROM d)")
