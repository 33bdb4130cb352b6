"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A mask is a fixed pattern of word positions that count or do not. Each mask laid at each word gives a hash; test items' hashes meet the
training texts' in a join, and around each hit the item is compared word by word with the text along the hit's diagonal, so that
substituted words do not hide an overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, settle

#: 1: the word counts; 0: any word may stand there. Each stretch of four or more equal words that leaks() scores has a hit: it begins with three equal words or
#: more, as a miss after fewer takes the score to 0. With four, the first mask hits. With three, the miss leaves a score of 1, which only two equal words or more
#: carry over the next miss, or above the 3 scored before: the second hits.
MASKS = ("1111", "111011")
#: Items of fewer words than this never count as a leak; the masks need four equal words.
LEAST = 4
#: An overlap counts from so many equal words, or from this share of a short item's.
OVERLAP, SHARE = 13, 0.8
#: Seeds of the test items that may be broadcast (about 50 bytes each); more are joined by a shuffle, in which a seed's rows are dealt SALT ways, and the seeds repeated for each.
BROADCAST_SEEDS, SALT = 400_000, 16


def word_array(text: Column) -> Column:
    """Hashes of the words of a text, A-Z lower-cased; empty for null, empty and white space only."""
    bare = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), rf"^{SPACE}|{SPACE}$", "")
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, SPACE), lambda w: F.xxhash64(w)))


def _seeds(rows: DataFrame, h: Column) -> DataFrame:
    """rows, but for the text or words themselves, with k and i: the key at word i by each mask, the hash of the words that count there, where the mask fits. Words are hashed once a text; keys
    are worked out a row at a time, in compiled code. What is exploded is not a plain column, as a filter on its size would work the words out a second time."""
    kept = [c for c in rows.columns if c not in ("t", "q")]
    n = F.size("_h")
    at = rows.withColumn("_h", h).select(*kept, "_h", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("i"))

    def key(number: int, mask: str) -> Column:
        picked = [F.get("_h", F.col("i") + j) for j, bit in enumerate(mask) if bit == "1"]
        return F.when(F.col("i") + len(mask) <= n, F.xxhash64(F.lit(number), *picked))

    keys = F.array(*[key(number, mask) for number, mask in enumerate(MASKS)])
    return at.select(*kept, "i", F.explode(keys).alias("k")).filter("k is not null").select(*kept, "k", "i")


def leaks(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, th, item, words, matched, first): a row for each text and item that overlap. th: hash of the text; words: the item's number of words; matched: equal words in the
    best-scoring stretch (1 for an equal word, -2 for another); first: the word of the text at which the item would begin.

    They overlap if matched is OVERLAP or more, or, for an item too short for that, SHARE of its words; items under LEAST words never do.
    Words are what stands between white space, A-Z lower-cased; null and empty texts have none. Items of equal words are sought once and all reported, as are different texts under one item id; rows of
    one key and different texts are sought and reported each, and so are null keys and null item ids. Equal rows are reported once. Empty tables give an empty result; other columns are ignored.
    """
    items = bench.select(F.col(f"`{item}`").alias("item"), word_array(F.col(f"`{item_text}`")).alias("q")).filter(F.size("q") >= LEAST)
    items = settle(items.withColumn("rep", F.xxhash64("q")).distinct(), "leak-items")
    each = items.select("q", "rep").distinct()  # equal items are one
    seeds = settle(_seeds(each, F.col("q")).select("k", F.col("i").alias("o"), "rep"), "leak-seeds")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    spots = _seeds(rows.select("key", F.xxhash64("t").alias("th"), "t"), word_array(F.col("t")))
    spots, on = spots.select("key", "th", "k", "i"), ["k"]
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    else:  # few common words in a row may be a seed that very many texts have
        spots, on = spots.withColumn("salt", F.pmod(F.xxhash64("th", "i"), F.lit(SALT))), ["k", "salt"]
        seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    hits = spots.join(seeds, on).select("key", "th", "rep", (F.col("i") - F.col("o")).alias("first"))
    hits = hits.groupBy("key", "th", "rep").agg(F.collect_set("first").alias("firsts"))  # no more than a text has words
    hits = settle(hits, "leak-hits")

    def sized(df: DataFrame, numbers: str) -> DataFrame:
        """df, to be broadcast if all its numbers are few."""
        size = df.agg(F.coalesce(F.sum(F.size(numbers) + 4), F.lit(0))).first()[0]
        return F.broadcast(df) if size <= 8 * BROADCAST_SEEDS else df

    where = sized(hits.select(F.col("key").alias("key2"), F.col("th").alias("th2"), "rep", "firsts"), "firsts")
    again = rows.withColumn("th", F.xxhash64("t")).join(where, (F.col("th") == F.col("th2")) & F.col("key").eqNullSafe(F.col("key2"))).withColumn("h", word_array(F.col("t")))
    found = again.join(sized(each, "q"), "rep").select("key", "th", "h", "q", "rep", F.explode("firsts").alias("first"))
    same = F.transform("q", lambda w, j: F.coalesce(F.get("h", F.col("first") + j) == w, F.lit(False)))
    state = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("top"), F.lit(0).alias("matched"))

    def step(a: Column, eq: Column) -> Column:
        s = F.when(eq, a["s"] + 1).when(a["s"] > 2, a["s"] - 2).otherwise(0)
        n = F.when(eq, a["n"] + 1).when(a["s"] > 2, a["n"]).otherwise(0)
        return F.struct(s.alias("s"), n.alias("n"), F.greatest(a["top"], s).alias("top"), F.when(s > a["top"], n).otherwise(a["matched"]).alias("matched"))

    scored = found.select("key", "th", "rep", "first", F.size("q").alias("words"), F.aggregate(same, state, step)["matched"].alias("matched"))
    scored = scored.filter(F.col("matched") >= F.least(F.lit(OVERLAP), F.ceil(F.col("words") * SHARE)))
    best = scored.groupBy("key", "th", "rep").agg(F.max("words").alias("words"), F.max(F.struct("matched", (-F.col("first")).alias("f"))).alias("b"))
    return best.join(items.select("item", "rep"), "rep").select("key", "th", "item", "words", F.col("b.matched").alias("matched"), (-F.col("b.f")).alias("first"))


def clean(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows whose text overlaps with an item; their columns. A row goes for its own text, never for its key, which may be null or repeated."""
    found = leaks(docs, bench, key, text, **how).select(F.col("key").alias("__k"), F.col("th").alias("__th")).distinct()
    found = settle(found, "leak-keys")
    if found.count() <= BROADCAST_SEEDS:
        found = F.broadcast(found)
    return docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col("__k")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__th")), "left_anti")
