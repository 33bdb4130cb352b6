"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal n-gram sets are one class: a row of the matrix. Columns come in one order for all rows, rare ones first by a sketch that counts every
n-gram of every text in fixed space, so that what many texts share comes last. Two sets within the threshold must meet in the columns that come first
in each (the size-derived bound: n - ceil(t n) + 1 of n), so the product starts there and most pairs never arise. A pair that meets is dropped when the
parity bitmaps of its sets differ in more bits than the threshold allows n-grams; the others accumulate their overlap over all columns.

No column's pairs are all formed. First each row meets one row of the column; then, with what links by that contracted, rows of different components
meet in blocks. Links are kept as what holds components together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import chunks, low, meet, mix, settle, small_batches, spans, word_hashes

#: Counters of the sketch, and counters in one of its slices. It orders columns; no result depends on it.
SKETCH, SLICE = 1 << 23, 1 << 16
#: Rows of a column whose pairs may be looked at in one task; larger columns come in tiles of so many by so many.
TILE = 512
#: Pairs in a task of the product, and words of bitmaps compared at once.
PAIRS, WORDS = 256, 1 << 19
#: Cells of the open columns in a task, and pairs of these before repeated ones are dropped.
CELLS, PAIRED = 1 << 13, 1 << 20
#: Rows of 8 to 24 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 250_000


def sets(texts, width: int):
    """(first, past-the-last, sizes, grams) for runs of texts: each text's distinct n-gram hashes, ascending, one text after the other."""
    for a, b, data, ends in chunks(texts):
        data = low(data)
        start, end, of = spans(data, ends)
        h = word_hashes(data, start, end)
        at = np.searchsorted(of, np.arange(b - a + 1))
        # n-grams at each word; those that would cross into the next text are not used
        g = h.copy()
        for k in range(1, width):
            g[:-k] += h[k:] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1)) if k < len(h) else np.uint64(0)
        g = mix(g)
        out = []
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= width:
                out.append(np.unique(g[lo : hi - width + 1]))
            elif hi > lo:  # fewer words than n: the whole sequence, marked by its length
                v = np.uint64(hi - lo)
                for k, x in enumerate(h[lo:hi]):
                    v = mix(np.array([v ^ x]) + np.uint64(k + 1))[0]
                out.append(np.array([v], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        yield a, b, np.array([len(x) for x in out]), np.concatenate(out) if out else np.zeros(0, np.uint64)


def _class_ids(n: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, the same for equal sets and independent of where they stand."""
    edge = np.concatenate([[0], np.cumsum(n)])
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0x51ED270B7A3C1F55)), dtype=np.uint64)])
    return mix((run[edge[1:]] - run[edge[:-1]]) + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


# ---- parity bitmaps ------------------------------------------------------------------------------------------------


def _width(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: the power of two from twice its size on, 64 at least."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64))


def bitmaps(n: np.ndarray, grams: np.ndarray) -> list[bytes]:
    """For each set, bits that say whether an odd number of its n-grams fall there. Two sets' bitmaps differ in at most as many bits as the sets in n-grams."""
    m = _width(n)
    off = np.cumsum(m) - m
    at = np.repeat(off, n) + (mix(grams ^ np.uint64(0x7F4A7C159E3779B9)) & np.repeat(m - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(m.sum())) & 1).astype(np.uint8), bitorder="little")
    return [odd[a : a + b].tobytes() for a, b in zip((off // 8).tolist(), (m // 8).tolist(), strict=True)]


def difference(n: np.ndarray, bits, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, bits that differ) of those of the pairs (i, j) that may still link: by their sizes, and by their bitmaps. The wider bitmap is folded."""
    need = -(-(n[i] + n[j]) * num // (num + den))
    place = np.flatnonzero(np.minimum(n[i], n[j]) >= need)
    i, j, most = i[place], j[place], (n[i] + n[j] - 2 * need)[place]
    m = _width(n)
    level = np.minimum(m[i], m[j])
    got = np.zeros(len(place), np.int64)
    for w in np.unique(level):
        use = np.flatnonzero(level == w)
        ids, inv = np.unique(np.concatenate([i[use], j[use]]), return_inverse=True)
        inv = inv.reshape(2, -1)
        words = int(w) // 64
        b = np.empty((len(ids), words), np.uint64)
        for k, x in enumerate(ids.tolist()):
            b[k] = np.bitwise_xor.reduce(np.frombuffer(bits[x], np.uint64).reshape(-1, words), 0)
        step = max(1, WORDS // words)
        for lo in range(0, len(use), step):
            part = slice(lo, lo + step)
            got[use[part]] = np.bitwise_count(b[inv[0, part]] ^ b[inv[1, part]]).sum(1, dtype=np.int64)
    keep = got <= most
    return place[keep], got[keep]


# ---- the order of columns ------------------------------------------------------------------------------------------


def _counted(seen: np.ndarray) -> list[tuple[int, bytes]]:
    """The sketch's slices that hold anything, packed."""
    return [(k, pa.compress(x.astype(np.int64).tobytes(), codec="zstd", asbytes=True)) for k, x in enumerate(seen.reshape(-1, SLICE)) if x.any()]


def _sum(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros(SLICE, np.int64)
    for x in pdf["counts"]:
        out += np.frombuffer(pa.decompress(x, SLICE * 8, codec="zstd", asbytes=True), np.int64)
    return out


def levels(slices: DataFrame) -> np.ndarray:
    """How frequent the n-grams of each counter are, in half octaves. SKETCH bytes reach the driver, whatever the data."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [pa.compress(_sum(pdf).tobytes(), codec="zstd", asbytes=True)]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "level": [np.ceil(2 * np.log2(np.maximum(_sum(pdf), 1))).astype(np.uint8).tobytes()]})

    some = slices.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(32))).groupBy("slice", "part").applyInPandas(add, "slice int, counts binary")
    out = np.zeros(SKETCH, np.uint8)
    for r in some.groupBy("slice").applyInPandas(finish, "slice int, level binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["level"], np.uint8)
    return out


def firsts(n: np.ndarray, grams: np.ndarray, level: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, n-grams) of the columns in which a partner must show."""
    take = n - -(-n * num // den) + 1
    key = (level[(grams & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (mix(grams) >> np.uint64(7))
    end = np.cumsum(n)
    out = []
    for a, b, k in zip((end - n).tolist(), end.tolist(), take.tolist(), strict=True):
        if b > a:
            out.append(grams[a:b][np.argpartition(key[a:b], k - 1)[:k]] if k < b - a else grams[a:b])
    return np.repeat(np.arange(len(n)), np.where(n > 0, np.minimum(take, n), 0)), np.concatenate(out) if out else np.zeros(0, np.uint64)


# ---- components ----------------------------------------------------------------------------------------------------


def _forest(batches):
    """A spanning forest of a task's own edges, as stars."""
    for pdf in batches:
        ids, inv = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
        u, v = inv.reshape(-1, 2).T
        root = np.arange(len(ids))
        while True:
            least = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], least)
            np.minimum.at(new, root[v], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(root != np.arange(len(ids)))
        yield pd.DataFrame({"u": ids[at], "v": ids[root[at]]})


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for edges (a, b): each node of an edge and the smallest node that it hangs together with. Forests in each task first, then star contraction:
    about log(size) rounds of grouped minima and joins, unless so few edges are left that they might be broadcast. A star's centre meets its rows in a broadcast, or,
    beyond BROADCAST_ROWS, by meet()."""

    def joined(rows: DataFrame, least: DataFrame) -> DataFrame:
        least = settle(least, label)
        return rows.join(F.broadcast(least), "u") if least.count() <= BROADCAST_ROWS else meet(settle(rows, label), least, "u")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").mapInPandas(_forest, "u long, v long")
    e, before = settle(e, label), None
    small = e.count() <= BROADCAST_ROWS
    if small:  # as few as may be broadcast: one task
        e = e.coalesce(1).mapInPandas(lambda batches: _forest([pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches])]), "u long, v long")
    while not small:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = settle(joined(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)  # large star
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = joined(e, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u > v").distinct()  # small star
        e = settle(e, label)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return settle(roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), label)


# ---- the product ---------------------------------------------------------------------------------------------------


def _overlaps(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links among the pairs (pivot, c): each pivot's columns by the incidences of all that meet it. A pivot's own row is marked."""
    a, b = [], []
    for (pivot, _), part in pdf.groupby(["pivot", "chunk"], sort=False):
        own = part["own"].to_numpy()
        g = np.frombuffer(part["grams"][own].iloc[0], np.uint64)
        rest = [np.frombuffer(x, np.uint64) for x in part["grams"][~own]]
        n = np.array([len(x) for x in rest])
        every = np.concatenate(rest)
        at = np.minimum(np.searchsorted(g, every), len(g) - 1)
        over = np.bincount(np.repeat(np.arange(len(n)), n), weights=g[at] == every, minlength=len(n))
        ids = part["c"].to_numpy()[~own][over * den >= num * (n + len(g) - over)]
        a.append(np.full(len(ids), pivot, np.int64))
        b.append(ids)
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def _linked(base: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (pivot, c) that link, by their overlap over all columns. A pivot of many pairs is dealt in chunks."""
    size = pairs.count()
    chunk = max(64, size // 512)
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("c"), F.lit(chunk)))
    need = pairs.select("c").unionByName(pairs.select(F.col("pivot").alias("c"))).distinct().join(classes.select("c", "th"), "c")
    need = settle(need.select("c", "th"), "jaccard-need")
    few = F.broadcast if need.count() <= BROADCAST_ROWS else (lambda x: x)

    def whole(batches):
        for pdf in batches:
            ids = pdf["c"].to_numpy()
            for a, b, n, g in sets(pdf["text"], width):
                yield pd.DataFrame({"c": ids[a:b], "grams": [x.tobytes() for x in np.split(g, np.cumsum(n)[:-1])]})

    held = base.select("th", "text").join(few(need), "th").select("c", "text").mapInPandas(whole, "c long, grams binary")
    held = settle(held.groupBy("c").agg(F.first("grams").alias("grams")), "jaccard-grams")
    own = pairs.select("pivot", "chunk").distinct().join(held.withColumnRenamed("c", "pivot"), "pivot").select("pivot", "chunk", F.col("pivot").alias("c"), F.lit(True).alias("own"), "grams")
    both = own.unionByName(pairs.join(held, "c").select("pivot", "chunk", "c", F.lit(False).alias("own"), "grams"))
    packs = max(1, size // PAIRS)
    out = both.groupBy(F.pmod(F.xxhash64("pivot", "chunk"), F.lit(packs)).alias("pack")).applyInPandas(lambda pdf: _overlaps(pdf, num, den), "a long, b long")
    return settle(out, "jaccard-links")


def _stars(cells: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Each row of a column with the column's first row, where sizes and bitmaps allow a link."""
    pairs = settle(cells.filter("c > low").select("c", F.col("low").alias("pivot")).distinct(), "jaccard-stars")
    need = settle(pairs.select("c").unionByName(pairs.select(F.col("pivot").alias("c"))).distinct(), "jaccard-need")
    rows = rows.join(F.broadcast(need) if need.count() <= BROADCAST_ROWS else need, "c", "left_semi")
    pairs = meet(pairs, rows.select(F.col("c").alias("pivot"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "pivot", many=2000)

    def screen(batches):
        for pdf in batches:
            k = len(pdf)
            n = np.concatenate([pdf["n"], pdf["n2"]]).astype(np.int64)
            keep, _ = difference(n, [*pdf["bits"], *pdf["bits2"]], np.arange(k), np.arange(k) + k, num, den)
            yield pdf[["pivot", "c"]].iloc[keep]

    return settle(pairs.join(rows, "c").select("pivot", "c", "n", "bits", "n2", "bits2").mapInPandas(screen, "pivot long, c long"), "jaccard-pairs")


def _crossed(c: np.ndarray, root: np.ndarray, n: np.ndarray, bits, i: np.ndarray, j: np.ndarray, num: int, den: int, best: bool) -> pd.DataFrame:
    """Of the pairs (i, j) of different components, those that may link; with `best`, the closest of each row and component."""
    place, apart = difference(n, bits, i, j, num, den)
    i, j = i[place], j[place]
    if best and len(i):
        order = np.lexsort((apart, root[j], i))
        i, j = i[order], j[order]
        first = np.concatenate([[True], (i[1:] != i[:-1]) | (root[j[1:]] != root[j[:-1]])])
        i, j = i[first], j[first]
    return pd.DataFrame({"pivot": np.minimum(c[i], c[j]), "c": np.maximum(c[i], c[j])})


def _rest(cells: DataFrame, roots: DataFrame, rows: DataFrame, num: int, den: int, best: bool, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, open cells): pairs of rows that share a column, are of different components and may link, and the cells (g, c) of the columns that have rows of different components and, if failed (c) is given, one of these rows. Columns
    of two rows, which have been looked at as stars, are not among the cells."""
    at = cells.select("g", "c").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("g", "c", F.coalesce("root", "c").alias("root"))
    if failed is None:
        at = at.withColumn("again", F.lit(True))
    else:
        failed = failed.withColumn("again", F.lit(True))
        at = at.join(F.broadcast(failed) if failed.count() <= BROADCAST_ROWS else failed, "c", "left").withColumn("again", F.col("again").isNotNull())
    at = settle(at, "jaccard-cells")
    # a column's rows by component first, so that its largest one is known where the column's rows meet it
    open_ = at.groupBy("g", "root").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("again").alias("again")).groupBy("g")
    open_ = open_.agg(F.sum("k").alias("k"), F.count("*").alias("roots"), F.min("low").alias("low"), F.max("again").alias("again"), F.max_by("root", F.struct("k", "root")).alias("top"))
    open_ = settle(open_.filter("roots > 1 and again").select("g", "k", "low", "top"), "jaccard-open")
    at = at.select("g", "c", "root")
    # columns of the same first row, which have much in common, go to the same pack, in parts of about CELLS
    homes = open_.groupBy("low").agg(F.ceil(F.sum("k") / CELLS).alias("parts"))
    open_ = meet(open_, homes, "low").select("g", "k", "top", F.xxhash64("low", F.pmod(F.xxhash64("g"), "parts")).alias("home"))
    at = settle(meet(at, open_, "g"), "jaccard-open-cells")
    need = at.select("c").distinct()
    rows = rows.join(F.broadcast(need) if need.count() <= BROADCAST_ROWS else need, "c", "left_semi")
    packs = max(1, at.count() // CELLS)

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", ignore_index=True)
        c, root, n = (pdf[x].to_numpy() for x in ("c", "root", "n"))
        column, own = np.concatenate(pdf["gs"].tolist()), np.repeat(np.arange(len(c)), pdf["gs"].map(len))
        order = np.argsort(column, kind="stable")
        met = np.zeros(0, np.int64)
        wait, size = [], 0
        for x in np.split(own[order], np.flatnonzero(np.diff(column[order])) + 1):
            i, j = np.triu_indices(len(x), 1)
            i, j = x[i], x[j]
            use = root[i] != root[j]
            wait.append(i[use] * len(c) + j[use])
            size += len(wait[-1])
            if size > PAIRED:
                met, wait, size = np.unique(np.concatenate([met, *wait])), [], 0
        met = np.unique(np.concatenate([met, *wait]))
        return _crossed(c, root, n, pdf["bits"].tolist(), met // len(c), met % len(c), num, den, best)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        c, root, n, side = (pdf[x].to_numpy() for x in ("c", "root", "n", "side"))
        left, right, bits = np.flatnonzero(side == 0), np.flatnonzero(side == 1), pdf["bits"].tolist()
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        use = root[i] != root[j]
        return _crossed(c, root, n, bits, i[use], j[use], num, den, best)

    form = "pivot long, c long"
    few = at.filter(F.col("k") <= TILE).withColumn("pack", F.pmod("home", F.lit(packs))).groupBy("c", "pack").agg(F.first("root").alias("root"), F.collect_list("g").alias("gs"))
    pairs = few.join(rows, "c").groupBy("pack").applyInPandas(small, form)
    large = at.filter(F.col("k") > TILE)
    if large.take(1):
        large = settle(large.join(rows, "c").withColumn("blocks", F.ceil(F.col("k") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")), "jaccard-large")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        sides = large.filter("root <> top").select("g", F.col("own").alias("p"), every.alias("q"), F.lit(0).alias("side"), "c", "root", "n", "bits")
        sides = sides.unionByName(large.select("g", every.alias("p"), F.col("own").alias("q"), F.lit(1).alias("side"), "c", "root", "n", "bits"))
        pairs = pairs.unionByName(sides.groupBy("g", "p", "q").applyInPandas(tile, form))
    return settle(pairs.distinct(), "jaccard-pairs"), at.select("g", "c")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """A row for each row of docs: key, th (hash of its text), n (size of its set of n-grams of `width` words), rep (the smallest key with the same set), component (the
    smallest key reachable by links of Jaccard similarity num/den or more, itself included) and cluster (a number that such rows alone have in common).

    Words are what stands between white space, A-Z lower-cased. A text of fewer words than `width` has its whole sequence as one n-gram; a null or
    empty text has none, links with nothing and has no cluster. Keys may be of any type that has an order. Rows without a key take part as all others; rep and component are null only
    where no row of them has a key. Equal rows stay separate rows with the same result. Every text counts as a whole, however long, and no group, however large, is cut.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))

    def digest(batches):
        seen = np.zeros(SKETCH, np.uint32)
        for pdf in batches:
            for a, b, n, g in sets(pdf["text"], width):
                np.add.at(seen, (g & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                yield pd.DataFrame({"key": pdf["key"].iloc[a:b].to_numpy(), "th": pdf["th"].iloc[a:b].to_numpy(), "n": n, "c": _class_ids(n, g), "bits": bitmaps(n, g), "slice": None, "counts": None})
        for k, x in _counted(seen):
            yield pd.DataFrame({"key": [None], "th": None, "n": None, "c": None, "bits": None, "slice": k, "counts": [x]})

    read = settle(base.mapInPandas(digest, "key string, th long, n long, c long, bits binary, slice int, counts binary"), "jaccard-sets")
    rows = read.filter("slice is null").select(F.col("key").cast(kind).alias("key"), "th", "n", "c")
    classes = read.filter("slice is null and n > 0").groupBy("c").agg(F.min(F.col("key").cast(kind)).alias("rep"), F.min("th").alias("th"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    classes = settle(classes, "jaccard-classes")
    order = levels(read.filter("slice is not null").select("slice", "counts"))
    level = spark.sparkContext.broadcast(order.tobytes())
    # counters of more n-grams than this are hot: no other column has more rows
    hot = int(np.ceil(2 * np.log2(max(common.HOT, (rows.agg(F.sum("n")).first()[0] or 0) // common.MANY))))

    def columns(batches):
        order = np.frombuffer(level.value, np.uint8)
        for pdf in batches:
            for _, _, n, g in sets(pdf["text"], width):
                c = _class_ids(n, g)
                at, g = firsts(n, g, order, num, den)
                yield pd.DataFrame({"g": g.view(np.int64), "c": c[at], "hot": order[(g & np.uint64(SKETCH - 1)).astype(np.int64)] >= hot})

    cells = settle(base.select("text").mapInPandas(columns, "g long, c long, hot boolean"), "jaccard-columns")
    column = Window.partitionBy("g")
    cold = cells.filter("not hot").select("g", "c").withColumns({"low": F.min("c").over(column), "high": F.max("c").over(column)}).filter("low < high")
    # more: the column has a third row
    cold = cold.withColumn("more", F.max((F.col("c") > F.col("low")) & (F.col("c") < F.col("high"))).over(column)).drop("high").distinct()  # lies by g already
    if order.max(initial=0) >= hot:  # hot columns are summed where they are, and what they have in common meets them in a broadcast
        cells = cells.filter("hot").select("g", "c").distinct()
        shared = settle(cells.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).filter("low < high").select("g", "low", F.expr("k > 2").alias("more")), "jaccard-shared")
        cold = cold.unionByName(cells.join(F.broadcast(shared), "g") if shared.count() <= BROADCAST_ROWS else meet(settle(cells, "jaccard-hot"), shared, "g"))
    cells = settle(cold, "jaccard-cells")
    sides = classes.select("c", "n", "bits")
    links = _linked(base, _stars(cells, sides, num, den), classes, width, num, den)
    roots = components(links, "jaccard-roots")
    cells = cells.filter("more").select("g", "c")
    failed = None
    for best in (True, False):
        pairs, cells = _rest(cells, roots, sides, num, den, best, failed)  # components only grow: what is one in a column stays so
        if not pairs.take(1):
            break
        more = _linked(base, pairs, classes, width, num, den)
        links = links.unionByName(more)
        roots = components(links, "jaccard-roots")
        if not best:  # all pairs have been looked at
            break
        # where the closest of a row and a component linked, the others of the two are of one component as well; open are columns of rows of which one did not
        failed = pairs.join(more.select(F.col("a").alias("pivot"), F.col("b").alias("c")), ["pivot", "c"], "left_anti")
        failed = settle(failed.select("c").unionByName(failed.select(F.col("pivot").alias("c"))).distinct(), "jaccard-failed")
        if not failed.take(1):
            break

    found = settle(roots.join(classes.select(F.col("c").alias("node"), "rep"), "node"), "jaccard-found")
    least = found.groupBy("root").agg(F.min("rep").alias("component"))
    found = meet(found, least, "root").select(F.col("node").alias("c"), "component", F.col("root").alias("cluster"))
    named = classes.select("c", "rep").join(found, "c", "left").select("c", "rep", F.when(F.col("cluster").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component"), F.coalesce("cluster", "c").alias("cluster"))
    named = settle(named, "jaccard-named")
    some = meet(settle(rows.filter("n > 0"), "jaccard-whole"), named, "c").select("key", "th", "n", "rep", "component", "cluster")
    none = rows.filter("n = 0").select("key", "th", "n", F.col("key").alias("rep"), F.col("key").alias("component"), F.lit(None).cast("long").alias("cluster"))
    return some.unionByName(none)
