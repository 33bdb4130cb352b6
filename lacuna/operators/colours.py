"""Clustering of colours: seeds by oversampling (k-means||), Lloyd's rounds in Columns, and an image of labels.

Centres are a few numbers that the driver holds; a round is one aggregation with partial sums. Rounds end when no centre moves farther than a tolerance. A centre that no colour is nearest to takes the colour that
lies farthest from its own centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of seeding; seeds drawn in a round, times k.
SEEDING, OVER = 5, 2


def _literal(centres: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def nearest(columns: list[str], centres: list[list[float]]) -> Column:
    """(d, label): the squared distance to the nearest centre and its number, the smallest among equals."""
    d = lambda c: sum(((F.col(n) - c[i]) * (F.col(n) - c[i]) for i, n in enumerate(columns)), F.lit(0.0))
    return F.array_min(F.transform(_literal(centres), lambda c, i: F.struct(d(c).alias("d"), i.alias("label"))))


def _sound(px: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        px = px.filter(F.col(c).isNotNull() & ~F.isnan(c))
    return px


def seeds(px: DataFrame, columns: list[str], k: int, seed: int = 1) -> list[list[float]]:
    """k colours far from each other: in each round every colour is drawn with a chance in proportion to its squared distance to those drawn before, by a hash of its position; of what is drawn (about k * OVER a round), weighted by
    the colours nearest to it, those of the greatest weight times squared distance are taken one by one."""
    px = _sound(px, columns)
    by = F.xxhash64("image_id", "x", "y", F.lit(seed))
    drawn = [list(r) for r in px.orderBy(by, "image_id", "x", "y").limit(1).select(*columns).collect()]
    if not drawn:
        return []
    for i in range(SEEDING):
        at = px.withColumn("_d", nearest(columns, drawn)["d"])
        total = at.agg(F.sum("_d")).first()[0]
        if not total:
            break
        chance = F.pmod(F.xxhash64("image_id", "x", "y", F.lit(seed + 1 + i)), F.lit(1 << 30)) / float(1 << 30)
        drawn += [list(r) for r in at.filter(chance < k * OVER * F.col("_d") / total).select(*columns).distinct().limit(8 * k * OVER).collect()]
    weight = {r["label"]: r["n"] for r in px.groupBy(nearest(columns, drawn)["label"].alias("label")).agg(F.count("*").alias("n")).collect()}
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    taken = [max(range(len(drawn)), key=lambda j: (weight.get(j, 0), -j))]
    while len(taken) < min(k, len(drawn)):
        score = lambda j: weight.get(j, 0) * min(apart(drawn[j], drawn[t]) for t in taken)
        best = max(range(len(drawn)), key=lambda j: (score(j), -j))
        if score(best) == 0:
            break
        taken.append(best)
    return [drawn[j] for j in taken]


def lloyd(px: DataFrame, columns: list[str], centres: list[list[float]], rounds: int = 50, tolerance: float = 1e-6) -> tuple[list[list[float]], int]:
    """(centres, rounds taken): each centre in the middle of the colours nearest to it, until none moves farther than `tolerance`, or after `rounds`."""
    px = _sound(px, columns)
    for n in range(rounds):
        at = px.withColumn("_n", nearest(columns, centres))
        found = {r["label"]: r for r in at.groupBy(F.col("_n.label").alias("label")).agg(*[F.avg(c).alias(c) for c in columns]).collect()}  # a row for each centre
        empty = [j for j in range(len(centres)) if j not in found]
        far = [[r[c] for c in columns] for r in at.groupBy(*columns).agg(F.max("_n.d").alias("_d")).orderBy(F.desc("_d"), *columns).limit(len(empty)).collect()] if empty else []
        new = [[found[j][c] for c in columns] if j in found else (far[empty.index(j)] if empty.index(j) < len(far) else old) for j, old in enumerate(centres)]
        moved = max((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for x, y in zip(new, centres, strict=True)), default=0.0)
        centres = new
        if moved <= tolerance:
            return centres, n + 1
    return centres, rounds


def labelled(px: DataFrame, columns: list[str], centres: list[list[float]]) -> DataFrame:
    """px with label: the number of the nearest centre; null where a colour is null or NaN, or without centres."""
    if not centres:
        return px.withColumn("label", F.lit(None).cast("int"))
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return px.withColumn("label", F.when(~bad, nearest(columns, centres)["label"]))
