"""Queries of sources and sinks (IO), histogram strategies (A7-A9, R) and acceptance (V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import colours, hist, integral, patches, priority, search, windows
from ..sources import grid, mha, vts
from .base import R, R3, TX, TX3, TY, TY3, candidates, candidates3, query, rd
from .q_log import LOG, log
from .q_windows import BEFORE, BND, CONF, ENERGY, MATCHES, PAINT, _dsql, change_sql, painted

# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query("io1_image_scan", "SELECT x, y, round(v, 6) + 0.0 AS v FROM px")
def io1(spark, sf):
    return grid.pixels(spark, sf).select("x", "y", rd("v").alias("v"))


@query("io1_mha_round_trip", "SELECT x, y, round(v, 6) + 0.0 AS v FROM px")
def io1_mha(spark, sf):
    """The grid written as one MetaImage file and read again, in slices."""
    px = grid.pixels(spark, sf)
    path = grid.shared_path(spark, "io1").removeprefix("file://") + ".mha"
    height = grid.embeddings(spark, sf).count()
    mha.write_image(px, path, ["v"], 64, height)
    return mha.read_image(spark, path, 0, 64 * 8 * 100).select("x", "y", rd("c0").alias("v"))


@query("io2_mask_scan", "SELECT x, y, x % 5 = 0 AS hole FROM px")
def io2(spark, sf):
    header = grid.mask_header(spark.range(1).select(F.lit("0 255 mask.png").alias("value")))
    levels = grid.pixels(spark, sf).select("x", "y", F.when(F.col("x") % 5 == 0, 0).otherwise(255).alias("level"))
    return grid.apply_mask(grid.pixels(spark, sf), levels, header).select("x", "y", "hole")


@query("io5_structured_grid", "SELECT CAST(vec_id AS INTEGER) AS id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total FROM embeddings", common=False)
def io5_grid(spark, sf):
    """The vectors as the named array of a structured grid's points, written and read again, in slices."""
    e = grid.embeddings(spark, sf)
    path = grid.shared_path(spark, "io5").removeprefix("file://") + ".vts"
    vts.write_points(e.select(F.lit(0).alias("i"), F.col("vec_id").cast("int").alias("j"), F.lit(0).alias("k"), F.col("embedding").cast("array<double>").alias("value")), path, "embedding", 64, (1, e.count(), 1), "Float32")
    back = vts.read_points(spark, path, "embedding", 64 * 4 * 100)
    return back.select(F.col("j").alias("id"), F.size("value").alias("n"), rd(F.aggregate("value", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


LINES = "i AS iter, CAST(i % 64 AS INTEGER) AS {0}x, CAST(i AS INTEGER) AS {0}y, CAST((i + 3) % 64 AS INTEGER) AS {1}x, CAST(i + 7 AS INTEGER) AS {1}y FROM (SELECT vec_id AS i FROM embeddings)"


def _lines(spark, sf):
    i = F.col("vec_id")
    return grid.embeddings(spark, sf).select(i.alias("n"), F.concat_ws(" ", i % 64, i, F.lit(":"), (i + 3) % 64, i + 7).alias("value"))


@query("io3_match_log", "SELECT " + LINES.format("s", "t"), common=False)
def io3(spark, sf):
    return grid.match_log(_lines(spark, sf), "n")


@query("io4_precomputed_neighbors", "SELECT i AS tx, i + 1 AS ty, CAST((i + 4) % 64 AS INTEGER) AS sx, CAST(i + 8 AS INTEGER) AS sy FROM generate_series(0, 9) g(i)", common=False)
def io4(spark, sf):
    """Lookups of targets in a log that names the target first; a target that is missing is an error."""
    log = grid.match_log(_lines(spark, sf), "n", source_first=False).select("tx", "ty", "sx", "sy")
    asked = spark.range(10).select(F.col("id").alias("qx"), (F.col("id") + 1).alias("qy"))
    asked = asked.withColumns({"tx": (F.col("qy") % 64).cast("int"), "ty": F.col("qy").cast("int")})
    got = asked.join(log, ["tx", "ty"], "left").withColumn("sx", F.coalesce("sx", F.raise_error(F.lit("no match for a target")).cast("int")))
    return got.select(F.col("qx").alias("tx"), F.col("qy").alias("ty"), "sx", "sy")


@query("io5_feature_scan", "SELECT CAST(vec_id AS INTEGER) AS id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings", common=False)
def io5(spark, sf):
    return grid.embeddings(spark, sf).select(F.col("vec_id").cast("int").alias("id"), F.size("embedding").alias("n"), rd(F.get("embedding", F.lit(0))).alias("first"))


@query("io8_match_lines", LOG + "SELECT iter, concat_ws(' ', sx, sy, ':', tx, ty) AS value FROM lg")
def io8(spark, sf):
    """The text of a log with a match for each line of the table."""
    return grid.match_lines(log(spark, sf))


@query("io9_fill_order", "SELECT x, y, CAST(CASE WHEN x BETWEEN 15 AND 23 AND y BETWEEN 106 AND 114 THEN 0 WHEN x BETWEEN 26 AND 34 AND y BETWEEN 101 AND 109 THEN 1 END AS INTEGER) AS iter FROM px WHERE hole")
def io9(spark, sf):
    m = spark.createDataFrame(MATCHES, "iter int, tx int, ty int, sx int, sy int")
    near = (F.abs(F.col("x") - F.col("tx")) <= R) & (F.abs(F.col("y") - F.col("ty")) <= R)
    return grid.pixels(spark, sf).filter("hole").join(F.broadcast(m), near, "left").groupBy("x", "y").agg(F.min("iter").alias("iter"))


@query("io12_patch_indicator", "SELECT x, y, CASE WHEN greatest(abs(x - 24), abs(y - 298)) = 4 THEN 'green' WHEN greatest(abs(x - 19), abs(y - 110)) = 4 THEN 'red' END AS color FROM px")
def io12(spark, sf):
    on = lambda cx, cy: F.greatest(F.abs(F.col("x") - cx), F.abs(F.col("y") - cy)) == R
    return grid.pixels(spark, sf).select("x", "y", F.when(on(24, 298), "green").when(on(TX, TY), "red").alias("color"))


@query("io15_top_patch_sheet", "SELECT cx, cy, CAST((rn - 1) % 5 AS INTEGER) AS col, CAST(floor((rn - 1) / 5) AS INTEGER) AS row FROM top")
def io15(spark, sf):
    n = F.col("rn") - 1
    return candidates(grid.pixels(spark, sf)).select("cx", "cy", (n % 5).cast("int").alias("col"), F.floor(n / 5).cast("int").alias("row"))


@query("io16_queue_dump", CONF + "SELECT x, y, round(c, 6) AS priority FROM cf WHERE x <> 30")
def io16(spark, sf):
    q = priority.invalidate(priority.initial_queue(grid.pixels(spark, sf), R), F.col("x") == 30)
    return priority.dump(q).select("x", "y", rd("priority").alias("priority"))


# ---- histogram strategies ------------------------------------------------------------------------------------------

#: Feature pixels, long: x, y, hole, ch, f. raw: the three channels; grad: their gradients' magnitudes; mag: the gradient of the pixel's magnitude.


def wide_features(spark, sf, kind: str) -> tuple[DataFrame, list[str]]:
    """The grid with a feature in each of the columns named."""
    px = grid.pixels3(spark, sf)
    if kind == "mag":
        px = px.withColumn("m", F.sqrt(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2")))
    names = ["m"] if kind == "mag" else ["c0", "c1", "c2"]
    if kind == "raw":
        return px, names

    def slopes(t: DataFrame) -> DataFrame:
        for c in names:
            t = windows.derivative(windows.derivative(t, "x", c, f"{c}x", CYCLIC if kind == "hsv" and c == "c0" else None), "y", c, f"{c}y", CYCLIC if kind == "hsv" and c == "c0" else None)
            t = t.withColumn(f"{c}g", F.sqrt(F.col(f"{c}x") * F.col(f"{c}x") + F.col(f"{c}y") * F.col(f"{c}y")))
        return t

    px = patches.tiled(px, 1, slopes)  # all channels in one pass
    return px, [f"{c}{a}" for c in names for a in "xy"] if kind == "signed" else [f"{c}g" for c in names]


#: The difference of two hues, which lie on a circle.
CYCLIC = lambda a, b: F.least(F.abs(a - b), 1 - F.abs(a - b))


def features(spark, sf, kind: str) -> DataFrame:
    px, cols = wide_features(spark, sf, kind)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.col(c).alias("f")) for i, c in enumerate(cols)]))
    return px.select("x", "y", "hole", pairs.alias("p")).select("x", "y", "hole", "p.ch", "p.f")


def target_part(feats: DataFrame, valid: bool, quadrant: bool = False) -> DataFrame:
    """(dx, dy, ch, f) of the target's valid pixels or of its hole."""
    t = feats.filter(F.col("x").between(TX3 - R3, TX3 + R3) & F.col("y").between(TY3 - R3, TY3 + R3)).withColumns({"dx": F.col("x") - TX3, "dy": F.col("y") - TY3})
    t = t.filter(~F.col("hole") if valid else F.col("hole"))
    return t.withColumn("ch", channel(quadrant)).select("dx", "dy", "ch", "f")


def channel(quadrant: bool) -> Column:
    q = (F.col("dx") >= 0).cast("int") * 2 + (F.col("dy") >= 0).cast("int")
    return F.col("ch") * 4 + q if quadrant else F.col("ch")


def candidate_part(feats: DataFrame, cands: DataFrame, offsets: DataFrame, quadrant: bool = False) -> DataFrame:
    """(cx, cy, ch, f) of the candidates' pixels at the given offsets (dx, dy)."""
    at = cands.select("cx", "cy").join(F.broadcast(offsets.select("dx", "dy").distinct())).withColumns({"x": F.col("cx") + F.col("dx"), "y": F.col("cy") + F.col("dy")})
    return feats.join(F.broadcast(at), ["x", "y"]).withColumn("ch", channel(quadrant)).select("cx", "cy", "ch", "f")


def compare(spark, sf, kind: str, bins: int, side: str = "valid", fixed: tuple[float, float] | None = None, normal: bool = False, outside: bool = True, quadrant: bool = False, target_outside: bool = True) -> DataFrame:
    feats, cands = features(spark, sf, kind), candidates3(grid.pixels3(spark, sf))
    t = target_part(feats, True, quadrant)
    offsets = target_part(feats, side == "valid")
    limits = hist.ranges(t)
    if fixed:
        limits = limits.select("ch", F.lit(fixed[0]).alias("lo"), F.lit(fixed[1]).alias("hi"))
    a = hist.counts(t, limits, bins, target_outside)
    b = hist.counts(candidate_part(feats, cands, offsets, quadrant), limits, bins, outside, ("cx", "cy"))
    if normal:
        a, b = hist.normalised(a), hist.normalised(b, ("cx", "cy"))
    return hist.difference(a, b, cands)


# the oracle's parts: gradients, features, target and candidates
FEATS = {
    "raw": "ft AS (SELECT x, y, hole, 0 AS ch, c0 AS f FROM p3 UNION ALL SELECT x, y, hole, 1, c1 FROM p3 UNION ALL SELECT x, y, hole, 2, c2 FROM p3)",
    "grad": "lg AS (SELECT x, y, hole, 0 AS ch, c0 AS v FROM p3 UNION ALL SELECT x, y, hole, 1, c1 FROM p3 UNION ALL SELECT x, y, hole, 2, c2 FROM p3)",
    "mag": "lg AS (SELECT x, y, hole, 0 AS ch, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS v FROM p3)",
}


def _hue(a: str, b: str) -> str:
    return f"(CASE WHEN ch = 0 THEN least(abs({a} - {b}), 1 - abs({a} - {b})) ELSE {a} - {b} END)"


def _grad_sql(kind: str) -> str:
    if kind == "raw":
        return FEATS["raw"]
    by = lambda s: s.replace("PARTITION BY y", "PARTITION BY ch, y").replace("PARTITION BY x", "PARTITION BY ch, x")
    if kind == "hsv":  # on the first channel, the difference along the circle
        return FEATS["grad"] + f""", nb AS (SELECT *, {", ".join(f"{f}(CASE WHEN NOT hole THEN v END) OVER (PARTITION BY ch, {b} ORDER BY {a}) AS {n}" for a, b, f, n in (("x", "y", "lag", "l"), ("x", "y", "lead", "r"), ("y", "x", "lag", "u"), ("y", "x", "lead", "d")))} FROM lg),
gd AS (SELECT x, y, hole, ch, {", ".join(f"CASE WHEN hole THEN NULL WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {_hue(b, a)} / 2 WHEN {b} IS NOT NULL THEN {_hue(b, 'v')} WHEN {a} IS NOT NULL THEN {_hue('v', a)} ELSE 0 END AS {g}" for a, b, g in (("l", "r", "gx"), ("u", "d", "gy")))} FROM nb),
ft AS (SELECT x, y, hole, ch, sqrt(gx * gx + gy * gy) AS f FROM gd)"""
    return FEATS[kind] + f", gd AS (SELECT x, y, hole, ch, {by(_dsql('x', 'gx'))}, {by(_dsql('y', 'gy'))} FROM lg), ft AS (SELECT x, y, hole, ch, sqrt(gx * gx + gy * gy) AS f FROM gd)"


def compare_sql(kind: str, bins: int, side: str = "valid", fixed: tuple[float, float] | None = None, normal: bool = False, outside: bool = True, quadrant: bool = False, name: str = "", cands: str = "top3") -> str:
    q = " * 4 + CASE WHEN dx >= 0 THEN 2 ELSE 0 END + CASE WHEN dy >= 0 THEN 1 ELSE 0 END" if quadrant else ""
    lim = f"{fixed[0]} AS lo, {fixed[1]} AS hi" if fixed else "min(f) AS lo, max(f) AS hi"
    keep = "" if outside else "WHERE f BETWEEN lo AND hi"
    n = "count(*)::DOUBLE"
    share = "n / sum(n) OVER (PARTITION BY cx, cy)" if normal else "n"
    b = f"CASE WHEN hi = lo THEN 0 ELSE least({bins - 1}, greatest(0, floor((f - lo) / (hi - lo) * {bins}))) END"
    return f"""tv{name} AS (SELECT dx, dy, ch{q} AS ch, f FROM ft, t3 t WHERE ft.x = 7 + dx AND ft.y = 105 + dy AND NOT t.hole),
lm{name} AS (SELECT ch, {lim} FROM tv{name} GROUP BY ch),
cd{name} AS (SELECT cx, cy, ch{q} AS ch, f FROM {cands}, t3 t, ft WHERE ft.x = cx + dx AND ft.y = cy + dy AND {'NOT ' if side == 'valid' else ''}t.hole),
th{name} AS (SELECT 0 AS cx, 0 AS cy, ch, {b} AS bin, {n} AS n FROM tv{name} JOIN lm{name} USING (ch) GROUP BY ALL),
ch{name} AS (SELECT cx, cy, ch, {b} AS bin, {n} AS n FROM cd{name} JOIN lm{name} USING (ch) {keep} GROUP BY ALL),
tn{name} AS (SELECT ch, bin, {share} AS n FROM th{name}), cn{name} AS (SELECT cx, cy, ch, bin, {share} AS n FROM ch{name}),
un{name} AS (SELECT cx, cy, ch, bin, n FROM cn{name} UNION ALL SELECT cx, cy, t.ch, t.bin, -t.n FROM tn{name} t, {cands}), bd{name} AS (SELECT cx, cy, ch, bin, abs(sum(n)) AS n FROM un{name} GROUP BY ALL),
df{name} AS (SELECT cx, cy, sum(n) AS d FROM bd{name} GROUP BY cx, cy)
"""


def _compare(name: str, kind: str, bins: int, **how):
    sql = {k: v for k, v in how.items() if k != "target_outside"}

    @query(name, ", " + _grad_sql(kind) + ", " + compare_sql(kind, bins, **sql) + "SELECT cx, cy, round(d, 6) AS d FROM df")
    def run(spark, sf):
        return compare(spark, sf, kind, bins, **how).select("cx", "cy", rd("d").alias("d"))


_compare("a7_gmh_difference", "grad", 30, normal=True)
_compare("a8_gmh_difference_fast", "grad", 30, normal=True)
_compare("a9_quadrant_histogram_difference", "raw", 10, normal=True, quadrant=True)
_compare("r1_histogram_difference", "raw", 20, fixed=(-0.6, 0.6))
_compare("r4_hole_histogram", "raw", 20, side="hole", normal=True)
_compare("r7_quadrant_histogram", "raw", 10, normal=True, quadrant=True)
_compare("r11_texture", "mag", 30)
_compare("r12_color_texture", "grad", 30, normal=True)
_compare("v15_gmh_energy", "grad", 40, normal=True)
_compare("v16_histogram_energy", "raw", 20, fixed=(-0.6, 0.6), normal=True)
_compare("v18_hole_histogram_energy", "raw", 20, side="hole", fixed=(-0.6, 0.6), normal=True)


def _compare_all(name: str, kind: str, bins: int, quadrant: bool = False, **how):
    """Every source patch by its histograms, from integral images; the ranks go by differences of nine digits."""

    @query(name, ", " + _grad_sql(kind) + ", " + compare_sql(kind, bins, quadrant=quadrant, cands="s3", **how) + "SELECT cx, cy, round(d, 6) AS d, CAST(row_number() OVER (ORDER BY round(df.d, 9), cy, cx) AS INTEGER) AS rn FROM df")
    def run(spark, sf):
        px, names = wide_features(spark, sf, kind)
        parts = integral.target_parts(px, names, TX3, TY3, R3, bins, quadrant, how.get("fixed"))
        got = integral.differences(px, names, parts, R3, bins, how.get("normal", False)).withColumn("s", F.round("d", 9))
        return search.ranked(got, ["cy", "cx"], None, "s").select("cx", "cy", rd("d").alias("d"), F.col("rn").cast("int").alias("rn"))


_compare_all("r1_histogram_difference_of_all", "raw", 20, fixed=(-0.6, 0.6))
_compare_all("r7_quadrant_histogram_of_all", "raw", 10, quadrant=True, normal=True)
_compare_all("r12_color_texture_of_all", "grad", 30, normal=True)


@query("r2_histogram_correlation", ", " + FEATS["raw"] + ", " + compare_sql("raw", 20, fixed=(-0.6, 0.6)) + """, ev AS (SELECT cx, cy, c.i AS ch, b.i AS bin FROM top3, generate_series(0, 2) c(i), generate_series(0, 19) b(i)),
j AS (SELECT e.cx, e.cy, coalesce(t.n, 0) AS t, coalesce(s.n, 0) AS s FROM ev e LEFT JOIN tn t ON t.ch = e.ch AND t.bin = e.bin LEFT JOIN cn s ON s.cx = e.cx AND s.cy = e.cy AND s.ch = e.ch AND s.bin = e.bin)
SELECT cx, cy, round(corr(t, s), 6) AS d FROM j GROUP BY cx, cy""")
def r2(spark, sf):
    feats, cands = features(spark, sf, "raw"), candidates3(grid.pixels3(spark, sf))
    t = target_part(feats, True)
    limits = hist.ranges(t).select("ch", F.lit(-0.6).alias("lo"), F.lit(0.6).alias("hi"))
    b = hist.counts(candidate_part(feats, cands, t), limits, 20, True, ("cx", "cy"))
    return hist.correlation(hist.counts(t, limits, 20), b, cands, 20, 3).select("cx", "cy", rd("d").alias("d"))


@query("r3_new_colors", """, w AS (SELECT x, y, hole, floor((c0 + 1) * 5)::INT * 100 + floor((c1 + 1) * 5)::INT * 10 + floor((c2 + 1) * 5)::INT AS bin FROM p3),
t AS (SELECT DISTINCT bin FROM w WHERE x BETWEEN 5 AND 9 AND y BETWEEN 103 AND 107 AND NOT hole),
s AS (SELECT DISTINCT cx, cy, bin FROM top3, t3, w WHERE t3.hole AND w.x = cx + dx AND w.y = cy + dy)
SELECT cx, cy, count(*) FILTER (WHERE bin NOT IN (SELECT bin FROM t))::DOUBLE AS d FROM s GROUP BY cx, cy""")
def r3(spark, sf):
    px = grid.pixels3(spark, sf)
    part = lambda c: F.floor((F.col(c) + 1) * 5)
    f = px.select("x", "y", "hole", F.lit(0).alias("ch"), (part("c0") * 100 + part("c1") * 10 + part("c2")).alias("f"))
    cands = candidates3(px)
    s = candidate_part(f, cands, target_part(f, False)).select("cx", "cy", F.col("f").alias("bin"))
    return hist.new_bins(target_part(f, True).select(F.col("f").alias("bin")), s, cands).select("cx", "cy", "d")


def _dual(name: str, quadrant: bool = False, fixed=None):
    """n_valid times the valid parts' difference and n_hole times that of target's valid and candidate's hole part."""
    sql = ", " + FEATS["raw"] + ", " + compare_sql("raw", 10, fixed=fixed, normal=True, quadrant=quadrant) + ", " + compare_sql("raw", 10, side="hole", fixed=fixed, normal=True, name="h")

    @query(name, sql + "SELECT cx, cy, round((SELECT count(*) FROM t3 WHERE NOT hole) * df.d + (SELECT count(*) FROM t3 WHERE hole) * dfh.d, 5) AS d FROM df JOIN dfh USING (cx, cy)")
    def run(spark, sf):
        a = compare(spark, sf, "raw", 10, fixed=fixed, normal=True, quadrant=quadrant)
        b = compare(spark, sf, "raw", 10, side="hole", fixed=fixed, normal=True).withColumnRenamed("d", "e")
        t = patches.patch(grid.pixels3(spark, sf), TX3, TY3, R3).agg(F.count_if(~F.col("hole")).alias("nv"), F.count_if("hole").alias("nh"))
        return a.join(b, ["cx", "cy"]).join(F.broadcast(t)).select("cx", "cy", rd(F.col("nv") * F.col("d") + F.col("nh") * F.col("e"), 5).alias("d"))


_dual("r5_dual_histogram", fixed=(-0.6, 0.6))
_dual("r6_adaptive_dual_histogram")
_dual("r8_adaptive_dual_quadrant_histogram", True)


@query("r9_strategy_selection", ", " + FEATS["raw"] + ", " + compare_sql("raw", 10, fixed=(-0.6, 0.6), normal=True) + ", " + compare_sql("raw", 10, side="hole", fixed=(-0.6, 0.6), normal=True, name="h") + """, vv AS (SELECT var_samp(c0) + var_samp(c1) + var_samp(c2) AS v FROM t3 WHERE NOT hole),
qh AS (SELECT CASE WHEN dx >= 0 THEN 2 ELSE 0 END + CASE WHEN dy >= 0 THEN 1 ELSE 0 END AS q, ch, least(9, greatest(0, floor((f + 0.6) / 1.2 * 10))) AS bin, count(*) AS n FROM tv GROUP BY ALL),
qn AS (SELECT q, ch, bin, n / sum(n) OVER (PARTITION BY q) AS n FROM qh), qq AS (SELECT DISTINCT q FROM qn),
qd AS (SELECT a.q AS a, b.q AS b, u.ch, u.bin, abs(coalesce(sum(CASE WHEN u.q = a.q THEN u.n END), 0) - coalesce(sum(CASE WHEN u.q = b.q THEN u.n END), 0)) AS d FROM qq a JOIN qq b ON a.q < b.q JOIN qn u ON u.q = a.q OR u.q = b.q GROUP BY a.q, b.q, u.ch, u.bin),
qm AS (SELECT coalesce(max(d), 0) AS m FROM (SELECT sum(d) AS d FROM qd GROUP BY a, b)),
dd AS (SELECT cx, cy, rn, (SELECT count(*) FROM t3 WHERE NOT hole) * df.d + (SELECT count(*) FROM t3 WHERE hole) * dfh.d AS d FROM df JOIN dfh USING (cx, cy) JOIN top3 USING (cx, cy))
SELECT cx, cy FROM dd, vv, qm ORDER BY CASE WHEN v < 1 OR m < 0.5 THEN round(dd.d, 9) ELSE 0 END, rn LIMIT 1""")
def r9(spark, sf):
    """The dual histogram's choice where the target is even (its quadrants' histograms differ by less than a half, or its variance is low), else the first stage's."""
    px = grid.pixels3(spark, sf)
    t = patches.patch(px, TX3, TY3, R3).agg(F.count_if(~F.col("hole")).alias("nv"), F.count_if("hole").alias("nh"), sum((F.var_samp(F.when(~F.col("hole"), F.col(c))) for c in ("c0", "c1", "c2")), F.lit(0.0)).alias("var"))
    t = t.join(F.broadcast(hist.greatest_between(target_part(features(spark, sf, "raw"), True), (-0.6, 0.6), 10)))
    a = compare(spark, sf, "raw", 10, fixed=(-0.6, 0.6), normal=True)
    b = compare(spark, sf, "raw", 10, side="hole", fixed=(-0.6, 0.6), normal=True).withColumnRenamed("d", "e")
    both = a.join(b, ["cx", "cy"]).join(candidates3(px).select("cx", "cy", "rn"), ["cx", "cy"]).join(F.broadcast(t))
    both = both.withColumn("s", F.when((F.col("var") < 1) | (F.col("most") < 0.5), F.round(F.col("nv") * F.col("d") + F.col("nh") * F.col("e"), 9)).otherwise(0.0))
    return search.best(both, ["rn"], None, "s").select("cx", "cy")


def _choice_sql() -> str:
    out = BND + BEFORE
    for k in (1, 2, 3):
        out += f""", m{k} AS (SELECT cx - 19 AS mx, cy - 110 AS my_ FROM top WHERE rn = {k}),
pn{k} AS (SELECT p.x, p.y, CASE WHEN p.hole AND p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114 THEN s.v ELSE p.v END AS v, p.hole AND NOT (p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114) AS hole FROM px p JOIN m{k} ON true LEFT JOIN px s ON s.x = p.x + mx AND s.y = p.y + my_)""" + change_sql(f"pn{k}", f"cg{k}")
    every = " UNION ALL ".join(f"SELECT {k} AS rn, avg(c) AS e FROM cg{k} JOIN bn USING (x, y)" for k in (1, 2, 3))
    return out + f", ee AS ({every}) SELECT cx, cy, round(e, 6) AS energy FROM ee JOIN top USING (rn) ORDER BY e, rn LIMIT 1"


@query("r10_introduced_energy_choice", _choice_sql())
def r10(spark, sf):
    """Of the three best, the one whose paint changes the gradients on the mask's boundary least."""
    px = grid.pixels(spark, sf)
    out = None
    for c in candidates(px, 3).collect():  # three rows
        new = patches.paint(px, TX, TY, c["cx"], c["cy"], R)
        one = windows.mask_boundary_energy(px, new).select(F.lit(c["cx"]).alias("cx"), F.lit(c["cy"]).alias("cy"), F.lit(c["rn"]).alias("rn"), "energy")
        out = one if out is None else out.unionByName(one)
    return search.best(out, ["rn"], None, "energy").select("cx", "cy", rd("energy").alias("energy"))


@query("r13_sort_by_gmh", ", " + _grad_sql("grad") + ", " + compare_sql("grad", 30, normal=True) + "SELECT cx, cy, CAST(row_number() OVER (ORDER BY round(df.d, 9), top3.rn) AS INTEGER) AS rn FROM df JOIN top3 USING (cx, cy)")
def r13(spark, sf):
    first = candidates3(grid.pixels3(spark, sf)).select("cx", "cy", F.col("rn").alias("rn1"))
    got = compare(spark, sf, "grad", 30, normal=True).withColumn("d", F.round("d", 9)).join(first, ["cx", "cy"])
    return search.numbered(got, ["d", "rn1"]).select("cx", "cy", "rn")


def _lidar(name: str, kind: str, ranked: bool = False):
    """Colour gradients' histograms and three times those of depth, here the pixel's magnitude."""
    sql = ", " + _grad_sql(kind) + ", " + compare_sql(kind, 30, normal=True) + ", " + _grad_sql("mag").replace("lg AS", "lgm AS").replace("FROM lg)", "FROM lgm)").replace("gd AS", "gdm AS").replace("FROM gd)", "FROM gdm)").replace("ft AS", "ftm AS") + ", " + compare_sql("mag", 30, normal=True, name="m").replace("FROM ft, t3 t WHERE ft.x", "FROM ftm ft, t3 t WHERE ft.x").replace("top3, t3 t, ft WHERE", "top3, t3 t, ftm ft WHERE")
    tail = "SELECT cx, cy, round(df.d + 3 * dfm.d, 6) AS d FROM df JOIN dfm USING (cx, cy)"
    if ranked:
        tail = "SELECT cx, cy, CAST(row_number() OVER (ORDER BY round(df.d + 3 * dfm.d, 9), rn) AS INTEGER) AS rn FROM df JOIN dfm USING (cx, cy) JOIN top3 USING (cx, cy)"

    @query(name, sql + tail)
    def run(spark, sf):
        a, b = compare(spark, sf, kind, 30, normal=True), compare(spark, sf, "mag", 30, normal=True).withColumnRenamed("d", "e")
        got = a.join(b, ["cx", "cy"]).withColumn("d", F.col("d") + 3 * F.col("e"))
        if not ranked:
            return got.select("cx", "cy", rd("d").alias("d"))
        first = candidates3(grid.pixels3(spark, sf)).select("cx", "cy", F.col("rn").alias("rn1"))
        return search.numbered(got.withColumn("d", F.round("d", 9)).join(first, ["cx", "cy"]), ["d", "rn1"]).select("cx", "cy", "rn")


_lidar("r14_lidar_rgb_texture", "grad")
_lidar("r15_lidar_hsv_texture", "hsv")  # hues on a circle
_lidar("r16_lidar_texture_sorted", "hsv", True)


def _signed_sql() -> str:
    by = lambda s: s.replace("PARTITION BY y", "PARTITION BY ch, y").replace("PARTITION BY x", "PARTITION BY ch, x")
    return FEATS["grad"] + f", gd AS (SELECT x, y, hole, ch, {by(_dsql('x', 'gx'))}, {by(_dsql('y', 'gy'))} FROM lg), ft AS (SELECT x, y, hole, 2 * ch AS ch, abs(gx) AS f FROM gd UNION ALL SELECT x, y, hole, 2 * ch + 1, abs(gy) FROM gd)"


@query("r17_lidar_derivatives", ", " + _signed_sql() + ", " + compare_sql("signed", 30, normal=True) + "SELECT cx, cy, round(d, 6) AS d FROM df")
def r17(spark, sf, ref_quirk: bool = False):
    """Histograms of the absolute derivatives of all channels; ref_quirk: the candidates' keep their signs."""
    feats = features(spark, sf, "signed")
    plain = feats.withColumn("f", F.abs("f"))
    cands = candidates3(grid.pixels3(spark, sf))
    t = target_part(plain, True)
    limits = hist.ranges(t)
    a = hist.normalised(hist.counts(t, limits, 30))
    b = hist.normalised(hist.counts(candidate_part(feats if ref_quirk else plain, cands, t), limits, 30, True, ("cx", "cy")), ("cx", "cy"))
    return hist.difference(a, b, cands).select("cx", "cy", rd("d").alias("d"))


# ---- acceptance ----------------------------------------------------------------------------------------------------


def _accept(name: str, energy: str, threshold: str, where: str = "true"):
    """One row for a candidate: its energy, and whether it is accepted; energies are aggregates over the paired pixels (thole, tv, sv)."""

    @query(name, f", e AS (SELECT cx, cy, {energy} AS e FROM co WHERE {where} GROUP BY cx, cy, d) SELECT cx, cy, round(e, 6) + 0.0 AS energy, e {threshold} AS accepted FROM e")
    def run(spark, sf):
        px = grid.pixels(spark, sf)
        top = candidates(px).select("cx", "cy", "d")
        co = patches.correspondence(px, top, TX, TY, R).withColumnsRenamed({"t_v": "tv", "s_v": "sv"}).join(F.broadcast(top), ["cx", "cy"])
        got = co.filter(where).groupBy("cx", "cy", "d").agg(F.expr(energy).alias("e"))
        return got.select("cx", "cy", rd("e").alias("energy"), F.expr(f"e {threshold}").alias("accepted"))


TV, TH, SV, SH = "CASE WHEN NOT thole THEN tv END", "CASE WHEN thole THEN tv END", "CASE WHEN NOT thole THEN sv END", "CASE WHEN thole THEN sv END"
_accept("v1_always_accept", "min(d)", "IS NOT NULL")
_accept("v2_never_accept", "min(d)", "IS NULL")
_accept("v5_average_difference", f"abs(avg({TV}) - avg({SH}))", "< 0.01")
_accept("v6_full_patch_average", "abs(avg(tv) - avg(sv))", "IS NOT NULL")
_accept("v7_full_patch_variance", "abs(var_samp(tv) - var_samp(sv))", "IS NOT NULL")
_accept("v8_source_target_variance", f"abs(var_samp({TV}) - var_samp({SH}))", "< 0.004")
_accept("v9_intra_source_patch", f"abs(var_samp({SV}) - var_samp({SH}))", "< 0.004")
_accept("v13_source_hole_target_valid", f"abs(avg({TV}) - avg({SH})) + abs(var_samp({TV}) - var_samp({SH}))", "< 0.02")
_accept("v14_source_valid_target_valid", f"abs(avg({TV}) - avg({SV})) + abs(var_samp({TV}) - var_samp({SV}))", "< 0.02")
_accept("v21_correlation", f"avg((tv - sv * 0) * sv) / (stddev_samp(tv) * stddev_samp(sv))", "< 0.5", "NOT thole")
_accept("v21_correlation_centred", "corr(tv, sv)", "< 0.5", "NOT thole")
_accept("v22_hole_size", "avg(CASE WHEN thole THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)", "< 0.15")
_accept("v23_score_threshold", "min(d)", "< 0.018")
_accept("v24_average_and_variance", f"avg({TV}) + var_samp({TV})", "< 1")
_accept("v26_count_valid", f"count({TV}) * CAST(1 AS DOUBLE)", "> 40")
_accept("v27_range_of_valid", f"max({TV}) - min({TV})", "> 0")


@query("v3_and", f", e AS (SELECT cx, cy, abs(avg({TV}) - avg({SH})) AS a, d FROM co GROUP BY cx, cy, d) SELECT cx, cy, a < 0.02 AND d < 0.018 AS accepted FROM e")
def v3(spark, sf):
    return _parts(spark, sf).select("cx", "cy", (F.col("p1") & F.col("p2")).alias("accepted"))


@query("v4_composite", f", e AS (SELECT cx, cy, abs(avg({TV}) - avg({SH})) AS a, d FROM co GROUP BY cx, cy, d) SELECT cx, cy, cx < 20 OR (a < 0.02 AND d < 0.018) AS accepted FROM e")
def v4(spark, sf):
    """Any override, or all that are required."""
    return _parts(spark, sf).select("cx", "cy", ((F.col("cx") < 20) | (F.col("p1") & F.col("p2"))).alias("accepted"))


def _parts(spark, sf) -> DataFrame:
    px = grid.pixels(spark, sf)
    top = candidates(px).select("cx", "cy", "d")
    co = patches.correspondence(px, top, TX, TY, R).withColumnsRenamed({"t_v": "tv", "s_v": "sv"}).join(F.broadcast(top), ["cx", "cy"])
    return co.groupBy("cx", "cy", "d").agg(F.expr(f"abs(avg({TV}) - avg({SH})) < 0.02").alias("p1")).withColumn("p2", F.col("d") < 0.018)


RIND = ", rd AS (SELECT dx, dy FROM tp WHERE NOT hole AND 19 + dx BETWEEN 17 AND 32 AND 110 + dy BETWEEN 97 AND 122), cr AS (SELECT c.* FROM co c JOIN rd USING (dx, dy))\n"


def _rind(name: str, energy: str, threshold: str):
    @query(name, RIND + f", e AS (SELECT cx, cy, {energy} AS e FROM cr GROUP BY cx, cy) SELECT cx, cy, round(e, 6) + 0.0 AS energy, e < {threshold} AS accepted FROM e")
    def run(spark, sf):
        px = grid.pixels(spark, sf)
        band = windows.rind(px, 3).filter("rind").select((F.col("x") - TX).alias("dx"), (F.col("y") - TY).alias("dy"))
        co = patches.correspondence(px, candidates(px).select("cx", "cy"), TX, TY, R).withColumnsRenamed({"t_v": "tv", "s_v": "sv"})
        got = co.join(band, ["dx", "dy"], "left_semi").groupBy("cx", "cy").agg(F.expr(energy).alias("e"))
        return got.select("cx", "cy", rd("e").alias("energy"), F.expr(f"e < {threshold}").alias("accepted"))


_rind("v10_dilated_variance", "abs(var_samp(tv) - var_samp(sv))", "0.004")
_rind("v11_dilated_source_valid_target_valid", "abs(avg(tv) - avg(sv))", "0.01")


@query("v12_dilated_source_hole_target_valid", """, inn AS (SELECT dx, dy FROM tp WHERE hole AND NOT (19 + dx BETWEEN 22 AND 27 AND 110 + dy BETWEEN 102 AND 117)), outr AS (SELECT dx, dy FROM tp WHERE NOT hole AND 19 + dx BETWEEN 18 AND 31),
e AS (SELECT cx, cy, abs(avg(sv) FILTER (WHERE (dx, dy) IN (SELECT (dx, dy) FROM inn)) - avg(tv) FILTER (WHERE (dx, dy) IN (SELECT (dx, dy) FROM outr))) AS e FROM co GROUP BY cx, cy)
SELECT cx, cy, round(e, 6) AS energy, e < 0.02 AS accepted FROM e""")
def v12(spark, sf):
    """The source inside the hole's edge (the hole without its erosion by two) against the target outside it (the dilation by two)."""
    px = windows.eroded(windows.rind(grid.pixels(spark, sf), 2, "outer"), 2)
    ring = px.select((F.col("x") - TX).alias("dx"), (F.col("y") - TY).alias("dy"), "outer", (F.col("hole") & ~F.col("eroded")).alias("inner"))
    base = grid.pixels(spark, sf)
    co = patches.correspondence(base, candidates(base).select("cx", "cy"), TX, TY, R).join(ring, ["dx", "dy"])
    e = F.abs(F.avg(F.when(F.col("inner"), F.col("s_v"))) - F.avg(F.when(F.col("outer"), F.col("t_v"))))
    return co.groupBy("cx", "cy").agg(e.alias("e")).select("cx", "cy", rd("e").alias("energy"), (F.col("e") < 0.02).alias("accepted"))


@query("v17_compressed_histogram", ", " + FEATS["raw"] + """, tv AS (SELECT ch, f FROM ft, t3 t WHERE ft.x = 7 + dx AND ft.y = 105 + dy AND NOT t.hole), cd AS (SELECT cx, cy, ch, f FROM top3, t3 t, ft WHERE ft.x = cx + dx AND ft.y = cy + dy AND NOT t.hole),
l1 AS (SELECT ch, min(f) AS a, max(f) AS b FROM tv GROUP BY ch), l2 AS (SELECT cx, cy, ch, min(f) AS a, max(f) AS b FROM cd GROUP BY cx, cy, ch), lm AS (SELECT cx, cy, ch, least(l1.a, l2.a) AS lo, greatest(l1.b, l2.b) AS hi FROM l2 JOIN l1 USING (ch)),
h AS (SELECT cx, cy, ch, least(19, floor((f - lo) / (hi - lo) * 20)) AS bin, 1.0 / count(*) OVER (PARTITION BY cx, cy, ch) AS n FROM cd JOIN lm USING (cx, cy, ch) UNION ALL SELECT cx, cy, ch, least(19, floor((f - lo) / (hi - lo) * 20)), -1.0 / count(*) OVER (PARTITION BY cx, cy, ch) FROM tv JOIN lm USING (ch)),
b AS (SELECT cx, cy, ch, bin, abs(sum(n)) AS n FROM h GROUP BY ALL) SELECT cx, cy, round(sum(n), 6) AS energy FROM b GROUP BY cx, cy""")
def v17(spark, sf):
    """20 bins over the joint range of both sides, for each candidate and channel."""
    feats, cands = features(spark, sf, "raw"), candidates3(grid.pixels3(spark, sf))
    t = target_part(feats, True)
    c = candidate_part(feats, cands, t)
    lim = c.groupBy("cx", "cy", "ch").agg(F.min("f").alias("a"), F.max("f").alias("b")).join(F.broadcast(hist.ranges(t)), "ch")
    lim = lim.select("cx", "cy", "ch", F.least("a", "lo").alias("lo"), F.greatest("b", "hi").alias("hi"))
    both = c.withColumn("side", F.lit(1.0)).unionByName(cands.select("cx", "cy").join(F.broadcast(t.select("ch", "f"))).withColumn("side", F.lit(-1.0)))
    binned = both.join(lim, ["cx", "cy", "ch"]).withColumn("bin", hist.bin_of(F.col("f"), F.col("lo"), F.col("hi"), 20))
    n = binned.groupBy("cx", "cy", "ch", "side", "bin").agg(F.count("*").alias("k"))
    n = n.join(n.groupBy("cx", "cy", "ch", "side").agg(F.sum("k").alias("t")), ["cx", "cy", "ch", "side"])
    d = n.groupBy("cx", "cy", "ch", "bin").agg(F.abs(F.sum(F.col("side") * F.col("k") / F.col("t"))).alias("n"))
    return d.groupBy("cx", "cy").agg(rd(F.sum("n")).alias("energy"))


def _quadrants(spark, sf) -> DataFrame:
    """(cx, cy, q, energy, covered): each quadrant's normalised histogram difference, 0 where under a fifth of the target's quadrant is valid."""
    feats, cands = features(spark, sf, "raw").filter("ch = 0"), candidates3(grid.pixels3(spark, sf))
    t = target_part(feats, True, True)
    limits = F.broadcast(hist.ranges(t))
    a, b = hist.counts(t, limits, 20), hist.counts(candidate_part(feats, cands, target_part(feats, True), True), limits, 20, True, ("cx", "cy"))
    a, b = hist.normalised(a, (), True), hist.normalised(b, ("cx", "cy"), True)
    u = cands.select("cx", "cy").join(F.broadcast(a)).select("cx", "cy", "ch", "bin", "n").unionByName(b.select("cx", "cy", "ch", "bin", (-F.col("n")).alias("n")))
    d = u.groupBy("cx", "cy", "ch", "bin").agg(F.abs(F.sum("n")).alias("n")).groupBy("cx", "cy", "ch").agg(F.sum("n").alias("e"))
    share = t.groupBy("ch").agg((F.count("*") / F.when(F.col("ch") == 3, 9).when(F.col("ch") == 0, 4).otherwise(6)).alias("covered"))
    return d.join(F.broadcast(share), "ch").select("cx", "cy", F.col("ch").alias("q"), F.when(F.col("covered") < 0.2, 0.0).otherwise(F.col("e")).alias("energy"))


QUAD = ", " + FEATS["raw"].replace("UNION ALL SELECT x, y, hole, 1, c1 FROM p3 UNION ALL SELECT x, y, hole, 2, c2 FROM p3", "") + ", " + compare_sql("raw", 20, quadrant=True).replace("AS (SELECT ch, bin, n AS n FROM th)", "AS (SELECT ch, bin, n / sum(n) OVER (PARTITION BY ch) AS n FROM th)").replace("AS (SELECT cx, cy, ch, bin, n AS n FROM ch)", "AS (SELECT cx, cy, ch, bin, n / sum(n) OVER (PARTITION BY cx, cy, ch) AS n FROM ch)") + ", cov AS (SELECT ch, count(*) / CASE ch WHEN 3 THEN 9.0 WHEN 0 THEN 4.0 ELSE 6.0 END AS c FROM tv GROUP BY ch), qd AS (SELECT cx, cy, ch AS q, CASE WHEN c < 0.2 THEN 0 ELSE sum(n) END AS e FROM bd JOIN cov USING (ch) GROUP BY cx, cy, ch, c)\n"


@query("v19_quadrant_histogram", QUAD + "SELECT cx, cy, CAST(q AS INTEGER) AS q, round(e, 6) AS energy, e < 1.5 AS accepted FROM qd")
def v19(spark, sf):
    return _quadrants(spark, sf).select("cx", "cy", "q", rd("energy").alias("energy"), (F.col("energy") < 1.5).alias("accepted"))


@query("v20_all_quadrants", QUAD + "SELECT cx, cy, bool_and(e < 1.5) AS accepted FROM qd GROUP BY cx, cy")
def v20(spark, sf):
    return _quadrants(spark, sf).groupBy("cx", "cy").agg(F.every(F.col("energy") < 1.5).alias("accepted"))


#: Clusters of colours, and rounds.
CLUSTERS, ROUNDS = 5, 4


def _clusters_sql() -> str:
    near = "SELECT x, y, c, d FROM (SELECT p.x, p.y, m.c, (p.c0 - m.c0) * (p.c0 - m.c0) + (p.c1 - m.c1) * (p.c1 - m.c1) + (p.c2 - m.c2) * (p.c2 - m.c2) AS d FROM p3 p, k{0} m) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY d, c) = 1"
    out = f", k0 AS (SELECT row_number() OVER (ORDER BY md5(concat_ws(',', x, y))) - 1 AS c, c0, c1, c2 FROM p3 QUALIFY c < {CLUSTERS})"
    for i in range(ROUNDS):
        out += f", l{i} AS MATERIALIZED ({near.format(i)}), k{i + 1} AS MATERIALIZED (SELECT l.c, avg(p.c0) AS c0, avg(p.c1) AS c1, avg(p.c2) AS c2 FROM p3 p JOIN l{i} l USING (x, y) GROUP BY l.c)"
    return out + f" SELECT x, y, CAST(c AS INTEGER) AS label, round(d, 6) + 0.0 AS d FROM ({near.format(ROUNDS)})"


@query("v28_colour_clusters", _clusters_sql())
def v28(spark, sf):
    """The image of labels after some rounds from the colours of the least hash."""
    px, names = grid.pixels3(spark, sf), ["c0", "c1", "c2"]
    first = px.orderBy(F.md5(F.concat_ws(",", "x", "y").cast("binary"))).limit(CLUSTERS).select(*names).collect()
    centres, _ = colours.lloyd(px, names, [list(r) for r in first], ROUNDS, 0.0)
    return colours.labelled(px, names, centres).select("x", "y", "label", rd(colours.nearest(names, centres)["d"]).alias("d"))


@query("v23_boundary_energy", PAINT + ENERGY.replace("px p", "n p").replace("px q", "n q") + "SELECT round(avg(e), 6) AS energy, avg(e) < 100 AS accepted FROM e WHERE h > 0")
def v23(spark, sf):
    e = windows.boundary_energy(painted(grid.pixels(spark, sf)))
    return e.select(rd("energy").alias("energy"), (F.col("energy") < 100).alias("accepted"))


@query("v23_patch_distance", "SELECT cx, cy, round(sqrt((cx - 19) ** 2 + (cy - 110) ** 2), 6) AS energy, sqrt((cx - 19) ** 2 + (cy - 110) ** 2) < 100 AS accepted FROM top")
def v23d(spark, sf):
    d = F.hypot(F.col("cx") - TX, F.col("cy") - TY)
    return candidates(grid.pixels(spark, sf)).select("cx", "cy", rd(d).alias("energy"), (d < 100).alias("accepted"))

