"""Queries of enumeration (P), windows (W), priorities (Q) and painting (U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as fn
from ..operators import delta, loop, many, paint, patches, points, priority, search, windows
from ..sources import grid
from .base import R, TX, TY, candidates, query, rd, scores

px1 = grid.pixels


def _flat(name: str, sql: str, pred):
    @query(name, f"SELECT x, y FROM px WHERE {sql}")
    def run(spark, sf, pred=pred):
        return px1(spark, sf).filter(pred()).select("x", "y")


_flat("p1_pixels_satisfying", "x BETWEEN 5 AND 30 AND y BETWEEN 50 AND 90 AND v > 0.1 AND NOT hole", lambda: grid.rect(5, 30, 50, 90) & (F.col("v") > 0.1) & ~F.col("hole"))
_flat("p2_greater_than", "v > 0.2", lambda: F.col("v") > 0.2)
_flat("p3_greater_or_equal", "v >= 0.2", lambda: F.col("v") >= 0.2)
_flat("p4_full_image_search", "true", lambda: F.lit(True))


@query("p5_neighborhood_search", "SELECT cx AS x, cy AS y FROM src WHERE cx BETWEEN 19 - 8 AND 19 + 8 AND cy BETWEEN 110 - 8 AND 110 + 8 UNION ALL SELECT cx, cy FROM src WHERE cx BETWEEN 30 - 8 AND 30 + 8 AND cy BETWEEN 105 - 8 AND 105 + 8")
def p5(spark, sf):
    """Candidates about two targets, joined by tiles."""
    src = patches.sources(px1(spark, sf), R).select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    q = spark.range(2).select(F.when(F.col("id") == 0, 19).otherwise(30).alias("qx"), F.when(F.col("id") == 0, 110).otherwise(105).alias("qy"))
    return search.band_join(src, q, 8).select("x", "y")


@query("p6_first_valid", "SELECT cx, cy FROM top ORDER BY rn LIMIT 1")
def p6(spark, sf):
    return candidates(px1(spark, sf)).filter("rn = 1").select("cx", "cy")


@query("p7_first_of_range", "SELECT cx, cy FROM src ORDER BY cy, cx LIMIT 1")
def p7(spark, sf):
    return patches.sources(px1(spark, sf), R).orderBy("cy", "cx").limit(1).select("cx", "cy")


@query("p8_pass_through", "SELECT cx, cy FROM top")
def p8(spark, sf):
    return candidates(px1(spark, sf)).select("cx", "cy")


STATUS = """, b AS (SELECT p.x, p.y, count(*) AS n, count(*) FILTER (WHERE q.hole) AS h FROM px p, o4 o, px q WHERE q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY ALL)
SELECT x, y, n = 81 AS inside, h = 0 AS fully_valid, CASE WHEN n = 81 AND h = 0 THEN 'SOURCE_NODE' WHEN h < n THEN 'TARGET_NODE' ELSE 'INVALID' END AS status FROM b"""


def _status(name):
    @query(name, STATUS)
    def run(spark, sf):
        return patches.with_status(px1(spark, sf), R).select("x", "y", "inside", "fully_valid", "status")


for _n in ("p11_initialize_from_mask", "p14_vertex_initializer", "p15_patch_status"):
    _status(_n)


@query("p12_fill_status_map", "SELECT x, y, NOT hole AS filled FROM px")
def p12(spark, sf):
    return px1(spark, sf).select("x", "y", (~F.col("hole")).alias("filled"))


BND = ", bn AS (SELECT DISTINCT p.x, p.y FROM px p, o1 o, px q WHERE NOT p.hole AND q.hole AND q.x = p.x + o.dx AND q.y = p.y + o.dy)\n"


@query("p16_boundary", BND + "SELECT x, y FROM bn")
def p16(spark, sf):
    return patches.boundary(px1(spark, sf)).select("x", "y")


CONF = BND + """, cf AS (SELECT b.x, b.y, count(*) FILTER (WHERE NOT q.hole)::DOUBLE / count(*) AS c FROM bn b, o4 o, px q WHERE q.x = b.x + o.dx AND q.y = b.y + o.dy GROUP BY ALL)
"""


def _conf(name):
    @query(name, CONF + "SELECT x, y, round(c, 6) AS priority FROM cf")
    def run(spark, sf):
        return priority.initial_queue(px1(spark, sf), R).select("x", "y", rd("priority").alias("priority"))


for _n in ("p13_initialize_priority", "q2_confidence"):
    _conf(_n)


@query("p17_discover_target", "SELECT dx, dy, round(v, 6) + 0.0 AS v FROM tp WHERE NOT hole")
def p17(spark, sf):
    return patches.target_values(px1(spark, sf), TX, TY, R).select("dx", "dy", rd("t_v").alias("v"))


@query("p18_vectorised_patch", "SELECT s.cx, s.cy, list(round(p.v, 4) + 0.0 ORDER BY p.y, p.x) AS pixels FROM src s, o4 o, px p WHERE p.x = cx + o.dx AND p.y = cy + o.dy GROUP BY ALL")
def p18(spark, sf):
    got = patches.vectorised(px1(spark, sf), R)
    return got.select("cx", "cy", F.transform("pixels", lambda v: F.round(v, 4) + F.lit(0.0)).alias("pixels"))


@query("p19_feature_vector_of_patch", "SELECT s.cx, s.cy, CAST(count(*) AS INTEGER) AS n, round(sum(p.v), 6) + 0.0 AS total FROM src s, o4 o, px p WHERE p.x = cx + o.dx AND p.y = cy + o.dy GROUP BY ALL")
def p19(spark, sf):
    got = patches.vectorised(px1(spark, sf), R)
    return got.select("cx", "cy", F.size("pixels").alias("n"), rd(fn.total(F.col("pixels"))).alias("total"))


@query("p20_precomputed_features", "SELECT p.x, p.y, CASE WHEN y % 9 = 0 THEN 'INVALID' ELSE 'SOURCE_NODE' END AS status FROM px p")
def p20(spark, sf):
    """Feature rows joined to pixels; a pixel without a row, or with one that is not finite, is INVALID."""
    px = px1(spark, sf)
    feats = grid.embeddings(spark, sf).filter("vec_id % 9 <> 0").select(F.col("vec_id").cast("int").alias("y"), F.col("embedding").alias("f"))
    bad = F.col("f").isNull() | F.exists("f", lambda v: F.isnan(v))
    return px.join(feats, "y", "left").select("x", "y", F.when(bad, "INVALID").otherwise("SOURCE_NODE").alias("status"))


#: Radius within which points, pixels whose channels are their coordinates, are neighbours.
NEAR = 0.03


def points_of(spark, sf) -> DataFrame:
    px = grid.pixels3(spark, sf)
    return px.select((F.col("y").cast("long") * 21 + F.col("x")).alias("id"), F.col("c0").alias("px"), F.col("c1").alias("py"), F.col("c2").alias("pz"))


@query("p20_normals", f", nb AS (SELECT a.x, a.y, count(*) FILTER (WHERE (a.x, a.y) <> (b.x, b.y)) AS k FROM p3 a, p3 b WHERE b.c0 BETWEEN a.c0 - {NEAR} AND a.c0 + {NEAR} AND (a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 <= {NEAR} * {NEAR} GROUP BY a.x, a.y) SELECT x, y, k, CASE WHEN k < 2 THEN 'INVALID' ELSE 'SOURCE_NODE' END AS status FROM nb")
def p20_normals(spark, sf):
    """Normals from each point's neighbours; a point with too few of them has none and is INVALID."""
    pts = points_of(spark, sf)
    got = points.normals(pts, points.neighbours(pts, NEAR))
    return got.select((F.col("id") % 21).cast("int").alias("x"), F.floor(F.col("id") / 21).cast("int").alias("y"), "k", F.when(F.col("nx").isNull(), "INVALID").otherwise("SOURCE_NODE").alias("status"))


@query("p21_point_features")
def p21(spark, sf):
    """33 bins for each point; tests hold them against a plain version."""
    got = points.point_features(points_of(spark, sf), NEAR)
    return got.select((F.col("id") % 21).cast("int").alias("x"), F.floor(F.col("id") / 21).cast("int").alias("y"), F.transform("fpfh", lambda v: F.round(v, 4)).alias("fpfh"))


@query("p22_composite_descriptors", STATUS.replace("SELECT x, y, n = 81 AS inside", "SELECT x, y, x + 64 * y AS node, n = 81 AS inside"))
def p22(spark, sf):
    return patches.with_status(px1(spark, sf), R).select("x", "y", (F.col("x") + 64 * F.col("y")).cast("long").alias("node"), "inside", "fully_valid", "status")


@query("k8_knn_of_all_targets", BND + """, tt AS (SELECT bn.x AS tx, bn.y AS ty, dx, dy, t.v FROM bn, o4 o, px t WHERE t.x = bn.x + o.dx AND t.y = bn.y + o.dy AND NOT t.hole),
ds AS (SELECT tx, ty, cx, cy, avg((p.v - t.v) ** 2) AS d FROM src s, tt t, px p WHERE p.x = cx + dx AND p.y = cy + dy GROUP BY tx, ty, cx, cy)
SELECT tx, ty, cx, cy, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY tx, ty ORDER BY ds.d, cy, cx) AS INTEGER) AS rn FROM ds QUALIFY rn <= 5""")
def k8_all(spark, sf):
    """The five best source patches of every pixel of the boundary."""
    px = px1(spark, sf)
    targets = patches.boundary(px).select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return many.nearest_patches(px, targets, 5, R).select("tx", "ty", "cx", "cy", rd("d").alias("d"), "rn")


@query("p24_region_copy", "SELECT t.x AS x, t.y AS y, round(s.v, 6) + 0.0 AS v FROM px t JOIN px s ON s.x = t.x + 60 AND s.y = t.y + 3 WHERE t.x BETWEEN 0 AND 6 AND t.y BETWEEN 0 AND 4")
def p24(spark, sf):
    """A source region that runs over the edge clips the target alike: only offsets that both have remain."""
    px = px1(spark, sf)
    s = px.select((F.col("x") - 60).alias("x"), (F.col("y") - 3).alias("y"), F.col("v").alias("sv"))
    return px.filter(grid.rect(0, 6, 0, 4)).join(s, ["x", "y"]).select("x", "y", rd("sv").alias("v"))


@query("p25_holes_inside", "SELECT bool_and(x >= 4 AND x <= 59 AND y >= 4 AND y <= my - 4) AS inside FROM px, ext WHERE hole")
def p25(spark, sf):
    px = px1(spark, sf)
    size = px.agg(F.max("x").alias("w"), F.max("y").alias("h"))
    return px.filter("hole").join(F.broadcast(size)).agg(F.every((F.col("x") >= R) & (F.col("x") <= F.col("w") - R) & (F.col("y") >= R) & (F.col("y") <= F.col("h") - R)).alias("inside"))


def _dsql(axis: str, out: str = "d") -> str:
    a, b = ("x", "y") if axis == "x" else ("y", "x")
    w = f"OVER (PARTITION BY {b} ORDER BY {a})"
    m = "(CASE WHEN NOT hole THEN v END)"
    lo, hi = f"lag({m}) {w}", f"lead({m}) {w}"
    return f"CASE WHEN hole THEN NULL WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN ({hi} - {lo}) / 2 WHEN {hi} IS NOT NULL THEN {hi} - v WHEN {lo} IS NOT NULL THEN v - {lo} ELSE 0 END AS {out}"


@query("w1_masked_derivative", f", d AS (SELECT x, y, {_dsql('x', 'gx')}, {_dsql('y', 'gy')} FROM px) SELECT x, y, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM d")
def w1(spark, sf):
    px = windows.derivative(windows.derivative(px1(spark, sf), "x", "v", "gx"), "y", "v", "gy")
    return px.select("x", "y", rd("gx").alias("gx"), rd("gy").alias("gy"))


def _across_sql(weights: list[float], least: float, zero: str, twice: bool = False) -> str:
    """Differences along x, weighted over the lines beside: by a join on y, not by windows."""
    n = len(weights) // 2
    ws = ", ".join(f"({k - n}, {w!r})" for k, w in enumerate(weights))
    return f""", n AS (SELECT p.x, p.y, p.hole, p.v, l.v AS lv, l.hole AS lh, r.v AS rv, r.hole AS rh FROM px p LEFT JOIN px l ON l.x = p.x - 1 AND l.y = p.y LEFT JOIN px r ON r.x = p.x + 1 AND r.y = p.y),
d AS (SELECT x, y, hole, CASE WHEN hole THEN NULL WHEN NOT lh AND NOT rh THEN (rv - lv) / 2 WHEN NOT rh THEN rv - v WHEN NOT lh THEN v - lv END AS d FROM n),
k(k, w) AS (VALUES {ws}),
s AS (SELECT d.x, d.y, sum(e.d * k.w) AS p, sum(CASE WHEN e.d IS NOT NULL THEN k.w{' * 2' if twice else ''} END) AS u FROM d, k, d e WHERE NOT d.hole AND e.x = d.x AND e.y = d.y + k.k GROUP BY ALL)
SELECT d.x, d.y, round(CASE WHEN d.hole THEN NULL WHEN u > {least} THEN p / u ELSE {zero} END, 6) + 0.0 AS g FROM d LEFT JOIN s USING (x, y)"""


KERNEL = ", kg(k, w) AS (VALUES " + ", ".join(f"({k - 5}, {w!r})" for k, w in enumerate(windows.kernel(11, 3.0))) + ")"


def gauss_sql(table: str, out: str, axis: str) -> str:
    """`out` (x, y, g): the masked derivative of a table (x, y, hole, v) along an axis, weighted by kg across it; by joins, not by windows."""
    a, b = ("x", "y") if axis == "x" else ("y", "x")
    return f""", n_{out} AS (SELECT p.x, p.y, p.hole, p.v, l.v AS lv, l.hole AS lh, r.v AS rv, r.hole AS rh FROM {table} p LEFT JOIN {table} l ON l.{a} = p.{a} - 1 AND l.{b} = p.{b} LEFT JOIN {table} r ON r.{a} = p.{a} + 1 AND r.{b} = p.{b}),
d_{out} AS (SELECT x, y, hole, CASE WHEN hole THEN NULL WHEN NOT lh AND NOT rh THEN (rv - lv) / 2 WHEN NOT rh THEN rv - v WHEN NOT lh THEN v - lv END AS d FROM n_{out}),
s_{out} AS (SELECT d.x, d.y, sum(e.d * k.w) AS p, sum(CASE WHEN e.d IS NOT NULL THEN k.w END) AS u FROM d_{out} d, kg k, d_{out} e WHERE NOT d.hole AND e.{a} = d.{a} AND e.{b} = d.{b} + k.k GROUP BY ALL),
{out} AS (SELECT d.x, d.y, CASE WHEN d.hole THEN NULL WHEN u > 0 THEN p / u ELSE 0 END AS g FROM d_{out} d LEFT JOIN s_{out} s USING (x, y))
"""


def _w(name, sql, f):
    @query(name, sql)
    def run(spark, sf, f=f):
        return f(px1(spark, sf)).select("x", "y", rd("g").alias("g"))


_w("w2_masked_prewitt", _across_sql([1.0, 1.0, 1.0], 1, "coalesce(p, 0)"), lambda px: windows.prewitt(px, "x", "v", "g"))
_w("w3_masked_sobel", _across_sql([1.0, 2.0, 1.0], 1, "coalesce(p, 0)"), lambda px: windows.sobel(px, "x", "v", "g"))
_w("w4_masked_gaussian", _across_sql(windows.kernel(11, 3.0), 0, "0"), lambda px: windows.gaussian(px, "x", "v", "g"))
_w("w4_masked_gaussian_quirk", _across_sql(windows.kernel(11, 3.0), 0, "0", True), lambda px: windows.gaussian(px, "x", "v", "g", ref_quirk=True))


BOTH = "SELECT a.x, a.y, round({0}, 6) + 0.0 AS {1}, round({2}, 6) + 0.0 AS {3} FROM ga a JOIN gb b USING (x, y)"


@query("w5_masked_gradient", KERNEL + gauss_sql("px", "ga", "x") + gauss_sql("px", "gb", "y") + BOTH.format("a.g", "gx", "b.g", "gy"))
def w5(spark, sf):
    return windows.gradient(px1(spark, sf), "v").select("x", "y", rd("gx").alias("gx"), rd("gy").alias("gy"))


@query("w6_gradient_from_derivatives", f", d AS (SELECT x, y, {_dsql('x', 'gx')}, {_dsql('y', 'gy')} FROM px) SELECT x, y, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM d")
def w6(spark, sf):
    px = px1(spark, sf)
    a, b = (windows.derivative(px, axis, "v", "g").select("image_id", "x", "y", F.col("g").alias("v")) for axis in "xy")
    return windows.zip_fields(a, b).select("x", "y", rd("gx").alias("gx"), rd("gy").alias("gy"))


@query("w7_isophotes", ", lu AS (SELECT x, y, hole, 0.3 * c0 + 0.59 * c1 + 0.11 * c2 AS v FROM p3)" + KERNEL + gauss_sql("lu", "ga", "x") + gauss_sql("lu", "gb", "y") + BOTH.format("-b.g", "ix", "a.g", "iy"))
def w7(spark, sf):
    """The gradient of the luminance, turned by a quarter."""
    return windows.isophotes(grid.pixels3(spark, sf)).select("x", "y", rd("ix").alias("ix"), rd("iy").alias("iy"))


_G = ", ".join(f"({k}, exp(-{k * k} / 4.0::DOUBLE))" for k in range(-3, 4))
BLUR = f""", k(k, w) AS (VALUES {_G}), bx AS (SELECT p.x, p.y, sum(k.w * q.m) AS s, sum(CASE WHEN q.m IS NOT NULL THEN k.w ELSE 0 END) AS n FROM val p, k, val q WHERE q.x = p.x + k.k AND q.y = p.y GROUP BY ALL),
b AS (SELECT p.x, p.y, sum(k.w * q.s) / nullif(sum(k.w * q.n), 0) AS b FROM val p, k, bx q WHERE q.x = p.x AND q.y = p.y + k.k GROUP BY ALL)
"""


@query("w13_masked_blur", ", val AS (SELECT x, y, CASE WHEN NOT hole THEN v END AS m FROM px)" + BLUR + "SELECT p.x, p.y, round(b, 6) + 0.0 AS g FROM px p LEFT JOIN b USING (x, y)")
def w13(spark, sf):
    return windows.masked_blur(px1(spark, sf), "v", "g").select("x", "y", rd("g").alias("g"))


@query("w8_boundary_normals", BND + ", val AS (SELECT x, y, CASE WHEN hole THEN 0.0 ELSE 1.0 END AS m FROM px)" + BLUR + """, g AS (SELECT p.x, p.y, (r.b - l.b) / 2 AS gx, (d.b - u.b) / 2 AS gy FROM bn p JOIN b r ON r.x = p.x + 1 AND r.y = p.y JOIN b l ON l.x = p.x - 1 AND l.y = p.y JOIN b d ON d.x = p.x AND d.y = p.y + 1 JOIN b u ON u.x = p.x AND u.y = p.y - 1)
SELECT x, y, round(gx / sqrt(gx * gx + gy * gy), 6) + 0.0 AS nx, round(gy / sqrt(gx * gx + gy * gy), 6) + 0.0 AS ny FROM g""")
def w8(spark, sf):
    return windows.boundary_normals(px1(spark, sf)).filter("nx <> 0 or ny <> 0").select("x", "y", rd("nx").alias("nx"), rd("ny").alias("ny"))


ENERGY = """, e AS (SELECT p.x, p.y, abs(avg(q.v) FILTER (WHERE q.hole) - avg(q.v) FILTER (WHERE NOT q.hole)) AS e, count(*) FILTER (WHERE q.hole) AS h FROM px p, o1 o, px q WHERE NOT p.hole AND q.x = p.x + o.dx AND q.y = p.y + o.dy AND NOT (o.dx = 0 AND o.dy = 0) GROUP BY ALL)
"""


@query("w9_boundary_energy", ENERGY + "SELECT round(avg(e), 6) AS energy FROM e WHERE h > 0")
def w9(spark, sf):
    return windows.boundary_energy(px1(spark, sf)).select(rd("energy").alias("energy"))


SX, SY = 24, 298


def painted(px: DataFrame) -> DataFrame:
    return patches.paint(px, TX, TY, SX, SY, R)


PAINT = ", n AS (SELECT p.x, p.y, CASE WHEN p.hole AND p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114 THEN s.v ELSE p.v END AS v, p.hole AND NOT (p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114) AS hole, CASE WHEN NOT p.hole THEN p.x WHEN s.x IS NOT NULL AND p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114 THEN s.x ELSE -1 END AS src_x FROM px p LEFT JOIN px s ON s.x = p.x + 5 AND s.y = p.y + 188)\n"


def change_sql(painted: str, out: str) -> str:
    """`out` (x, y, c): squared norm of the difference of gradients of px (ga, gb) and of a painted table."""
    return gauss_sql(painted, f"pa_{out}", "x") + gauss_sql(painted, f"pb_{out}", "y") + f""", g_{out} AS (SELECT a.x, a.y, coalesce(a.g, 0) AS ax, coalesce(b.g, 0) AS ay, coalesce(c.g, 0) AS bx, coalesce(d.g, 0) AS by_ FROM ga a JOIN gb b USING (x, y) JOIN pa_{out} c USING (x, y) JOIN pb_{out} d USING (x, y)),
{out} AS (SELECT x, y, (abs(ax) - abs(bx)) ** 2 + (CASE WHEN ax < 0 THEN -ay ELSE ay END - CASE WHEN bx < 0 THEN -by_ ELSE by_ END) ** 2 AS c FROM g_{out})
"""


BEFORE = KERNEL + gauss_sql("px", "ga", "x") + gauss_sql("px", "gb", "y")
CHANGE = BND + PAINT + BEFORE + change_sql("n", "cg") + """, em AS (SELECT avg(c) AS e FROM cg JOIN bn USING (x, y)), ep AS (SELECT coalesce(avg(c), 0) AS e FROM cg JOIN px USING (x, y) WHERE NOT hole AND greatest(abs(x - 19), abs(y - 110)) = 4)
"""


@query("w10_introduced_energy_mask", CHANGE + "SELECT round(e, 6) AS energy FROM em")
def w10(spark, sf):
    px = px1(spark, sf)
    return windows.mask_boundary_energy(px, painted(px)).select(rd("energy").alias("energy"))


@query("w11_introduced_energy_patch", CHANGE + "SELECT round(e, 6) AS energy FROM ep")
def w11(spark, sf):
    px = px1(spark, sf)
    return windows.patch_boundary_energy(px, painted(px), TX, TY, R).select(rd("energy").alias("energy"))


@query("w12_introduced_energy", CHANGE + "SELECT round(em.e + ep.e, 6) AS energy FROM em, ep")
def w12(spark, sf):
    px = px1(spark, sf)
    new = painted(px)
    a, b = windows.mask_boundary_energy(px, new), windows.patch_boundary_energy(px, new, TX, TY, R).withColumnRenamed("energy", "e2")
    return a.join(F.broadcast(b)).select(rd(F.col("energy") + F.col("e2")).alias("energy"))


@query("w14_masked_laplacian", "SELECT p.x, p.y, round(CASE WHEN p.hole THEN NULL ELSE coalesce(sum(q.v - p.v) FILTER (WHERE NOT q.hole), 0) END, 6) + 0.0 AS g FROM px p JOIN o1 o ON abs(dx) + abs(dy) = 1 LEFT JOIN px q ON q.x = p.x + dx AND q.y = p.y + dy GROUP BY p.x, p.y, p.hole, p.v")
def w14(spark, sf):
    return windows.laplacian(px1(spark, sf), "v", "g").select("x", "y", rd("g").alias("g"))


@query("w15_across_hole", "SELECT x, y, 30 AS ox, y AS oy FROM px WHERE x = 19 AND y BETWEEN 100 AND 119")
def w15(spark, sf):
    """From the left edge of the mask straight through to its right."""
    px = px1(spark, sf)
    starts = px.filter("x = 19 and y between 100 and 119").select("image_id", "x", "y", F.lit(-1.0).alias("ix"), F.lit(0.0).alias("iy"))
    return windows.across_hole(px, starts, 20).drop("image_id")


@query("w16_rind", "SELECT x, y FROM px WHERE NOT hole AND x BETWEEN 14 AND 35 AND y BETWEEN 94 AND 125")
def w16(spark, sf):
    return windows.rind(px1(spark, sf), 6).filter("rind").select("x", "y")


@query("w17_expand_shrink", "SELECT x, y, x BETWEEN 19 AND 30 AND y BETWEEN 99 AND 120 AS dilated, x BETWEEN 21 AND 28 AND y BETWEEN 101 AND 118 AS eroded FROM px")
def w17(spark, sf):
    return windows.eroded(windows.dilated(px1(spark, sf), 1), 1).select("x", "y", "dilated", "eroded")


@query("q3_confidence_update", CONF + ", t AS (SELECT c FROM cf WHERE x = 19 AND y = 110) SELECT p.x, p.y, round(CASE WHEN NOT hole THEN 1 WHEN p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114 THEN c ELSE 0 END, 6) AS confidence FROM px p, t")
def q3(spark, sf):
    px = priority.with_confidence(px1(spark, sf))
    return priority.update_confidence(px, TX, TY, R).select("x", "y", rd("confidence").alias("confidence"))


def terms_sql(grid3: str) -> str:
    """pr (x, y, term, ix, iy, nx, ny) on the boundary of a table (x, y, hole, c0, c1, c2, conf), for patches of radius 2."""
    return f""", lu AS (SELECT x, y, hole, 0.3 * c0 + 0.59 * c1 + 0.11 * c2 AS v FROM {grid3})""" + KERNEL + gauss_sql("lu", "ga", "x") + gauss_sql("lu", "gb", "y") + f""", val AS (SELECT x, y, CASE WHEN hole THEN 0.0 ELSE 1.0 END AS m FROM {grid3})""" + BLUR + f""",
b3 AS (SELECT DISTINCT p.x, p.y FROM {grid3} p, o1 o, {grid3} q WHERE NOT p.hole AND q.hole AND q.x = p.x + o.dx AND q.y = p.y + o.dy),
tm AS (SELECT p.x, p.y, sum(CASE WHEN q.hole THEN 0 ELSE q.conf END) / count(*) AS term FROM b3 p, o4 o, {grid3} q WHERE abs(dx) <= 2 AND abs(dy) <= 2 AND q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY ALL),
nm AS (SELECT p.x, p.y, (coalesce(r.b, m.b) - coalesce(l.b, m.b)) / 2 AS gx, (coalesce(d.b, m.b) - coalesce(u.b, m.b)) / 2 AS gy FROM b3 p JOIN b m USING (x, y) LEFT JOIN b r ON r.x = p.x + 1 AND r.y = p.y LEFT JOIN b l ON l.x = p.x - 1 AND l.y = p.y LEFT JOIN b d ON d.x = p.x AND d.y = p.y + 1 LEFT JOIN b u ON u.x = p.x AND u.y = p.y - 1),
pr AS (SELECT x, y, term, -gb.g AS ix, ga.g AS iy, CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE gx / sqrt(gx * gx + gy * gy) END AS nx, CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE gy / sqrt(gx * gx + gy * gy) END AS ny FROM tm JOIN nm USING (x, y) JOIN ga USING (x, y) JOIN gb USING (x, y))
"""


WHOLE3 = ", w3 AS (SELECT *, CASE WHEN hole THEN 0.0 ELSE 1.0 END AS conf FROM p3)"
#: After a paint of (7, 105) from (14, 50): what is filled has the target's confidence.
AFTER3 = """, tc AS (SELECT sum(CASE WHEN hole THEN 0.0 ELSE 1.0 END) / count(*) AS c FROM t3), f3 AS (SELECT x, y, hole AND x BETWEEN 5 AND 9 AND y BETWEEN 103 AND 107 AS filled FROM p3),
w3 AS (SELECT p.x, p.y, p.hole AND NOT filled AS hole, CASE WHEN filled THEN s.c0 ELSE p.c0 END AS c0, CASE WHEN filled THEN s.c1 ELSE p.c1 END AS c1, CASE WHEN filled THEN s.c2 ELSE p.c2 END AS c2, CASE WHEN filled THEN tc.c WHEN p.hole THEN 0 ELSE 1 END AS conf
  FROM p3 p JOIN f3 USING (x, y) JOIN tc ON true LEFT JOIN p3 s ON s.x = p.x + 7 AND s.y = p.y - 55)"""
DATA = "SELECT x, y, round(term * abs(ix * nx + iy * ny) / 255, 6) + 0.0 AS priority FROM pr"


@query("q4_criminisi", WHOLE3 + terms_sql("w3") + DATA)
def q4(spark, sf):
    return priority.criminisi(grid.pixels3(spark, sf), 2).select("x", "y", rd("priority").alias("priority"))


@query("q5_criminisi_update", AFTER3 + terms_sql("w3") + DATA)
def q5(spark, sf):
    """After a paint: confidences passed on, and the priorities about the target computed anew; the others stay."""
    px = priority.with_confidence(grid.pixels3(spark, sf))
    rank = lambda t: priority.criminisi(t, 2)
    after = delta.merged(px, delta.patch_after(px, 7, 105, 14, 50, 2), 7, 105, 2)
    return delta.queue_after(rank(px), after, 7, 105, 2, 6, rank).select("x", "y", rd("priority").alias("priority"))


@query("q6_improved_criminisi", WHOLE3 + terms_sql("w3") + ", an AS (SELECT x, y, sqrt(ix * ix + iy * iy) AS l, ix * nx + iy * ny AS d FROM pr), co_ AS (SELECT x, y, l, CASE WHEN l > 0 THEN d / l ELSE 0 END AS c FROM an) SELECT x, y, round(CASE WHEN degrees(acos(least(1, greatest(-1, c)))) < 20 THEN l * c ELSE l END, 6) + 0.0 AS priority FROM co_")
def q6(spark, sf):
    return priority.improved(grid.pixels3(spark, sf), 2).select("x", "y", rd("priority").alias("priority"))


@query("q7_curvature", BND + "SELECT x, y, round(v, 6) + 0.0 AS priority FROM bn JOIN px USING (x, y)")
def q7(spark, sf):
    return priority.from_column(px1(spark, sf), "v").select("x", "y", rd("priority").alias("priority"))


@query("q8_depth")
def q8(spark, sf):
    return priority.depth(grid.pixels3(spark, sf), "c2", 12).select("x", "y", rd("priority").alias("priority"))


@query("q9_manual", CONF + "SELECT x, y, round(c + CASE WHEN x < 20 THEN 10000 ELSE 0 END, 6) AS priority FROM cf")
def q9(spark, sf):
    return priority.manual(priority.initial_queue(px1(spark, sf), R), F.col("x") < 20).select("x", "y", rd("priority").alias("priority"))


@query("q10_random", BND + "SELECT x, y, round(('0x' || substr(md5(concat_ws(',', x, y, 0)), 1, 8))::BIGINT / 4294967296.0, 6) AS priority FROM bn")
def q10(spark, sf):
    return priority.random(px1(spark, sf), 0).select("x", "y", rd("priority").alias("priority"))


@query("q12_push_or_update", CONF + "SELECT x, y, round(CASE WHEN x = 19 THEN 2 ELSE c END, 6) AS priority FROM cf UNION ALL SELECT 5, 5, 3")
def q12(spark, sf):
    q = priority.initial_queue(px1(spark, sf), R)
    new = q.filter("x = 19").select("image_id", "x", "y", F.lit(2.0).alias("priority")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("image_id"), F.lit(5).alias("x"), F.lit(5).alias("y"), F.lit(3.0).alias("priority")))
    return priority.push_or_update(q, new).select("x", "y", rd("priority").alias("priority"))


@query("q13_top", CONF + "SELECT x, y, round(c, 6) AS priority FROM cf ORDER BY c DESC, y, x LIMIT 1")
def q13(spark, sf):
    return priority.top(priority.initial_queue(px1(spark, sf), R)).select("x", "y", rd("priority").alias("priority"))


@query("q14_invalidate_and_count", CONF + "SELECT count(*) FILTER (WHERE x <> 19) AS valid, count(*) AS all_nodes FROM cf")
def q14(spark, sf):
    q = priority.invalidate(priority.initial_queue(px1(spark, sf), R), F.col("x") == 19)
    return q.agg(F.count_if("valid").alias("valid"), F.count("*").alias("all_nodes"))


def _paint(name):
    @query(name, PAINT + "SELECT x, y, round(v, 6) + 0.0 AS v, hole, CAST(src_x AS INTEGER) AS src_x FROM n")
    def run(spark, sf):
        return painted(px1(spark, sf)).select("x", "y", rd("v").alias("v"), "hole", "src_x")


for _n in ("u1_paint_patch", "u4_paint_variants", "u8_legacy_visitor"):
    _paint(_n)


@query("u2_paint_vertex", "SELECT x, y, round(CASE WHEN x = 20 AND y = 110 THEN (SELECT v FROM px WHERE x = 40 AND y = 50) ELSE v END, 6) + 0.0 AS v FROM px")
def u2(spark, sf):
    return patches.paint(px1(spark, sf), 20, 110, 40, 50, 0).select("x", "y", rd("v").alias("v"))


@query("u3_paint_two_images", PAINT + "SELECT n.x, n.y, round(n.v, 6) + 0.0 AS v, round(CASE WHEN p.hole AND NOT n.hole THEN n.v * 2 ELSE p.v * 2 END, 6) + 0.0 AS blurred FROM n JOIN px p USING (x, y)")
def u3(spark, sf):
    return painted(px1(spark, sf).withColumn("blurred", F.col("v") * 2)).select("x", "y", rd("v").alias("v"), rd("blurred").alias("blurred"))


@query("u5_finish_vertex", PAINT + "SELECT DISTINCT p.x, p.y FROM n p, o1 o, n q WHERE NOT p.hole AND q.hole AND q.x = p.x + o.dx AND q.y = p.y + o.dy")
def u5(spark, sf):
    """The boundary after a paint: what is queued, and what no longer is."""
    return patches.boundary(painted(px1(spark, sf))).select("x", "y")


@query("u5_finish_vertex_effects", CONF + PAINT + """, tc AS (SELECT count(*) FILTER (WHERE NOT hole)::DOUBLE / count(*) AS c FROM tp),
n2 AS (SELECT n.x, n.y, n.v, n.hole, n.src_x, p.hole AND NOT n.hole AS filled, CASE WHEN p.hole AND NOT n.hole THEN tc.c WHEN n.hole THEN 0 ELSE 1 END AS conf FROM n JOIN px p USING (x, y), tc),
b2 AS (SELECT DISTINCT p.x, p.y FROM n2 p, o1 o, n2 q WHERE NOT p.hole AND q.hole AND q.x = p.x + o.dx AND q.y = p.y + o.dy),
q2 AS (SELECT b.x, b.y, sum(CASE WHEN q.hole THEN 0 ELSE q.conf END) / count(*) AS c FROM b2 b, o4 o, n2 q WHERE q.x = b.x + o.dx AND q.y = b.y + o.dy GROUP BY ALL),
s2 AS (SELECT p.x, p.y FROM n2 p, ext WHERE p.x BETWEEN 4 AND 59 AND p.y BETWEEN 4 AND my - 4 AND (p.x, p.y) NOT IN (SELECT (q.x + o.dx, q.y + o.dy) FROM n2 q, o4 o WHERE q.hole) AND (p.x, p.y) NOT IN (SELECT (cx, cy) FROM src))
SELECT 'used' AS effect, 24 AS x, 298 AS y, NULL::DOUBLE AS v, NULL::INTEGER AS src_x, NULL::DOUBLE AS confidence, NULL::DOUBLE AS priority
UNION ALL SELECT 'filled', x, y, round(v, 6) + 0.0, src_x, round(conf, 6), NULL FROM n2 WHERE filled
UNION ALL SELECT 'source', x, y, NULL, NULL, NULL, NULL FROM s2
UNION ALL SELECT 'queued', q2.x, q2.y, NULL, NULL, NULL, round(q2.c, 6) FROM q2 LEFT JOIN cf USING (x, y) WHERE cf.c IS NULL OR round(cf.c, 9) <> round(q2.c, 9)
UNION ALL SELECT 'dropped', cf.x, cf.y, NULL, NULL, NULL, NULL FROM cf LEFT JOIN q2 USING (x, y) WHERE q2.c IS NULL""")
def u5_effects(spark, sf):
    """All that the paint changes, worked out near the target alone."""
    px = priority.with_confidence(px1(spark, sf))
    rank = lambda t: priority.initial_queue(t, R)
    got = delta.effects(px, rank(px), TX, TY, SX, SY, R, R, rank)
    return got.select("effect", "x", "y", rd("v").alias("v"), "src_x", rd("confidence").alias("confidence"), rd("priority").alias("priority"))


@query("u6_match_checks", "SELECT (SELECT count(*) FROM src WHERE cx = 24 AND cy = 298) = 1 AS source_valid, true AS target_on_boundary")
def u6(spark, sf):
    return paint.check_match(px1(spark, sf), TX, TY, SX, SY, R)


@query("u9_allow_new_patches", PAINT + "SELECT p.x AS cx, p.y AS cy FROM n p, ext WHERE p.x BETWEEN 4 AND 59 AND p.y BETWEEN 4 AND my - 4 AND (p.x, p.y) NOT IN (SELECT (q.x + o.dx, q.y + o.dy) FROM n q, o4 o WHERE q.hole)")
def u9(spark, sf):
    """Sources by the current mask, filled pixels included."""
    return patches.sources(painted(px1(spark, sf)), R).select("cx", "cy")


MATCHES = [(0, 19, 110, 24, 298), (1, 30, 105, 40, 50)]


def _replay(name):
    @query(name, """, n AS (SELECT p.x, p.y, CASE WHEN p.hole AND p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114 THEN s.v WHEN p.hole AND p.x BETWEEN 26 AND 34 AND p.y BETWEEN 101 AND 109 THEN t.v ELSE p.v END AS v,
 p.hole AND NOT (p.x BETWEEN 15 AND 23 AND p.y BETWEEN 106 AND 114) AND NOT (p.x BETWEEN 26 AND 34 AND p.y BETWEEN 101 AND 109) AS hole FROM px p LEFT JOIN px s ON s.x = p.x + 5 AND s.y = p.y + 188 LEFT JOIN px t ON t.x = p.x + 10 AND t.y = p.y - 55)
SELECT x, y, round(v, 6) + 0.0 AS v, hole FROM n""")
    def run(spark, sf):
        m = spark.createDataFrame(MATCHES, "iter int, tx int, ty int, sx int, sy int")
        return paint.replay(px1(spark, sf), m, R).select("x", "y", rd("v").alias("v"), "hole")


for _n in ("u7_replay", "g6_precomputed"):
    _replay(_n)


LOOK = """, t1 AS (SELECT x, y, c FROM cf ORDER BY round(c, 9) DESC, y, x LIMIT 1),
c2 AS (SELECT cf.* FROM cf, t1 WHERE abs(cf.x - t1.x) > {k} OR abs(cf.y - t1.y) > {k}), t2 AS (SELECT x, y, c FROM c2 ORDER BY round(c, 9) DESC, y, x LIMIT 1),
c3 AS (SELECT c2.* FROM c2, t2 WHERE abs(c2.x - t2.x) > {k} OR abs(c2.y - t2.y) > {k}), t3_ AS (SELECT x, y, c FROM c3 ORDER BY round(c, 9) DESC, y, x LIMIT 1),
tg AS (SELECT x AS tx, y AS ty FROM t1 UNION ALL SELECT x, y FROM t2 UNION ALL SELECT x, y FROM t3_),
tt AS (SELECT tx, ty, dx, dy, t.v FROM tg, o4 o, px t WHERE t.x = tx + o.dx AND t.y = ty + o.dy AND NOT t.hole),
ds AS (SELECT tx, ty, p.x - dx AS cx, p.y - dy AS cy, avg((p.v - t.v) ** 2) AS d FROM tt t, px p WHERE (p.x - dx, p.y - dy) IN (SELECT (s.cx, s.cy) FROM src s) GROUP BY tx, ty, p.x - dx, p.y - dy)
SELECT tx, ty, cx, cy, round(d, 6) AS d FROM ds ORDER BY ds.d, ty, tx, cy, cx LIMIT 1"""


def _look(name: str, distance: int):
    @query(name, CONF + LOOK.format(k=distance))
    def run(spark, sf):
        return paint.forward_look(px1(spark, sf), 3, R, distance).select("tx", "ty", "cx", "cy", rd("d").alias("d"))


# targets whose patches do not overlap, and targets that only stand outside the patches of those before
_look("g7_forward_look", 2 * R)
_look("g7_forward_look_outside", R)


@query("g8_scale_consistent", "SELECT cx, cy, round(d + a, 6) AS total FROM sc ORDER BY sc.d + sc.a, cy, cx LIMIT 1")
def g8(spark, sf):
    """Two scores added; here squares and absolutes stand for the blurred and the detailed image."""
    px = px1(spark, sf)
    both = patches.differences(px, patches.target_values(px, TX, TY, R), R, patches.ssd(["v"]) + patches.sad(["v"]))
    return search.best(both, ["cy", "cx"]).select("cx", "cy", rd("d").alias("total"))


@query("g9_two_step_depth", "SELECT cx, cy, round(a, 6) AS a FROM top ORDER BY top.a, rn LIMIT 1")
def g9(spark, sf):
    px = px1(spark, sf)
    two = patches.differences(px, patches.target_values(px, TX, TY, R), R, patches.sad(["v"])).select("cx", "cy", F.col("d").alias("a")).join(scores(px), ["cx", "cy"])
    return search.staged(two, 20, "a", ["cy", "cx"]).select("cx", "cy", rd("a").alias("a"))


@query("g10_lambda_search", ", l AS (SELECT i / 10.0::DOUBLE AS l FROM generate_series(0, 10) g(i)), m AS (SELECT l, cx, cy, l * d + (1 - l) * a AS s FROM sc, l) SELECT round(l, 1) AS lambda, arg_min(cx, (s, cy, cx)) AS cx, arg_min(cy, (s, cy, cx)) AS cy, round(min(s), 6) AS score FROM m GROUP BY l")
def g10(spark, sf):
    px = px1(spark, sf)
    two = patches.differences(px, patches.target_values(px, TX, TY, R), R, patches.sad(["v"])).select("cx", "cy", F.col("d").alias("a")).join(scores(px), ["cx", "cy"])
    lam = two.withColumn("lambda", F.explode(F.array(*[F.lit(i / 10) for i in range(11)]))).withColumn("score", F.col("lambda") * F.col("d") + (1 - F.col("lambda")) * F.col("a"))
    return search.best(lam, ["cy", "cx"], ["lambda"], "score").select(F.round("lambda", 1).alias("lambda"), "cx", "cy", rd("score").alias("score"))


def _loop(name, **how):
    @query(name)
    def run(spark, sf, how=how):
        return loop.inpaint(px1(spark, sf), R, **how).select("x", "y", rd("v").alias("v"), "iter", "src_x", "src_y")


_loop("g1_inpainting")
_loop("g2_inpainting_local_search", neighborhood=24)
_loop("g3_inpainting_verification", accept=0.03, k=10)
_loop("g4_local_global_search", neighborhood=24, accept=0.03, k=10)
_loop("g5_inpainting_loop", accept=9.0, strict=True)


# ---- sinks ---------------------------------------------------------------------------------------------------------


@query("io6_image_sink", "SELECT x, y, round(v, 6) + 0.0 AS v, hole FROM px")
def io6(spark, sf):
    return grid.through(px1(spark, sf), "io6").select("x", "y", rd("v").alias("v"), "hole")


@query("io7_final_image", PAINT + "SELECT x, y, round(v, 6) + 0.0 AS v, hole FROM n")
def io7(spark, sf):
    return grid.through(painted(px1(spark, sf)), "io7").select("x", "y", rd("v").alias("v"), "hole")


@query("io10_iterations", PAINT + "SELECT 0 AS iter, x, y, round(v, 6) + 0.0 AS v, hole FROM px UNION ALL SELECT 1, x, y, round(v, 6) + 0.0, hole FROM n")
def io10(spark, sf):
    """The grid before and after a paint, in a folder each."""
    px = px1(spark, sf)
    both = px.select("x", "y", "v", "hole", F.lit(0).alias("iter")).unionByName(painted(px).select("x", "y", "v", "hole", F.lit(1).alias("iter")))
    return grid.through(both, "io10", "iter").select("iter", "x", "y", rd("v").alias("v"), "hole")


@query("io11_debug_regions", "SELECT 'source' AS region, x, y, round(v, 6) + 0.0 AS v FROM px WHERE x BETWEEN 20 AND 28 AND y BETWEEN 294 AND 302 UNION ALL SELECT 'target', x, y, round(v, 6) + 0.0 FROM px WHERE x BETWEEN 15 AND 23 AND y BETWEEN 106 AND 114")
def io11(spark, sf):
    """The source's and the target's patch of a match, in a folder each."""
    px = px1(spark, sf)
    both = [patches.patch(px, x, y, R).select("x", "y", "v", F.lit(name).alias("region")) for name, x, y in (("source", SX, SY), ("target", TX, TY))]
    return grid.through(both[0].unionByName(both[1]), "io11", "region").select("region", "x", "y", rd("v").alias("v"))


@query("io13_target_patch", "SELECT x, y, round(v, 6) + 0.0 AS v, hole FROM px WHERE x BETWEEN 15 AND 23 AND y BETWEEN 106 AND 114")
def io13(spark, sf):
    return grid.through(patches.patch(px1(spark, sf), TX, TY, R), "io13").select("x", "y", rd("v").alias("v"), "hole")
