"""Queries of pixel and vector differences (F), patch differences (A) and search (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as fn
from ..operators import graph, metric, patches, search
from ..sources import grid
from .base import K, R, TX, TY, candidates, query, rd, scores, target


def ab(spark, sf) -> DataFrame:
    e = grid.embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(nxt, "vec_id").withColumnRenamed("vec_id", "id")


W5 = [1.0, 1.0, 1.0, 500.0, 500.0]


def _f(name, col, sql):
    @query(name, f"SELECT id, round({sql}, 6) + 0.0 AS d FROM ab")
    def run(spark, sf, col=col):
        return ab(spark, sf).select("id", rd(col(F.col("a"), F.col("b"))).alias("d"))


_sq = "list_sum(list_transform(range(1, {n} + 1), lambda i: (a[i] - b[i]) ** 2))"
_ab = "list_sum(list_transform(range(1, {n} + 1), lambda i: abs(a[i] - b[i])))"
_wsum = lambda f: " + ".join(f.format(w=w, i=i + 1) for i, w in enumerate(W5))
_hue = "least(abs(a[1] - b[1]), 1 - abs(a[1] - b[1]))"
first5 = lambda a: F.slice(a, 1, 5)
_f("f1_sum_squared", fn.squared, _sq.format(n=64))
_f("f2_sum_squared_bytes", lambda a, b: fn.squared(*[F.transform(x, lambda v: F.floor((v + 1) * 100).cast("int").cast("double")) for x in (a, b)]), "list_sum(list_transform(range(1, 65), lambda i: (floor((a[i] + 1) * 100) - floor((b[i] + 1) * 100)) ** 2))")
_f("f3_sum_squared_unrolled", lambda a, b: sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(3)), F.lit(0.0)), _sq.format(n=3))
_f("f4_sum_absolute", fn.absolute, _ab.format(n=64))
_f("f5_sum_absolute_first_n", lambda a, b: fn.absolute_n(a, b, 3), _ab.format(n=3))
_f("f6_weighted_absolute", lambda a, b: fn.weighted_absolute(first5(a), first5(b), W5), _wsum("{w} * abs(a[{i}] - b[{i}])"))
_f("f7_weighted_squared", lambda a, b: fn.weighted_squared(first5(a), first5(b), W5), _wsum("{w} * (a[{i}] - b[{i}]) ** 2"))
_f("f8_rgb_squared", lambda a, b: fn.squared(F.slice(a, 1, 3), F.slice(b, 1, 3)), _sq.format(n=3))
_f("f9_hsv_squared", fn.hsv_squared, f"{_hue} ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2")
_f("f10_weighted_hsv", lambda a, b: fn.hsv_squared(a, b, [2.0, 1.0, 0.5]), f"2 * {_hue} ** 2 + (a[2] - b[2]) ** 2 + 0.5 * (a[3] - b[3]) ** 2")
_f("f11_weighted_hsv_full", lambda a, b: fn.hsv_squared(a, b, W5), f"{_hue} ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 + 500 * (a[4] - b[4]) ** 2 + 500 * (a[5] - b[5]) ** 2")
_f("f12_norm", fn.norm, f"sqrt({_sq.format(n=64)})")
_f("f16_vector_topology", fn.absolute, _ab.format(n=64))


@query("f13_feature_vector", f"SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE round({_ab.format(n=64)}, 6) END AS d FROM ab")
def f13(spark, sf):
    # every tenth is not valid, so its difference is infinite; shown as -1
    d = fn.feature(F.col("a"), F.col("b"), F.lit(False), F.col("id") % 10 != 0)
    return ab(spark, sf).select("id", F.when(d == fn.INF, -1.0).otherwise(rd(d)).alias("d"))


@query("f14_weighted_feature_vector", f"SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE round({_wsum('{w} * abs(a[{i}] - b[{i}])')}, 6) END AS d FROM ab")
def f14(spark, sf):
    d = fn.feature(first5(F.col("a")), first5(F.col("b")), F.lit(False), F.col("id") % 10 != 0, W5)
    return ab(spark, sf).select("id", F.when(d == fn.INF, -1.0).otherwise(rd(d)).alias("d"))


@query("f15_angle", """, t AS (SELECT id, acos(least(1, greatest(-1, list_inner_product(a, b) / sqrt(list_inner_product(a, a)) / sqrt(list_inner_product(b, b))))) AS t FROM ab)
SELECT id, round(CASE WHEN t > 3.14 / 2 THEN t - 3.14 / 2 ELSE t END, 6) + 0.0 AS d FROM t""")
def f15(spark, sf):
    return ab(spark, sf).select("id", rd(fn.angle(fn.unit(F.col("a")), fn.unit(F.col("b")))).alias("d"))


@query("f18_rgb_to_lab", """, c AS (SELECT x, y, floor(255 * (c0 + 1) / 2) AS r, floor(255 * (c1 + 1) / 2) AS g, floor(255 * (c2 + 1) / 2) AS b FROM p3),
l AS (SELECT x, y, list_transform([r, g, b], lambda c: 100 * CASE WHEN c / 255 > 0.04045 THEN ((c / 255 + 0.055) / 1.055) ** 2.4 ELSE c / 255 / 12.92 END) AS l FROM c),
t AS (SELECT x, y, list_transform([(l[1] * 0.4124 + l[2] * 0.3576 + l[3] * 0.1805) / 95.047, (l[1] * 0.2126 + l[2] * 0.7152 + l[3] * 0.0722) / 100, (l[1] * 0.0193 + l[2] * 0.1192 + l[3] * 0.9505) / 108.883], lambda v: CASE WHEN v > 0.008856 THEN v ** (1.0::DOUBLE / 3) ELSE 7.787 * v + 16.0::DOUBLE / 116 END) AS f FROM l)
SELECT x, y, round(116 * f[2] - 16, 4) + 0.0 AS l, round(500 * (f[1] - f[2]), 4) + 0.0 AS a, round(200 * (f[2] - f[3]), 4) + 0.0 AS b FROM t""")
def f18(spark, sf):
    px = grid.pixels3(spark, sf)
    parts = fn.lab(*[F.floor(255 * (F.col(c) + 1) / 2) for c in ("c0", "c1", "c2")])
    return px.select("x", "y", *[rd(p, 4).alias(n) for p, n in zip(parts, ("l", "a", "b"), strict=True)])


@query("f19_rgb_to_hsv", """, c AS (SELECT x, y, (c0 + 1) / 2 AS r, (c1 + 1) / 2 AS g, (c2 + 1) / 2 AS b FROM p3), m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS e FROM c),
h AS (SELECT *, CASE WHEN e = 0 THEN 0 WHEN t = r THEN (g - b) / e WHEN t = g THEN 2 + (b - r) / e ELSE 4 + (r - g) / e END / 6 AS h FROM m)
SELECT x, y, round(CASE WHEN h < 0 THEN h + 1 ELSE h END, 6) + 0.0 AS h, round(CASE WHEN t = 0 THEN 0 ELSE e / t END, 6) AS s, round(t, 6) AS v FROM h""")
def f19(spark, sf):
    parts = fn.hsv(*[(F.col(c) + 1) / 2 for c in ("c0", "c1", "c2")])
    return grid.pixels3(spark, sf).select("x", "y", *[rd(p).alias(n) for p, n in zip(parts, ("h", "s", "v"), strict=True)])


@query("f20_rotate", "SELECT x, y, round(-c1, 6) + 0.0 AS rx, round(c0, 6) + 0.0 AS ry FROM p3")
def f20(spark, sf):
    rx, ry = fn.rotated(F.col("c0"), F.col("c1"))
    return grid.pixels3(spark, sf).select("x", "y", rd(rx).alias("rx"), rd(ry).alias("ry"))


@query("f21_magnitude", "SELECT x, y, round(c1, 6) + 0.0 AS channel, round(sqrt(c0 * c0 + c1 * c1 + c2 * c2), 6) AS magnitude FROM p3")
def f21(spark, sf):
    return grid.pixels3(spark, sf).select("x", "y", rd("c1").alias("channel"), rd(fn.magnitude(F.array("c0", "c1", "c2"))).alias("magnitude"))


@query("f22_centre_distance", "SELECT cx, cy, round(sqrt((cx - 19) ** 2 + (cy - 110) ** 2), 6) AS d FROM src")
def f22(spark, sf):
    return patches.sources(grid.pixels(spark, sf), R).select("cx", "cy", rd(F.hypot(F.col("cx") - TX, F.col("cy") - TY)).alias("d"))


_sc = "SELECT cx, cy, round(d, 6) AS d FROM sc"


@query("a1_patch_ssd", ", e AS (SELECT x AS cx, y AS cy FROM px) SELECT cx, cy, CASE WHEN d IS NULL THEN -1 ELSE round(d, 6) END AS d FROM e LEFT JOIN sc USING (cx, cy)")
def a1(spark, sf):
    """All centres; what is no source patch has the greatest difference, shown as -1."""
    px = grid.pixels(spark, sf)
    every = px.select(F.col("x").alias("cx"), F.col("y").alias("cy"))
    return every.join(scores(px), ["cx", "cy"], "left").select("cx", "cy", F.coalesce(rd("d"), F.lit(-1.0)).alias("d"))


@query("a2_patch_ssd_extracted", _sc)
def a2(spark, sf):
    return scores(grid.pixels(spark, sf)).select("cx", "cy", rd("d").alias("d"))


@query("a3_patch_sad_sources_only", "SELECT cx, cy, round(a, 6) AS d FROM sc")
def a3(spark, sf):
    px = grid.pixels(spark, sf)
    return patches.differences(px, target(px), R, patches.sad(["v"]), patches.sources(px, R)).select("cx", "cy", rd("d").alias("d"))


@query("f17_patch_topology", _sc)
def f17(spark, sf):
    return a2(spark, sf)


@query("a4_full_patch_difference", "SELECT cx, cy, round(avg((p.v - t.v) ** 2), 6) AS d FROM src, px t, px p WHERE t.x BETWEEN 6 AND 14 AND t.y BETWEEN 46 AND 54 AND p.x = cx + t.x - 10 AND p.y = cy + t.y - 50 AND NOT (cx = 10 AND cy = 50) GROUP BY cx, cy")
def a4(spark, sf):
    """A source patch against all others: all pixels count, and a patch and itself do not meet."""
    px = grid.pixels(spark, sf)
    got = patches.differences(px, patches.target_values(px, 10, 50, R), R, patches.ssd(["v"]))
    return got.filter("not (cx = 10 and cy = 50)").select("cx", "cy", rd("d").alias("d"))


def _vectors(spark, sf):
    """The source patches' arrays, and that of the patch at (12, 20), made of its own pixels (if it is a source patch)."""
    px = grid.pixels(spark, sf)
    one = patches.vectorised(px.filter(grid.rect(12 - R, 12 + R, 20 - R, 20 + R)), R)
    return patches.vectorised(px, R).filter("not (cx = 12 and cy = 20)"), one.select(F.col("pixels").alias("t"))


@query("a5_vectorised_difference", "SELECT s.cx, s.cy, round(sum((p.v - t.v) ** 2) / 81, 6) AS d FROM src s, px t, px p WHERE t.x BETWEEN 8 AND 16 AND t.y BETWEEN 16 AND 24 AND p.x = cx + t.x - 12 AND p.y = cy + t.y - 20 AND NOT (cx = 12 AND cy = 20) GROUP BY ALL")
def a5(spark, sf):
    """Flat arrays side by side, without a join on offsets."""
    vs, one = _vectors(spark, sf)
    return vs.join(F.broadcast(one)).select("cx", "cy", rd(fn.squared(F.col("pixels"), F.col("t")) / F.size("t")).alias("d"))


@query("a6_vectorised_indices_difference", "SELECT s.cx, s.cy, round(sum((p.v - t.v) ** 2) / 81, 6) AS d FROM src s, px t, px p WHERE t.x BETWEEN 8 AND 16 AND t.y BETWEEN 16 AND 24 AND p.x = cx + t.x - 12 AND p.y = cy + t.y - 20 AND NOT (cx = 12 AND cy = 20) GROUP BY ALL")
def a6(spark, sf):
    """Through an array of positions, at each of which the two arrays are looked up; all within the row."""
    vs, one = _vectors(spark, sf)
    at = F.sequence(F.lit(0), F.size("t") - 1)
    apart = F.transform(at, lambda i: (F.get("pixels", i) - F.get("t", i)) * (F.get("pixels", i) - F.get("t", i)))
    return vs.join(F.broadcast(one)).select("cx", "cy", rd(F.aggregate(apart, F.lit(0.0), lambda a, x: a + x) / F.size("t")).alias("d"))


@query("a10_under_the_hole", "SELECT cx, cy, dx, dy, round(sv, 6) + 0.0 AS v FROM co WHERE thole")
def a10(spark, sf):
    px = grid.pixels(spark, sf)
    return patches.correspondence(px, candidates(px), TX, TY, R).filter("thole").select("cx", "cy", "dx", "dy", rd("s_v").alias("v"))


_best = "SELECT cx, cy, round(d, 6) AS d FROM top WHERE rn = 1"


@query("k6_best_source_patch", _best)
def k6(spark, sf):
    return search.best(scores(grid.pixels(spark, sf)), ["cy", "cx"]).select("cx", "cy", rd("d").alias("d"))


@query("k7_best_no_check", _best)
def k7(spark, sf):
    """Candidates come as a written list, and their patches are not looked at for holes again."""
    px = grid.pixels(spark, sf)
    given = grid.through(patches.sources(px, R), "k7")
    return search.best(patches.differences(px, target(px), R, patches.ssd(["v"]), given), ["cy", "cx"]).select("cx", "cy", rd("d").alias("d"))


@query("k20_best_and_write", ", b AS (SELECT cx, cy, d FROM top WHERE rn = 1) SELECT cx, cy, round(d, 6) AS d, p.x, p.y, round(p.v, 6) + 0.0 AS v FROM b JOIN px p ON p.x BETWEEN cx - 4 AND cx + 4 AND p.y BETWEEN cy - 4 AND cy + 4")
def k20(spark, sf):
    """The best patch's pixels, written beside its score and read again."""
    px = grid.pixels(spark, sf)
    best = search.best(scores(px), ["cy", "cx"]).select("cx", "cy", "d")
    near = (F.abs(F.col("x") - F.col("cx")) <= R) & (F.abs(F.col("y") - F.col("cy")) <= R)
    return grid.through(px.join(F.broadcast(best), near).select("cx", "cy", "d", "x", "y", "v"), "k20").select("cx", "cy", rd("d").alias("d"), "x", "y", rd("v").alias("v"))


def vec(spark, sf):
    """Scores of all vectors against vector 7, L1."""
    e = grid.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"), "label")
    q = e.filter("id = 7").select(F.col("a").alias("q"))
    return e.filter("id <> 7").join(F.broadcast(q)).select("id", "label", fn.absolute(F.col("a"), F.col("q")).alias("d"), fn.squared(F.col("a"), F.col("q")).alias("s"))


VEC = """, v AS (SELECT e.vec_id AS id, e.label, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))) AS d,
 list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) ** 2)) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.vec_id <> 7)
"""


def _kv(name, sql, f):
    @query(name, VEC + sql)
    def run(spark, sf, f=f):
        return f(vec(spark, sf))


shown = lambda df, *more: df.select("id", rd("d").alias("d"), *more)
_one = "SELECT id, round(d, 6) AS d FROM v ORDER BY v.d, id LIMIT 1"
for _n in ("k1_linear_property_best", "k2_linear_best", "k4_best_functor", "k19_search_functor", "k21_min_distance", "k22_neighbor_search"):
    _kv(_n, _one, lambda v: shown(search.best(v, ["id"])))
_kv("k3_linear_knn_radius", "SELECT id, round(d, 6) AS d, CAST(row_number() OVER (ORDER BY v.d, id) AS INTEGER) AS rn FROM v WHERE v.d < 8 QUALIFY rn <= 10", lambda v: shown(search.top(v, 10, ["id"], None, 8.0), "rn"))
_kv("k5_knn_stride", ", w AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM v) SELECT id, round(d, 6) AS d, CAST(row_number() OVER (ORDER BY w.d, id) AS INTEGER) AS rn FROM w WHERE i % 3 = 0 QUALIFY rn <= 10", lambda v: shown(search.top(search.strided(v, 3, ["id", "d"]), 10, ["id"]), "rn"))


def _metric(name, sql, f):
    """The vectors but the query, in a metric index; the query, vector 7, comes to the driver."""

    @query(name, VEC + sql)
    def run(spark, sf, f=f):
        e = grid.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"), "label")
        q = e.filter("id = 7").first()["a"]
        points = metric.vantage_points(e)
        return f(metric.index(e.filter("id <> 7"), points), points, q)


_metric("k24_metric_range", "SELECT id, round(d, 6) AS d FROM v WHERE v.d <= 7.5", lambda t, p, q: shown(metric.within(t, p, q, 7.5)))
_metric("k24_metric_knn_by_label", "SELECT label, id, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY label ORDER BY v.d, id) AS INTEGER) AS rn FROM v QUALIFY rn <= 3", lambda t, p, q: metric.nearest(t, p, q, 3, by="label").select("label", "id", rd("d").alias("d"), "rn"))
_metric("k26_best_in_each_graph", "SELECT label, arg_min(id, (v.d, id)) AS id, round(min(v.d), 6) AS d FROM v GROUP BY label", lambda t, p, q: metric.nearest(t, p, q, 1, by="label").select("label", "id", rd("d").alias("d")))


ALL = """WITH p AS MATERIALIZED (SELECT a.vec_id AS query, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
"""


@query("k3_knn_join", ALL + "SELECT query, id, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY query ORDER BY p.d, id) AS INTEGER) AS rn FROM p QUALIFY rn <= 10", common=False)
def k3_knn_join(spark, sf):
    """The ten nearest of every vector among all others."""
    e = grid.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"))
    return metric.knn_join(e, e, 10).select("query", "id", rd("d").alias("d"), "rn")


@query("k23_graph_search")
def k23_graph_search(spark, sf):
    """Ten near ones of every vector, by descent in a graph of near neighbours; tests measure how many of the nearest it finds."""
    e = grid.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"))
    return graph.descend(e, e, graph.neighbour_graph(e, 16), 10).select("query", "id", rd("d").alias("d"), "rn")


@query("k24_insert_erase", VEC + ", w AS (SELECT id, d FROM v WHERE id % 5 <> 0 UNION ALL SELECT id + 1000000, d / 2 FROM v WHERE id % 100 = 1) SELECT id, round(d, 6) AS d FROM w ORDER BY w.d, id LIMIT 5")
def k24_insert_erase(spark, sf):
    """Every fifth vector is erased, and some are inserted that lie half as far from the query."""
    e = grid.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"))
    q = e.filter("id = 7").first()["a"]
    points = metric.vantage_points(e)
    e = e.filter("id <> 7")
    half = F.zip_with("a", F.array(*[F.lit(x) for x in q]), lambda v, c: (v + c) / 2)
    new = e.filter("id % 100 = 1").select((F.col("id") + 1000000).alias("id"), half.alias("a"))
    tree = metric.insert(metric.erase(metric.index(e, points), e.filter("id % 5 = 0").select("id")), new, points)
    return shown(metric.nearest(tree, points, q, 5))


_kv("k13_below_threshold_or_all", "SELECT id, round(d, 6) AS d FROM v WHERE v.d < 7.5 OR NOT (SELECT bool_or(d < 7.5) FROM v)", lambda v: shown(search.below_or_all(v, 7.5)))
_kv("k13_fall_back_to_all", "SELECT id, round(d, 6) AS d FROM v", lambda v: shown(search.below_or_all(v, -1.0)))
_kv("p10_stride", ", w AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM v) SELECT id, round(d, 6) AS d FROM w WHERE i % 4 = 0", lambda v: shown(search.strided(v, 4, ["id", "d"])))
_kv("k11_no_reuse", "SELECT id, round(d, 6) AS d FROM v WHERE id % 3 <> 0 ORDER BY v.d, id LIMIT 10", lambda v: shown(search.top(search.without(v, v.filter("id % 3 = 0").select("id"), ["id"]), 10, ["id"])))
_kv("k12_combine", "SELECT id, round(d, 6) AS d, 'd' AS side FROM (SELECT id, d FROM v ORDER BY d, id LIMIT 5) UNION ALL SELECT id, round(s, 6), 's' FROM (SELECT id, s FROM v ORDER BY s, id LIMIT 5)", lambda v: search.combine(search.top(v, 5, ["id"]).select("id", rd("d").alias("d"), F.lit("d").alias("side")), search.top(v, 5, ["id"], None, None, "s").select("id", rd("s").alias("d"), F.lit("s").alias("side"))))


@query("k25_vantage_point", """, p AS (SELECT * FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT (SELECT count(*) // 10 + 1 FROM embeddings)),
d AS (SELECT p.vec_id AS pv, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(p.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)))) AS d FROM p, embeddings e WHERE e.vec_id <> p.vec_id)
SELECT pv AS "pivot", round(stddev_pop(d), 6) AS spread FROM d GROUP BY pv ORDER BY stddev_pop(d) DESC, pv LIMIT 1""")
def k25(spark, sf):
    """The share of a tenth that is tried are the vectors of the least hash."""
    e = grid.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"))
    return metric.best_point(e, F.md5(F.col("id").cast("string"))).select("pivot", rd("spread").alias("spread"))


@query("k8_knn_patch", "SELECT cx, cy, round(d, 6) AS d, CAST(rn AS INTEGER) AS rn FROM top")
def k8(spark, sf):
    return search.top_or_fail(scores(grid.pixels(spark, sf)), K, ["cy", "cx"]).select("cx", "cy", rd("d").alias("d"), "rn")


@query("q15_keep_top_n", "SELECT cx, cy, round(d, 6) AS d FROM top")
def q15(spark, sf):
    return candidates(grid.pixels(spark, sf)).select("cx", "cy", rd("d").alias("d"))


COPIED = "(x % 7 = 0 and y % 5 < 3)"


@query("k9_limit_reuse", """, u AS (SELECT cx, cy, count(*) FILTER (WHERE p.x % 7 = 0 AND p.y % 5 < 3) AS used FROM src, o4 o, px p WHERE p.x = cx + o.dx AND p.y = cy + o.dy GROUP BY ALL)
SELECT cx, cy, round(d, 6) AS d FROM sc JOIN u USING (cx, cy) WHERE used < (SELECT count(*) FROM tp WHERE hole) / 4 ORDER BY sc.d, cy, cx LIMIT 10""")
def k9(spark, sf):
    """Copied pixels, here a fixed pattern of them, in a candidate's patch; a quarter of the target's holes is the limit, since half bars nobody."""
    px = grid.pixels(spark, sf)
    used = patches.box(px, R, used=F.expr(f"int({COPIED})")).select(F.col("x").alias("cx"), F.col("y").alias("cy"), "used")
    holes = patches.patch(px, TX, TY, R).filter("hole").count()
    return search.top(search.limit_reuse(scores(px), used, holes / 4, ["cx", "cy"]), 10, ["cy", "cx"]).select("cx", "cy", rd("d").alias("d"))


@query("k10_limit_local_reuse", """, u AS (SELECT cx, cy, count(*) FILTER (WHERE p.x % 2 = 0) AS used FROM src, tp t, px p WHERE t.hole AND p.x = cx + dx AND p.y = cy + dy GROUP BY ALL),
l AS (SELECT 5 + greatest(0, ceil((min(used) - 5) / 10.0)) * 10 AS l FROM u)
SELECT cx, cy, round(d, 6) AS d FROM sc JOIN u USING (cx, cy), l WHERE used <= l ORDER BY sc.d, cy, cx LIMIT 10""")
def k10(spark, sf):
    """Used pixels under the hole offsets; the limit of 5 is too low for all, and is raised by tens."""
    px = grid.pixels(spark, sf)
    hole = patches.patch(px, TX, TY, R).filter("hole").select("dx", "dy")
    at = px.withColumn("u", (F.col("x") % 2 == 0).cast("int")).join(F.broadcast(hole)).groupBy((F.col("x") - F.col("dx")).alias("cx"), (F.col("y") - F.col("dy")).alias("cy")).agg(F.sum("u").alias("used"))
    return search.top(search.limit_local_reuse(scores(px), at, 5.0, ["cx", "cy"]), 10, ["cy", "cx"]).select("cx", "cy", rd("d").alias("d"))


def _two(px):
    return patches.differences(px, target(px), R, patches.sad(["v"])).select("cx", "cy", F.col("d").alias("a")).join(scores(px), ["cx", "cy"])


@query("k14_two_step", "SELECT cx, cy, round(a, 6) AS a FROM top ORDER BY top.a, rn LIMIT 1")
def k14(spark, sf):
    return search.staged(_two(grid.pixels(spark, sf)), K, "a", ["cy", "cx"]).select("cx", "cy", rd("a").alias("a"))


@query("k16_knn_best", "SELECT cx, cy, round(a, 6) AS a FROM top ORDER BY top.a, rn LIMIT 1")
def k16(spark, sf):
    return k14(spark, sf)


@query("k15_three_step", ", b AS (SELECT *, row_number() OVER (ORDER BY a, rn) AS r2 FROM top QUALIFY r2 <= 5) SELECT cx, cy, round(sqrt((cx - 19) ** 2 + (cy - 110) ** 2), 6) AS far FROM b ORDER BY (cx - 19) ** 2 + (cy - 110) ** 2, r2 LIMIT 1")
def k15(spark, sf):
    two = search.top(search.top(_two(grid.pixels(spark, sf)), K, ["cy", "cx"]).withColumnRenamed("rn", "rn1"), 5, ["rn1"], None, None, "a").withColumn("far", F.hypot(F.col("cx") - TX, F.col("cy") - TY))
    return search.best(two, ["rn"], None, "far").select("cx", "cy", rd("far").alias("far"))


@query("k17_search_and_sort", "SELECT cx, cy, round(a, 6) AS a, CAST(row_number() OVER (ORDER BY top.a, top.rn) AS INTEGER) AS rn FROM top")
def k17(spark, sf):
    return search.resorted(_two(grid.pixels(spark, sf)), K, "a", ["cy", "cx"]).select("cx", "cy", rd("a").alias("a"), "rn")


@query("q16_sort_by_score", "SELECT cx, cy, CAST(row_number() OVER (ORDER BY d, cy, cx) AS INTEGER) AS rn FROM sc")
def q16(spark, sf):
    return search.ranked(scores(grid.pixels(spark, sf)), ["cy", "cx"]).select("cx", "cy", F.col("rn").cast("int").alias("rn"))


@query("k18_local_optimisation", """, q AS (SELECT x AS qx, y AS qy FROM (VALUES (18, 109), (18, 110), (18, 111), (19, 109), (19, 111), (20, 109), (20, 110), (20, 111)) w(x, y)),
tt AS MATERIALIZED (SELECT qx, qy, dx, dy, t.v FROM q, o4 o, px t WHERE t.x = qx + o.dx AND t.y = qy + o.dy AND NOT t.hole),
ns AS (SELECT qx, qy, p.x - dx AS cx, p.y - dy AS cy, avg((p.v - t.v) ** 2) AS d FROM tt t, px p WHERE (p.x - dx, p.y - dy) IN (SELECT (s.cx, s.cy) FROM src s) GROUP BY qx, qy, p.x - dx, p.y - dy),
nt AS (SELECT *, row_number() OVER (PARTITION BY qx, qy ORDER BY d, cy, cx) AS r FROM ns QUALIFY r <= 10),
m AS (SELECT c.cx, c.cy, c.rn, qx, qy, min(sqrt((c.cx - nt.cx) ** 2 + (c.cy - nt.cy) ** 2)) AS m FROM top c, nt WHERE c.rn <= 10 GROUP BY ALL)
SELECT cx, cy, round(sum(m), 6) AS total FROM m GROUP BY cx, cy, rn ORDER BY sum(m), rn LIMIT 1""")
def k18(spark, sf):
    """The ten best of the target, judged by how near they are to the ten best of each of its eight neighbours."""
    px = grid.pixels(spark, sf)
    few = patches.sources(px, R)
    near = None
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            if dx or dy:
                t = patches.target_values(px, TX + dx, TY + dy, R)
                one = search.top(patches.differences(px, t, R, patches.ssd(["v"]), few), 10, ["cy", "cx"]).select(F.lit(dx).alias("qx"), F.lit(dy).alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
                near = one if near is None else near.unionByName(one)
    c = candidates(px, 10).select("cx", "cy", "rn")
    m = near.join(F.broadcast(c)).groupBy("cx", "cy", "rn", "qx", "qy").agg(F.min(F.hypot(F.col("cx") - F.col("nx"), F.col("cy") - F.col("ny"))).alias("m"))
    got = m.groupBy("cx", "cy", "rn").agg(F.sum("m").alias("total"))
    return search.best(got, ["rn"], None, "total").select("cx", "cy", rd("total").alias("total"))


@query("v25_running_average", "SELECT y, x, round(avg(v) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS mean FROM px")
def v25(spark, sf):
    w = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return grid.pixels(spark, sf).select("y", "x", rd(F.avg("v").over(w)).alias("mean"))
