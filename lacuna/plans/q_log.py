"""Queries over a log of matches: replay (U7), and searches that look at what earlier matches used (K9, K10, K11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paint, reuse
from ..sources import grid
from .base import R, query, rd

#: A match for each line of the table, the hole that they fill, and the log as SQL: targets wander over the hole, and sources over the whole grid, the hole included.
HOLE = (10, 53, 60, 380)
LOG = """, hx AS (SELECT x, y, v, x BETWEEN 10 AND 53 AND y BETWEEN 60 AND 380 AS hole FROM px),
lg AS (SELECT vec_id AS iter, 8 + (vec_id * 37) % 48 AS tx, 56 + (vec_id * 53) % 330 AS ty, CAST(4 + floor(abs(CAST(embedding[1] AS DOUBLE)) * 10007) % 56 AS BIGINT) AS sx, CAST(4 + floor(abs(CAST(embedding[2] AS DOUBLE)) * 10007) % ((SELECT max(vec_id) FROM embeddings) - 7) AS BIGINT) AS sy FROM embeddings),
cv AS (SELECT p.x, p.y, arg_min(struct_pack(i := iter, sx := lg.sx + p.x - lg.tx, sy := lg.sy + p.y - lg.ty), iter) AS m FROM hx p JOIN lg ON p.x BETWEEN tx - 4 AND tx + 4 AND p.y BETWEEN ty - 4 AND ty + 4 JOIN px s ON s.x = lg.sx + p.x - lg.tx AND s.y = lg.sy + p.y - lg.ty WHERE p.hole GROUP BY p.x, p.y),
fl AS MATERIALIZED (SELECT x, y, m.i AS i, m.sx AS sx, m.sy AS sy FROM cv),
wk AS (SELECT x, y, sx AS ox, sy AS oy, i AS li FROM fl UNION ALL SELECT w.x, w.y, f.sx, f.sy, f.i FROM wk w JOIN fl f ON f.x = w.ox AND f.y = w.oy AND f.i < w.li),
en AS (SELECT x, y, arg_min(ox, li) AS ox, arg_min(oy, li) AS oy FROM wk GROUP BY x, y)
"""


def log_grid(spark, sf) -> DataFrame:
    return grid.pixels(spark, sf).withColumn("hole", grid.rect(*HOLE))


def log(spark, sf) -> DataFrame:
    """(iter, tx, ty, sx, sy), a match for each line."""
    e = grid.embeddings(spark, sf)
    last = e.agg(F.max("vec_id").alias("last"))
    far = lambda i: F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 10007)
    return e.join(F.broadcast(last)).select(F.col("vec_id").alias("iter"), *[c.cast("int").alias(n) for c, n in ((8 + (F.col("vec_id") * 37) % 48, "tx"), (56 + (F.col("vec_id") * 53) % 330, "ty"), (4 + far(0) % 56, "sx"), (4 + far(1) % (F.col("last") - 7), "sy"))])


@query("u7_replay_log", LOG + "SELECT p.x, p.y, round(coalesce(s.v, p.v), 6) + 0.0 AS v, p.hole AND fl.i IS NULL AS hole, fl.i AS iter, CAST(CASE WHEN fl.i IS NOT NULL THEN fl.sx WHEN p.hole THEN -1 ELSE p.x END AS INTEGER) AS src_x FROM hx p LEFT JOIN fl ON fl.x = p.x AND fl.y = p.y LEFT JOIN en ON en.x = p.x AND en.y = p.y LEFT JOIN px s ON s.x = en.ox AND s.y = en.oy")
def u7_log(spark, sf):
    """A match for each line of the table, painted at once."""
    return paint.replay(log_grid(spark, sf), log(spark, sf), R).select("x", "y", rd("v").alias("v"), "hole", "iter", "src_x")


#: Iterations as of which targets are searched for, and the share of the holes that may be used near by.
ASKED, RATIO, BEST = (5, 40, 160), 0.5, 10
AS_OF = LOG + f""", ask AS (SELECT iter, tx, ty FROM lg WHERE iter IN {ASKED}),
st AS (SELECT p.x, p.y, coalesce(s.v, p.v) AS v, CASE WHEN fl.i IS NOT NULL THEN fl.i WHEN p.hole THEN 1000000000 ELSE -1 END AS i, coalesce(fl.sx, p.x) AS sx, coalesce(fl.sy, p.y) AS sy
  FROM hx p LEFT JOIN fl ON fl.x = p.x AND fl.y = p.y LEFT JOIN en ON en.x = p.x AND en.y = p.y LEFT JOIN px s ON s.x = en.ox AND s.y = en.oy),
ta AS MATERIALIZED (SELECT iter, x - tx AS dx, y - ty AS dy, v, i >= iter AS hole FROM st JOIN ask ON x BETWEEN tx - 4 AND tx + 4 AND y BETWEEN ty - 4 AND ty + 4),
nh AS (SELECT iter, count(*) FILTER (WHERE hole) AS holes FROM ta GROUP BY iter),
hs AS (SELECT x AS cx, y AS cy FROM px, ext WHERE x BETWEEN 4 AND 59 AND y BETWEEN 4 AND my - 4 AND NOT (x + 4 >= 10 AND x - 4 <= 53 AND y + 4 >= 60 AND y - 4 <= 380)),
sl AS MATERIALIZED (SELECT t.iter, cx, cy, avg((p.v - t.v) ** 2) AS d FROM hs, ta t, px p WHERE NOT t.hole AND p.x = cx + dx AND p.y = cy + dy GROUP BY t.iter, cx, cy)
"""
SHOWN = " SELECT iter, cx, cy, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY iter ORDER BY {t}.d, cy, cx) AS INTEGER) AS rn FROM {t} QUALIFY rn <= 10"


def _state(spark, sf):
    """(grid, its state of the whole log, the targets that are asked for)"""
    px = log_grid(spark, sf)
    return px, grid.through(paint.replay(px, log(spark, sf), R), "replayed"), log(spark, sf).filter(F.col("iter").isin(*ASKED)).select("iter", "tx", "ty")


def _shown(scored: DataFrame) -> DataFrame:
    return reuse.nearest(scored, BEST).select("iter", "cx", "cy", rd("d").alias("d"), "rn")


@query("k9_limit_reuse_of_log", AS_OF + """, cp AS (SELECT sx AS x, sy AS y, min(i) AS since FROM fl GROUP BY sx, sy),
us AS (SELECT iter, cx, cy, count(*) AS used FROM hs JOIN cp ON x BETWEEN cx - 4 AND cx + 4 AND y BETWEEN cy - 4 AND cy + 4 JOIN ask ON since < iter GROUP BY iter, cx, cy),
ok AS (SELECT sl.* FROM sl LEFT JOIN us USING (iter, cx, cy) JOIN nh USING (iter) WHERE coalesce(used, 0) < holes // 2)""" + SHOWN.format(t="ok"))
def k9_log(spark, sf):
    """Candidates of which fewer pixels than half the target's holes were copied by the matches before."""
    px, state, asked = _state(spark, sf)
    made = state.filter("iter is not null").select("image_id", "iter", "src_x", "src_y")
    return _shown(reuse.limit_reuse(reuse.scores_as_of(px, state, asked, R), reuse.used_as_of(made, asked, R), reuse.holes_as_of(state, asked, R)))


@query("k10_limit_local_reuse_of_log", AS_OF + """, near AS (SELECT DISTINCT iter, sx, sy FROM st JOIN ask ON x BETWEEN tx - 13 AND tx + 13 AND y BETWEEN ty - 13 AND ty + 13 WHERE i < iter),
us AS (SELECT n.iter, n.sx - t.dx AS cx, n.sy - t.dy AS cy, count(*) AS used FROM near n JOIN ta t ON t.iter = n.iter AND t.hole GROUP BY ALL),
al AS (SELECT sl.*, coalesce(used, 0) AS used, floor(holes * 0.5) AS cap FROM sl LEFT JOIN us USING (iter, cx, cy) JOIN nh USING (iter)),
ok AS (SELECT * FROM al QUALIFY used <= cap + 10 * greatest(0, ceil((min(used) OVER (PARTITION BY iter) - cap) / 10)))""" + SHOWN.format(t="ok"))
def k10_log(spark, sf):
    """Candidates that repeat little of what stands about the target as of its iteration."""
    px, state, asked = _state(spark, sf)
    return _shown(reuse.limit_local_reuse(reuse.scores_as_of(px, state, asked, R), reuse.used_locally(state, asked, R), reuse.holes_as_of(state, asked, R), RATIO))


@query("k11_no_reuse_of_log", AS_OF + ", ok AS (SELECT * FROM sl WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.iter < sl.iter AND lg.sx = sl.cx AND lg.sy = sl.cy))" + SHOWN.format(t="ok"))
def k11_log(spark, sf):
    """Candidates that no match before has taken as its source."""
    px, state, asked = _state(spark, sf)
    return _shown(reuse.no_reuse(reuse.scores_as_of(px, state, asked, R), log(spark, sf)))
