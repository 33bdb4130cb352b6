"""The filling loop's priorities and second stages against plain versions, and the programs on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import loop, paint, priority
from lacuna.plans import q_programs
from test_fixtures import made


def grid_with_hole(seed=2, h=26, w=24):
    v, hole = np.random.default_rng(seed).random((h, w)), np.zeros((h, w), bool)
    hole[10:14, 9:13] = True
    return v, hole


def test_criminisi_equals_the_plan(spark):
    v, hole = grid_with_hole()
    rows = [(0, x, y, float(v[y, x] * 200), bool(hole[y, x])) for y in range(26) for x in range(24)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, v double, hole boolean").withColumns({c: F.col("v") for c in ("c0", "c1", "c2")})
    got = {(r["y"], r["x"]): r["priority"] for r in priority.criminisi(px, 2).collect()}
    term = paint._sum(np.where(hole, 0.0, 1.0), 2) / paint._sum(np.ones(v.shape), 2)
    mine = term * paint._data_term(v * 200, hole)
    assert len(got) == 20 and max(got.values()) > 0
    assert all(mine[at] == pytest.approx(p, abs=1e-9) for at, p in got.items())
    ty, tx = max(got, key=lambda at: (round(got[at], 9), -at[0], -at[1]))
    _, sx, sy, step = paint.fill(v * 200, hole, 2, order="criminisi")
    first = {tuple(p) for p in np.argwhere(step == 0).tolist()}
    assert first == {(y, x) for y in range(ty - 2, ty + 3) for x in range(tx - 2, tx + 3) if hole[y, x]}


def plain_scores(v, f, hole, ty, tx, r):
    """(mean squared, mean absolute, histogram difference of f) by centre, cell by cell."""
    out = {}
    for y in range(r, v.shape[0] - r):
        for x in range(r, v.shape[1] - r):
            if hole[y - r : y + r + 1, x - r : x + r + 1].any():
                continue
            at = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if 0 <= ty + i < v.shape[0] and 0 <= tx + j < v.shape[1] and not hole[ty + i, tx + j]]
            e = [v[y + i, x + j] - v[ty + i, tx + j] for i, j in at]
            t = [f[ty + i, tx + j] for i, j in at]
            lo, hi = min(t), max(t)
            bins = lambda c: np.array([sum(min(29, max(0, int(np.floor((z - lo) / (hi - lo) * 30)))) == b for z in c) / len(c) for b in range(30)])
            s = [f[y + i, x + j] for i in range(-r, r + 1) for j in range(-r, r + 1)]
            out[y, x] = (np.mean(np.square(e)), np.mean(np.abs(e)), np.abs(bins(s) - bins(t)).sum())
    return out


@pytest.mark.parametrize("second", paint.SECOND)
def test_second_stages(second):
    v, hole = grid_with_hole(4)
    _, sx, sy, step = paint.fill(v, hole, 2, k=12, second=second)
    term = np.where(hole, -1, paint._sum(np.where(hole, 0.0, 1.0), 2) / paint._sum(np.ones(v.shape), 2))
    edge = ~hole & (paint._sum(hole.astype(float), 1) > 0.5)
    ty, tx = np.unravel_index(np.where(edge, np.round(term, 9), -1).argmax(), v.shape)
    f = np.hypot(paint._slope(v, hole, 1), paint._slope(v, hole, 0)) if second == "gradient_histogram" else v
    scores = plain_scores(v, f, hole, ty, tx, 2)
    best = sorted(scores, key=lambda at: (round(scores[at][0], 12), at))[:12]
    y, x = min(best, key=lambda at: round(scores[at][1 if second == "absolute" else 2], 9))
    py, px = np.argwhere(step == 0)[0]
    assert (sy[py, px], sx[py, px]) == (y + py - ty, x + px - tx)


@pytest.mark.parametrize("name", q_programs.PROGRAMS)
def test_programs_fill(name):
    v, hole = grid_with_hole(6)
    how = q_programs.PROGRAMS[name]
    out, sx, sy, step = paint.fill(v, hole, 2, **how)
    assert (out[~hole] == v[~hole]).all() and (step[hole] >= 0).all()
    assert (out[hole] == v[sy[hole], sx[hole]]).all() and not hole[sy, sx].any()


def test_an_edge_continues():
    """Black over gray, the hole across the edge: the filled cells go on as beside it."""
    v = np.where(np.arange(30)[:, None] < 15, 0.0, 122.0) * np.ones((1, 40))
    hole = np.zeros(v.shape, bool)
    hole[11:19, 16:24] = True
    for order in ("criminisi", "confidence"):
        out, *_ = paint.fill(np.where(hole, 50.0, v), hole, 3, order=order)
        if order == "criminisi":
            assert (out == v).all()
    first = paint.fill(np.where(hole, 50.0, v), hole, 3, order="criminisi")[3]
    assert first[15, 16] == 0 or first[14, 16] == 0 or first[15, 23] == 0 or first[14, 23] == 0  # where the edge meets the hole


def test_blur_is_searched_and_not_painted():
    v, hole = grid_with_hole(9)
    a, b = paint.fill(v, hole, 2), paint.fill(v, hole, 2, blur=3.0)
    assert (a[0] != b[0]).any() and set(b[0][hole]) <= set(v[~hole])


def test_unknown_settings_are_errors():
    v, hole = grid_with_hole()
    for how in ({"order": "onion"}, {"second": "colour"}):
        with pytest.raises(ValueError, match="no such"):
            paint.fill(v, hole, 2, **how)


def test_strict_loops_end_with_an_error():
    v, hole = grid_with_hole()
    assert (paint.fill(v, hole, 2, accept=9.0, strict=True)[0] == paint.fill(v, hole, 2)[0]).all()
    with pytest.raises(ValueError, match="not accepted"):
        paint.fill(v, hole, 2, accept=0.0, strict=True)


SETTINGS = [{}, {"neighborhood": 7}, {"neighborhood": 1}, {"order": "criminisi"}, {"blur": 2.0}, {"k": 9, "second": "absolute"}, {"k": 9, "second": "histogram"}, {"k": 9, "second": "gradient_histogram", "order": "criminisi"}, {"accept": 0.0, "k": 5, "neighborhood": 8}, {"accept": 9.0, "strict": True}]


@pytest.mark.parametrize("how", SETTINGS, ids=lambda h: "-".join(f"{k}={v}" for k, v in h.items()) or "plain")
def test_the_loop_over_tables_equals_the_plain_one(spark, monkeypatch, how):
    """Two images at once, over several tiles."""
    tiles = loop.dealt_in_tiles
    monkeypatch.setattr(loop, "dealt_in_tiles", lambda p, reach: tiles(p, reach, 10))
    grids = [grid_with_hole(3, 20, 18), grid_with_hole(4, 22, 16)]
    for _, hole in grids:
        hole[10, 9:13] = False
        hole[13, 9:12] = False
    rows = [(i, x, y, float(v[y, x] * 200), bool(hole[y, x])) for i, (v, hole) in enumerate(grids) for y in range(v.shape[0]) for x in range(v.shape[1])]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, v double, hole boolean")
    how = {k: (v * 200 * 200 if k == "accept" else v) for k, v in how.items()}
    got = {(r["image_id"], r["y"], r["x"]): (r["v"], r["iter"], r["src_x"], r["src_y"]) for r in loop.inpaint(px, 2, **how).collect()}
    assert len(got) == len(rows)
    for i, (v, hole) in enumerate(grids):
        out, sx, sy, step = paint.fill(v * 200, hole, 2, **how)
        assert all(got[i, y, x] == (out[y, x], step[y, x], sx[y, x], sy[y, x]) for y in range(v.shape[0]) for x in range(v.shape[1]))


def test_loops_over_tables_that_cannot_go_on(spark):
    px = made(spark, 12, 12, F.col("x"), F.col("x").between(3, 8))  # no whole patch is left
    assert loop.inpaint(px, 2).filter("iter is null").count() == 72
    assert loop.inpaint(px.filter("false"), 2).count() == 0 and loop.inpaint(px.filter("not hole"), 2).filter("iter = -1").count() == 72
    some = made(spark, 16, 16, (F.col("x") * 7 + F.col("y") * 3) % 11, F.col("x").between(6, 8) & F.col("y").between(6, 8))
    with pytest.raises(Exception, match="not accepted"):
        loop.inpaint(some, 2, accept=0.0, strict=True).count()
    with pytest.raises(ValueError, match="no such"):
        loop.inpaint(some, 2, order="onion")
