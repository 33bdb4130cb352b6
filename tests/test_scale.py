"""Tiles, searches of many queries, logs, integral histograms, deltas, points, colours and files against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import colours, delta, graph, hist, integral, many, metric, paint, patches, points, priority, reuse, search, windows
from lacuna.sources import grid, mha, vts
from test_fixtures import made

PIXELS = "image_id long, x int, y int, v double, hole boolean"


def images(spark, *grids):
    """(image_id, x, y, v, hole) of (values, holes), one image each."""
    rows = [(k, x, y, float(v[y, x]), bool(hole[y, x])) for k, (v, hole) in enumerate(grids) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, PIXELS)


def noise(seed, h=24, w=22, at=(8, 13, 9, 13)):
    v, hole = np.random.default_rng(seed).random((h, w)), np.zeros((h, w), bool)
    hole[at[0] : at[1], at[2] : at[3]] = True
    return v, hole


# ---- tiles


def test_tiles_of_any_size_give_the_same(spark, monkeypatch):
    px = images(spark, noise(1), noise(2, 18, 30)).filter("not (image_id = 0 and x = 3 and y = 5)")
    make = lambda: [df.withColumn("image_id", F.col("image_id").cast("int")).collect() for df in (patches.with_status(px, 2), windows.gradient(px, "v").select("image_id", "x", "y", F.round("gx", 9).alias("gx"), F.round("gy", 9).alias("gy")), windows.boundary_normals(px).select("image_id", "x", "y", F.round("nx", 9).alias("nx")), priority.initial_queue(px, 2).withColumn("priority", F.round("priority", 9)), windows.sobel(px, "y", "v", "g").withColumn("g", F.round("g", 9)))]
    whole = [sorted(map(str, r)) for r in make()]
    tiled = patches.dealt_in_tiles
    monkeypatch.setattr(patches, "dealt_in_tiles", lambda p, reach, side=0: tiled(p, reach, 11))
    assert [sorted(map(str, r)) for r in make()] == whole
    assert patches.with_status(px.filter("false"), 2).count() == 0


def test_no_window_is_keyed_by_a_whole_column(spark, capsys):
    long = spark.range(3000).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x")).withColumns({"v": F.rand(1), "hole": F.lit(False)})
    patches.with_status(long, 2).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(_t" in plan
    assert patches.dealt_in_tiles(long, 2).select("_i", "_j").distinct().count() >= 3000 // patches.SIDE


def test_a_target_meets_its_own_image_alone(spark):
    a, b = noise(3), noise(4)
    score = lambda px: {tuple(r)[:3]: round(r["d"], 12) for r in patches.differences(px, patches.target_values(px, 9, 7, 2), 2, patches.ssd(["v"])).collect()}
    both, first = score(images(spark, a, b)), score(images(spark, a))
    second = {(1, x, y): d for (_, x, y), d in score(images(spark, b)).items()}
    assert both == first | second and len(both) > 100


# ---- many queries at once


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_knn_join_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(metric, "POINTS", 8)
    monkeypatch.setattr(metric, "QUERIES", 40)
    rng = np.random.default_rng(11)
    mid = rng.random((12, 5)) * 10
    a = mid[rng.integers(0, 12, 500)] + rng.normal(0, spread, (500, 5))
    a[100:200] = a[7]  # a vector that many rows share
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows + [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 5)], "id long, a array<double>")
    got = metric.knn_join(df, df, 6, size=32).collect()
    d = np.abs(a[:, None] - a[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, rn + 1): (int(j), round(float(d[i, j]), 9)) for i in range(500) for rn, j in enumerate(np.lexsort((np.arange(500), np.round(d[i], 9)))[:6])}
    assert {(r["query"], r["rn"]): (r["id"], round(r["d"], 9)) for r in got} == want
    share = np.mean([r["compared"] for r in got]) / 500
    assert share < (0.45 if spread < 0.1 else 1.01)  # of clusters, few blocks are met
    few = metric.knn_join(df.filter("id < 3"), df.filter("id < 3"), 6)
    assert few.count() == 6 and metric.knn_join(df.filter("false"), df, 3).count() == 0 and metric.knn_join(df, df.filter("false"), 3).count() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "outlier", "infinite", "equal"])
def test_levels_rule_out_no_near_vector(kind):
    rng = np.random.default_rng(13)
    a = rng.normal(0, 1, (300, 24))
    if kind == "ties":
        a = np.round(a)
        a[40:90] = a[3]
    elif kind == "outlier":
        a[9, 4] = 1e6
    elif kind == "infinite":
        a[9, 4] = np.inf
    elif kind == "equal":
        a[:] = 0.25
    keys = np.arange(300) * 3
    d = np.abs(a[:, None] - a[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    d = np.nan_to_num(d, nan=np.inf, posinf=np.inf)
    limit = np.where(np.arange(300) % 2 == 0, np.inf, np.sort(d, 1)[:, 4])
    for bound in (None, limit):
        i, got, at = metric._nearest(a, keys, a, keys, 7, True, bound)
        want = [(r, int(j) * 3, d[r, j]) for r in range(300) for j in np.lexsort((keys, d[r]))[:7] if d[r, j] < np.inf and (bound is None or d[r, j] <= bound[r])]
        assert list(zip(i.tolist(), got.tolist(), at.tolist(), strict=True)) == want


def test_a_tile_sends_on_the_nearest_alone():
    # before, each block of a tile sent k rows for each query
    rng = np.random.default_rng(14)
    a = rng.normal(0, 1, (400, 6))
    points, block = a[:3], np.arange(400) // 40
    far = np.abs(a[:, None] - points[None]).sum(2)
    least, most = (np.stack([f(far[block == b], 0) for b in range(10)]) for f in (np.min, np.max))
    v = pd.DataFrame({"key": np.arange(400), "a": list(a), "block": block})
    q = v.assign(radius=np.where(np.arange(400) % 5 == 0, np.nan, 4.0))
    got = metric._in_tile(q, v, 5, True, points, least, most)
    d = np.abs(a[:, None] - a[None]).sum(2)
    d[block[:, None] == block[None]] = np.inf  # met before
    want = {(i, int(j)) for i in range(400) for j in np.argsort(d[i])[:5] if d[i, j] <= (np.inf if i % 5 == 0 else 4.0)}
    rows = got[got["id"].notna()]
    assert {(int(x), int(y)) for x, y in zip(rows["query"], rows["id"], strict=True)} == want and len(rows) == len(want)
    assert got["met"].max() <= 360 and len(got) - len(rows) == 400
    assert metric._in_tile(q.head(0), v, 5, True, points, least, most).empty


def test_knn_join_sends_some_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(metric, "BOUNDS", 700)
    monkeypatch.setattr(metric, "SENT", 50)
    far, least = rng.random((90, 4)), rng.random((30, 4))
    most, radius = least + 0.1, np.where(np.arange(90) % 9 == 0, np.inf, 0.4)
    gap = metric._gaps(far, least, most)
    home = metric._homes(far, least, most, np.arange(30) > 3)
    assert (home == 4 + gap[:, 4:].argmin(1)).all()
    got = list(metric._within(far, radius, home, least, most))
    near = gap <= radius[:, None]
    near[np.arange(90), home] = False
    assert max(len(i) for i, _ in got) <= 50 and (np.concatenate([np.stack(x, 1) for x in got]) == np.argwhere(near)).all()


def test_a_round_of_the_graph_sends_on_what_may_be_kept():
    a = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0], [6.0, 1.0]])
    far, new = [1.5, 0.5, float("inf"), 1.0], [True, False, False, True]
    pdf = pd.DataFrame({"id": [9, 9, 9, 9, 8, 8], "other": [0, 1, 2, 3, 0, 1], "new": [*new, True, False], "va": [*a, a[0], a[1]], "far": [*far, 1.5, 0.5]})
    got = graph._pairs(pdf)
    # 1 and 2 have old edges both; 0 and 1 meet twice and count once
    assert sorted(got.itertuples(index=False, name=None)) == [(0, 1, 1.0), (2, 0, 5.0), (2, 3, 2.0)]
    assert graph._pairs(pdf.head(0)).empty


def test_best_vantage_point_tries_the_share(spark, monkeypatch):
    monkeypatch.setattr(metric, "SIDE", 16)
    rng = np.random.default_rng(2)
    a = rng.random((130, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)] + [(500, None)], "id long, a array<double>")
    got = metric.best_point(df, F.col("id")).first()
    d = np.abs(a[:, None] - a[None]).sum(2)
    spread = [np.delete(d[i], i).std() for i in range(14)]
    assert got["pivot"] == int(np.argmax(spread)) and got["spread"] == pytest.approx(max(spread), rel=1e-9)
    assert metric.best_point(df.filter("false"), F.col("id")).count() == 0


def test_graph_search_finds_most_of_the_nearest(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (400, 12))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)] + [(900, None)], "id long, a array<double>")
    edges = graph.neighbour_graph(df, 10)
    assert edges.groupBy("id").count().agg(F.max("count")).first()[0] <= 10
    got = {}
    for r in graph.descend(df, df, edges, 10).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    d = np.abs(a[:, None] - a[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    recall = np.mean([len(got[i] & set(np.argsort(d[i])[:10].tolist())) / 10 for i in range(400)])
    assert len(got) == 400 and recall >= 0.9
    assert graph.neighbour_graph(df.filter("false"), 5).count() == 0


def test_patches_of_many_targets_equal_brute_force(spark, monkeypatch):
    tiled = patches.dealt_in_tiles
    monkeypatch.setattr(many, "dealt_in_tiles", lambda p, reach: tiled(p, reach, 16))
    monkeypatch.setattr(many, "CHUNK", 7)
    yy, xx = np.mgrid[0:40, 0:36]
    smooth = np.sin(yy / 5) + np.cos(xx / 7) + 0.02 * np.random.default_rng(1).random((40, 36))
    hole = np.zeros((40, 36), bool)
    hole[16:22, 14:20] = True
    px = images(spark, (smooth, hole), noise(17))
    targets = patches.boundary(px).select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    got = many.nearest_patches(px, targets, 4, 2).collect()
    found = {}
    for r in got:
        found.setdefault((r["image_id"], r["tx"], r["ty"]), []).append((r["rn"], r["cx"], r["cy"], round(r["d"], 12)))
    assert len(found) == targets.count()
    for k, (v, h) in enumerate(((smooth, hole), noise(17))):
        for (_, tx, ty), rows in ((t, r) for t, r in found.items() if t[0] == k):
            near = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if 0 <= ty + dy < v.shape[0] and 0 <= tx + dx < v.shape[1] and not h[ty + dy, tx + dx]]
            d = {(cx, cy): np.mean([(v[cy + dy, cx + dx] - v[ty + dy, tx + dx]) ** 2 for dy, dx in near]) for cy in range(2, v.shape[0] - 2) for cx in range(2, v.shape[1] - 2) if not h[cy - 2 : cy + 3, cx - 2 : cx + 3].any()}
            best = sorted(d, key=lambda c: (round(d[c], 12), c[1], c[0]))[:4]
            assert [(r[1], r[2]) for r in sorted(rows)] == best
    share = np.mean([r["survivors"] for r in got if r["image_id"] == 0]) / 1000
    assert share < 0.1  # of a smooth image, few are compared
    assert many.nearest_patches(px, targets.filter("false"), 4, 2).count() == 0


# ---- logs


def plain_replay(v, hole, log, r):
    v, hole, h, w = v.copy(), hole.copy(), *v.shape
    src, at = {}, {}
    for i, tx, ty, sx, sy in sorted(log):
        new = {}
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                x, y, a, b = tx + dx, ty + dy, sx + dx, sy + dy
                if 0 <= x < w and 0 <= y < h and 0 <= a < w and 0 <= b < h and hole[y, x]:
                    new[y, x] = (v[b, a], (a, b))
        for (y, x), (value, s) in new.items():
            v[y, x], hole[y, x], src[y, x], at[y, x] = value, False, s, i
    return v, hole, src, at


def test_replay_of_a_long_log_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    v, hole = noise(6, 60, 50, (5, 55, 5, 45))
    log = [(i, *(int(x) for x in (rng.integers(0, 50), rng.integers(0, 60), rng.integers(0, 50), rng.integers(0, 60)))) for i in range(1000)]
    got = paint.replay(images(spark, (v, hole)), spark.createDataFrame(log, "iter int, tx int, ty int, sx int, sy int"), 2).collect()
    want_v, want_hole, src, at = plain_replay(v, hole, log, 2)
    assert len(got) == 3000 and len(at) > 1500
    for r in got:
        y, x = r["y"], r["x"]
        assert r["v"] == want_v[y, x] and r["hole"] == want_hole[y, x] and r["iter"] == at.get((y, x))
        assert (r["src_x"], r["src_y"]) == src.get((y, x), (-1, -1) if hole[y, x] else (x, y))
    made_ = paint.provenance(images(spark, (v, hole)), spark.createDataFrame(log, "iter int, tx int, ty int, sx int, sy int"), 2)
    assert made_.filter("src_x <> origin_x or src_y <> origin_y").count() > 100  # chains there are
    assert paint.replay(images(spark, (v, hole)), spark.createDataFrame([], "iter int, tx int, ty int, sx int, sy int"), 2).filter("hole").count() == hole.sum()


def test_reuse_as_of_iterations(spark):
    rng = np.random.default_rng(10)
    v, hole = noise(7, 40, 40, (12, 30, 12, 30))
    log = [(i, *(int(x) for x in (rng.integers(11, 31), rng.integers(11, 31), rng.integers(2, 38), rng.integers(2, 38)))) for i in range(60)]
    px, matches = images(spark, (v, hole)), spark.createDataFrame(log, "iter int, tx int, ty int, sx int, sy int")
    state = paint.replay(px, matches, 2).persist()
    asked = matches.filter("iter in (3, 15, 40)").select("iter", "tx", "ty")
    holes = {r["iter"]: r["holes"] for r in reuse.holes_as_of(state, asked, 2).collect()}
    used = {(r["iter"], r["cx"], r["cy"]): r["used"] for r in reuse.used_as_of(state.filter("iter is not null"), asked, 2).collect()}
    near = {(r["iter"], r["cx"], r["cy"]): r["used"] for r in reuse.used_locally(state, asked, 2).collect()}
    scored = {(r["iter"], r["cx"], r["cy"]): r["d"] for r in reuse.scores_as_of(px, state, asked, 2).collect()}
    kept = {tuple(r) for r in reuse.limit_reuse(reuse.scores_as_of(px, state, asked, 2), reuse.used_as_of(state.filter("iter is not null"), asked, 2), reuse.holes_as_of(state, asked, 2)).select("iter", "cx", "cy").collect()}
    fresh = {tuple(r) for r in reuse.no_reuse(reuse.scores_as_of(px, state, asked, 2), matches).select("iter", "cx", "cy").collect()}
    for i in (3, 15, 40):
        now_v, now_hole, src, _ = plain_replay(v, hole, log[:i], 2)
        tx, ty = log[i][1:3]
        patch = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if 0 <= ty + dy < 40 and 0 <= tx + dx < 40]
        assert holes[i] == sum(now_hole[ty + dy, tx + dx] for dy, dx in patch)
        copied = set(src.values())
        around = {src.get((y, x), (x, y)) for y in range(max(0, ty - 7), min(40, ty + 8)) for x in range(max(0, tx - 7), min(40, tx + 8)) if not now_hole[y, x]}
        for cy in range(2, 38):
            for cx in range(2, 38):
                if not hole[cy - 2 : cy + 3, cx - 2 : cx + 3].any():
                    assert used.get((i, cx, cy), 0) == sum((cx + dx, cy + dy) in copied for dy in range(-2, 3) for dx in range(-2, 3))
                    assert near.get((i, cx, cy), 0) == sum((cx + dx, cy + dy) in around for dy, dx in patch if now_hole[ty + dy, tx + dx])
                    valid = [(now_v[ty + dy, tx + dx] - v[cy + dy, cx + dx]) ** 2 for dy, dx in patch if not now_hole[ty + dy, tx + dx]]
                    if valid:
                        assert scored[i, cx, cy] == pytest.approx(np.mean(valid))
                        assert ((i, cx, cy) in kept) == (used.get((i, cx, cy), 0) < holes[i] // 2)
                        assert ((i, cx, cy) in fresh) == ((cx, cy) not in {(m[3], m[4]) for m in log[:i]})
    state.unpersist()


def test_targets_apart_are_those_of_the_choice_one_by_one(spark):
    rng = np.random.default_rng(12)
    rows = [(k, int(x), int(y), float(rng.integers(0, 12)) / 4, bool(rng.random() < 0.95)) for k in (0, 1) for x, y in {(int(a), int(b)) for a, b in rng.integers(0, 40, (260, 2))}]
    queue = spark.createDataFrame(rows, "image_id long, x int, y int, priority double, valid boolean")
    for n, distance in ((3, 4), (12, 4), (500, 3)):
        want = set()
        for k in (0, 1):
            left = [r for r in rows if r[0] == k and r[4]]
            for _ in range(n):
                if not left:
                    break
                best = min(left, key=lambda r: (-r[3], r[2], r[1]))
                want.add(best[:4])
                left = [r for r in left if max(abs(r[1] - best[1]), abs(r[2] - best[2])) > distance]
        assert {tuple(r) for r in paint.apart(queue, n, distance).collect()} == want
    assert paint.apart(queue.filter("false"), 3, 4).count() == 0


# ---- histograms of all patches


def test_rectangles_cover_offsets_once():
    rng = np.random.default_rng(1)
    for _ in range(30):
        some = {(int(x), int(y)) for x, y in rng.integers(-3, 4, (int(rng.integers(0, 40)), 2))}
        got = [(x, y) for x0, x1, y0, y1 in integral.rectangles(some) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
        assert sorted(got) == sorted(some)


def test_integral_histograms_equal_counts(spark, monkeypatch):
    tiled = patches.dealt_in_tiles
    monkeypatch.setattr(integral, "dealt_in_tiles", lambda p, reach: tiled(p, reach, 10))
    v, hole = noise(13)
    px = images(spark, (v, hole)).withColumn("w", F.col("v") * F.col("v"))
    for quadrants in (False, True):
        parts = integral.target_parts(px, ["v", "w"], 8, 10, 2, 6, quadrants)
        got = {(r["cx"], r["cy"]): r["d"] for r in integral.differences(px, ["v", "w"], parts, 2, 6).collect()}
        near = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if not hole[10 + dy, 8 + dx]]
        groups = [[o for o in near if not quadrants or (o[1] >= 0) * 2 + (o[0] >= 0) == q] for q in range(4 if quadrants else 1)]

        def shares(cy, cx):
            out = []
            for g in groups:
                for f in (v, v * v):
                    t = np.array([f[10 + dy, 8 + dx] for dy, dx in g])
                    c = np.array([f[cy + dy, cx + dx] for dy, dx in g])
                    out.append(np.bincount(np.clip(np.floor((c - t.min()) / (t.max() - t.min()) * 6), 0, 5).astype(int), minlength=6))
            return np.concatenate(out) / np.concatenate(out).sum()

        want = {(x, y): np.abs(shares(y, x) - shares(10, 8)).sum() for y in range(2, 22) for x in range(2, 20) if not hole[y - 2 : y + 3, x - 2 : x + 3].any()}
        assert got == pytest.approx(want)
    assert hist.greatest_between(spark.createDataFrame([], "dx int, dy int, ch int, f double"), (0.0, 1.0), 4).first()["most"] == 0


def test_vectorised_patches_move_pixels_once(spark):
    v, hole = noise(15, 40, 150)
    px = images(spark, (v, hole))
    df = patches.vectorised(px, 2)
    got = {(r["cx"], r["cy"]): r["pixels"] for r in df.collect()}
    want = {(x, y): v[y - 2 : y + 3, x - 2 : x + 3].ravel().tolist() for y in range(2, v.shape[0] - 2) for x in range(2, v.shape[1] - 2) if not hole[y - 2 : y + 3, x - 2 : x + 3].any()}
    assert got == want and len(want) > 100
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    null = images(spark, (v, hole)).withColumn("v", F.when((F.col("x") != 30) | (F.col("y") != 30), F.col("v")))
    assert {(r["cx"], r["cy"]): r["pixels"] for r in patches.vectorised(null, 2).filter("cx = 31 and cy = 31").collect()} == {k: [None if i == 6 else x for i, x in enumerate(p)] for k, p in want.items() if k == (31, 31)}


# ---- deltas


@pytest.mark.parametrize("rank", ["confidence", "criminisi"])
def test_a_paint_changes_what_the_whole_grid_says(spark, rank):
    v, hole = noise(14, 40, 40, (15, 26, 14, 24))
    px = priority.with_confidence(images(spark, (v, hole))).withColumns({c: F.col("v") * k for k, c in ((1, "c0"), (2, "c1"), (3, "c2"))})
    by = (lambda t: priority.initial_queue(t, 2)) if rank == "confidence" else (lambda t: priority.criminisi(t, 2))
    before = grid.through(by(px), "before")
    after = grid.through(delta.merged(px, delta.patch_after(px, 14, 17, 30, 30, 2), 14, 17, 2), "after")
    shown = lambda q: {(r["x"], r["y"]): round(r["priority"], 9) for r in q.collect()}
    old, new = shown(before), shown(by(after))
    assert shown(delta.queue_after(before, after, 14, 17, 2, 6, by)) == new != old
    got = delta.effects(px, before, 14, 17, 30, 30, 2, 6, by).collect()
    kinds = {k: {(r["x"], r["y"]) for r in got if r["effect"] == k} for k in ("used", "filled", "source", "queued", "dropped")}
    assert kinds["used"] == {(30, 30)} and kinds["filled"] == {(x, y) for x in range(12, 17) for y in range(15, 20) if hole[y, x]}
    assert all(r["v"] == v[r["y"] + 13, r["x"] + 16] and (r["src_x"], r["src_y"]) == (r["x"] + 16, r["y"] + 13) for r in got if r["effect"] == "filled")
    assert kinds["source"] == {(r["cx"], r["cy"]) for r in patches.sources(after, 2).subtract(patches.sources(px, 2)).collect()}
    assert kinds["dropped"] == {k for k in old if k not in new}
    assert kinds["queued"] == {k for k, p in new.items() if old.get(k) != p}


# ---- points


def plain_features(p, radius):
    n = len(p)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = [[j for j in range(n) if j != i and d2[i, j] <= radius**2] for i in range(n)]
    normal = []
    for i in range(n):
        group = p[[i, *near[i]]]
        if len(group) < 3:
            normal.append(None)
            continue
        w = np.linalg.eigh(np.cov(group.T, bias=True))[1][:, 0]
        normal.append(-w if w @ -p[i] < 0 else w)
    simple = [np.zeros(33) for _ in range(n)]
    for i in range(n):
        js = [j for j in near[i] if normal[j] is not None and d2[i, j] > 0]
        for j in js if normal[i] is not None else ():
            e, a, b = p[j] - p[i], normal[i], normal[j]
            f4 = np.linalg.norm(e)
            a1, a2 = a @ e / f4, b @ e / f4
            f3 = a1
            if math.acos(min(1, abs(a1))) > math.acos(min(1, abs(a2))):
                a, b, e, f3 = b, a, -e, -a2
            v = np.cross(e, a)
            v /= np.linalg.norm(v)
            w = np.cross(a, v)
            for k, (f, lo, width) in enumerate(((math.atan2(w @ b, a @ b), -math.pi, 2 * math.pi), (v @ b, -1, 2), (f3, -1, 2))):
                simple[i][11 * k + min(10, max(0, math.floor(11 * (f - lo) / width)))] += 100 / len(js)
    out = []
    for i in range(n):
        s = sum((simple[j] / d2[i, j] for j in near[i] if normal[j] is not None and d2[i, j] > 0), np.zeros(33)) if normal[i] is not None else np.zeros(33)
        out.append([100 * x / s[11 * (k // 11) : 11 * (k // 11) + 11].sum() for k, x in enumerate(s)] if s.sum() else None)
    return near, normal, out


def test_normals_and_point_features(spark):
    rng = np.random.default_rng(21)
    p = rng.random((150, 3))
    p[:, 2] = 0.3 * np.sin(3 * p[:, 0]) + 0.01 * rng.random(150) + 1
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(900, 5.0, 5.0, 5.0), (901, float("nan"), 0.0, 0.0), (902, None, 0.0, 0.0)]
    got = {r["id"]: r for r in points.point_features(spark.createDataFrame(rows, "id long, px double, py double, pz double"), 0.2).collect()}
    near, normal, want = plain_features(p, 0.2)
    assert set(got) == {*range(150), 900} and got[900]["nx"] is None and got[900]["fpfh"] is None and got[900]["k"] == 0
    for i in range(150):
        assert got[i]["k"] == len(near[i])
        if normal[i] is not None:
            assert [got[i][c] for c in ("nx", "ny", "nz")] == pytest.approx(list(normal[i]), abs=1e-6)
        assert (got[i]["fpfh"] is None) == (want[i] is None)
    # an angle on the edge of two bins, or of two normals that are equally close to a line, may fall either way
    apart = [np.abs(np.array(got[i]["fpfh"]) - want[i]).sum() for i in range(150) if want[i] is not None]
    assert max(apart) < 15 and np.mean(np.array(apart) > 1e-6) < 0.25 and len(apart) > 100
    assert points.point_features(spark.createDataFrame([], "id long, px double, py double, pz double"), 0.2).count() == 0


def test_point_features_of_blocks_in_parts(spark, monkeypatch):
    p = np.random.default_rng(22).random((300, 3)) * 0.5 - 0.2  # many neighbours, on both sides of 0
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, px double, py double, pz double")
    shown = lambda: {r["id"]: r for r in points.point_features(df, 0.15).collect()}
    whole = shown()
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.15**2
    assert {i: r["k"] for i, r in whole.items()} == {i: near[i].sum() - 1 for i in range(300)}
    for name, n in (("OWN", 40), ("NEAR", 30), ("PACK", 50)):
        monkeypatch.setattr(points, name, n)
    parts = shown()
    for i, r in whole.items():
        for c in ("nx", "ny", "nz", "fpfh"):
            assert parts[i][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-6))


def test_point_features_where_a_group_has_no_points_of_its_own(spark, monkeypatch):
    # a group of a point's halo alone: its rows of sums are none
    monkeypatch.setattr(points, "PACK", 1)
    p = np.random.default_rng(23).random((60, 3)) * 0.4
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, px double, py double, pz double")
    near, _, want = plain_features(p, 0.15)
    got = {r["id"]: r for r in points.point_features(df, 0.15).collect()}
    assert {i: r["k"] for i, r in got.items()} == {i: len(n) for i, n in enumerate(near)}
    assert {i for i, r in got.items() if r["fpfh"] is None} == {i for i, w in enumerate(want) if w is None}


def test_cells_of_many_points_meet_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(24)
    p = rng.random((400, 3)) * 0.12
    p[50:60] = p[7]
    at = np.floor(p / 0.03).astype(int) + 1
    df = pd.DataFrame({"id": np.arange(400), **dict(zip(points.AXES, p.T, strict=True)), "unit": 5, **dict(zip(("cx", "cy", "cz"), at.T, strict=True))})
    left = df.sort_values(["unit", "cx", "cy", "cz", "id"], ignore_index=True)
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.03**2
    np.fill_diagonal(near, False)
    for dense, at_once in ((1, 1 << 18), (300, 40), (1 << 30, 40)):
        monkeypatch.setattr(points, "DENSE", dense)
        monkeypatch.setattr(points, "AT_ONCE", at_once)
        got = list(points._near(left, df, 0.03))
        pairs = np.concatenate([np.stack([left["id"].to_numpy()[i], df["id"].to_numpy()[j]], 1) for i, j, _, _ in got])
        assert (pairs[np.lexsort(pairs.T[::-1])] == np.argwhere(near)).all()
        assert (np.diff(np.concatenate([i for i, *_ in got])) >= 0).all()
        for i, j, e, d2 in got:
            assert (e == p[df["id"].to_numpy()[j]] - p[left["id"].to_numpy()[i]]).all() and np.allclose(d2, (e * e).sum(1), rtol=1e-15)


def test_points_of_the_same_neighbours_keep_their_own_frame(spark):
    # four points that are all neighbours have one normal: which of two lies closer to their line is rounding alone
    rows = [(i, x, y, z + 1) for i, (x, y, z) in enumerate([(0.1, 0.0, 0.0), (0.0, 0.1, 0.02), (-0.1, 0.03, 0.01), (0.02, -0.1, 0.05)])]
    got = points.point_features(spark.createDataFrame(rows, "id long, px double, py double, pz double"), 0.5).collect()
    p = np.array([r[1:] for r in rows])
    for r in got:
        assert r["k"] == 3
        n, d = np.array([r["nx"], r["ny"], r["nz"]]), p - p[r["id"]]
        simple = []
        for i in range(4):
            e = p[np.arange(4) != i] - p[i]
            simple.append(np.bincount(np.floor(11 * (e @ n / np.linalg.norm(e, axis=1) + 1) / 2).astype(int), minlength=11) / 0.03)
        w = np.array([0 if i == r["id"] else 1 / (x @ x) for i, x in enumerate(d)])
        assert r["fpfh"][22:] == pytest.approx(list(w @ np.array(simple) / w.sum()), abs=1e-6)


def test_points_in_one_place_have_no_normal(spark):
    same = spark.range(5).select("id", *[F.lit(1.0).alias(a) for a in points.AXES])
    line = spark.range(5).select((F.col("id") + 10).alias("id"), (F.col("id") * 0.01 + 3).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"))
    got = points.point_features(same.unionByName(line), 0.1).collect()
    assert len(got) == 10 and all(r["k"] == 4 and r["nx"] is None and r["fpfh"] is None for r in got)


# ---- colours


def test_colours_cluster_as_plain_rounds_do(spark):
    rng = np.random.default_rng(30)
    a = np.concatenate([rng.normal(m, 0.1, (60, 3)) for m in ((0, 0, 0), (1, 1, 0), (0, 1, 2))])
    px = spark.createDataFrame([(0, i, 0, *map(float, x)) for i, x in enumerate(a)] + [(0, 900, 0, None, 0.0, 0.0), (0, 901, 0, float("nan"), 0.0, 0.0)], "image_id long, x int, y int, c0 double, c1 double, c2 double")
    names = ["c0", "c1", "c2"]
    seeds = colours.seeds(px, names, 3)
    assert len(seeds) == 3 and {int(np.argmin(((np.array(s) - np.array([(0, 0, 0), (1, 1, 0), (0, 1, 2)])) ** 2).sum(1))) for s in seeds} == {0, 1, 2}
    first = [list(map(float, a[i])) for i in (0, 1, 70)]
    got, taken = colours.lloyd(px, names, first)
    c = np.array(first)
    for _ in range(taken):
        own = ((a[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([a[own == j].mean(0) for j in range(3)])
    assert np.allclose(got, c) and taken < 50
    labels = {r["x"]: r["label"] for r in colours.labelled(px, names, got).collect()}
    assert labels[900] is None and labels[901] is None and all(labels[i] == k for i, k in enumerate(((a[:, None] - c[None]) ** 2).sum(2).argmin(1)))
    far, _ = colours.lloyd(px, names, [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [100.0, 100.0, 100.0]], 20)  # a centre that equals another, and one too far away
    assert len({tuple(np.round(x, 3)) for x in far}) == 3
    assert colours.seeds(px.filter("false"), names, 3) == [] and colours.labelled(px, names, []).filter("label is not null").count() == 0


# ---- files


def test_images_in_files(spark, tmp_path):
    px = made(spark, 90, 70, (F.col("x") * 7 + F.col("y") * 13) % 251 / 7, F.lit(False)).withColumn("w", -F.col("v")).repartition(7)
    at = str(tmp_path / "a.mha")
    mha.write_image(px, at, ["v", "w"], 70, 90, "MET_FLOAT")
    back = mha.read_image(spark, at, slice_bytes=4000)
    assert back.rdd.getNumPartitions() > 5
    got = {(r["x"], r["y"]): (r["c0"], r["c1"]) for r in back.collect()}
    assert got == {(r["x"], r["y"]): (float(np.float32(r["v"])), float(np.float32(r["w"]))) for r in px.collect()}
    mha.write_image(px, at, ["v"], 70, 90, "MET_UCHAR")
    assert mha.read_image(spark, at).agg(F.sum("c0")).first()[0] == sum(int(r["v"]) for r in px.collect())
    with pytest.raises(Exception, match="pixels for"):
        mha.write_image(px.filter("x < 69"), str(tmp_path / "b.mha"), ["v"], 70, 90)
    assert not (tmp_path / "b.mha").exists() and not (tmp_path / "b.mha.part").exists()
    (tmp_path / "c.mha").write_bytes(b"not a header\n")
    with pytest.raises(Exception, match="MetaImage"):
        mha.read_image(spark, str(tmp_path / "c.mha")).count()


def test_structured_grids_in_files(spark, tmp_path):
    pts = spark.range(5 * 7 * 3).select((F.col("id") % 5).cast("int").alias("i"), (F.floor(F.col("id") / 5) % 7).cast("int").alias("j"), F.floor(F.col("id") / 35).cast("int").alias("k"), F.array(*[(F.col("id") * c + 1) / 3 for c in range(4)]).alias("value"))
    at = str(tmp_path / "a.vts")
    vts.write_points(pts.repartition(4), at, "a <feature>", 4, (5, 7, 3), "Float32")
    back = vts.read_points(spark, at, "a <feature>", 16 * 10)
    assert back.rdd.getNumPartitions() > 5
    want = {(r["i"], r["j"], r["k"]): [float(np.float32(x)) for x in r["value"]] for r in pts.collect()}
    assert {(r["i"], r["j"], r["k"]): r["value"] for r in back.collect()} == want
    assert {(r["i"], r["j"], r["k"]): tuple(r["value"]) for r in vts.read_points(spark, at, "Points").collect()} == {p: tuple(map(float, p)) for p in want}
    with pytest.raises(Exception, match="no appended array"):
        vts.read_points(spark, at, "other").count()
    with pytest.raises(Exception, match="components"):
        vts.write_points(pts.withColumn("value", F.array(F.lit(1.0))), str(tmp_path / "b.vts"), "a", 4, (5, 7, 3))
    (tmp_path / "c.vts").write_bytes(b"<VTKFile/>")
    with pytest.raises(Exception, match="not a structured grid"):
        vts.read_points(spark, str(tmp_path / "c.vts"), "a").count()


def test_ranks_of_a_table_of_ties(spark):
    rows = [(i, 1.0 if i % 3 else float(i % 7)) for i in range(2000)] + [(5000, None), (5001, float("nan"))]
    got = {r["id"]: r["rn"] for r in search.ranked(spark.createDataFrame(rows, "id int, d double").repartition(5), ["id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] is not None and np.isnan(r[1]), 0 if r[1] is None or np.isnan(r[1]) else r[1], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
