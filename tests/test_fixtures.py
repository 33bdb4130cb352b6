"""Small fixtures with results worked out by hand, and the flagship against its known answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import pixel as fn
from lacuna.operators import loop, metric, paint, patches, priority, search, windows
from lacuna.sources import grid

SF = "/root/testdata/sf0.01"


def made(spark, h, w, value, hole):
    px = spark.range(h * w).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % w).cast("int").alias("x"), (F.col("id") / w).cast("int").alias("y"))
    return px.select("*", value.cast("double").alias("v"), hole.alias("hole"))


def test_flagship_known_answer(spark):
    import __spark_entry__ as e

    row = e.queries()["k6_best_source_patch"](spark, SF).first()
    assert (row["cx"], row["cy"], row["d"]) == (24, 298, 0.01543)


def test_counts_of_sources_and_boundary(spark):
    px = grid.pixels(spark, SF)
    assert patches.sources(px, 4).count() == 27048
    assert patches.boundary(px).count() == 64
    q = priority.initial_queue(px, 4).filter("x = 19 and y = 110").first()
    assert q["priority"] == pytest.approx(5 / 9)


def test_boundary_energy_of_a_step(spark):
    px = made(spark, 10, 10, F.when(F.col("x") < 5, 100).otherwise(75), F.col("x") < 5)
    assert windows.boundary_energy(px).first()["energy"] == pytest.approx(25)


def test_no_boundary_is_an_error(spark):
    with pytest.raises(Exception, match="no boundary"):
        windows.boundary_energy(made(spark, 5, 5, F.lit(1), F.lit(False))).collect()


def test_integer_vectors(spark):
    v = spark.range(10).select("id", F.transform(F.array(*[F.lit(0.0)] * 4), lambda x: x + F.col("id")).alias("a"))
    v = v.select("id", fn.absolute(F.col("a"), F.array(*[F.lit(5.3)] * 4)).alias("d"))
    assert [r["id"] for r in search.top(v, 3, ["id"]).orderBy("rn").collect()][0] == 5
    with pytest.raises(Exception, match="fewer candidates"):
        search.top_or_fail(v, 11, ["id"]).collect()
    assert search.below_or_all(v, -1.0).count() == 10


def test_pixel_differences(spark):
    one = spark.range(1).select(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("a"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("b"))
    got = one.select(fn.squared("a", F.col("a")).alias("s"), fn.squared("a", F.col("b")).alias("t"), fn.feature(F.col("a"), F.col("a"), F.lit(True), F.lit(True)).alias("f")).first()
    assert got["s"] == 0 and got["t"] == 5 and got["f"] == float("inf")
    with pytest.raises(Exception, match="differ in size"):
        one.select(fn.weighted_absolute(F.col("a"), F.col("b"), [1.0, 2.0])).collect()


def test_sample_variance(spark):
    assert spark.range(1, 8).agg(F.var_samp("id")).first()[0] == pytest.approx(4.6666, abs=1e-4)


def test_morphology(spark):
    hole = F.col("x").between(4, 6) & F.col("y").between(4, 6)
    px = windows.eroded(windows.dilated(made(spark, 11, 11, F.lit(0), hole), 1), 1)
    assert px.filter("dilated").count() == 25 and px.filter("eroded").count() == 1


def test_normals_are_units_on_the_boundary(spark):
    px = windows.boundary_normals(made(spark, 20, 20, F.lit(0), F.col("x") >= 12))
    n = px.select("x", F.hypot("nx", "ny").alias("l")).collect()
    assert all(abs(r["l"] - (r["x"] == 11)) < 1e-9 for r in n)


def test_the_loop_and_its_log_replayed_agree(spark):
    px = made(spark, 16, 16, (F.col("x") * 7 + F.col("y") * 3) % 11, F.col("x").between(6, 8) & F.col("y").between(6, 8))
    out = loop.inpaint(px, 2).persist()
    shift = F.struct((F.col("src_x") - F.col("x")).alias("sx"), (F.col("src_y") - F.col("y")).alias("sy"))
    log = out.filter("iter >= 0").groupBy("iter").agg(F.first(shift).alias("s"), F.min("x").alias("x"), F.max("y").alias("y"))
    log = log.select("iter", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("x") + F.col("s.sx")).alias("sx"), (F.col("y") + F.col("s.sy")).alias("sy"))  # some target that covers what the step filled
    at = {(r["x"], r["y"]): r["v"] for r in out.collect()}
    again = paint.replay(px, log, 2)
    assert not again.filter("hole").count() and log.count() > 1
    first = log.agg(F.min("iter")).first()[0]
    filled = {(r["x"], r["y"]) for r in out.filter(f"iter = {first}").collect()}
    assert all(at[r["x"], r["y"]] == r["v"] for r in again.collect() if (r["x"], r["y"]) in filled)


def test_fill_copies_from_its_sources():
    rng = np.random.default_rng(3)
    v, hole = rng.random((20, 20)), np.zeros((20, 20), bool)
    hole[8:12, 8:12] = True
    out, sx, sy, step = paint.fill(v, hole, 2)
    assert (sx >= 0).all() and (step[hole] >= 0).all() and (step[~hole] == -1).all()
    assert np.allclose(out[hole], v[sy[hole], sx[hole]])


def test_logs_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2, 3, 4), (1, 5, 6, -7, 8)], "iter int, sx int, sy int, tx int, ty int")
    grid.write_log(m, str(tmp_path / "log"))
    back = grid.match_log(spark.read.text(str(tmp_path / "log")), "value").drop("iter")
    assert sorted(map(tuple, back.collect())) == [(1, 2, 3, 4), (5, 6, -7, 8)]


def two(px):
    """The grid twice, the second time with other values and as another image."""
    return px.unionByName(px.withColumns({"image_id": F.lit(1).cast("long"), "v": F.col("v") * 3 + 1}))


def test_two_images_stay_apart(spark):
    px = made(spark, 12, 12, (F.col("x") * 7 + F.col("y") * 3) % 11, F.col("x").between(5, 6) & F.col("y").between(5, 6))
    both = two(px)
    other = both.filter("image_id = 1")

    def same(f):
        rows = lambda df: sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
        assert rows(f(both)) == sorted(rows(f(px)) + rows(f(other)))

    same(lambda p: patches.paint(p, 5, 5, 2, 2, 1))
    same(lambda p: patches.correspondence(p, spark.createDataFrame([(2, 2), (9, 9)], "cx int, cy int"), 5, 5, 1))
    same(lambda p: priority.update_confidence(priority.with_confidence(p), 5, 5, 2))
    same(lambda p: priority.top(priority.initial_queue(p, 1)))
    same(lambda p: priority.push_or_update(priority.initial_queue(p, 1), priority.initial_queue(p, 1).filter("x = 4").withColumn("priority", F.lit(9.0))))
    same(lambda p: windows.across_hole(p, patches.boundary(p).select("image_id", "x", "y", F.lit(1.0).alias("ix"), F.lit(0.0).alias("iy")), 6))
    same(lambda p: priority.depth(p, "v", 6).withColumn("priority", F.round("priority", 6)))
    same(lambda p: loop.inpaint(p, 1))


def test_what_is_not_accepted_is_chosen_otherwise():
    rng = np.random.default_rng(8)
    v, hole = rng.random((24, 24)), np.zeros((24, 24), bool)
    hole[10:13, 10:13] = True
    plain, local = paint.fill(v, hole, 2), paint.fill(v, hole, 2, neighborhood=6)
    assert all((a == b).all() for a, b in zip(plain, paint.fill(v, hole, 2, accept=9.0, k=5)))  # all accepted
    assert all((a == b).all() for a, b in zip(plain, paint.fill(v, hole, 2, neighborhood=6, accept=0.0, k=1)))  # none: the whole grid is searched
    assert (local[0] != plain[0]).any()
    source = np.array([[not hole[y - 2 : y + 3, x - 2 : x + 3].any() and 2 <= y < 22 and 2 <= x < 22 for x in range(24)] for y in range(24)])
    first = paint._matches(v, hole, source, 9, 9, 2)
    for y, x, d, a in first[:20]:
        e = [v[int(y) + i, int(x) + j] - v[9 + i, 9 + j] for i in range(-2, 3) for j in range(-2, 3) if not hole[9 + i, 9 + j]]
        assert d == pytest.approx(np.mean(np.square(e))) and a == pytest.approx(np.mean(np.abs(e)))
    out, sx, sy, step = paint.fill(v, hole, 2, accept=0.0, k=8)
    ty, tx = np.argwhere(step == 0)[0]
    ry, rx = sy[ty, tx] - ty, sx[ty, tx] - tx
    targets = [(y, x) for y in range(8, 15) for x in range(8, 15) if not hole[y, x] and abs(ty - y) <= 2 and abs(tx - x) <= 2]
    assert any((b := paint._matches(v, hole, source, y, x, 2)[:8])[b[:, 3].argmin()][:2].astype(int).tolist() == [y + ry, x + rx] for y, x in targets)


def test_metric_index_equals_a_scan(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.random((300, 6)), np.repeat(rng.random((1, 6)), 40, 0), rng.random((60, 6)) / 50])  # ties and a dense corner
    v = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(a)] + [(1000, None, 0)], "id long, a array<double>, part int")
    points = metric.vantage_points(v, points=9)
    assert len(points) == 9 and metric.vantage_points(v.filter("a is null")) == []
    tree = metric.index(v, points)
    assert tree.count() == len(a)
    for q in (a[0], a[310], np.zeros(6), np.full(6, 9.0)):
        d = np.abs(a - q).sum(1)
        order = np.lexsort((np.arange(len(a)), d))
        assert [r["id"] for r in metric.nearest(tree, points, q.tolist(), 50).orderBy("rn").collect()] == order[:50].tolist()
        assert metric.nearest(tree, points, q.tolist(), 999).count() == len(a)
        for r in (0.0, float(np.sort(d)[30]), 1.5):
            assert {x["id"] for x in metric.within(tree, points, q.tolist(), r).collect()} == set(np.flatnonzero(d <= r).tolist()) or r == 0.0
        got = metric.nearest(tree, points, q.tolist(), 4, by="part").orderBy("part", "rn").collect()
        assert [x["id"] for x in got] == [i for p in range(3) for i in [j for j in order if j % 3 == p][:4]]
    assert metric.nearest(metric.index(v, []), [], [0.0] * 6, 3).count() == 0 and metric.within(metric.index(v, []), [], [0.0] * 6, 3).count() == 0


def test_ranks_of_a_whole_table(spark):
    d = [None, float("nan"), *[float(i % 17) for i in range(500)], *[3.0] * 300]
    v = spark.createDataFrame(list(enumerate(d)), "id long, d double").repartition(7)
    got = [r["id"] for r in search.ranked(v, ["id"]).orderBy("rn").collect()]
    assert got == [0, *sorted(range(2, len(d)), key=lambda i: (d[i], i)), 1]
    assert sorted(r["rn"] for r in search.ranked(v, ["id"]).collect()) == list(range(1, len(d) + 1))
    assert search.ranked(v.filter("false"), ["id"]).count() == 0
