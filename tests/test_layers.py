"""Clipping, channels and water layers against brute-force versions and maps whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvius.operators import layers, tiles
from fluvius.operators import vector as V

GEOM = "array<struct<x:double,y:double>>"


def points(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def lines(spark, rows):
    return spark.createDataFrame(rows, f"line long, name string, ord int, culvert boolean, intermittent boolean, discharge double, geom {GEOM}")


def polys(spark, rows):
    return spark.createDataFrame(rows, f"poly long, name string, ftype int, rings array<{GEOM}>")


def flat(spark, n, z=100.0):
    return spark.range(n * n).select((F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"), F.lit(z).alias("z"))


def test_interpolation_equals_a_walk(spark):
    rng = np.random.default_rng(1)
    rows, wanted, want = [], [], {}
    for line in range(12):
        p = np.cumsum(rng.integers(0, 4, (int(rng.integers(2, 9)), 2)), axis=0).astype(float)
        rows += [(line, i + 1, *map(float, (*p[i], *p[i + 1]))) for i in range(len(p) - 1)]
        size = np.linalg.norm(np.diff(p, axis=0), axis=1)
        for d in [-1.0, 0.0, *np.cumsum(size), *(rng.random(4) * (size.sum() + 2))]:
            left = min(max(float(d), 0.0), size.sum())
            k = 0
            while k < len(size) - 1 and left > size[k] + 1e-12:
                left -= size[k]
                k += 1
            t = min(left / size[k], 1) if size[k] else 0
            wanted.append((line, float(d), len(wanted)))
            want[len(wanted) - 1] = p[k] + (p[k + 1] - p[k]) * t
    m = V.measured(spark.createDataFrame(rows, "line long, seq int, x1 double, y1 double, x2 double, y2 double"))
    got = V.interpolate(m, spark.createDataFrame(wanted, "line long, d double, k int")).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose((r.x, r.y), want[r.k], atol=1e-9)


def test_touched_pixels_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for line in range(25):
        p = rng.random((int(rng.integers(2, 5)), 2)) * 12 + 4
        half = float(rng.random() * 2 + 0.2)
        rows += [(line, 1, i, *map(float, (*p[i], *p[i + 1])), half) for i in range(len(p) - 1)]
        for r in range(22):
            for c in range(22):
                mid = np.array([c + 0.5, r + 0.5])
                hit = False
                for i in range(len(p) - 1):
                    u = (p[i + 1] - p[i]) / (n := np.linalg.norm(p[i + 1] - p[i]))
                    v, d = np.array([-u[1], u[0]]), mid - (p[i] + p[i + 1]) / 2
                    hit |= bool(abs(d @ u) <= n / 2 + 0.5 * np.abs(u).sum() and abs(d @ v) <= half + 0.5 * np.abs(v).sum() and (np.abs(d) <= 0.5 + n / 2 * np.abs(u) + half * np.abs(v)).all())
                    if i:
                        hit |= bool(np.linalg.norm(np.maximum(np.abs(mid - p[i]) - 0.5, 0)) <= half)
                if hit:
                    want.add((line, r, c))
    s = spark.createDataFrame(rows, "line long, part long, seq int, x1 double, y1 double, x2 double, y2 double, half double")
    assert {tuple(x) for x in V.touched_pixels(s).collect()} == want


def test_clipped_rings_hold_the_same_pixels(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        a = np.sort(rng.random(int(rng.integers(3, 9)))) * 2 * np.pi
        shell = [(10 + np.cos(x) * s, 10 + np.sin(x) * s) for x, s in zip(a, rng.random(len(a)) * 12 + 1, strict=True)]
        rows.append((k, None, 390, [points(*shell, shell[0])]))
    p = polys(spark, rows)
    box = (5.0, 4.0, 16.0, 15.0)
    cut = p.withColumn("rings", F.transform("rings", lambda g: V.clip_ring(g, box)))
    whole, part = ({tuple(x) for x in V.rasterise(V.ring_edges(x)).collect()} for x in (p, cut))
    assert part == {x for x in whole if 4 <= x[1] < 15 and 5 <= x[2] < 16} and len(part) > 500
    outside = p.select(V.clip_ring(F.col("rings")[0], (100.0, 100.0, 110.0, 110.0)).alias("g"))
    assert all(r.g == [] for r in outside.collect())


def test_a_river_a_creek_and_land(spark):
    """A reservoir 140 m wide on a river of order 9, and a creek of order 3, on flat land at 100 m."""
    n, mpp = 128, 7.0
    side = n * mpp
    grid = layers.Grid(0.0, side, mpp, n, n)
    x0, x1 = side / 2 - 70, side / 2 + 70
    flow = lines(spark, [(1, "Big", 9, False, False, None, points((side / 2, side + 50), (side / 2, -50))), (2, None, 3, None, None, None, points((0, side / 4), (x0 - 100, side / 4))), (3, "Pipe", 9, True, False, None, points((0, 10), (side, 10)))])
    bodies = polys(spark, [(7, None, 436, [points((x0, -99), (x1, -99), (x1, side + 99), (x0, side + 99), (x0, -99))]), (8, "Dry", 361, [points((0, 0), (99, 0), (99, 99), (0, 0))]), (9, "Puddle", 390, [points((10, 800), (40, 800), (40, 830), (10, 830), (10, 800))])])
    made, reported = layers.build(flat(spark, n), grid, flow, polys(spark, []), bodies)
    p = made.toPandas()
    depth = np.zeros((n, n))
    depth[p.r, p.c] = p.depth
    mid = n // 2
    assert depth[50, mid] == pytest.approx(12.0) and 0 < depth[50, int(x0 / mpp) + 1] < 7
    creek = depth[int(n * 0.75) - 2 : int(n * 0.75) + 3, 20]
    assert 0.7 * 1.2 <= creek.max() <= 1.2 and depth[10, 10] == 0 and depth[n - 3, 5] == 0
    r = reported.collect()
    assert [(x.rank, x.label, x.ftype, x.ord, x.depth, x.p10) for x in r] == [(1, "Big", 436, 9, 12.0, 100.0)]
    assert p[p["mask"]].surface.notna().all() and p[~p["mask"]].surface.isna().all()
    level = layers.reference_surface(flat(spark, n), grid, flow, reported).first()
    assert level.surface == 100.0 and level.source == "Big (order 9, 0.125 km2) p10 surface"


def test_discharge_sizes_channels(spark):
    n, mpp = 128, 3.5
    grid = layers.Grid(0.0, n * mpp, mpp, n, n)
    flow = lines(spark, [(1, "dry", 6, False, False, 1.5, points((100, 0), (100, 500))), (2, "wet", 6, False, False, None, points((300, 0), (300, 500))), (3, "now and then", 6, False, True, None, points((400, 0), (400, 500)))])
    none = polys(spark, [])
    made, reported = layers.build(flat(spark, n), grid, flow, none, none)
    row = made.where("r = 60").toPandas().set_index("c").depth
    wide = lambda x: sum(row[c] > 0 for c in range(int(x / mpp) - 9, int(x / mpp) + 9))
    assert wide(100) <= 4 and wide(300) >= 10
    assert row[int(300 / mpp)] > row[int(100 / mpp)] and row[int(400 / mpp)] == pytest.approx(row[int(300 / mpp)] / 2, rel=0.1)
    assert reported.count() == 0
    level = layers.reference_surface(flat(spark, n, 42.0), grid, flow, reported).first()
    assert level.surface == 42.0 and level.source == "p10 surface along order-6 flowlines (dry, now and then, wet)"
    nothing = layers.reference_surface(flat(spark, n, 7.0), grid, flow.limit(0), reported).first()
    assert tuple(nothing) == (7.0, "playable minimum (no water found)")
    assert layers.reference_surface(flat(spark, n), grid, flow, reported, 55.5).first().surface == 55.5


def test_tiles_have_no_seams(spark, monkeypatch):
    """Kernels over a raster wider and taller than a tile equal those over the whole array, edges included."""
    from fluvius.operators import grid as G

    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "STRIP", 5)
    rng = np.random.default_rng(5)
    h, w = 37, 50
    z = np.rint(rng.random((h, w)) * 4 + np.arange(w) * 0.3)
    m = rng.random((h, w)) < 0.2
    df = spark.createDataFrame([(i, j, float(z[i, j]), bool(m[i, j])) for i in range(h) for j in range(w)], "r int, c int, z double, m boolean")

    def back(d, name):
        p = d.toPandas()
        out = np.full((h, w), np.nan)
        out[p.r, p.c] = p[name].astype(float)
        return out

    pad = lambda a, k: np.pad(a, k, mode="symmetric")
    mean = lambda a, k: np.array([[pad(a, k)[i : i + 2 * k + 1, j : j + 2 * k + 1].mean() for j in range(w)] for i in range(h)])
    assert np.allclose(back(G.focal_mean(df, 7), "mean"), mean(z, 3))
    spread = np.array([[np.ptp(pad(z, 3)[i : i + 7, j : j + 7]) for j in range(w)] for i in range(h)])
    once = np.where(spread <= 3.5, mean(z, 3), z)
    assert np.allclose(back(G.deterrace(df, 3.5), "z"), np.where(spread <= 3.5, mean(once, 3), once))
    with np.errstate(invalid="ignore", divide="ignore"):
        assert np.allclose(back(G.masked_mean(df, 9), "mean"), mean(np.where(m, z, 0), 4) / mean(m.astype(float), 4), equal_nan=True)
    at = np.argwhere(m)
    want = np.array([[((at - [i, j]) ** 2).sum(1).min() for j in range(w)] for i in range(h)])
    assert np.array_equal(back(G.nearest_distance(df, "m"), "d2"), want)
    none = G.nearest_distance(df.withColumn("m", F.lit(False)), "m")
    assert none.where("d2 is not null").count() == 0
    with pytest.raises(Exception, match="whole number"):
        G.block_mean(df, 4, checked=True).collect()
