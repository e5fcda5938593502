"""Analytic cases: small inputs whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvius.operators import geo, graph, grid, history, placements, resample, vector
from fluvius.plans import resampled
from fluvius.sources import png


def ras(spark, a):
    rows = [(i, j, None if np.isnan(v) else float(v)) for i, line in enumerate(np.asarray(a, float)) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "r int, c int, z double")


def back(df, col="z"):
    p = df.toPandas()
    out = np.full((p.r.max() + 1, p.c.max() + 1), np.nan)
    out[p.r, p.c] = p[col].astype(float)
    return out


def test_block_mean_ignores_nodata(spark):
    a = np.arange(16.0).reshape(4, 4)
    a[0, 0] = np.nan
    got = back(grid.block_mean(ras(spark, a), 2))
    assert got[0, 0] == pytest.approx((1 + 4 + 5) / 3) and got[1, 1] == 12.5


def test_fill_takes_a_nearest_value(spark):
    n = np.nan
    out = grid.fill_nodata(ras(spark, [[1, n, 3], [n, n, n], [7, n, 9]]))
    got = back(out)
    assert got[0, 1] in (1, 3) and got[1, 0] in (1, 7) and out.where("filled").count() == 5


def test_deterrace_smooths_terraces_but_keeps_cliffs(spark):
    r, c = np.mgrid[0:48, 0:48]
    smooth = 0.17 * c + 0.03 * r
    terraced = np.rint(smooth)
    got = back(grid.deterrace(ras(spark, terraced)))
    assert np.abs(got - smooth)[8:-8, 8:-8].mean() < 0.6 * np.abs(terraced - smooth)[8:-8, 8:-8].mean()
    cliff = np.where(c < 24, 0.0, 100.0)
    assert np.array_equal(back(grid.deterrace(ras(spark, cliff))), cliff)


def test_slope_of_a_ramp(spark):
    c = np.mgrid[0:20, 0:20][1]
    s = grid.slope_percent(ras(spark, 0.35 * c), 3.5)
    assert np.allclose(back(s, "slope"), 10, atol=1e-9)
    assert grid.buildable(s, 10.01).first()[0] == 1.0 and grid.buildable(s, 9.99).first()[0] == 0.0


def test_mirrored_mean_equals_padding(spark):
    a = np.random.default_rng(1).normal(size=(12, 9))
    p = np.pad(a, 3, mode="symmetric")
    want = np.array([[p[i : i + 7, j : j + 7].mean() for j in range(9)] for i in range(12)])
    assert np.allclose(back(grid.focal_mean(ras(spark, a), 7), "mean"), want)


def test_vertical_plan(spark):
    df = spark.createDataFrame([(136.0, 727.0, 193.0)], "lo double, hi double, ws double")
    r = grid.plan_vertical(df).first()
    assert (r.sea, r.u_min, r.u_max, r.scale) == (62.0, 5.0, 596.0, 610.0)


def test_distance_and_components(spark):
    rng = np.random.default_rng(2)
    m = rng.random((15, 17)) < 0.5
    df = spark.createDataFrame([(i, j, 1.0, bool(m[i, j])) for i in range(15) for j in range(17)], "r int, c int, z double, m boolean")
    got = back(grid.nearest_distance(df.withColumn("off", ~F.col("m")), "off"), "d2")
    off = np.argwhere(~m)
    want = np.array([[((off - [i, j]) ** 2).sum(1).min() for j in range(17)] for i in range(15)])
    assert np.array_equal(got, want)
    label = {(r.r, r.c): r.component for r in grid.raster_components(df, "m").collect()}
    for i, j in np.argwhere(m):
        for a, b in ((i + 1, j), (i, j + 1)):
            if (a, b) in label:
                assert label[i, j] == label[a, b]
    assert len(label) == m.sum()


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_five_way_network(spark):
    rows = [(1, 0.0, 10.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0), (3, 10.0, 10.0, 20.0, 10.0), (4, 20.0, 10.0, 30.0, 10.0), (5, 90.0, 90.0, 99.0, 99.0)]
    e = spark.createDataFrame(rows, "line long, x1 double, y1 double, x2 double, y2 double")
    edges = graph.snap_edges(e, 2.0)
    levels = graph.upstream_levels(e.select(F.col("line").alias("node")), edges)
    got = {r.node: (r.level, r.start, r.terminal) for r in graph.network_flags(levels, edges).collect()}
    assert got == {1: (3, 1, 0), 2: (3, 1, 0), 3: (2, 0, 0), 4: (1, 0, 1), 5: (1, 1, 1)}


def test_zones_and_regions(spark):
    df = spark.createDataFrame([(-85.3, 35.0), (-122.0, 37.0), (151.0, -33.0), (5.0, 60.0), (5.0, 89.0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.utm_zone(F.col("lon"), F.col("lat"))).collect()] == [32616, 32610, 32756, 32632, None]
    areas = spark.createDataFrame([(1.0, 1), (1.5, 2), (100.0, 4), (40000.0, 9)], "a double, k int")
    assert all(r[0] == r[1] for r in areas.select(geo.order_from_area(F.col("a")), "k").collect())


def test_snap_edge(spark):
    df = spark.createDataFrame([(3, 2000), (4090, 2000), (2000, 5), (2000, 4000), (0, 0)], "c int, r int")
    assert [r[0].edge for r in df.select(geo.snap_edge(F.col("c"), F.col("r"))).collect()] == ["W", "E", "N", "S", "W"]


def test_png_round_trip(tmp_path, spark):
    a = np.random.default_rng(4).integers(0, 65536, (64, 64)).astype(np.uint16)
    assert np.array_equal(png.decode(png.encode(a)), a)
    df = spark.createDataFrame([(i, j, int(a[i, j])) for i in range(64) for j in range(64)], "r int, c int, lvl int")
    png.write_grid(df, str(tmp_path / "x.png"), 64)
    assert png.verify(str(tmp_path / "x.png"), 64)[:2] == (a.min(), a.max())
    with pytest.raises(png.ExportError):
        png.encode(a.astype(float))
    with pytest.raises(png.ExportError):
        png.write_grid(df.where("r > 0"), str(tmp_path / "y.png"), 64)


def test_hash_ignores_key_order():
    assert history.key_for({"b": 1, "a": 2.5}) == history.key_for({"a": 2.5, "b": 1}) != history.key_for({"a": 2.5, "b": 2})


def test_unknown_kind_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, "water.none", 0, 0, "x")], "id int, doc int, kind string, r int, c int, label string")
    with pytest.raises(Exception, match="unknown kind"):
        placements.numbered(df).collect()


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)], "src int, dst int")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert graph.components(edges.where("src > 1000")).count() == 0


def test_drift_by_source_and_failure(spark):
    schema = "slug string, seq int, buildable double, scale double, sources int, seam double, water double, dem_source string, failed boolean"
    rows = [("a", 1, 0.5, 300.0, 3, 0.1, 0.1, "x", False), ("a", 2, 0.5, 300.0, 3, 0.1, 0.1, "y", False), ("b", 1, 0.5, 300.0, 3, 0.1, 0.1, "x", False), ("b", 2, None, None, None, None, None, None, True), ("c", 1, 0.1, 1.0, 1, 0.1, 0.1, "x", True), ("c", 2, 0.9, 9.0, 9, 9.0, 0.1, "x", False)]
    runs = spark.createDataFrame(rows, schema)
    assert {r.slug: r.drift for r in history.drift(runs).collect()} == {"a": ["dem_source"], "b": ["failed"], "c": ["now builds"]}
    known = spark.createDataFrame([("a",)], "slug string")
    assert [r.slug for r in history.seeded(runs, known).collect()] == ["c"]
    assert sorted(r.slug for r in history.seeded(runs, known, force=True).collect()) == ["a", "c"]


def test_vertical_plan_with_a_given_sea_level(spark):
    df = spark.createDataFrame([(136.0, 727.0, 193.0)], "lo double, hi double, ws double")
    assert grid.plan_vertical(df, sea_level=100.0).first().sea == 100.0
    with pytest.raises(Exception, match="too low"):
        grid.plan_vertical(df, sea_level=10.0).collect()


def test_spline_beside_a_lone_pixel(spark):
    """Its only valid neighbour has no weight: a division by zero before."""
    df = spark.createDataFrame([(2, 2, 7.0)], "r int, c int, z double")
    points = spark.createDataFrame([(1, 0.5, 2.5), (2, 1.25, 2.5), (3, 4.0, 1.0), (4, 9.0, 9.0), (5, None, 1.0)], "k int, x double, y double")
    got = {x.k: x.z for x in resample.cubic_spline(df, F.col("x"), F.col("y"), points).collect()}
    assert got == {2: pytest.approx(7.0), 3: pytest.approx(7.0)}


def test_spline_makes_no_pairs(spark):
    """Points and pixels meet in tiles: a row for each of the sixteen neighbours was shuffled twice."""
    plan = resampled.resample_cubic(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Generate posexplode" not in plan


def test_first_crossing_makes_no_pairs(spark, monkeypatch):
    """20 boxes on 4,000 lines that all meet them: the least line of each without a row for each of the 80,000 pairs; cells are dealt."""
    monkeypatch.setattr(vector, "DEAL", 900)
    rng = np.random.default_rng(8)
    line = [(int(i), -50.0 + u, 5.0, 150.0, 5.5) for i, u in enumerate(rng.random(4000).tolist())]
    line += [(-1, 30.0, 0.0, 30.0, 99.0), (-2, 30.0, 7.1, 31.0, 7.1), (-3, 44.0, 5.2, 44.0, 5.2), (None, 0.0, 0.0, 99.0, 9.0), (-9, 500.0, 500.0, 501.0, 501.0)]
    s = spark.createDataFrame(line, "line long, x1 double, y1 double, x2 double, y2 double")
    boxes = [(k, 2.0 * k + 0.5, 4.0, 2.0 * k + 2.5, 7.0) for k in range(20)] + [(20, 31.0, 7.1, 33.0, 7.2), (21, 200.0, 0.0, 201.0, 1.0)]
    b = spark.createDataFrame(boxes, "id long, minx double, miny double, maxx double, maxy double")
    got = {r.id: r.line for r in vector.first_crossing(b, s, ["line"], 10.0).collect()}
    assert got == {k: 0 for k in range(20)} | {14: -1, 20: -2}
    some = s.where("line < 0 or line > 3900")
    want = {r.id: r.line for r in vector.crossing_boxes(b, some, 10.0).groupBy("id").agg(F.min("line").alias("line")).collect()}
    assert {r.id: r.line for r in vector.first_crossing(b, some, ["line"], 10.0).collect()} == want
