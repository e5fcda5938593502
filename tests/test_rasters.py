"""GeoTIFF files, rings and water layers against plain versions."""

import numpy as np
import pytest

from fluvius.operators import grid, rings, water
from fluvius.plans import rasters, resampled
from fluvius.sources import geotiff

SF = "/root/testdata/sf0.001"


def test_geotiff_round_trip(spark, tmp_path):
    z = np.arange(700 * 3, dtype=float).reshape(700, 3) / 4
    z[5, 1] = np.nan
    data = geotiff.encode(geotiff.Raster(z, 1000.0, 5000.0, 3.5))
    got = geotiff.decode(data)
    assert np.array_equal(got.z, z, equal_nan=True) and (got.west, got.north, got.mpp) == (1000.0, 5000.0, 3.5)
    (tmp_path / "a.tif").write_bytes(data)
    df = geotiff.read(spark, f"file://{tmp_path}/*.tif")
    assert df.count() == 2100 and df.where("z is null").select("r", "c").collect() == [(5, 1)]
    b = geotiff.bounds(df).first()
    assert (b.minx, b.miny, b.maxx, b.maxy) == (1000.0, 5000.0 - 700 * 3.5, 1010.5, 5000.0)
    with pytest.raises(geotiff.RasterError):
        geotiff.decode(b"not a raster")


def test_rings(spark):
    square = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    hole = [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0), (10.0, 10.0)]
    rows = [(1, "outer", 1, square[:3]), (1, "outer", 2, [square[0], square[3], square[2]]), (1, "inner", 3, hole), (2, "outer", 4, square[:2])]
    members = spark.createDataFrame([(a, b, c, [{"x": x, "y": y} for x, y in w]) for a, b, c, w in rows], f"rel long, role string, way long, points {rings.POINTS}")
    found = rings.assemble(members)
    assert {(r.rel, r.role, len(r.points)) for r in found.collect()} == {(1, "outer", 5), (1, "inner", 5)}
    assert [tuple(r) for r in rings.polygon_areas(found).collect()] == [(1, 9900.0)]


def test_water_layers(spark):
    rows = sorted(tuple(r) for r in resampled.water_layers(spark, SF).collect())
    at = {(r, c): v for r, c, *v in rows}
    raster = {(x.r, x.c): x.z for x in resampled.raster(spark, SF).collect()}
    assert at.keys() == raster.keys()
    wet = {k for k, v in at.items() if v[0]}
    dry = np.array([k for k in at if k not in wet])
    size = max(at)[0] + 1, 100
    half = max(3, round(water.SMOOTH / 14) | 1) // 2
    mirror = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    for (r, c) in sorted(wet)[::17]:
        px = np.sqrt(((dry - (r, c)) ** 2).sum(1).min())
        assert at[r, c][2] == pytest.approx(2.0 * np.sqrt(min(px * 14 / 60, 1)), abs=2e-6)
        near = [(mirror(i, size[0]), mirror(j, size[1])) for i in range(r - half, r + half + 1) for j in range(c - half, c + half + 1)]
        mean = np.mean([raster[k] for k in near if k in wet])
        assert at[r, c][3] == pytest.approx(min(mean, raster[r, c]), abs=2e-6)
    for k, (polygon, mask, depth, surface) in at.items():
        if not mask:
            assert depth == 0 and surface is None
        elif not polygon:
            assert 1.5 * 0.7 - 1e-6 <= depth <= 1.5 and surface == pytest.approx(raster[k], abs=2e-6)


def test_water_layers_of_a_wide_channel(spark):
    """A channel of 23 pixels of 14 m: its half, 161 m, is beyond the polygons' reach."""
    dem = spark.createDataFrame([(r, c, 9.0) for r in range(5) for c in range(41)], "r int, c int, z double")
    lines = spark.createDataFrame([(r, c, 4.0, 11.5) for r in range(5) for c in range(9, 32)], "r int, c int, depth double, half double")
    none = spark.createDataFrame([], "r int, c int, depth double")
    got = {x.c: x.depth for x in water.layers(dem, none, lines, 14.0).where("r = 2").collect()}
    for c in range(41):
        assert got[c] == pytest.approx(4 * max(np.sqrt(min(min(c - 8, 32 - c) / 11.5, 1)), 0.7) if 9 <= c < 32 else 0)


def test_fill_nodata_at_any_distance(spark):
    rng = np.random.default_rng(2)
    z = rng.random((60, 70))
    z[3:58, 5:66] = np.nan
    z[30, 20] = 5.0
    schema = "r int, c int, z double"
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(60) for c in range(70)]
    valid = sorted((r, c) for r, c, v in rows if v is not None)
    at = np.array(valid)
    for x in grid.fill_nodata(spark.createDataFrame(rows, schema)).collect():
        r, c = valid[int(np.argmin(((at - (x.r, x.c)) ** 2).sum(1)))]
        assert x.z == z[r, c] and x.filled == np.isnan(z[x.r, x.c])
    with pytest.raises(Exception, match="entirely nodata"):
        grid.fill_nodata(spark.createDataFrame([(0, 0, None), (0, 1, None)], schema)).collect()
    assert not grid.fill_nodata(spark.createDataFrame([(0, 0, 1.0)], schema)).first().filled


def test_levels_make_no_pairs(spark):
    """A row for each point and pixel of its window, 625 times the points, was taken for small and broadcast."""
    plan = rasters.median_window_sample(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join Inner, ((r" not in plan


def test_window_level_against_numpy(spark):
    """Windows over tiles' borders and the raster's, several values of a pixel, values and masks that are NULL, NaN the greatest."""
    rng = np.random.default_rng(5)
    rows = [(int(r), int(c), None if u < 0.2 else float("nan") if u > 0.99 else float(v), None if x < 0.1 else bool(x < 0.4)) for r, c, u, v, x in zip(rng.integers(0, 290, 9000), rng.integers(0, 140, 9000), rng.random(9000), rng.random(9000), rng.random(9000), strict=True)]
    points = [(int(r), int(c)) for r, c in zip(rng.integers(-8, 300, 200), rng.integers(-8, 150, 200), strict=True)] + [(-50, -50), (127, 127), (128, 128), (127, 127)]
    got = {(x.pr, x.pc): x.lvl for x in grid.window_level(spark.createDataFrame(rows, "r int, c int, z double, m boolean"), spark.createDataFrame(points, "pr int, pc int"), 4).collect()}
    want = {}
    for r, c in points:
        near = [x for x in rows if abs(x[0] - r) <= 4 and abs(x[1] - c) <= 4]
        v = np.sort([x[2] for x in near if x[2] is not None])
        wet = np.sort([x[2] for x in near if x[2] is not None and x[3]])
        if near:
            want[r, c] = (wet[(len(wet) - 1) // 2] + wet[len(wet) // 2]) / 2 if len(wet) else v[0] if len(v) else None
    assert got.keys() == want.keys() and (-50, -50) not in got
    for k, v in want.items():
        assert got[k] == v if v is None else got[k] == pytest.approx(v, nan_ok=True)
