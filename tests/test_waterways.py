"""Frames from mapped elements on a small map with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvius.operators import geo, layers, waterways
from fluvius.sources import osm

EPSG = 32616


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    lon0, lat0 = -85.3, 35.0
    x0, y0 = spark.range(1).select(*geo.to_utm(F.lit(lon0), F.lit(lat0), F.lit(EPSG))).first()
    side, n = 20_000.0, 100
    on = layers.Grid(x0 - side / 2, y0 + side / 2, side / n, n, n)
    back = lambda x, y: spark.createDataFrame([(x, y)], "x double, y double").select(*geo.from_utm(F.col("x"), F.col("y"), F.lit(EPSG))).first()

    def at(*points):
        out = []
        for x, y in points:
            lon, lat = back(x0 + x, y0 + y)
            out.append({"lat": lat, "lon": lon})
        return out

    square = lambda x, y, a: at((x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y))
    way = lambda i, g, **tags: {"type": "way", "id": i, "tags": tags, "geometry": g}
    elements = [
        way(1, at((-6000, 0), (0, 0)), waterway="river", name="Big"),
        way(2, at((0, 0), (6000, 0)), waterway="river", name="Big"),
        way(3, at((0, 0), (0, 3000), (0, 5000)), waterway="stream"),  # drawn away from its mouth: the terrain falls the other way
        way(4, at((2000, -4000), (4000, -4000)), waterway="stream", tunnel="culvert"),
        way(5, at((5000, 5000), (5000, 5400)), waterway="drain", intermittent="yes", name=""),
        way(6, square(-8000, -8000, 500), natural="water", water="lake", name="Lake"),
        way(7, square(-6000, -8000, 400), natural="water", water="reservoir"),
        way(8, square(-4000, -8000, 10), natural="water"),
        way(9, at((-3000, -8000), (-2500, -7500), (-2500, -8000), (-3000, -7500), (-3000, -8000)), natural="water"),
        way(10, at((-9000, -9900), (9000, -9900)), natural="coastline"),
        {"type": "relation", "id": 20, "tags": {"natural": "water", "water": "river"}, "members": [
            {"type": "way", "role": "outer", "geometry": at((6000, -7000), (7000, -7000), (7000, -6500))},
            {"type": "way", "role": "outer", "geometry": at((7000, -6500), (6000, -6500), (6000, -7000))},
            {"type": "way", "role": "inner", "geometry": square(6200, -6900, 100)}]},
    ]
    path = tmp_path_factory.mktemp("osm") / "a.json"
    path.write_text(json.dumps({"elements": elements}))
    rivers = spark.createDataFrame([(1, 5, 1200.0, 20.0, at((-7000, 50), (7000, 50)))], "river long, strahler int, upland double, discharge double, geometry array<struct<lat:double,lon:double>>")
    # falls to the east and to the south; the lowest rows are sea
    z = lambda r, c: 0.0 if r >= 95 else 300.0 - 0.5 * c - 1.0 * r
    dem = spark.createDataFrame([(r, c, z(r, c)) for r in range(n) for c in range(n)], "r int, c int, z double")
    flow, areas, bodies = waterways.frames(osm.read(spark, str(path)), EPSG, dem, on, rivers)
    return {r.id: r for r in flow.collect()}, {r.id: r for r in areas.collect()}, {r.id: r for r in bodies.collect()}, on


def test_lines(frames):
    flow = frames[0]
    assert set(flow) == {f"osm-w{i}" for i in range(1, 6)}
    big, creek = flow["osm-w1"], flow["osm-w3"]
    assert (big.ord, big.drainage, big.strahler, big.discharge, big.order_source) == (6, 1200.0, 5, 20.0, "hydrorivers-area")
    assert creek.order_source == "osm-tag" and creek.ord == 1  # its mouth is near the river, its body is not
    assert creek.flipped and creek.flowdir == 1 and creek.geom[0]["y"] > creek.geom[-1]["y"]
    assert flow["osm-w4"].culvert and not big.culvert and flow["osm-w5"].intermittent and flow["osm-w5"].fcode == 46003 and flow["osm-w5"].name is None
    assert (flow["osm-w5"].flowdir, flow["osm-w5"].flipped) == (1, True) or flow["osm-w5"].flowdir in (0, 1)
    assert big.lengthkm == pytest.approx(6.0, abs=1e-3) and big.ftype == 460


def test_network(frames):
    flow = frames[0]
    assert flow["osm-w1"].path == flow["osm-w2"].path == flow["osm-w3"].path == 1 and flow["osm-w4"].path == 2
    got = {k: (flow[k].hydroseq, flow[k].dnhydroseq, flow[k].startflag, flow[k].terminalfl) for k in ("osm-w1", "osm-w2", "osm-w3")}
    assert got == {"osm-w1": (2, 1, 1, 0), "osm-w2": (1, 0, 0, 1), "osm-w3": (2, 1, 1, 0)}


def test_polygons_and_sea(frames):
    _, areas, bodies, on = frames
    assert set(bodies) == {"osm-6", "osm-7"}  # too small and crossing itself are left out
    assert (bodies["osm-6"].ftype, bodies["osm-7"].ftype, bodies["osm-6"].name) == (390, 436, "Lake") and bodies["osm-6"].areasqkm == pytest.approx(0.25, abs=1e-4)
    assert set(areas) == {"osm-20", "dem-sea-0"}
    assert areas["osm-20"].ftype == 460 and areas["osm-20"].areasqkm == pytest.approx(0.49, abs=1e-4) and len(areas["osm-20"].rings) == 2
    assert areas["dem-sea-0"].areasqkm == pytest.approx(5 * 100 * (on.mpp / 1000) ** 2) and areas["dem-sea-0"].ftype == 445


def test_sea_with_an_island(spark):
    n = 40
    on = layers.Grid(0.0, n * 100.0, 100.0, n, n)
    z = np.full((n, n), 20.0)
    z[10:, :] = 0.0
    z[20:24, 20:23] = 5.0
    z[2:5, 2:5] = 0.0  # low ground that does not reach the edge
    dem = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(n) for c in range(n)], "r int, c int, z double")
    rows = waterways.sea(dem, on).withColumn("m2", waterways.area(F.col("rings"))).collect()
    assert len(rows) == 1 and len(rows[0].rings) == 2 and rows[0].m2 == (30 * 40 - 12) * 1e4
