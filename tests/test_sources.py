"""Remote and local sources against a server of this machine and files of known content."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvius.operators import geo, layers
from fluvius.plans import maps
from fluvius.sources import geotiff, registry, remote

SEEN = []


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, status, body=b"", kind="application/json"):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        SEEN.append(self.path)
        if self.path == "/busy":
            return self.answer(429)
        self.answer(200, json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"waterway": "river"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}]}).encode())

    def do_GET(self):
        at, q = urlparse(self.path).path, parse_qs(urlparse(self.path).query)
        SEEN.append(at)
        if at == "/flaky":
            return self.answer(503) if SEEN.count("/flaky") < 3 else self.answer(200, b'{"ok": 1}')
        if at == "/error":
            return self.answer(200, b'{"error": {"message": "bad box"}}', "application/json")
        if at == "/catalogue":
            rows = [{"Name": "B", "Category": 1, "LowPS": 1.0}, {"Name": "A", "Category": 1, "LowPS": 10.0}, {"Name": "C", "Category": 2, "LowPS": 0.1}]
            return self.answer(200, json.dumps({"features": [{"attributes": r} for r in rows]}).encode())
        if at.endswith("/3/query"):
            first = int(q["resultOffset"][0])
            n = min(int(q["resultRecordCount"][0]), 5 - first)
            f = [{"type": "Feature", "properties": {"GNIS_Name": f"r{i}", "StreamOrde": i, "FType": 428 if i == 0 else 460, "FCode": 46003 if i == 1 else 46006}, "geometry": {"type": "LineString", "coordinates": [[i, 1.0], [i + 0.5, 2.0]]}} for i in range(first, first + n)]
            return self.answer(200, json.dumps({"type": "FeatureCollection", "features": f, "exceededTransferLimit": first + n < 5}).encode())
        if at.endswith("/8/query"):
            return self.answer(200, b'{"type": "FeatureCollection", "features": []}')
        if at.endswith("exportImage"):
            h = int(q["size"][0].split(",")[1])
            w = int(q["size"][0].split(",")[0])
            x, _, _, y = map(float, q["bbox"][0].split(","))
            z = np.full((h, w), x + y)
            z[0, 0] = np.nan
            return self.answer(200, geotiff.encode(geotiff.Raster(z, x, y, 1.0)), "image/tiff")
        if at.endswith("N01.tif"):
            return self.answer(200, geotiff.encode(geotiff.Raster(np.ones((3, 3)), 0.0, 2.0, 0.5)), "image/tiff")
        self.answer(404)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_requests_are_tried_again(url):
    assert remote.get(f"{url}/flaky", kind="json", wait=0.01) == b'{"ok": 1}'
    with pytest.raises(remote.FetchError, match="404"):
        remote.get(f"{url}/nothing", tries=2, wait=0.01)
    assert remote.get(f"{url}/nothing", missing=True) is None
    with pytest.raises(remote.FetchError, match="bad box"):
        remote.get(f"{url}/error", kind="tiff", tries=1)


def test_pages_and_frames(spark, url):
    docs = remote.documents(spark, [{"url": f"{url}/3/query", "paged": True, "page": 2, "key": "flowline", "wait": 0.01}])
    assert sorted(r.page for r in docs.collect()) == [0, 1, 2]
    from fluvius.operators import waterways

    rows = waterways.nhd_flow(remote.lines(remote.features(docs, "struct<gnis_name:string,streamorde:int,ftype:int,fcode:int>"))).orderBy("streamorde").collect()
    assert [r.gnis_name for r in rows] == [f"r{i}" for i in range(5)] and rows[0].culvert and rows[1].intermittent and not rows[2].culvert
    assert rows[4].geometry[0].lon == 4.0 and rows[0].order_source == "nhd"
    with pytest.raises(remote.FetchError, match="nothing"):
        remote.layer(spark, url, "area", (0, 0, 1, 1), required=True, wait=0.01)


def test_mirrors_and_elements(spark, url):
    rows = remote.elements(spark, [f"{url}/busy", f"{url}/ok"], (0, 0, 3, 3), wait=0.01).collect()
    assert rows[0].id == 5 and rows[0].tags["waterway"] == "river" and "/busy" in SEEN


def test_catalogue(spark, url):
    docs = remote.documents(spark, [{"url": f"{url}/catalogue"}])
    r = remote.catalogue(docs, 60.0).first()
    assert (r.finest_ground_m, r.finest_name, r.datasets) == (0.5, "B", ["A", "B"]) and remote.covers(docs)
    assert not remote.covers(remote.documents(spark, [{"url": f"{url}/nothing", "wait": 0.001}]))


def test_terrain_tiles(spark, url):
    grid = geo.tile_grid(spark.createDataFrame([(1, 0.0, 0.0, 6.0, 4.0)], "id int, minx double, miny double, maxx double, maxy double"), 1.0, 4).collect()
    dem = remote.placed(remote.tiles(spark, remote.export_tiles(url, grid, 32616, 1.0)))
    z = {(r.r, r.c): r.z for r in dem.collect()}
    assert len(z) == 24 and z[1, 1] == 4.0 and z[1, 5] == 8.0 and z[0, 0] is None and z[0, 4] is None
    r = remote.valid_share(dem).first()
    assert r.share == pytest.approx(22 / 24) and r.warn
    with pytest.raises(Exception, match="entirely nodata"):
        remote.valid_share(dem.withColumn("z", F.lit(None).cast("double"))).collect()
    with pytest.raises(remote.FetchError, match="more than 3"):
        remote.export_tiles(url, grid, 32616, 1.0, 3)
    got = remote.tiles(spark, remote.copernicus_tiles(["N01", "N02"], url)).groupBy("tile").agg(F.count("z").alias("n")).collect()
    assert {r.tile: r.n for r in got} == {"N01": 9, "N02": 0}


def test_local_sources(spark, tmp_path):
    folder = tmp_path / "data" / "local"
    folder.mkdir(parents=True)
    for i, (x, y) in enumerate([(0, 4000), (4000, 4000)]):
        (folder / f"t{i}.tif").write_bytes(geotiff.encode(geotiff.Raster(np.full((400, 400), 250.0), x, y, 10.0)))
    (folder / "sources.json").write_text(json.dumps([{"name": "a", "files": ["data/local/t*.tif", "data/local/no.tif"], "native_m": 10}, {"name": "b", "files": ["data/local/none*.tif"], "native_m": 1, "kind": "dsm"}]))
    assert registry.local_sources(str(tmp_path / "no.json")) == []
    a, b = registry.local_sources(str(folder / "sources.json"))
    assert (a.id, len(a.files), a.kind, b.files) == ("local:a", 2, "dtm", [])
    inside, across, beyond = (100, 100, 2100, 2100), (3000, 500, 5000, 2500), (3000, 500, 8100, 2500)
    assert a.covers(spark, inside) and a.covers(spark, across) and not a.covers(spark, beyond) and not b.covers(spark, inside)
    on = layers.Grid(3500.0, 3000.0, 3.5, 30, 290)
    files = geotiff.read(spark, a.files).withColumn("ord", F.col("file"))
    z = registry.warp(files, on, None)
    assert z.count() == 30 * 290 and z.agg(F.min("z"), F.max("z")).first() == (pytest.approx(250.0), pytest.approx(250.0))
    off = registry.warp(files, layers.Grid(7990.0, 3000.0, 10.0, 2, 5), None, fill=0.0).where("r = 0").orderBy("c").collect()
    assert off[0].z == pytest.approx(250.0) and off[4].z == 0.0


def test_warp_from_degrees(spark):
    """A plane over one-degree tiles, seen from a zone's grid."""
    n = 120
    plane = lambda lon, lat: 100 + 50 * (lon - 28) + 30 * (lat - 47)
    rows = []
    for west in (28.0, 29.0):
        for r in range(n):
            for c in range(n):
                rows.append((str(west), west, 48.0, 1 / n, r, c, plane(west + (c + 0.5) / n, 48 - (r + 0.5) / n)))
    files = spark.createDataFrame(rows, "ord string, west double, north double, mpp double, r int, c int, z double")
    x, y = spark.range(1).select(*geo.to_utm(F.lit(29.0), F.lit(47.5), F.lit(32635))).first()
    on = layers.Grid(x - 1000, y + 1000, 200.0, 10, 10)
    z = {(r.r, r.c): r.z for r in registry.warp(files, on, 32635).collect()}
    lon, lat = spark.createDataFrame([(x - 1000 + 5.5 * 200, y + 1000 - 5.5 * 200)], "x double, y double").select(*geo.from_utm(F.col("x"), F.col("y"), F.lit(32635))).first()
    assert z[5, 5] == pytest.approx(plane(lon, lat), abs=0.5) and len(z) == 100


def test_choosing_sources():
    S = registry.Source
    some = [(S("local:x", "dsm", 1.0), True), (S("3dep", "dtm", 10.0), True), (S("cop30", "dsm", 30.0), True)]
    assert registry.resolve_elevation(some).id == "3dep" and registry.resolve_elevation(some, "cop30").id == "cop30"
    assert registry.resolve_elevation([(s, s.id != "3dep") for s, _ in some]).id == "local:x"
    for sources, prefer, said in ((some, "none", "unknown"), ([(s, False) for s, _ in some], None, "no elevation"), ([(s, False) for s, _ in some], "3dep", "does not cover")):
        with pytest.raises(remote.FetchError, match=said):
            registry.resolve_elevation(sources, prefer)
    assert (registry.resolve_hydro(), registry.resolve_hydro(national=True), registry.resolve_hydro("osm", True)) == ("osm", "nhd", "osm")
    with pytest.raises(remote.FetchError):
        registry.resolve_hydro("x")


def test_sites(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"slug": "a", "lat": 35.0, "lon": -85.3}, {"slug": "b", "lat": 1.0, "lon": 2.0}]))
    known = registry.sites(spark, str(tmp_path / "s.json"))
    with pytest.raises(remote.FetchError, match="a.*b"):
        registry.one_site(known, "c")
    s = geo.sites(known.where("slug = 'a'"))
    r = s.select("*", geo.degrees(F.col("playable"), F.col("epsg")).alias("box"), geo.box_text(F.col("playable"), 1).alias("text")).first()
    assert r.epsg == 32616 and r.playable.maxx - r.playable.minx == 14336.0 and r.world.maxy - r.world.miny == pytest.approx(57344.0)
    assert r.box.minx < -85.3 < r.box.maxx and r.box.miny < 35.0 < r.box.maxy and len(r.text.split(",")) == 4
    with pytest.raises(Exception, match="outside of the zones"):
        geo.sites(spark.createDataFrame([(0.0, 89.0)], "lon double, lat double")).collect()
    with pytest.raises(Exception, match="west, south"):
        spark.range(1).select(geo.centre(F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))[0]).collect()


def test_covered_at_many_sizes(spark):
    """Boxes and rectangles of all sizes, equal ones and odd ones among them, against pixels."""
    rng = np.random.default_rng(7)

    def some(n, most):
        side = 2 ** rng.integers(0, most, (n, 2))
        low = rng.integers(-40, 40, (n, 2))
        return np.c_[low, low + side]

    rects, boxes = np.r_[some(250, 5), [[-3000, -20, 3000, 20]]], np.r_[some(200, 4), some(20, 7)]
    have = np.zeros((400, 400), bool)
    for a, b, c, d in np.clip(rects, -200, 199) + 200:
        have[a:c, b:d] = True
    want = {i: bool(have[a:c, b:d].all()) for i, (a, b, c, d) in enumerate((boxes + 200).tolist())}
    assert 20 < sum(want.values()) < 200
    rows = [(i, *map(float, x)) for i, x in enumerate(boxes.tolist())]
    odd = [(901, 0.5, 0.5, 0.5, 0.5), (902, None, 0.0, 1.0, 1.0), (903, 0.0, 0.0, float("inf"), 1.0), (904, 0.0, 0.0, float("nan"), 1.0), (905, 1.0, 1.0, 0.0, 0.0), (906, 0.5, -300.0, 0.5, 0.0)]
    names = "minx double, miny double, maxx double, maxy double"
    b = spark.createDataFrame([tuple(map(float, x)) for x in rects.tolist() * 3] + [(None, 0.0, 1.0, 1.0), (0.0, float("nan"), 1.0, 1.0)], names)
    got = {r.id: r.covered for r in registry.covered(b, spark.createDataFrame(rows + rows + odd, f"id int, {names}")).collect()}
    assert got == want | {901: True, 902: False, 903: False, 904: False, 905: False, 906: False}


def test_covered_has_no_nested_loop(spark):
    """Every box was held against every rectangle."""
    plan = maps.covered_boxes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"NestedLoopJoin.*b_minx#\d+ < maxx#", plan), plan
