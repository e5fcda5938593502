"""A whole small map, staging, shapefiles and command lines."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvius import pipeline
from fluvius.operators import layers, publishing
from fluvius.sources import shapefile, staging

GEOM = "array<struct<x:double,y:double>>"


def test_a_whole_map(spark):
    n, mpp = 32, 14.0
    on = layers.Grid(0.0, n * mpp, mpp, n, n)
    around = layers.Grid(-1.5 * n * mpp, 2.5 * n * mpp, 4 * mpp, n, n)
    slope = lambda g: spark.range(n * n).select((F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c")).withColumn("z", 200.0 + (F.lit(g.maxy) - F.col("r") * g.mpp) * 0.02)
    play = slope(on).withColumn("z", F.when((F.col("r") == 3) & (F.col("c") == 3), F.lit(None)).otherwise(F.col("z")))
    river = [{"x": 224.0, "y": 2000.0}, {"x": 224.0, "y": -2000.0}]
    flow = spark.createDataFrame([(1, 1, 8, "Big", 5000.0, 1, 1, 1, False, False, None, river)], f"line long, path long, ord int, name string, drainage double, hydroseq int, startflag int, flowdir int, culvert boolean, intermittent boolean, discharge double, geom {GEOM}")
    none = spark.createDataFrame([], f"poly long, name string, ftype int, rings array<{GEOM}>")
    got = pipeline.build(play, slope(around), on, around, flow, none, none, {"name": "a", "lat": 1.0, "lon": 2.0, "epsg": 32631})
    m = got.manifest
    assert m["nodata_filled_fraction"]["playable"] == pytest.approx(1 / n**2) and not m["terracing"]["deterraced"]
    assert m["vertical"]["water_surface_source"].startswith("p10 surface along order-8") and m["vertical"]["height_scale_m"] == 200.0
    assert sorted(x["kind"] for x in m["water_sources"]) == ["water.border_river_in", "water.border_river_out"]
    assert sum(m["slope_histogram"]["fraction"]) == pytest.approx(1, abs=1e-3) and 0 < m["water_fraction"]["playable"] < 0.5
    p = got.playable.toPandas()
    lvl = np.zeros((n, n))
    lvl[p.r, p.c] = p.lvl
    w = got.world.toPandas()
    far = np.zeros((n, n))
    far[w.r, w.c] = w.lvl
    inner = far[12:20, 12:20]
    assert np.abs(inner - lvl.reshape(8, 4, 8, 4).mean((1, 3))).max() <= 0.5
    maps = publishing.named(publishing.parsed(spark.createDataFrame([(1, json.dumps(m, default=str))], "map int, manifest string")))
    assert len(maps.first().hash) == 7 and len(pipeline.banner(m)) == 4


def test_command_lines():
    assert pipeline.argv(["--center", "-33.9,151.2", "--name", "x"]) == ["--center=-33.9,151.2", "--name", "x"]
    assert pipeline.argv(["--center=-1,2", "-v", "--exaggeration", "1.5"]) == ["--center=-1,2", "-v", "--exaggeration", "1.5"]


def test_staging(spark, tmp_path):
    staging.reset()
    stage, made = staging.Stage(spark, f"file://{tmp_path}/stage"), []
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "tr int, z double")
    make = lambda: made.append(1) or df
    assert stage.get("dem", {"a": 1}) is None
    for _ in range(2):
        assert stage.through("dem", {"a": 1}, make).count() == 2
    assert len(made) == 1 and staging.COUNTERS["tables"] == 1 and staging.COUNTERS["bytes"] > 0
    assert stage.put(df, "dem", {"b": 2}, by=["tr"]).where("tr = 1").first().z == 2.0
    metas = list((tmp_path / "stage" / "dem").glob("*.meta.json"))
    assert len(metas) == 2 and all("cached_at" in json.loads(f.read_text()) for f in metas)


def test_shapefile(spark, tmp_path):
    lines = [[(0.0, 0.0), (1.0, 2.0)], [(5.0, 5.0), (6.0, 7.0), (8.0, 6.0)]]
    shp = b"\0" * 100
    for i, p in enumerate(lines):
        xs, ys = zip(*p, strict=True)
        body = struct.pack("<i4d2ii", 3, min(xs), min(ys), max(xs), max(ys), 1, len(p), 0) + b"".join(struct.pack("<2d", *q) for q in p)
        shp += struct.pack(">2I", i + 1, len(body) // 2) + body
    fields = [(b"ORD_STRA", 5), (b"UPLAND_SKM", 8), (b"DIS_AV_CMS", 8)]
    head = b"".join(n.ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in fields) + b"\r"
    rows = b"".join(b" " + b"".join(str(v).rjust(w).encode() for v, (_, w) in zip(r, fields, strict=True)) for r in ((3, 12.5, 0.5), (6, 900.0, "")))
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 32 + len(head), 22) + head + rows
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/r.shp", shp)
        z.writestr("x/r.dbf", dbf)
    (tmp_path / "r.zip").write_bytes(raw.getvalue())
    all_ = shapefile.rivers(spark, str(tmp_path / "r.zip"))
    got = shapefile.within(all_, (4, 4, 9, 9)).collect()
    assert [(r.river, r.strahler, r.upland, r.discharge, len(r.geometry)) for r in got] == [(1, 6, 900.0, None, 3)]
    assert shapefile.within(all_, (-1, -1, 9, 9)).count() == 2
