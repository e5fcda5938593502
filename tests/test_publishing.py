"""Names, hashes, pages and plans of finished maps."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from fluvius.operators import placements, publishing

MANIFEST = {
    "site": {"name": "new-york_city", "lat": 40.71284, "lon": -74.006, "epsg": 32618},
    "params": {"exaggeration": 1.0, "sea_level_m": None, "water_surface_real_m": None, "burn": True, "deterrace": "auto", "oversample": "auto", "hydro": {"min_order": 2, "depth_scale": 1.0}},
    "vertical": {"height_scale_m": 2380.0, "sea_level_m": 62.0, "water_surface_real_m": 193.3, "exaggeration": 1.5},
    "playable": {"min_real_m": 12.4, "max_real_m": 500.6, "relief_m": 488.2, "buildable_fraction_land": 0.5065}, "water_fraction": {"playable": 0.0619},
    "dem_source": {"finest_ground_m": 0.82, "finest_name": "fine"}, "water_polygons_playable": [{"name": "River"}], "run": {"generated": "2026-01-02T03:04:05", "git_commit": "abc", "argv": ["--site", "x"]},
}


def named(spark, *docs):
    return publishing.named(publishing.parsed(spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "map int, manifest string")))


def changed(path, value):
    m = copy.deepcopy(MANIFEST)
    at = m
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return m


def test_hash_follows_what_defines_the_terrain(spark):
    import hashlib

    alter = [(("site", "lat"), 41.0), (("site", "epsg"), 32617), (("params", "exaggeration"), 1.5), (("params", "sea_level_m"), 5.0), (("params", "water_surface_real_m"), 3.0), (("params", "burn"), False), (("params", "hydro", "min_order"), 3), (("params", "hydro", "depth_scale"), 2.0), (("params", "deterrace"), "on"), (("params", "oversample"), "2")]
    same = [(("site", "lat"), 40.71281), (("site", "name"), "other"), (("vertical", "sea_level_m"), 9.0)]
    got = [r.hash for r in named(spark, MANIFEST, *[changed(*c) for c in alter + same]).orderBy("map").collect()]
    assert len(set(got[: len(alter) + 1])) == len(alter) + 1 and set(got[len(alter) + 1 :]) == {got[0]}
    text = '{"burn":true,"depth_scale":1.0,"deterrace":"auto","epsg":32618,"exaggeration":1.0,"lat":40.7128,"lon":-74.006,"min_order":2,"oversample":"auto","sea_level_m":null,"water_surface_real_m":null}'
    assert got[0] == hashlib.sha1(text.encode()).hexdigest()[:7]


def test_names_and_pages(spark):
    r = publishing.page(named(spark, MANIFEST)).first()
    assert r.title == "New York City" and r.stem == "New_York_City" and r.folder == f"New York City - {r.hash}"
    for said in ("# New York City", "**2380 m**", "| 193.3 m (River) |", "40.7128, -74.0060 (EPSG:32618)", "12 – 501 m (relief 488 m)", "×1.50", "6.2% of playable", "~0.82 m (fine)", "`--site x`", r.hash):
        assert said in r.page, said
    assert named(spark, {**MANIFEST, "display_name": " My Map "}).first().title == "My Map"
    assert named(spark, changed(("site", "name"), "bench_lviv")).first().title == "Lviv"


def test_index(spark):
    maps = named(spark, MANIFEST, "no json", changed(("site", "name"), "a"))
    page = publishing.index(maps, F.lit("# Maps\n\n## Maps\nold")).first().text
    assert page.index("[A - ") < page.index("[New York City - ") and page.count("| [QA](") == 2 and "2026-01-02 |" in page and "%20" in page
    again = publishing.index(maps, F.lit(page)).first().text
    assert again == page
    assert "_none published yet_" in publishing.index(maps.where("map = 1"), F.lit(None).cast("string")).first().text


def test_plan_is_idempotent(spark):
    maps = named(spark, MANIFEST)
    files = spark.createDataFrame([(0, "out_heightmap.png", "1"), (0, "out_qa.png", "2"), (0, "out.log", "3")], "map int, name string, sha string")
    none = spark.createDataFrame([], "target string, sha string")
    plan = publishing.file_plan(maps, files, none)
    assert sorted(r.action for r in plan.collect()) == ["add", "add"]
    done = plan.join(files.select(F.col("name").alias("source"), "sha"), "source").select("target", "sha")
    assert {r.action for r in publishing.file_plan(maps, files, done).collect()} == {"keep"}
    assert [r.target.rsplit("_", 1)[1] for r in publishing.untracked(plan, none.select("target")).collect()] == ["heightmap.png"]


def test_scorecard_and_manifest(spark):
    full = {**MANIFEST, "water_sources": [{"kind": "water.lake"}, {"kind": "water.lake"}, {"kind": "water.stream"}], "downloaded": {"bytes": 1234567}, "timings_s": {"burn": 17.5}}
    r = publishing.scorecards(named(spark, full).withColumn("slug", F.lit("x"))).first()
    assert (r.water_sources, r.water_source_kinds, r.downloaded_mb, r.timings_s, r.height_scale_m, r.hydro_source) == (3, {"lake": 2, "stream": 1}, 1.2, {"burn": 17.5}, 2380.0, None)
    back = publishing.manifests(named(spark, full).select("map", "m.site", "m.params", "m.vertical"))
    assert json.loads(back.first().manifest)["params"]["sea_level_m"] is None


def test_placements_json_and_checks(spark):
    schema = "doc int, id int, kind string, c int, r int, elev double, label string, why string"
    p = spark.createDataFrame([(1, 1, "water.lake", 10, 4000, 50.0, "L", "w"), (1, 2, "water.border_river_in", 0, 0, None, "R", "w")], schema)
    got = json.loads(publishing.placements_json(placements.numbered(placements.checked(p)), F.struct(F.lit("m").alias("name"))).first().json)
    assert [(x["number"], x["kind"], x["xy_m"], x["xy_center_m"], x["elev_m"]) for x in got["placements"]] == [(1, "water.border_river_in", [0.0, 14332.5], [-7168.0, 7164.5], None), (2, "water.lake", [35.0, 332.5], [-7133.0, -6835.5], 50.0)]
    assert got["meta"] == {"name": "m"} and got["placements"][1]["symbol"] == "Constant-level lake"
    for bad, said in (((1, 1, "water.pond", 1, 1, None, "", ""), "unknown kind"), ((1, 1, "water.lake", 4096, 1, None, "", ""), "outside")):
        with pytest.raises(Exception, match=said):
            placements.checked(spark.createDataFrame([bad], schema)).collect()
