"""What is published of finished maps: names and hashes, manifests, scorecards, pages, the index, and the plan of files.

A manifest is a JSON document (column ``manifest``) with the parts of ``MANIFEST``; what it lacks is NULL. Rows hold one document
a map, so nothing here grows with pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluvius.operators import documents, history, placements

MANIFEST = (
    "struct<display_name:string,site:struct<name:string,lat:double,lon:double,epsg:int>,"
    "params:struct<exaggeration:double,sea_level_m:double,water_surface_real_m:double,burn:boolean,deterrace:string,oversample:string,hydro:struct<min_order:int,depth_scale:double>>,"
    "vertical:struct<height_scale_m:double,sea_level_m:double,water_surface_real_m:double,exaggeration:double,m_per_level:double,water_surface_source:string>,"
    "playable:struct<min_real_m:double,max_real_m:double,relief_m:double,buildable_fraction_land:double>,water_fraction:struct<playable:double,world:double>,"
    "dem_source:struct<source:string,finest_name:string,kind:string,finest_ground_m:double,resample:string,mixed_sources:boolean>,"
    "hydro_source:struct<id:string,flowlines:int,culverted:int>,nodata_filled_fraction:map<string,double>,terracing:struct<playable_integer_fraction:double,deterraced:boolean>,"
    "water_sources:array<struct<kind:string>>,slope_histogram:struct<fraction:array<double>>,world_center_mean_abs_diff_before_replace_m:double,"
    "water_polygons_playable:array<struct<name:string>>,timings_s:map<string,double>,downloaded:struct<bytes:bigint,files:int>,elapsed_s:double,run:struct<generated:string,git_commit:string,argv:array<string>>>"
)
INDEX_START, INDEX_END = "<!-- maps:start -->", "<!-- maps:end -->"
INDEX_HEADER = "| Map | Centre | Height scale | Sea level | Exag. | Buildable | Relief | QA | Published |\n|---|---|---|---|---|---|---|---|---|"
#: Files of a map by the endings of their names (fixed values).
ENDINGS = ("heightmap.png", "worldmap.png", "manifest.json", "qa.png", "guide.png", "placements.json", "placements.md")


def parsed(maps: DataFrame) -> DataFrame:
    """Adds ``m``, the manifest as a struct. A document that is no JSON is NULL."""
    return maps.withColumn("m", F.from_json("manifest", MANIFEST))


def map_hash(m: str = "m") -> Column:
    """Seven hex digits over what defines the terrain: the place to four decimals, the zone, vertical and channel settings."""
    p = lambda f: F.col(f"{m}.params.{f}")
    fields = {
        "lat": F.bround(F.col(f"{m}.site.lat"), 4), "lon": F.bround(F.col(f"{m}.site.lon"), 4), "epsg": F.col(f"{m}.site.epsg"), "exaggeration": F.coalesce(p("exaggeration"), F.lit(1.0)),
        "sea_level_m": p("sea_level_m"), "water_surface_real_m": p("water_surface_real_m"), "burn": F.coalesce(p("burn"), F.lit(True)), "min_order": p("hydro.min_order"),
        "depth_scale": p("hydro.depth_scale"), "deterrace": p("deterrace"), "oversample": F.coalesce(p("oversample"), F.lit("None")),
    }
    return F.substring(history.request_hash(*fields.items()), 1, 7)


def display_name(m: str = "m") -> Column:
    given = F.trim(F.col(f"{m}.display_name"))
    return F.coalesce(F.when(given != "", given), history.display_name(F.col(f"{m}.site.name")))


def named(maps: DataFrame) -> DataFrame:
    """Adds title, hash, folder and stem to parsed maps."""
    return maps.withColumns({"title": display_name(), "hash": map_hash()}).withColumns({"folder": F.concat_ws(" - ", "title", "hash"), "stem": F.replace("title", F.lit(" "), F.lit("_"))})


def _m(path: str, digits: int) -> Column:
    return documents.fixed(F.col(f"m.{path}"), digits)


def page(maps: DataFrame, built_by: str = "the map builder") -> DataFrame:
    """Adds ``page``, the Markdown page of each named map: what to enter in the editor, what the terrain is, how it was made."""
    v, p = "vertical", "playable"
    scale, water = F.replace(_m(f"{v}.height_scale_m", 0), F.lit(","), F.lit("")), F.coalesce(F.get("m.water_polygons_playable", F.lit(0))["name"], F.lit("n/a"))
    rows = [
        ("**Height scale (type into the editor)**", F.concat(F.lit("**"), scale, F.lit(" m**"))),
        ("Water surface, in-game", F.concat(_m(f"{v}.sea_level_m", 1), F.lit(" m"))),
        ("Water surface, real", F.concat(_m(f"{v}.water_surface_real_m", 1), F.lit(" m ("), water, F.lit(")"))),
        ("Centre", F.concat(_m("site.lat", 4), F.lit(", "), _m("site.lon", 4), F.lit(" (EPSG:"), F.col("m.site.epsg").cast("string"), F.lit(")"))),
        ("Playable elevation, real", F.concat(_m(f"{p}.min_real_m", 0), F.lit(" – "), _m(f"{p}.max_real_m", 0), F.lit(" m (relief "), _m(f"{p}.relief_m", 0), F.lit(" m)"))),
        ("Vertical exaggeration", F.concat(F.lit("×"), _m(f"{v}.exaggeration", 2))),
        ("Buildable (< 10 % slope)", F.concat(documents.share(F.col(f"m.{p}.buildable_fraction_land"), 1), F.lit(" of land"))),
        ("Water coverage", F.concat(documents.share(F.col("m.water_fraction.playable"), 1), F.lit(" of playable"))),
        ("Channel burning", F.when(F.coalesce(F.col("m.params.burn"), F.lit(True)), "on").otherwise("off")),
        ("Source DEM", F.concat(F.lit("~"), F.coalesce(F.col("m.dem_source.finest_ground_m").cast("string"), F.lit("?")), F.lit(" m ("), F.coalesce("m.dem_source.finest_name", F.lit("?")), F.lit(")"))),
    ]
    table = F.concat_ws("\n", F.lit("| | |\n|---|---|"), *[F.concat(F.lit(f"| {k} | "), F.coalesce(c, F.lit("")), F.lit(" |")) for k, c in rows])
    steps = F.concat(F.lit("## Import\n\n1. Copy `"), F.col("stem"), F.lit("_heightmap.png` and `"), F.col("stem"), F.lit("_worldmap.png` to the game's heightmap folder.\n2. In the map editor import the heightmap, then the world map.\n3. Set the height scale to **"), scale, F.lit("**."))
    run = F.concat(F.lit(f"## Provenance\n\n- Built by {built_by} commit `"), F.coalesce("m.run.git_commit", F.lit("unknown")), F.lit("` on "), F.coalesce("m.run.generated", F.lit("unknown")), F.lit("\n- Command: `"), F.concat_ws(" ", "m.run.argv"), F.lit("`\n- Map hash `"), F.col("hash"), F.lit("`"))
    return maps.withColumn("page", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n![QA sheet]("), F.col("stem"), F.lit("_qa.png)\n\n"), table, F.lit("\n\n"), steps, F.lit("\n\n"), run, F.lit("\n")))


def index_lines(maps: DataFrame) -> DataFrame:
    """(ord, line) of named maps whose manifest can be read and whose folder is not hidden, in order of folders."""
    link = F.replace("folder", F.lit(" "), F.lit("%20"))
    cells = [
        F.concat(F.lit("["), F.col("folder"), F.lit("]("), link, F.lit("/)")), F.concat(_m("site.lat", 4), F.lit(", "), _m("site.lon", 4)), F.concat(F.lit("**"), F.replace(_m("vertical.height_scale_m", 0), F.lit(","), F.lit("")), F.lit(" m**")),
        F.concat(_m("vertical.sea_level_m", 0), F.lit(" m")), F.concat(F.lit("×"), _m("vertical.exaggeration", 2)), documents.share(F.col("m.playable.buildable_fraction_land")), F.concat(_m("playable.relief_m", 0), F.lit(" m")),
        F.concat(F.lit("[QA]("), link, F.lit("/"), F.col("stem"), F.lit("_qa.png)")), F.coalesce(F.substring("m.run.generated", 1, 10), F.lit("")),
    ]
    ok = F.col("m.vertical").isNotNull() & F.col("m.playable").isNotNull() & F.col("m.site").isNotNull() & ~F.startswith("folder", F.lit("."))
    return maps.where(ok).select(F.col("folder").alias("ord"), documents.row(*cells).alias("line"))


def index(maps: DataFrame, text: Column) -> DataFrame:
    """One row, ``text``: a page with the index of all maps between its markers. Without maps the table says so."""
    table = documents.joined(index_lines(maps).select("ord", "line"), INDEX_HEADER).select(F.col("text").alias("_table"))
    empty = F.lit(INDEX_HEADER + "\n| _none published yet_ | | | | | | | | |")
    block = F.when(F.col("_table") == INDEX_HEADER + "\n", empty).otherwise(F.col("_table"))
    return table.select(documents.put_block(text, block, INDEX_START, INDEX_END, "## Maps").alias("text"))


def file_plan(maps: DataFrame, files: DataFrame, published: DataFrame) -> DataFrame:
    """What publishing would do: folder, source, target and action (add, replace or keep) for each file (map, name, sha) of named maps
    (map) whose name ends as a map's files do; ``published`` is target and sha. A second run with the same files keeps them all."""
    ending = F.regexp_extract("name", f"({'|'.join(e.replace('.', '[.]') for e in ENDINGS)})$", 1)
    plan = files.withColumn("_end", ending).where("_end <> ''").join(maps.select("map", "folder", "stem"), "map")
    plan = plan.select("map", "folder", F.col("name").alias("source"), "sha", F.concat("folder", F.lit("/"), "stem", F.lit("_"), "_end").alias("target"))
    p = plan.join(published.select("target", F.col("sha").alias("_sha")), "target", "left")
    return p.select("map", "folder", "source", "target", F.when(F.col("_sha").isNull(), "add").when(F.col("_sha") != F.col("sha"), "replace").otherwise("keep").alias("action"))


def untracked(plan: DataFrame, tracked: DataFrame) -> DataFrame:
    """Targets of height maps that are not among the tracked large files (target)."""
    large = F.endswith("target", F.lit("_heightmap.png")) | F.endswith("target", F.lit("_worldmap.png"))
    return plan.where(large).select("target").distinct().join(tracked, "target", "left_anti")


def scorecards(maps: DataFrame) -> DataFrame:
    """A flat row of figures for each parsed map (slug)."""
    m = lambda p: F.col(f"m.{p}")
    kinds = F.transform(F.coalesce(m("water_sources"), F.array().cast("array<struct<kind:string>>")), lambda w: F.regexp_replace(w["kind"], "^[^.]*[.]", ""))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value"))))
    cols = {
        "dem_source": m("dem_source.source"), "dem_product": m("dem_source.finest_name"), "dem_kind": m("dem_source.kind"), "dem_native_m": m("dem_source.finest_ground_m"), "dem_resample": m("dem_source.resample"),
        "mixed_sources": F.coalesce(m("dem_source.mixed_sources"), F.lit(False)), "hydro_source": m("hydro_source.id"), "flowlines": m("hydro_source.flowlines"), "culverted": m("hydro_source.culverted"),
        "nodata_filled": m("nodata_filled_fraction"), "terracing_playable": m("terracing.playable_integer_fraction"), "deterraced": m("terracing.deterraced"), "relief_m": m("playable.relief_m"),
        "min_real_m": m("playable.min_real_m"), "max_real_m": m("playable.max_real_m"), "height_scale_m": m("vertical.height_scale_m"), "m_per_level": m("vertical.m_per_level"), "sea_level_m": m("vertical.sea_level_m"),
        "water_surface_real_m": m("vertical.water_surface_real_m"), "water_surface_source": m("vertical.water_surface_source"), "buildable_land": m("playable.buildable_fraction_land"), "water_fraction": m("water_fraction.playable"),
        "water_sources": F.size(kinds), "water_source_kinds": counts, "seam_m": m("world_center_mean_abs_diff_before_replace_m"), "slope_hist": m("slope_histogram.fraction"), "elapsed_s": m("elapsed_s"),
        "timings_s": m("timings_s"), "downloaded_mb": F.bround(F.coalesce(m("downloaded.bytes"), F.lit(0)) / 1e6, 1),
    }
    return maps.select("slug", *[c.alias(k) for k, c in cols.items()])


def manifests(parts: DataFrame, key: str = "map") -> DataFrame:
    """key and ``manifest``: the JSON document of every other column of ``parts``, nulls kept."""
    return parts.select(key, F.to_json(F.struct(*[F.col(c) for c in parts.columns if c != key]), {"ignoreNullFields": "false"}).alias("manifest"))


NOTE = "xy_m from the SW corner of the playable area, x east / y north; xy_center_m relative to the map centre"


def placements_json(placed: DataFrame, meta: Column | None = None, mpp: float = 3.5, size: int = 4096) -> DataFrame:
    """(doc, json): the numbered placements (doc, number, kind, c, r, elev, label, why) of each document with their places in metres."""
    x, y = F.bround(F.col("c") * mpp, 1), F.bround((size - 1 - F.col("r")) * mpp, 1)
    half = size * mpp / 2
    kinds = F.create_map(*[F.lit(v) for kind, label, _ in placements.KINDS for v in (kind, label)])
    one = F.struct("number", "kind", F.array("c", "r").alias("px"), F.col("elev").alias("elev_m"), "label", "why", F.array(x, y).alias("xy_m"), F.array(F.bround(x - half, 1), F.bround(y - half, 1)).alias("xy_center_m"), F.element_at(kinds, F.col("kind")).alias("symbol"))
    rows = placed.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("placements"))
    head = [meta.alias("meta")] if meta is not None else []
    return rows.select("doc", F.to_json(F.struct(*head, F.lit(NOTE).alias("coordinate_note"), "placements"), {"ignoreNullFields": "false"}).alias("json"))


def appended(runs: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """Runs with new ones (slug, and more) put behind each site's, numbered on, of which the last ``keep`` stay."""
    last = runs.groupBy("slug").agg(F.max("seq").alias("_last"))
    w = Window.partitionBy("slug").orderBy(*[F.col(c) for c in new.columns if c != "slug"])
    n = new.withColumn("_n", F.row_number().over(w)).join(last, "slug", "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")
    return history.latest(runs.unionByName(n, allowMissingColumns=True), keep).drop("back")


def named_orders(flow: DataFrame, most: int = 8) -> DataFrame:
    """The highest order of each named line, the greatest ``most`` first."""
    return flow.where("name is not null").groupBy("name").agg(F.max("ord").alias("ord")).orderBy(F.col("ord").desc(), "name").limit(most)


def channel_groups(flow: DataFrame) -> DataFrame:
    """Lines by the width and depth of their channels: width, depth, n, km."""
    from fluvius.operators import geo

    width, depth = geo.channel(F.col("ord"), F.col("discharge"), F.coalesce("intermittent", F.lit(False)))
    return flow.groupBy(width.alias("width"), depth.alias("depth")).agg(F.count("*").alias("n"), F.sum("lengthkm").alias("km"))
