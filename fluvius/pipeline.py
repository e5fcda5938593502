"""A whole map: from terrain and water frames to height levels, placements, figures and a manifest.

Each step is a DataFrame; what several steps read is written once. The figures of the manifest are one row each.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvius.operators import grid as G
from fluvius.operators import layers as L
from fluvius.operators import proposal
from fluvius.operators import vector as V
from fluvius.session import write_table

TERRACED = 0.5  # share of whole heights beyond which terrain counts as terraced


@dataclass
class Params:
    exaggeration: float = 1.0
    sea_level_m: float | None = None
    water_surface_real_m: float | None = None
    floor_margin_m: float = 5.0
    burn: bool = True
    deterrace: str = "auto"
    oversample: str = "auto"
    depth_scale: float = 1.0


@dataclass
class Result:
    playable: DataFrame  # r, c, lvl
    world: DataFrame  # r, c, lvl
    layers: DataFrame
    placements: DataFrame
    slopes: DataFrame  # r, c, slope, class, mask
    manifest: dict
    timings: dict[str, float] = field(default_factory=dict)


def argv(given: list[str]) -> list[str]:
    """Command lines whose values begin with a minus and a digit, put behind their option with an equals sign."""
    out: list[str] = []
    for word in given:
        number = len(word) > 1 and word[0] == "-" and (word[1].isdigit() or word[1] == ".")
        if number and out and out[-1].startswith("--") and "=" not in out[-1]:
            out[-1] = f"{out[-1]}={word}"
        else:
            out.append(word)
    return out


def terrain(dem: DataFrame) -> tuple[DataFrame, dict]:
    """Filled terrain, and the shares of filled and of whole heights."""
    filled = write_table(G.fill_nodata(dem), "terrain")
    share = G.filled_share(filled).first().share
    return filled.select("r", "c", "z"), {"filled": share, "terraced": G.terracing(filled).first().terracing}


def checked_centre(world: DataFrame, playable: DataFrame, factor: int, top: int, left: int) -> DataFrame:
    """The world's levels (r, c, lvl) with the playable area's means at its centre; these must agree within a level afterwards."""
    put = G.centre_overwrite(world.select("r", "c", F.col("lvl").alias("z")), playable.select("r", "c", F.col("lvl").alias("z")), factor, top, left)
    off = F.raise_error(F.lit("the world's centre differs from the playable area")).cast("double")
    return put.select("r", "c", F.when(F.abs(F.col("z") - F.col("p")) > 1, off).otherwise(F.col("z")).cast("int").alias("lvl"), "before", "p")


def build(playable: DataFrame, world: DataFrame, on: L.Grid, around: L.Grid, flow: DataFrame, areas: DataFrame, bodies: DataFrame, site: dict, p: Params | None = None) -> Result:
    """A map of a playable raster and the world raster around it (r, c, z), whose pixels are a whole number of playable ones.
    ``flow``, ``areas`` and ``bodies`` are frames of ``waterways``, ``site`` is name, lat, lon and epsg."""
    p = p or Params()
    began, times = time.time(), {}

    def lap(name: str) -> None:
        times[name] = round(time.time() - began - sum(times.values()), 1)

    play, a = terrain(playable)
    far, b = terrain(world)
    smooth = {"on": True, "off": False}.get(p.deterrace, max(a["terraced"], b["terraced"]) > TERRACED)
    if smooth:
        play, far = write_table(G.deterrace(play), "smooth"), write_table(G.deterrace(far), "smooth")
    lap("elevation")

    near, report = L.build(play, on, flow, areas, bodies, p.depth_scale)
    near, report = write_table(near, "layers"), write_table(report, "report")
    wide = write_table(L.build(far, around, flow, areas, bodies, p.depth_scale)[0], "layers")
    level = L.reference_surface(play, on, flow, report, p.water_surface_real_m).first()
    bed = lambda d: d.withColumn("z", G.burn(F.col("z"), F.col("mask"), F.col("surface"), F.col("depth"))) if p.burn else d
    play_b, far_b = bed(near), bed(wide)
    lap("burn")

    both = play_b.select("z").unionAll(far_b.select("z")).agg(F.min("z").alias("lo"), F.max("z").alias("hi")).withColumn("ws", F.lit(level.surface))
    v = G.plan_vertical(both, p.exaggeration, p.floor_margin_m, p.sea_level_m).first()
    game = lambda z: z * p.exaggeration + v.offset
    near_m = play_b.withColumns({"m": game(F.col("z"))})
    levels = near_m.select("r", "c", G.quantise(F.col("m"), F.lit(v.scale)).alias("lvl"))
    factor = round(around.mpp / on.mpp)
    top, left = round((around.maxy - on.maxy) / around.mpp), round((on.minx - around.minx) / around.mpp)
    far_lvl = far_b.select("r", "c", G.quantise(game(F.col("z")), F.lit(v.scale)).alias("lvl"))
    levels = write_table(levels, "levels")
    centred = write_table(checked_centre(far_lvl, levels, factor, top, left), "levels")
    seam = centred.where("p is not null").agg((F.avg(F.abs(F.col("before") - F.col("p"))) * v.m_per_level).alias("seam")).first().seam
    slopes = G.slope_percent(near_m.select("r", "c", F.col("m").alias("z"), "mask"), on.mpp)
    slopes = write_table(slopes.select("r", "c", "slope", F.when(F.col("mask"), F.lit(None)).otherwise(G.slope_class(F.col("slope"))).cast("int").alias("class"), "mask"), "slopes")
    land = slopes.where("not mask")

    pixels = near.select("r", "c", game(F.col("z")).alias("z"), game(F.col("surface")).alias("surface"), F.col("mask").alias("water"))
    lines = flow.select("line", "path", "ord", "name", "drainage", "hydroseq", "startflag", "flowdir", "culvert")
    polys = areas.select("poly", "ftype", "name", F.lit(False).alias("body"), "rings").unionAll(bodies.select("poly", "ftype", "name", F.lit(True).alias("body"), "rings"))
    placed = proposal.propose(lines, V.line_segments(flow), polys.drop("rings"), V.ring_edges(polys), pixels, proposal.Border(on.box, on.mpp, on.cols))
    placed = write_table(placed, "placements")

    r = play_b.agg(F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    share = lambda d: d.agg(F.avg(F.col("mask").cast("double"))).first()[0]
    manifest = {
        "site": site, "params": {**{k: x for k, x in asdict(p).items() if k != "depth_scale"}, "hydro": {"min_order": L.LEAST_ORDER, "depth_scale": p.depth_scale}},
        "nodata_filled_fraction": {"playable": a["filled"], "world": b["filled"]}, "terracing": {"playable_integer_fraction": a["terraced"], "world_integer_fraction": b["terraced"], "deterraced": smooth},
        "vertical": {"height_scale_m": v.scale, "sea_level_m": v.sea, "water_surface_real_m": level.surface, "water_surface_source": level.source, "exaggeration": p.exaggeration, "m_per_level": v.m_per_level},
        "playable": {"min_real_m": r.lo, "max_real_m": r.hi, "relief_m": r.hi - r.lo, "buildable_fraction_land": G.buildable(land).first()[0], "buildable_fraction_all": G.buildable(slopes).first()[0]},
        "water_fraction": {"playable": share(near), "world": share(wide)}, "water_polygons_playable": [x.asDict() for x in report.orderBy("rank").collect()], "world_center_mean_abs_diff_before_replace_m": seam,
        "slope_histogram": {"fraction": [x.share for x in G.slope_bins(land).orderBy("bin").collect()]}, "water_sources": [x.asDict() for x in placed.collect()],
    }
    lap("finish")
    manifest |= {"timings_s": dict(times), "elapsed_s": round(time.time() - began, 1)}
    return Result(levels, centred.select("r", "c", "lvl"), near, placed, slopes, manifest, times)


def banner(manifest: dict) -> list[str]:
    """Lines that tell of a finished map."""
    v, p = manifest["vertical"], manifest["playable"]
    return [
        f"height scale {v['height_scale_m']:.0f} m, sea level {v['sea_level_m']:.0f} m", f"relief {p['relief_m']:.0f} m, buildable {p['buildable_fraction_land']:.1%} of land",
        f"water {manifest['water_fraction']['playable']:.1%} of playable: {v['water_surface_source']}", f"{len(manifest['water_sources'])} placements, {manifest['elapsed_s']:.0f} s",
    ]
