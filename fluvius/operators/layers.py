"""Water layers of a map from its lines and polygons, and the level that the map's heights are measured from.

``flow``: line, name, ord, culvert, intermittent, discharge, geom (array of points). ``areas`` and ``bodies``: poly, name, ftype,
rings (arrays of points, the first the shell, closed). Coordinates are metres; a map is a ``Grid``. Missing optional columns are
taken as NULL. Empty tables give layers without water.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluvius.operators import geo, rings, water
from fluvius.operators import vector as V
from fluvius.session import write_table

#: Feature types that are open water, as bodies and as areas (fixed values).
BODY_TYPES, AREA_TYPES = (390, 436, 493), (460, 445, 312, 336)
LEAST_ORDER, LEAST_AREA, POND_DEPTH, REPORTED = 2, 2000.0, 2.0, 12
CELL = 500.0


@dataclass(frozen=True)
class Grid:
    """A raster's place: its north-west corner, metres a pixel, rows and columns."""

    minx: float
    maxy: float
    mpp: float
    rows: int
    cols: int

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.minx, self.maxy - self.rows * self.mpp, self.minx + self.cols * self.mpp, self.maxy

    def px(self, x: str) -> Column:
        return (F.col(x) - self.minx) / self.mpp

    def py(self, y: str) -> Column:
        return (self.maxy - F.col(y)) / self.mpp

    def pixels(self, df: DataFrame) -> DataFrame:
        """Coordinates x1 .. y2 in pixels."""
        return df.withColumns({"x1": self.px("x1"), "y1": self.py("y1"), "x2": self.px("x2"), "y2": self.py("y2")})

    def within(self, df: DataFrame) -> DataFrame:
        return df.where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < self.rows) & (F.col("c") < self.cols))


def _with(df: DataFrame, **optional: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in optional.items()})


def open_lines(flow: DataFrame) -> DataFrame:
    """Lines of at least the least order that run in the open."""
    f = _with(flow, name="string", culvert="boolean", intermittent="boolean", discharge="double")
    return f.where((F.coalesce("ord", F.lit(0)) >= LEAST_ORDER) & ~F.coalesce("culvert", F.lit(False)))


def clipped_segments(lines: DataFrame, grid: Grid) -> DataFrame:
    """line, part, seq, x1 .. y2: what of the lines is inside; segments that follow each other inside are one part."""
    s = V.clip(V.line_segments(lines), grid.box)
    w = Window.partitionBy("line").orderBy("seq")
    broken = F.coalesce((F.col("seq") - F.lag("seq").over(w) > 1) | (F.lag("x2").over(w) != F.col("x1")) | (F.lag("y2").over(w) != F.col("y1")), F.lit(True))
    return s.withColumn("_new", broken.cast("int")).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def clipped_polygons(areas: DataFrame, bodies: DataFrame, grid: Grid) -> DataFrame:
    """key, ftype, name, rings (clipped), area of the water polygons of which at least ``LEAST_AREA`` is inside, bodies first."""
    kinds = [(bodies, BODY_TYPES, 0), (areas, AREA_TYPES, 1)]
    polys = None
    for df, types, rank in kinds:
        part = _with(df, name="string").where(F.col("ftype").isin(*types)).select(F.struct(F.lit(rank).alias("rank"), F.col("poly").alias("id")).alias("key"), "ftype", "name", "rings")
        polys = part if polys is None else polys.unionAll(part)
    cut = F.filter(F.transform("rings", lambda g: V.clip_ring(g, grid.box)), lambda g: F.size(g) > 0)
    # holes are cut out of the shell, the first ring
    sizes = F.transform("rings", lambda g, i: F.when(i == 0, rings.area(g)).otherwise(-rings.area(g)))
    polys = polys.withColumn("rings", cut).where(F.size("rings") > 0)
    return polys.withColumn("area", F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)).where(F.col("area") >= LEAST_AREA)


def through(polygons: DataFrame, segments: DataFrame, lines: DataFrame) -> DataFrame:
    """key, ord, river: the highest order of the lines through each polygon and the name of the first such line."""
    edges = V.ring_edges(polygons, "key")
    bounds = edges.groupBy("poly").agg(F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"), F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"))
    met = V.meeting(edges, bounds, segments, CELL).join(lines.select("line", "ord", "name"), "line")
    best = met.groupBy(F.col("poly").alias("key")).agg(F.min(F.struct((-F.col("ord")).alias("n"), "line", "name")).alias("b"))
    return best.select("key", (-F.col("b.n")).alias("ord"), F.col("b.name").alias("river"))


def sized(polygons: DataFrame, met: DataFrame, depth_scale: float = 1.0) -> DataFrame:
    """Polygons with their order, depth and label."""
    p = polygons.join(met, "key", "left").withColumn("ord", F.coalesce("ord", F.lit(0)))
    depth = F.element_at(F.create_map(*[F.lit(x) for kv in geo.DEPTHS.items() for x in kv]), F.greatest(F.lit(2), F.least(F.lit(10), F.col("ord"))))
    depth = F.when(F.col("ord") >= LEAST_ORDER, depth).otherwise(POND_DEPTH) * depth_scale
    return p.withColumns({"depth": depth, "label": F.coalesce("name", "river", F.concat(F.lit("unnamed ftype "), F.col("ftype").cast("string")))})


def polygon_pixels(polygons: DataFrame, grid: Grid) -> DataFrame:
    """poly, r, c: pixels whose centres are inside."""
    return grid.within(V.rasterise(grid.pixels(V.ring_edges(polygons, "key"))))


def channel_pixels(lines: DataFrame, segments: DataFrame, grid: Grid, depth_scale: float = 1.0) -> DataFrame:
    """r, c, depth, half: pixels that the lines' channels touch, sized by discharge or order."""
    width, depth = geo.channel(F.col("ord"), F.col("discharge"), F.coalesce("intermittent", F.lit(False)), depth_scale)
    half = F.greatest(width / 2, F.lit(grid.mpp * 0.5)) / grid.mpp
    sizes = lines.select("line", depth.alias("depth"), half.alias("half"))
    s = grid.pixels(segments.join(sizes.select("line", "half"), "line"))
    return grid.within(V.touched_pixels(s)).join(sizes, "line").select("r", "c", "depth", "half")


def report(polygons: DataFrame, pixels: DataFrame, dem: DataFrame) -> DataFrame:
    """rank, label, ftype, area_km2, ord, depth, p10, p90 of the largest polygons: percentiles of the terrain inside, NULL without a pixel."""
    top = polygons.orderBy(F.col("area").desc(), "key").limit(REPORTED)
    z = pixels.join(top.select(F.col("key").alias("poly")), "poly", "left_semi").join(dem, ["r", "c"])
    p = z.groupBy(F.col("poly").alias("key")).agg(F.percentile("z", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    rank = F.row_number().over(Window.orderBy(F.col("area").desc(), "key"))  # of a dozen rows
    return top.join(p, "key", "left").select(rank.alias("rank"), "label", "ftype", F.bround(F.col("area") / 1e6, 3).alias("area_km2"), "ord", F.bround("depth", 1).alias("depth"), F.bround(F.col("p")[0], 2).alias("p10"), F.bround(F.col("p")[1], 2).alias("p90"))


def build(dem: DataFrame, grid: Grid, flow: DataFrame, areas: DataFrame, bodies: DataFrame, depth_scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(layers, report) of a map: layers as in ``water.layers``."""
    lines = open_lines(flow)
    segments = clipped_segments(lines, grid)
    polygons = clipped_polygons(areas, bodies, grid)
    # what several steps read is written once
    polygons = write_table(sized(polygons, through(polygons, segments, lines), depth_scale), "polygons")
    inside = write_table(polygon_pixels(polygons, grid), "inside")
    deep = inside.join(polygons.select(F.col("key").alias("poly"), "depth"), "poly").select("r", "c", "depth")
    channels = write_table(channel_pixels(lines, segments, grid, depth_scale), "channels")
    made = water.layers(dem, deep, channels, grid.mpp)
    return made, report(polygons, inside, dem)


def flowline_surface(dem: DataFrame, grid: Grid, flow: DataFrame, order: Column, buffer: float = 10.0, share: float = 0.1) -> DataFrame:
    """One row, surface: a low percentile of the terrain along the open lines of one order (a column of ``flow``), within ``buffer``
    metres and a pixel at least; NULL without any."""
    f = _with(flow, culvert="boolean").where((F.col("ord") == order) & ~F.coalesce("culvert", F.lit(False)))
    s = grid.pixels(V.clip(V.line_segments(f), grid.box))
    near = grid.within(V.near_pixels(s, max(buffer, grid.mpp) / grid.mpp)).select("r", "c").distinct()
    return near.join(dem.where("z is not null"), ["r", "c"]).agg(F.percentile("z", F.lit(share)).alias("surface"))


def reference_surface(dem: DataFrame, grid: Grid, flow: DataFrame, reported: DataFrame, override: float | None = None) -> DataFrame:
    """One row, surface and source: the level given; else that of the largest reported polygon on a line of the map's top order;
    else along the lines of that order; else that of the largest polygon; else the lowest terrain."""
    f = _with(flow, name="string", culvert="boolean").where(~F.coalesce("culvert", F.lit(False)))
    inside = f.join(V.clip_touching(V.line_segments(f), grid.box), "line", "left_semi")
    top = inside.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    ranked = inside.crossJoin(F.broadcast(top))
    named = ranked.where("ord = top").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("names"))
    along = flowline_surface(dem, grid, ranked, F.col("top")).withColumnRenamed("surface", "along")
    polys = reported.crossJoin(F.broadcast(top)).agg(
        F.min(F.when((F.col("ord") >= F.col("top")) & (F.col("top") >= LEAST_ORDER), F.struct("rank", "label", "ord", "area_km2", "p10"))).alias("best"),
        F.min(F.struct("rank", "label", "ord", "area_km2", "p10")).alias("largest"),
    )
    low = dem.agg(F.min("z").alias("low"))
    d = top.crossJoin(named).crossJoin(along).crossJoin(polys).crossJoin(low)  # one row each
    use_along = (F.col("top") >= LEAST_ORDER) & F.col("along").isNotNull()
    names = F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("unnamed")
    km2 = lambda p: F.col(f"{p}.area_km2").cast("string")
    given = F.lit(override).cast("double")
    surface = F.coalesce(given, F.when(F.col("best").isNotNull(), F.col("best.p10")).when(use_along, F.col("along")).when(F.col("largest").isNotNull(), F.col("largest.p10")).otherwise(F.col("low")))
    source = (
        F.when(given.isNotNull(), "--water-surface override")
        .when(F.col("best").isNotNull(), F.concat(F.col("best.label"), F.lit(" (order "), F.col("best.ord").cast("string"), F.lit(", "), km2("best"), F.lit(" km2) p10 surface")))
        .when(use_along, F.concat(F.lit("p10 surface along order-"), F.col("top").cast("string"), F.lit(" flowlines ("), names, F.lit(")")))
        .when(F.col("largest").isNotNull(), F.concat(F.col("largest.label"), F.lit(" (largest water body, "), km2("largest"), F.lit(" km2) p10 surface")))
        .otherwise("playable minimum (no water found)")
    )
    return d.select(surface.alias("surface"), source.alias("source"))
