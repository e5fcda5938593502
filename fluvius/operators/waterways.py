"""Frames of lines and water polygons from mapped elements: projected, directed, ordered and joined to a river network.

``elements`` are rows of ``sources.osm``; ``dem`` (r, c, z) is the terrain of a ``layers.Grid`` in metres of the zone ``epsg``.
Where several would do the smallest id is taken.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluvius.operators import geo, graph, grid, rings
from fluvius.operators import vector as V
from fluvius.operators.layers import Grid
from fluvius.session import write_table
from fluvius.sources import osm

SNAP, MATCH, FLIP, FLAT, SEA_LEVEL, LEAST_AREA, LEAST_SEA = 2.0, 300.0, 1.0, 0.5, 0.5, 500.0, 1e5


def projected(geometry: Column, epsg: int) -> Column:
    """An array of lon, lat as one of x, y."""

    def one(p: Column) -> Column:
        x, y = geo.to_utm(p["lon"], p["lat"], F.lit(epsg))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geometry, one)


def samples(lines: DataFrame, shares: Column) -> DataFrame:
    """line, i, share, x, y: points of lines (line, geom) at an array of shares of their length."""
    m = V.measured(V.line_segments(lines))
    total = m.groupBy("line").agg(F.sum("len").alias("_total"))
    want = lines.select("line", F.posexplode(shares).alias("i", "share")).join(total, "line").select("line", "i", "share", (F.col("share") * F.col("_total")).alias("d"))
    return V.interpolate(m, want).drop("d")


def directed(lines: DataFrame, dem: DataFrame | None, on: Grid | None) -> DataFrame:
    """Lines (line, geom, ...) run downhill: turned where the terrain falls by more than ``FLIP`` the other way. Adds flowdir (0 where
    the fall is below ``FLAT``, else 1) and flipped. Lines without terrain under both ends stay as they are."""
    if dem is None:
        return lines.withColumns({"flowdir": F.lit(1), "flipped": F.lit(False)})
    n = F.greatest(F.size("geom"), F.lit(8))
    shares = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / (n - 1))
    p = samples(lines, shares).withColumns({"c": on.px("x").cast("int"), "r": on.py("y").cast("int")})
    z = p.join(dem.where("z is not null"), ["r", "c"]).join(lines.select("line", n.alias("n")), "line")
    k = F.greatest(F.lit(2), F.expr("n div 4"))
    drop = F.median(F.when(F.col("i") < k, F.col("z"))) - F.median(F.when(F.col("i") >= F.col("n") - k, F.col("z")))
    d = lines.join(z.groupBy("line").agg(drop.alias("_drop")), "line", "left")
    flip = F.coalesce(F.col("_drop") < -FLIP, F.lit(False))
    return d.withColumns({"flipped": flip, "flowdir": F.when(F.abs("_drop") < FLAT, 0).otherwise(1), "geom": F.when(flip, F.reverse("geom")).otherwise(F.col("geom"))}).drop("_drop")


def networked(lines: DataFrame) -> DataFrame:
    """Adds path (number of the connected part), hydroseq, dnhydroseq, startflag and terminalfl to lines (line, geom)."""
    first, last = F.element_at("geom", 1), F.element_at("geom", -1)
    ends = write_table(lines.select("line", first["x"].alias("x1"), first["y"].alias("y1"), last["x"].alias("x2"), last["y"].alias("y2")), "ends")
    edges = write_table(graph.snap_edges(ends, SNAP).distinct(), "downstream")
    part = graph.components(graph.touch_edges(ends, SNAP))
    of = ends.join(part, ends["line"] == part["node"], "left").select("line", F.coalesce("component", "line").alias("_part"))
    # one row for each connected part: far fewer than lines
    numbers = of.select("_part").distinct().withColumn("path", F.row_number().over(Window.orderBy("_part")))
    flags = graph.network_flags(graph.upstream_levels(ends.select(F.col("line").alias("node")), edges), edges)
    flags = flags.select(F.col("node").alias("line"), F.col("level").alias("hydroseq"), F.col("down").alias("dnhydroseq"), F.col("start").alias("startflag"), F.col("terminal").alias("terminalfl"))
    return lines.join(of.join(numbers, "_part").drop("_part"), "line").join(flags, "line")


def matched(lines: DataFrame, rivers: DataFrame, reach: float = MATCH) -> DataFrame:
    """line, strahler, drainage, discharge of lines whose middle is within ``reach`` of a river (river, strahler, upland, discharge,
    geom) and whose points at a quarter and three quarters are as near to that same river: mouths alone do not match."""
    p = samples(lines, F.array(*map(F.lit, (0.5, 0.25, 0.75))))
    s = V.line_segments(rivers, "river")
    mid = V.nearest(p.where("i = 0").select(F.col("line").alias("id"), F.col("x").alias("px"), F.col("y").alias("py")), s, reach).where("line is not null")
    mid = mid.select(F.col("id").alias("line"), F.col("line").alias("river"))
    near = p.where("i > 0").join(mid, "line").join(s.withColumnRenamed("line", "river"), "river")
    near = near.groupBy("line", "river", "i").agg(F.min(V.point_distance(F.col("x"), F.col("y"))).alias("d")).groupBy("line", "river").agg(F.max("d").alias("d")).where(F.col("d") <= reach)
    return near.join(rivers, "river").select("line", "strahler", F.col("upland").alias("drainage"), "discharge")


def ordered(lines: DataFrame, rivers: DataFrame | None) -> DataFrame:
    """Adds ord, drainage, strahler, discharge and order_source: by the drainage of the river matched, never below the tag's order."""
    none = {"drainage": F.lit(0.0), "strahler": F.lit(None).cast("int"), "discharge": F.lit(None).cast("double"), "ord": F.col("tag_order"), "order_source": F.lit("osm-tag")}
    if rivers is None:
        return lines.withColumns(none)
    d = lines.join(matched(lines, rivers), "line", "left")
    hit = F.col("drainage").isNotNull()
    by_area = F.greatest(geo.order_from_area(F.col("drainage")), F.col("tag_order"))
    return d.withColumns({"ord": F.when(hit, by_area).otherwise(F.col("tag_order")), "order_source": F.when(hit, "hydrorivers-area").otherwise("osm-tag"), "drainage": F.coalesce("drainage", F.lit(0.0))})


def simple(polygons: DataFrame) -> DataFrame:
    """Polygons (poly, rings) whose edges do not cross each other."""
    e = V.ring_edges(polygons).withColumn("_e", F.monotonically_increasing_id())
    e = write_table(e, "edges")  # numbers of edges stay the same
    cut = V.cells_along(e, 1000.0)
    o = cut.select("poly", "_cx", "_cy", F.col("_e").alias("_o"), *[F.col(c).alias(f"o{c}") for c in V.SEGMENT])
    side = lambda a, b, p: F.signum((F.col(f"{b}x2") - F.col(f"{b}x1")) * (F.col(f"{a}y{p}") - F.col(f"{b}y1")) - (F.col(f"{b}y2") - F.col(f"{b}y1")) * (F.col(f"{a}x{p}") - F.col(f"{b}x1")))
    crosses = (side("", "o", 1) * side("", "o", 2) < 0) & (side("o", "", 1) * side("o", "", 2) < 0)
    bad = cut.join(o, ["poly", "_cx", "_cy"]).where((F.col("_e") < F.col("_o")) & crosses).select("poly").distinct()
    return polygons.join(bad, "poly", "left_anti")


def relation_polygons(members: DataFrame) -> DataFrame:
    """id, rings of members (id, role, way, geom): each outer ring with the inner rings that begin inside it."""
    made = rings.assemble(members.select(F.col("id").alias("rel"), "role", "way", F.col("geom").alias("points")))
    outer = made.where("role = 'outer'").select("rel", "ring", F.col("points").alias("shell"))
    inner = made.where("role = 'inner'").select("rel", F.col("ring").alias("hole"), F.col("points").alias("inner"))
    p, shell = F.element_at("inner", 1), F.col("shell")
    sides = F.zip_with(F.slice(shell, 1, F.size(shell) - 1), F.slice(shell, 2, F.size(shell) - 1), lambda a, b: F.when((a["y"] > p["y"]) != (b["y"] > p["y"]), (p["x"] < a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])).cast("int")).otherwise(0))
    inside = F.aggregate(sides, F.lit(0), lambda n, x: n + x) % 2 == 1
    holes = outer.join(inner, "rel").where(inside).groupBy("rel", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "inner"))), lambda x: x["inner"]).alias("holes"))
    none = F.array().cast(f"array<{rings.POINTS}>")
    return outer.join(holes, ["rel", "ring"], "left").select(F.col("rel").alias("id"), F.concat(F.array("shell"), F.coalesce("holes", none)).alias("rings"))


def area(polygon_rings: Column) -> Column:
    """Area of a polygon's shell less its holes."""
    return F.aggregate(F.transform(polygon_rings, lambda g, i: F.when(i == 0, rings.area(g)).otherwise(-rings.area(g))), F.lit(0.0), lambda a, x: a + x)


def sea(dem: DataFrame, on: Grid, level: float = SEA_LEVEL) -> DataFrame:
    """poly, rings: the parts of the terrain at or below a level that reach the raster's edge, each larger than ``LEAST_SEA``.
    Rasters of more than 1024 rows are thinned before rings are drawn."""
    low = dem.withColumn("low", F.coalesce(F.col("z") <= level, F.lit(False)))
    part = write_table(grid.raster_components(low, "low"), "low")
    border = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == on.rows - 1) | (F.col("c") == on.cols - 1)
    wet = part.join(part.where(border).select("component").distinct(), "component")
    step = max(1, on.rows // 1024)
    cells = wet.where((F.col("r") % step == 0) & (F.col("c") % step == 0)).select((F.col("r") / step).cast("int").alias("r"), (F.col("c") / step).cast("int").alias("c"))
    cells = grid.raster_components(write_table(cells.withColumn("on", F.lit(True)), "sea"), "on")
    size = on.mpp * step

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """The rings around a part's cells, the outer one first. Each of its sides with no cell beyond is an edge of one."""
        have = set(zip(g.r.tolist(), g.c.tolist(), strict=True))
        edges = []
        for r, c in sorted(have):
            for dr, dc, a, b in ((-1, 0, (r, c), (r, c + 1)), (1, 0, (r + 1, c + 1), (r + 1, c)), (0, -1, (r + 1, c), (r, c)), (0, 1, (r, c + 1), (r + 1, c + 1))):
                if (r + dr, c + dc) not in have:
                    edges.append([a, b])
        out = []
        for ring in rings.stitch(edges):
            turn = [p for p, q, s in zip(ring[:-1], ring[-2:-1] + ring[:-2], ring[1:], strict=True) if (p[0] - q[0], p[1] - q[1]) != (s[0] - p[0], s[1] - p[1])]
            points = [{"x": on.minx + c * size, "y": on.maxy - r * size} for r, c in [*turn, turn[0]]]
            out.append(points)
        extent = lambda q: max(p["x"] for p in q) - min(p["x"] for p in q)
        out.sort(key=extent, reverse=True)
        return pd.DataFrame({"poly": [key[0]], "rings": [out], "m2": [len(have) * size * size]})

    drawn = cells.groupBy("component").applyInPandas(draw, f"poly long, rings array<{rings.POINTS}>, m2 double")
    return drawn.where(F.col("m2") > LEAST_SEA).select("poly", "rings")


def frames(elements: DataFrame, epsg: int, dem: DataFrame | None = None, on: Grid | None = None, rivers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flow, areas, bodies). ``rivers`` (river, strahler, upland, discharge, geometry in lon, lat) may be missing, and so may the
    terrain: then lines keep their direction and there is no sea. Areas and bodies: poly, id, name, ftype, fcode, areasqkm, rings."""
    ways = osm.waterways(elements).withColumn("geom", projected(F.col("geometry"), epsg)).drop("geometry")
    ways = write_table(directed(ways, dem, on), "ways")
    net = rivers.withColumn("geom", projected(F.col("geometry"), epsg)).drop("geometry") if rivers is not None else None
    length = F.aggregate(F.zip_with(F.slice("geom", 1, F.size("geom") - 1), F.slice("geom", 2, F.size("geom") - 1), lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)), F.lit(0.0), lambda a, x: a + x)
    flow = ordered(networked(ways), net).withColumn("lengthkm", length / 1000)

    of_ways = osm.water_polygons(elements).select("id", "name", "flowing", "ftype", F.array(projected(F.col("geometry"), epsg)).alias("rings"))
    of_ways = simple(of_ways.withColumn("poly", F.col("id"))).drop("poly")
    members = osm.water_relations(elements).withColumn("geom", projected(F.col("geometry"), epsg))
    about = members.groupBy("id").agg(F.first("name").alias("name"), F.first("flowing").alias("flowing"), F.first("ftype").alias("ftype"))
    of_rel = relation_polygons(members).join(about, "id").select("id", "name", "flowing", "ftype", "rings")
    polys = of_ways.unionByName(of_rel).withColumn("m2", area(F.col("rings"))).where(F.col("m2") >= LEAST_AREA)
    polys = polys.select(F.col("id").alias("poly"), F.concat(F.lit("osm-"), "id").alias("id"), "name", "flowing", "ftype", F.lit(0).alias("fcode"), (F.col("m2") / 1e6).alias("areasqkm"), "rings")
    areas, bodies = polys.where("flowing").drop("flowing"), polys.where("not flowing").drop("flowing")
    if dem is not None and not osm.coastlines(elements).isEmpty():
        s = sea(dem, on).withColumn("_n", F.row_number().over(Window.orderBy("poly")) - 1)  # a few seas a map
        s = s.select((-1 - F.col("_n")).cast("long").alias("poly"), F.concat(F.lit("dem-sea-"), F.col("_n").cast("string")).alias("id"), F.lit("sea").alias("name"), F.lit(445).alias("ftype"), F.lit(0).alias("fcode"), (area(F.col("rings")) / 1e6).alias("areasqkm"), "rings")
        areas = areas.unionByName(s)
    return flow, areas, bodies


def nhd_flow(features: DataFrame) -> DataFrame:
    """Adds culvert (feature type 428), intermittent (codes 46003 and 46007) and order_source to a national frame (ftype, fcode)."""
    return features.withColumns({"culvert": F.coalesce(F.col("ftype") == 428, F.lit(False)), "intermittent": F.coalesce(F.col("fcode").isin(46003, 46007), F.lit(False)), "order_source": F.lit("nhd")})
