"""Water placements of one map, proposed from its lines, polygons and water layers.

``lines``: line, path, ord, name, drainage, hydroseq, startflag, flowdir, culvert. ``segments``: line, seq, x1 .. y2, in flow
direction. ``polygons``: poly, ftype, name, body (a water body, not an area). ``edges``: poly, x1 .. y2, holes wound against
their shells. ``pixels``: r, c, z, surface, water, with heights as they are in the map.

Lines and polygons meet over grid cells. Only crossings of one map's border with its greatest rivers, a few hundred points,
reach a task as a group. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluvius.operators import geo, placements
from fluvius.operators import vector as V

RIVER, CREEKS, STREAMS = 6, (4, 5), 8
LAKE_KM2 = 0.5
SAME, CLUSTER, LOOP, REACH = 150.0, 400.0, 150.0, 4000.0  # metres
STEP = 30.0
AROUND = 12  # pixels on each side of a point at which its level is read
CELL = 1000.0
#: Kinds of polygons that are lakes as bodies, lakes as areas, and seas (fixed values).
BODIES, AREAS, SEAS = (390, 436, 493), (460, 336), (445, 312, 493)
FIELDS = ("kind", "key", "c", "r", "level", "label", "ord", "edge", "drainage", "rate", "size", "entry", "path", "area_km2", "edge_km", "confidence")
TYPES = dict.fromkeys(FIELDS, "string") | dict.fromkeys(("level", "drainage", "rate", "area_km2", "edge_km"), "double") | dict.fromkeys(("c", "r", "ord"), "int")


def levels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """``points`` (key, c, r) with the median surface of the water around them, else the lowest pixel there, to a decimetre."""
    around = lambda c: F.explode(F.sequence(F.col(c) - AROUND, F.col(c) + AROUND))
    near = points.select("key", around("c").alias("c"), "r").select("key", "c", around("r").alias("r"))
    value = F.coalesce(F.median(F.when(F.col("water"), F.col("surface"))), F.min("z"))
    return points.join(near.join(pixels, ["c", "r"]).groupBy("key").agg(F.bround(value, 1).alias("level")), "key", "left")


class Border:
    """The square that a map covers, and its pixels."""

    def __init__(self, box: tuple[float, float, float, float], mpp: float, size: int):
        self.box, self.mpp, self.size = tuple(map(float, box)), mpp, size

    def pixel(self, df: DataFrame, snap: Column) -> DataFrame:
        """Adds c, r and edge of x, y; moved onto the border where ``snap`` is true, with a NULL edge elsewhere."""
        c, r = geo.pixel(F.col("x"), F.col("y"), F.lit(self.box[0]), F.lit(self.box[3]), self.mpp, self.size)
        df = df.withColumns({"c": c, "r": r}).withColumn("_at", geo.snap_edge(F.col("c"), F.col("r"), self.size)).withColumn("_snap", snap)
        on = lambda a, b: F.when(F.col("_snap"), F.col(f"_at.{a}")).otherwise(b)
        return df.withColumns({"edge": on("edge", F.lit(None)), "c": on("c", F.col("c")), "r": on("r", F.col("r"))}).drop("_at", "_snap")

    def inside(self, x: str, y: str) -> Column:
        x0, y0, x1, y1 = self.box
        return (F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1)

    def meeting(self, segments: DataFrame) -> DataFrame:
        """line, on_ring: the lines that meet the square, and whether they meet its border."""
        t0, t1 = V.clip_range(self.box)
        within = self.inside("x1", "y1") & self.inside("x2", "y2")
        return segments.where(t0 <= t1).groupBy("line").agg(F.max(~within).alias("on_ring"))


def _fields(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f) if f in df.columns else F.lit(None)).cast(TYPES[f]).alias(f) for f in FIELDS])


def _named(suffix: Column) -> Column:
    return F.concat(F.coalesce("name", F.format_string("unnamed order-%d stream", "ord")), suffix)


def border_rivers(lines: DataFrame, crossings: DataFrame, pixels: DataFrame, border: Border) -> DataFrame:
    """Where great rivers come in and go out: one crossing per river and place, one per direction of parallel channels, and none
    where a bend only nicks the border."""
    found = crossings.join(lines.where(F.col("ord") >= RIVER), "line").withColumn("seq", F.struct("line", "d"))
    found = found.withColumn("seq", F.row_number().over(Window.orderBy("seq")))  # crossings of one border, not lines
    found = found.select("seq", "x", "y", "flow", "path", "line", "ord", "name", "drainage", "flowdir")
    kept = placements.seed_clusters(placements.suppress(found, ["path", "flow"], SAME), ["flow"], CLUSTER).drop("n")
    cell = lambda df: df.withColumns({"_cx": F.floor(F.col("x") / LOOP), "_cy": F.floor(F.col("y") / LOOP)})
    spread = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    other = cell(kept.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("flow").alias("oflow"), "x", "y")).drop("x", "y")
    other = other.select("ox", "oy", "oflow", spread("_cx"), "_cy").select("ox", "oy", "oflow", "_cx", spread("_cy"))
    partner = (F.col("oflow") != F.col("flow")) & ((F.col("ox") - F.col("x")) ** 2 + (F.col("oy") - F.col("y")) ** 2 <= LOOP * LOOP)
    a, b = cell(kept).alias("a"), other.alias("b")
    kept = a.join(b, (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & partner, "left_anti").drop("_cx", "_cy")
    p = border.pixel(kept, F.lit(True)).withColumn("key", F.concat(F.lit("river-"), "seq"))
    p = p.withColumn("label", _named(F.format_string(" %sflow (%s edge)", "flow", "edge")))
    sure = F.when(F.col("flowdir") == 1, "high").otherwise("low")
    return _fields(levels(p, pixels).withColumns({"kind": F.concat(F.lit("water.border_river_"), "flow"), "confidence": sure}))


def streams(lines: DataFrame, segments: DataFrame, crossings: DataFrame, meeting: DataFrame, pixels: DataFrame, border: Border) -> DataFrame:
    """The greatest creeks that start in the map or enter it, by their most upstream line there; not those of great rivers."""
    met = lines.join(meeting, "line")
    great = met.where((F.col("ord") >= RIVER) & F.col("on_ring")).select("path").where("path is not null").distinct()
    creeks = met.where(F.col("ord").between(*CREEKS) & F.col("path").isNotNull()).join(great, "path", "left_anti")
    up = Window.partitionBy("path").orderBy(F.col("hydroseq").desc_nulls_last(), "line")
    top = creeks.withColumn("_n", F.row_number().over(up)).where("_n = 1").drop("_n")
    first = segments.groupBy("line").agg(F.min_by(F.struct(F.col("x1").alias("sx"), F.col("y1").alias("sy")), "seq").alias("s")).select("line", "s.sx", "s.sy")
    enters = crossings.where("flow = 'in'").groupBy("line").agg(F.max_by(F.struct("x", "y"), "d").alias("e"))
    t = top.join(first, "line").join(enters, "line", "left").withColumn("_in", border.inside("sx", "sy"))
    entry = F.when(F.col("_in") & (F.col("startflag") == 1), "headwater").when(F.col("e").isNotNull(), "edge").when(F.col("_in"), "upstream end")
    t = t.withColumn("entry", entry).where("entry is not null")
    at_edge = F.col("entry") == "edge"
    t = t.withColumns({"x": F.when(at_edge, F.col("e.x")).otherwise(F.col("sx")), "y": F.when(at_edge, F.col("e.y")).otherwise(F.col("sy"))})
    t = t.withColumns({"drainage": F.coalesce(F.col("drainage"), F.lit(0.0)), "key": F.concat(F.lit("stream-"), "line")})
    known = levels(border.pixel(t, F.lit(False)).select("key", "c", "r"), pixels).select("key", "level")
    reaches = t.join(known, "key").select(F.col("line").alias("id"), "x", "y", "ord", F.col("drainage").alias("area"), "level")
    kept = placements.reach_clusters(reaches, REACH).select(F.col("id").alias("line"), "others")
    t = t.join(kept, "line")
    rank = placements.ranked(t.select(F.col("line").alias("id"), "drainage"), STREAMS).select(F.col("id").alias("line"), "rate", "size")
    # an entry that stands for further reaches stays where it is
    p = border.pixel(t.join(rank, "line"), at_edge & (F.col("others") == 0))
    p = p.withColumn("label", _named(F.when(F.col("edge").isNull(), "").otherwise(F.format_string(" (%s edge)", "edge"))))
    return _fields(levels(p, pixels).withColumns({"kind": F.lit("water.stream"), "rate": F.bround("rate", 2)}))


def crossed(edges: DataFrame, boxes: DataFrame, segments: DataFrame) -> DataFrame:
    """poly: polygons that a segment meets, by crossing an edge or by starting inside."""
    return V.meeting(edges, boxes, segments, CELL).select("poly").distinct()


def spans(edges: DataFrame, fixed: str, run: str, at: Column) -> DataFrame:
    """poly, a, b: the stretches of a line (the coordinate ``fixed`` equals ``at``) inside polygons, along the coordinate ``run``."""
    f1, f2, g1, g2 = (F.col(c) for c in (f"{fixed}1", f"{fixed}2", f"{run}1", f"{run}2"))
    cut = edges.withColumn("_at", at).where((f1 <= F.col("_at")) != (f2 <= F.col("_at")))
    cut = cut.select("poly", (g1 + (F.col("_at") - f1) * (g2 - g1) / (f2 - f1)).alias("a"))
    w = Window.partitionBy("poly").orderBy("a")
    return cut.withColumns({"_k": F.row_number().over(w), "b": F.lead("a").over(w)}).where("_k % 2 = 1 and b is not null").select("poly", "a", "b")


def lakes(polygons: DataFrame, edges: DataFrame, lines: DataFrame, segments: DataFrame, pixels: DataFrame, border: Border) -> DataFrame:
    """Lakes wholly in the map that no great river runs through, at the middle of the widest stretch half way up."""
    x0, y0, x1, y1 = border.box
    shoelace = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2e6
    ends = {"minx": F.min(F.least("x1", "x2")), "miny": F.min(F.least("y1", "y2")), "maxx": F.max(F.greatest("x1", "x2")), "maxy": F.max(F.greatest("y1", "y2"))}
    of = polygons.where((F.col("body") & F.col("ftype").isin(*BODIES)) | (~F.col("body") & F.col("ftype").isin(*AREAS)))
    shape = edges.groupBy("poly").agg(shoelace.alias("area_km2"), *[v.alias(k) for k, v in ends.items()])
    shape = shape.where((F.col("minx") >= x0) & (F.col("miny") >= y0) & (F.col("maxx") <= x1) & (F.col("maxy") <= y1) & (F.col("area_km2") >= LAKE_KM2))
    own = of.join(shape, "poly")
    rivers = segments.join(lines.where(F.col("ord") >= RIVER).select("line"), "line", "left_semi")
    boxes = own.select("poly", "minx", "miny", "maxx", "maxy")
    own = own.join(crossed(edges, boxes, rivers), "poly", "left_anti")
    half = own.select("poly", ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    wide = spans(edges.join(half, "poly"), "y", "x", F.col("y")).groupBy("poly").agg(F.max_by((F.col("a") + F.col("b")) / 2, F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("x"))
    p = border.pixel(own.join(half, "poly").join(wide, "poly"), F.lit(False)).withColumn("key", F.concat(F.lit("lake-"), "poly"))
    more = {"kind": F.lit("water.lake"), "label": F.coalesce("name", F.lit("unnamed lake")), "area_km2": F.bround("area_km2", 3)}
    return _fields(levels(p, pixels).withColumns(more))


def seas(polygons: DataFrame, edges: DataFrame, pixels: DataFrame, border: Border) -> DataFrame:
    """Seas that touch the border, half way along what they touch; the border runs from its south-east corner northwards."""
    x0, y0, x1, y1 = border.box
    w, h, in_ = x1 - x0, y1 - y0, 1e-6  # a sea cut off at the border touches it
    own = edges.join(polygons.where(~F.col("body") & F.col("ftype").isin(*SEAS)).select("poly"), "poly", "left_semi")
    sides = [("x", "y", x1 - in_, y0, 1, 0.0, h), ("y", "x", y1 - in_, x1, -1, h, w), ("x", "y", x0 + in_, y1, -1, h + w, h), ("y", "x", y0 + in_, x0, 1, 2 * h + w, w)]
    parts = None
    for fixed, run, at, origin, way, before, length in sides:
        s = spans(own, fixed, run, F.lit(at))
        a, b = (F.col("a") - origin) * way, (F.col("b") - origin) * way
        s = s.select("poly", (F.greatest(F.lit(0.0), F.least(a, b)) + before).alias("s0"), (F.least(F.lit(length), F.greatest(a, b)) + before).alias("s1")).where("s0 < s1")
        parts = s if parts is None else parts.unionAll(s)
    by = Window.partitionBy("poly")
    done = F.sum(F.col("s1") - F.col("s0"))
    parts = parts.withColumns({"_sum": done.over(by.orderBy("s0")), "_all": done.over(by)}).where("_sum >= _all / 2")
    mid = parts.groupBy("poly", F.col("_all").alias("length")).agg(F.min_by(F.col("s1") - (F.col("_sum") - F.col("_all") / 2), "s0").alias("s"))
    s = F.col("s")
    x = F.when(s <= h, x1).when(s <= h + w, x1 - (s - h)).when(s <= 2 * h + w, x0).otherwise(x0 + (s - 2 * h - w))
    y = F.when(s <= h, y0 + s).when(s <= h + w, y1).when(s <= 2 * h + w, y1 - (s - h - w)).otherwise(y0)
    p = border.pixel(mid.withColumns({"x": x, "y": y}), F.lit(True)).withColumn("key", F.concat(F.lit("sea-"), "poly"))
    more = {"kind": F.lit("water.border_sea"), "label": F.format_string("sea (%s edge)", "edge"), "edge_km": F.bround(F.col("length") / 1000, 2)}
    return _fields(levels(p, pixels).withColumns(more))


def propose(lines: DataFrame, segments: DataFrame, polygons: DataFrame, edges: DataFrame, pixels: DataFrame, border: Border) -> DataFrame:
    """All placements of a map: border rivers, streams, lakes and seas, with the columns ``FIELDS``."""
    open_ = lines.where(F.col("ord").isNotNull() & ~F.coalesce("culvert", F.lit(False)))
    segments = segments.join(open_.select("line"), "line", "left_semi")
    meeting = border.meeting(segments)
    cross = V.crossings(segments.join(meeting.where("on_ring").select("line"), "line", "left_semi"), border.box, STEP)
    out = border_rivers(open_, cross, pixels, border).unionByName(streams(open_, segments, cross, meeting, pixels, border))
    return out.unionByName(lakes(polygons, edges, open_, segments, pixels, border)).unionByName(seas(polygons, edges, pixels, border))
