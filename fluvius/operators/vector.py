"""Lines and polygons as vertex and segment tables; spatial joins over a grid of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from fluvius.session import write_table

SEGMENT = ("x1", "y1", "x2", "y2")
DEAL = 500_000  # segments of a cell that one task takes
PAIRS = 1 << 19  # of boxes and segments at once


def measured(segments: DataFrame) -> DataFrame:
    """Segments with their length, and the length of the line before them (``at``)."""
    s = segments.withColumn("len", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    before = Window.partitionBy("line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("at", F.coalesce(F.sum("len").over(before), F.lit(0.0)))


def lengths(segments: DataFrame) -> DataFrame:
    return measured(segments).groupBy("line").agg(F.sum("len").alias("length"))


def interpolate(measures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points at distances ``d`` along lines (wanted: line, d, and more), clamped to the line; the first segment that reaches d.
    Segments and distances of a line are merged by where they end, so the work is linear in both."""
    more = [c for c in wanted.columns if c not in ("line", "d")]
    seg = F.struct("seq", *SEGMENT, "len", "at")
    ends = measures.select("line", (F.col("at") + F.col("len")).alias("_pos"), F.lit(0).alias("_kind"), (-F.col("seq")).cast("long").alias("_seq"), seg.alias("_s"), F.lit(None).cast("double").alias("d"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in more])
    asked = wanted.select("line", F.greatest(F.lit(0.0), F.col("d")).alias("_pos"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_seq"), F.lit(None).cast(ends.schema["_s"].dataType).alias("_s"), F.col("d").cast("double").alias("d"), *more)
    back = Window.partitionBy("line").orderBy(F.col("_pos").desc(), "_kind", "_seq")
    on = Window.partitionBy("line").orderBy(F.col("_pos"), F.col("_kind"), F.col("_seq"))
    both = ends.unionByName(asked)
    found = F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last("_s", ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, 0))  # beyond the line's end
    hit = both.withColumn("_hit", F.coalesce(found, last)).where("_kind = 1 and _hit is not null")
    g = lambda k: F.col(f"_hit.{k}")
    t = F.when(g("len") > 0, F.least((F.col("_pos") - g("at")) / g("len"), F.lit(1.0))).otherwise(0.0)
    x, y = g("x1") + (g("x2") - g("x1")) * t, g("y1") + (g("y2") - g("y1")) * t
    return hit.select(*wanted.columns, x.alias("x"), y.alias("y"))


def clip_range(box: tuple) -> tuple[Column, Column]:
    """Liang-Barsky: the parameters between which a segment (x1 .. y2) is inside a box (numbers or columns); empty if t0 > t1."""
    minx, miny, maxx, maxy = (b if isinstance(b, Column) else F.lit(float(b)) for b in box)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def one(p: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(low - p, d), F.try_divide(high - p, d)
        outside = (d == 0) & ((p < low) | (p > high))
        return F.when(outside, 2.0).when(d == 0, 0.0).otherwise(F.least(a, b)), F.when(outside, -1.0).when(d == 0, 1.0).otherwise(F.greatest(a, b))

    x0, x1 = one(F.col("x1"), dx, minx, maxx)
    y0, y1 = one(F.col("y1"), dy, miny, maxy)
    return F.greatest(F.lit(0.0), x0, y0), F.least(F.lit(1.0), x1, y1)


def clip(segments: DataFrame, box: tuple) -> DataFrame:
    """The parts of segments inside a box."""
    t0, t1 = clip_range(box)
    s = segments.withColumns({"_t0": t0, "_t1": t1}).where("_t0 < _t1")
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    return s.select("line", "seq", at("x1", "x2", "_t0").alias("x1"), at("y1", "y2", "_t0").alias("y1"), at("x1", "x2", "_t1").alias("x2"), at("y1", "y2", "_t1").alias("y2"))


def cells(df: DataFrame, minx: Column, miny: Column, maxx: Column, maxy: Column, cell: float) -> DataFrame:
    """A row for each grid cell that an envelope touches: _cx, _cy."""
    df = df.withColumn("_cx", F.explode(F.sequence(F.floor(minx / cell), F.floor(maxx / cell))))
    return df.withColumn("_cy", F.explode(F.sequence(F.floor(miny / cell), F.floor(maxy / cell))))


def cells_along(segments: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """A row for each grid cell within ``pad`` of a segment, column by column: their number grows with its length, not with its
    envelope's area. Cells that it just fails to touch may be among them."""
    pad = pad + 1e-9 * cell
    minx, _, maxx, _ = envelope()
    s = segments.withColumn("_cx", F.explode(F.sequence(F.floor((minx - pad) / cell), F.floor((maxx + pad) / cell))))
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    at = lambda x: F.col("y1") + (F.greatest(minx, F.least(maxx, x)) - F.col("x1")) * slope
    a, b = at(F.col("_cx") * cell - pad), at((F.col("_cx") + 1) * cell + pad)
    low, high = F.coalesce(F.least(a, b), F.least("y1", "y2")), F.coalesce(F.greatest(a, b), F.greatest("y1", "y2"))
    return s.withColumn("_cy", F.explode(F.sequence(F.floor((low - pad) / cell), F.floor((high + pad) / cell))))


def envelope(pad: float = 0.0) -> tuple[Column, ...]:
    return F.least("x1", "x2") - pad, F.least("y1", "y2") - pad, F.greatest("x1", "x2") + pad, F.greatest("y1", "y2") + pad


def point_distance(px: Column, py: Column) -> Column:
    """Distance of a point to a segment (x1 .. y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((px - F.col("x1")) * dx + (py - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt((px - F.col("x1") - t * dx) ** 2 + (py - F.col("y1") - t * dy) ** 2)


def nearest(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """The nearest segment of each point (id, px, py) within reach: id, line, distance; ties to the smaller line. A segment is in
    every cell within reach of its envelope, a point in one: an equality join on cells."""
    s = cells_along(segments, reach, reach)
    p = points.withColumns({"_cx": F.floor(F.col("px") / reach), "_cy": F.floor(F.col("py") / reach)})
    d = p.join(s, ["_cx", "_cy"]).withColumn("distance", point_distance(F.col("px"), F.col("py"))).where(F.col("distance") <= reach)
    best = d.groupBy("id").agg(F.min(F.struct("distance", "line")).alias("_b"))
    return points.join(best, "id", "left").select("id", F.col("_b.line").alias("line"), F.col("_b.distance").alias("distance"))


def crossing_boxes(boxes: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (id, minx, miny, maxx, maxy) and segments that meet: the box's columns and the segment's."""
    b = cells(boxes, F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cell)
    s = cells_along(segments, cell)
    t0, t1 = clip_range((F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))
    return b.join(s, ["_cx", "_cy"]).where(t0 <= t1)


def _first_met(boxes: list[np.ndarray], segments: list[np.ndarray]) -> np.ndarray:
    """Of each box (minx, miny, maxx, maxy) the first segment (x1 .. y2) that meets it as in ``clip_range``, else -1. Segments are
    taken in growing runs for the boxes that none has met yet."""
    first = np.full(len(boxes[0]), -1)
    todo, at, run = np.arange(len(first)), 0, 64
    while len(todo) and at < len(segments[0]):
        x1, y1, x2, y2 = (s[at : at + run] for s in segments)
        for some in np.array_split(todo, -(-len(todo) * run // PAIRS)):
            minx, miny, maxx, maxy = (b[some][:, None] for b in boxes)
            t0, t1 = np.zeros((len(some), len(x1))), np.ones((len(some), len(x1)))
            for p, d, low, high in ((x1, x2 - x1, minx, maxx), (y1, y2 - y1, miny, maxy)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    a, b = (low - p) / d, (high - p) / d
                outside = (p < low) | (p > high)
                t0 = np.maximum(t0, np.where(d == 0, np.where(outside, 2.0, 0.0), np.minimum(a, b)))
                t1 = np.minimum(t1, np.where(d == 0, np.where(outside, -1.0, 1.0), np.maximum(a, b)))
            hit = t0 <= t1
            first[some] = np.where(hit.any(axis=1), at + hit.argmax(axis=1), -1)
        todo, at = todo[first[todo] < 0], at + run
        run = min(2 * run, 1 << 16)
    return first


def first_crossing(boxes: DataFrame, segments: DataFrame, order: list[str], cell: float) -> DataFrame:
    """id and ``order`` of each box (id, minx, miny, maxx, maxy) that segments meet: those of the least by ``order`` (longs, not
    NULL). Segments are cut off at the boxes' extent and written; the rest is one pass over cells, in which a box is held against
    segments in order up to the first that meets it, so that not all pairs that meet are made. Cells of many segments are dealt."""
    extent = F.broadcast(boxes.agg(F.min("minx").alias("_minx"), F.min("miny").alias("_miny"), F.max("maxx").alias("_maxx"), F.max("maxy").alias("_maxy")))
    t0, t1 = clip_range(tuple(F.col(c) for c in ("_minx", "_miny", "_maxx", "_maxy")))
    known = " and ".join(f"{c} is not null" for c in [*order, *SEGMENT])
    s = segments.where(known).select(*order, *SEGMENT).crossJoin(extent).withColumns({"_t0": t0, "_t1": t1}).where("_t0 <= _t1")
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    s = write_table(s.select(*order, *[F.col(c).alias(f"_{c}") for c in SEGMENT], at("x1", "x2", "_t0").alias("x1"), at("y1", "y2", "_t0").alias("y1"), at("x1", "x2", "_t1").alias("x2"), at("y1", "y2", "_t1").alias("y2")), "cut")
    s = cells_along(s, cell).drop(*SEGMENT)
    parts = F.broadcast(s.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / DEAL).alias("_parts")).where("_parts > 1"))  # of at most all rows / DEAL cells
    key, n = ["_cx", "_cy"], F.coalesce("_parts", F.lit(1))
    s = s.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*order, *[f"_{c}" for c in SEGMENT]), n)).drop("_parts")
    sides = ["minx", "miny", "maxx", "maxy"]
    b = cells(boxes.select("id", *sides), *map(F.col, sides), cell).join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_parts")
    schema = StructType([boxes.schema["id"], *[StructField(c, LongType()) for c in order]])

    def run(box: pa.Table, seg: pa.Table) -> pa.Table:
        if not box.num_rows or not seg.num_rows:
            return empty
        seg = seg.take(pa.array(np.lexsort([seg[c].to_numpy() for c in reversed(order)])))
        first = _first_met([box[c].to_numpy() for c in sides], [seg[f"_{c}"].to_numpy() for c in SEGMENT])
        found = pa.array(np.flatnonzero(first >= 0))
        best = seg.select(order).take(pa.array(first[first >= 0]))
        return pa.table([box["id"].take(found), *best.columns], ["id", *order]).cast(empty.schema)

    empty = to_arrow_schema(schema).empty_table()
    key = [*key, "_part"]
    met = b.groupBy(*key).cogroup(s.groupBy(*key)).applyInArrow(run, schema)
    return met.groupBy("id").agg(F.min(F.struct(*order)).alias("_b")).select("id", "_b.*")


def clip_touching(segments: DataFrame, box: tuple) -> DataFrame:
    """line: the lines that meet a box."""
    t0, t1 = clip_range(box)
    return segments.where(t0 <= t1).select("line").distinct()


def meeting(edges: DataFrame, boxes: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """poly, line: polygons (their edges, and boxes with poly and bounds) and lines that meet, by crossing an edge or by lying inside."""
    pairs = crossing_boxes(boxes, segments, cell).select("poly", "line", "seq", *SEGMENT).distinct()
    e = edges.select("poly", *[F.col(c).alias(f"e{c}") for c in SEGMENT])
    side = lambda ax, ay, bx, by, px, py: F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))
    over = side("x1", "y1", "x2", "y2", "ex1", "ey1") * side("x1", "y1", "x2", "y2", "ex2", "ey2") <= 0
    over &= side("ex1", "ey1", "ex2", "ey2", "x1", "y1") * side("ex1", "ey1", "ex2", "ey2", "x2", "y2") <= 0
    over &= (F.least("ex1", "ex2") <= F.greatest("x1", "x2")) & (F.least("x1", "x2") <= F.greatest("ex1", "ex2"))
    over &= (F.least("ey1", "ey2") <= F.greatest("y1", "y2")) & (F.least("y1", "y2") <= F.greatest("ey1", "ey2"))
    at = F.col("ex1") + F.try_divide((F.col("y1") - F.col("ey1")) * (F.col("ex2") - F.col("ex1")), F.col("ey2") - F.col("ey1"))
    right = ((F.col("ey1") <= F.col("y1")) != (F.col("ey2") <= F.col("y1"))) & (at > F.col("x1"))
    hit = pairs.join(e, "poly").groupBy("poly", "line", "seq").agg(F.max(over).alias("over"), F.sum(F.coalesce(right.cast("int"), F.lit(0))).alias("n"))
    return hit.where("over or n % 2 = 1").select("poly", "line").distinct()


def ring_area(vertices: DataFrame) -> DataFrame:
    """Signed area of each line closed to a ring."""
    w = Window.partitionBy("line").orderBy("seq")
    all_ = Window.partitionBy("line").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = vertices.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(all_)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(all_))})
    return v.groupBy("line").agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def rasterise(edges: DataFrame) -> DataFrame:
    """Pixels (r, c) whose centre is inside polygons given by their edges (poly, x1 .. y2), even-odd: each edge becomes its
    crossings with the rows' centre lines (half open in y), sorted crossings are paired, and pairs become runs of pixels."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    rows = edges.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("poly", "r").orderBy("x")
    cut = rows.select("poly", "r", x.alias("x")).withColumns({"k": F.row_number().over(w), "next": F.lead("x").over(w)}).where("k % 2 = 1")
    c0, c1 = F.ceil(F.col("x") - 0.5), F.ceil(F.col("next") - 0.5) - 1
    return cut.where(c0 <= c1).select("poly", F.col("r").cast("int").alias("r"), F.explode(F.sequence(c0.cast("int"), c1.cast("int"))).alias("c"))


def near_pixels(segments: DataFrame, radius: float) -> DataFrame:
    """Pixels (r, c) whose centre is within a radius of a segment, each once per line."""
    minx, miny, maxx, maxy = envelope(radius + 0.5)
    p = segments.withColumn("r", F.explode(F.sequence(F.floor(miny).cast("int"), F.ceil(maxy).cast("int")))).withColumn("c", F.explode(F.sequence(F.floor(minx).cast("int"), F.ceil(maxx).cast("int"))))
    return p.where(point_distance(F.col("c") + 0.5, F.col("r") + 0.5) <= radius).select("line", "r", "c").distinct()


RING = "array<struct<x:double,y:double>>"


def _side(axis: str, bound: float, sign: int):
    """What of an edge from p to q a side of a box leaves: none to two points."""
    other = "y" if axis == "x" else "x"

    def cut(p: Column, q: Column) -> Column:
        along = p[other] + (q[other] - p[other]) * F.try_divide(F.lit(bound) - p[axis], q[axis] - p[axis])
        x, y = (F.lit(bound), along) if axis == "x" else (along, F.lit(bound))
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def step(q: Column, p: Column) -> Column:
        inside = lambda v: (v[axis] - bound) * sign >= 0
        none = F.array().cast(RING)
        return F.when(inside(q), F.when(inside(p), F.array(q)).otherwise(F.array(cut(p, q), q))).otherwise(F.when(inside(p), F.array(cut(p, q))).otherwise(none))

    return step


def _cut_by(axis: str, bound: float, sign: int):
    step = _side(axis, bound, sign)

    def cut(ring: Column) -> Column:
        before = F.concat(F.slice(ring, F.size(ring) - 1, 1), F.slice(ring, 1, F.size(ring) - 2))  # of an open ring each point's predecessor
        open_ = F.slice(ring, 1, F.size(ring) - 1)
        closed = F.transform(F.array(F.flatten(F.zip_with(open_, before, step))), lambda c: F.when(F.size(c) >= 3, F.concat(c, F.slice(c, 1, 1))).otherwise(F.array().cast(RING)))
        return F.when(F.size(ring) >= 4, F.get(closed, F.lit(0))).otherwise(F.array().cast(RING))

    return cut


def clip_ring(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """A closed ring (array of points) inside a box, closed again; empty if it is outside. The box's four sides cut it one after
    the other. Parts of a ring that leaves and comes back stay joined along the border, which adds no area."""
    minx, miny, maxx, maxy = map(float, box)
    for axis, bound, sign in (("x", minx, 1), ("x", maxx, -1), ("y", miny, 1), ("y", maxy, -1)):
        ring = F.get(F.transform(F.array(ring), _cut_by(axis, bound, sign)), F.lit(0))  # binds the ring, which is used many times
    return ring


def ring_edges(polygons: DataFrame, key: str = "poly", rings: str = "rings") -> DataFrame:
    """poly, x1 .. y2: the edges of all rings of polygons; even-odd, holes need no winding of their own."""
    pairs = F.flatten(F.transform(rings, lambda g: F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))))
    return polygons.select(F.col(key).alias("poly"), F.explode(pairs).alias("e")).select("poly", "e.*")


def line_segments(lines: DataFrame, key: str = "line", geom: str = "geom") -> DataFrame:
    """line, seq (from 1), x1 .. y2 of lines held as arrays of points."""
    pairs = F.zip_with(F.slice(geom, 1, F.greatest(F.size(geom) - 1, F.lit(0))), F.slice(geom, 2, F.greatest(F.size(geom) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return lines.select(F.col(key).alias("line"), F.posexplode(pairs).alias("seq", "e")).select("line", (F.col("seq") + 1).alias("seq"), "e.*")


def touched_pixels(segments: DataFrame, half: str = "half") -> DataFrame:
    """line, r, c: the pixels whose squares a buffer of lines touches, each once per line: flat at the lines' ends, round where
    segments meet. Segments (line, part, seq, x1 .. y2, ``half``: the buffer's half width) are in pixels, y downwards; segments of
    one part that follow each other by ``seq`` meet. Row by row the buffer's greatest extent gives its pixels, so their number
    grows with the buffer's area."""
    h = F.col(half)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.sqrt(dx * dx + dy * dy)
    s = segments.where(n > 0).withColumns({"_ox": -dy / n * h, "_oy": dx / n * h})
    corner = lambda x, y, sign: F.struct((F.col(x) + F.col("_ox") * sign).alias("x"), (F.col(y) + F.col("_oy") * sign).alias("y"))
    s = s.select("line", F.array(corner("x1", "y1", 1), corner("x2", "y2", 1), corner("x2", "y2", -1), corner("x1", "y1", -1)).alias("q"))
    ys = F.transform("q", lambda p: p["y"])
    s = s.withColumn("r", F.explode(F.sequence(F.floor(F.array_min(ys)).cast("int"), F.floor(F.array_max(ys)).cast("int"))))
    top, bottom = F.col("r").cast("double"), F.col("r") + 1.0

    def at(p: Column, q: Column, y: Column) -> Column:
        between = (F.least(p["y"], q["y"]) <= y) & (y <= F.greatest(p["y"], q["y"]))
        return F.when(between, p["x"] + (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]))

    inside = F.transform("q", lambda p: F.when((p["y"] >= top) & (p["y"] <= bottom), p["x"]))
    turned = F.concat(F.slice("q", 2, 3), F.slice("q", 1, 1))
    xs = F.concat(inside, F.zip_with("q", turned, lambda p, q: at(p, q, top)), F.zip_with("q", turned, lambda p, q: at(p, q, bottom)))
    bands = s.select("line", "r", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"))
    joint = Window.partitionBy("line", "part").orderBy("seq")
    ends = segments.where(n > 0).withColumn("_next", F.lead("seq").over(joint)).where("_next is not null").select("line", F.col("x2").alias("x"), F.col("y2").alias("y"), h.alias("_h"))
    ends = ends.withColumn("r", F.explode(F.sequence(F.floor(F.col("y") - F.col("_h")).cast("int"), F.floor(F.col("y") + F.col("_h")).cast("int"))))
    off = F.greatest(F.lit(0.0), F.col("r") - F.col("y"), F.col("y") - F.col("r") - 1)
    wide = F.sqrt(F.greatest(F.lit(0.0), F.col("_h") * F.col("_h") - off * off))
    bands = bands.unionByName(ends.where(off <= F.col("_h")).select("line", "r", (F.col("x") - wide).alias("x0"), (F.col("x") + wide).alias("x1")))
    return bands.where("x0 is not null").select("line", "r", F.explode(F.sequence(F.floor("x0").cast("int"), F.floor("x1").cast("int"))).alias("c")).distinct()


def crossings(segments: DataFrame, box: tuple[float, float, float, float], step: float) -> DataFrame:
    """Where lines cross a box's border, told as in or out by the line's points ``step`` before and after; others are dropped."""
    minx, miny, maxx, maxy = (F.lit(float(b)) for b in box)
    m = measured(segments)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ts = F.array(*[F.try_divide(e - F.col(p), d) for e, p, d in ((minx, "x1", dx), (maxx, "x1", dx), (miny, "y1", dy), (maxy, "y1", dy))])
    hit = m.select("line", "seq", *SEGMENT, "len", "at", F.posexplode(ts).alias("side", "t")).where("t >= 0 and t < 1")
    x, y = F.col("x1") + dx * F.col("t"), F.col("y1") + dy * F.col("t")
    on = F.when(F.col("side") < 2, (y >= miny) & (y <= maxy)).otherwise((x >= minx) & (x <= maxx))
    hit = hit.where(on).select("line", "seq", "side", (F.col("at") + F.col("len") * F.col("t")).alias("d0"), x.alias("cx"), y.alias("cy"))
    probes = hit.select("line", "seq", "side", "d0", "cx", "cy", F.explode(F.array(F.lit(-1), F.lit(1))).alias("dir")).withColumn("d", F.col("d0") + F.col("dir") * step)
    p = interpolate(m, probes).withColumn("in", (F.col("x") > minx) & (F.col("x") < maxx) & (F.col("y") > miny) & (F.col("y") < maxy))
    both = p.groupBy("line", "seq", "side", "d0", "cx", "cy").agg(F.max(F.when(F.col("dir") == 1, F.col("in"))).alias("after"), F.max(F.when(F.col("dir") == -1, F.col("in"))).alias("before"))
    return both.where("after <> before").select("line", "seq", F.element_at(F.array(*map(F.lit, "WESN")), F.col("side") + 1).alias("edge"), F.col("d0").alias("d"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.when(F.col("after"), "in").otherwise("out").alias("flow"))
