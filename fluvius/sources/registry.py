"""Sources of terrain and of water: what there is, what covers a box, which one is taken."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.operators import geo, resample
from fluvius.operators.layers import Grid
from fluvius.sources import geotiff
from fluvius.sources.remote import FetchError

LOWEST, HIGHEST = -1000.0, 20000.0  # terrain beyond is none
SIDES = ("minx", "miny", "maxx", "maxy")


@dataclass
class Source:
    """A source of terrain: its kind (dtm, or dsm with what stands on the ground), resolution, and whether it covers a box."""

    id: str
    kind: str
    native_m: float
    vertical_datum: str = "unknown"
    files: list[str] = field(default_factory=list)
    epsg: int | None = None
    nodata: float | None = None

    def covers(self, spark: SparkSession, box: tuple) -> bool:
        """Whether the union of the files' bounds contains a box of the same zone."""
        if not self.files:
            return False
        bounds = geotiff.bounds(geotiff.read(spark, self.files))
        return covered(bounds, spark.createDataFrame([(0, *map(float, box))], "id int, minx double, miny double, maxx double, maxy double")).first().covered


def local_sources(path: str) -> list[Source]:
    """Entries (name, files, kind, native_m, vertical_datum, nodata) of a JSON list; files that are missing are left out, patterns are
    spelled out in order. No file, no sources."""
    if not os.path.exists(path):
        return []
    root, out = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(path)))), []
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    for e in entries:
        files = [x for p in e["files"] for x in (sorted(glob.glob(os.path.join(root, p))) if any(c in p for c in "*?[") else [os.path.join(root, p)]) if os.path.exists(x)]
        out.append(Source(f"local:{e['name']}", e.get("kind", "dtm"), float(e["native_m"]), e.get("vertical_datum", "unknown"), files, e.get("epsg"), e.get("nodata")))
    return out


def _covered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes with the rectangles that meet them, cut off at the box: whether their union is the box."""
    for b in batches:
        rects = b.column("rects")
        many, flat = rects.value_lengths().to_numpy(zero_copy_only=False), rects.flatten()
        sides = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        box = [b.column(k).to_numpy(zero_copy_only=False) for k in SIDES]
        ends = np.concatenate([[0], np.cumsum(many)])
        full = [fills(*(v[i] for v in box), *(v[ends[i] : ends[i + 1]] for v in sides)) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in SIDES), pa.array(full, pa.bool_())], [*SIDES, "_full"])


def fills(minx: float, miny: float, maxx: float, maxy: float, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> bool:
    """Whether rectangles (x0 .. y1) within a box fill it: strip by strip between their sides, with the number of rectangles over each
    place between their other sides. A side without length counts as one place."""
    if minx == maxx:
        minx, maxx, x0, x1 = 0.0, 1.0, np.zeros(len(x0)), np.ones(len(x0))
    if miny == maxy:
        miny, maxy, y0, y1 = 0.0, 1.0, np.zeros(len(x0)), np.ones(len(x0))
    if ((x0 <= minx) & (y0 <= miny) & (x1 >= maxx) & (y1 >= maxy)).any():
        return True
    xs, ys = np.unique(np.concatenate([x0, x1, [minx, maxx]])), np.unique(np.concatenate([y0, y1, [miny, maxy]]))
    low, high = np.searchsorted(ys, y0), np.searchsorted(ys, y1)
    begin, end = np.argsort(x0, kind="stable"), np.argsort(x1, kind="stable")
    at_begin, at_end = np.searchsorted(x0[begin], xs, side="right"), np.searchsorted(x1[end], xs, side="right")
    step, i, j = np.zeros(len(ys), np.int64), 0, 0
    for p, q in zip(at_begin[:-1].tolist(), at_end[:-1].tolist(), strict=True):
        np.add.at(step, low[begin[i:p]], 1)
        np.add.at(step, high[begin[i:p]], -1)
        np.add.at(step, low[end[j:q]], -1)
        np.add.at(step, high[end[j:q]], 1)
        i, j = p, q
        if np.cumsum(step)[:-1].min() < 1:
            return False
    return True


def _levelled(df: DataFrame, at: list[str], levels: Column, own: str) -> DataFrame:
    """A row for each cell that a rectangle (columns ``at``) touches on each level from its own up: squares of 2^level, which are no
    smaller than the rectangle, so at most four a level."""
    df = df.withColumn("_level", F.explode(F.filter(levels, lambda v: v >= F.col(own)))).withColumn("_cell", F.pow(F.lit(2.0), "_level"))
    spread = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_cell")), F.floor(F.col(high) / F.col("_cell"))))
    return df.withColumn("_cx", spread(at[0], at[2])).withColumn("_cy", spread(at[1], at[3]))


def covered(bounds: DataFrame, boxes: DataFrame) -> DataFrame:
    """id, covered: whether the union of rectangles (minx, miny, maxx, maxy) contains each box. Equal rectangles and equal boxes are
    taken once. They meet in square cells on the level of the larger of the two, so each is in few cells whatever the sizes, and a
    pair counts in the cell of its common part's corner only. A box without finite sides is not covered."""
    b = bounds.select(*[F.col(c).cast("double").alias(f"b_{c}") for c in SIDES]).where("b_minx < b_maxx and b_miny < b_maxy").distinct()
    keyed = boxes.select("id", *[(F.col(c).cast("double") + 0.0).alias(c) for c in SIDES])
    finite = reduce(lambda p, q: p & q, [F.abs(F.col(c)) < F.lit(float("inf")) for c in SIDES])
    one = keyed.where(finite & (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))).select(*SIDES).distinct()
    # rectangles end at the boxes' extent: what is beyond covers nothing
    over = F.broadcast(one.agg(*[F.min(c).alias(f"_{c}") for c in SIDES[:2]], *[F.max(c).alias(f"_{c}") for c in SIDES[2:]]))
    b = b.crossJoin(over).where("b_minx < _maxx and b_maxx > _minx and b_miny < _maxy and b_maxy > _miny")
    b = b.select(*[F.greatest(f"b_{c}", f"_{c}").alias(f"b_{c}") for c in SIDES[:2]], *[F.least(f"b_{c}", f"_{c}").alias(f"b_{c}") for c in SIDES[2:]]).distinct()
    # the least side keeps a cell's number below 2^40
    level = lambda p: F.ceil(F.log2(F.greatest(F.col(f"{p}maxx") - F.col(f"{p}minx"), F.col(f"{p}maxy") - F.col(f"{p}miny"), *[F.abs(F.col(p + c)) * 2.0**-40 for c in SIDES], F.lit(1e-300)))).cast("int")
    one, b = one.withColumn("_own", level("")), b.withColumn("_b_own", level("b_"))
    levels = F.broadcast(one.select("_own").unionAll(b.select(F.col("_b_own"))).agg(F.collect_set("_own").alias("_levels")))
    left = _levelled(one.crossJoin(levels), list(SIDES), F.col("_levels"), "_own").drop("_levels")
    right = _levelled(b.crossJoin(levels), [f"b_{c}" for c in SIDES], F.col("_levels"), "_b_own").drop("_levels", "_cell")
    meet = (F.col("b_minx") < F.col("maxx")) & (F.col("b_maxx") > F.col("minx")) & (F.col("b_miny") < F.col("maxy")) & (F.col("b_maxy") > F.col("miny"))
    corner = reduce(lambda p, q: p & q, [F.col(f"_c{a}") == F.floor(F.greatest(f"min{a}", f"b_min{a}") / F.col("_cell")) for a in "xy"])
    key, mine, other = ["_level", "_cx", "_cy"], F.col("_level") == F.col("_own"), F.col("_level") == F.col("_b_own")
    near = left.where(mine).join(right.hint("merge"), key).unionByName(left.where(~mine).join(right.where(other).hint("merge"), key)).where(corner & meet)
    held = near.select(*SIDES, F.struct(*[F.greatest(c, f"b_{c}").alias(c) for c in SIDES[:2]], *[F.least(c, f"b_{c}").alias(c) for c in SIDES[2:]]).alias("rect"))
    found = held.groupBy(*SIDES).agg(F.collect_set("rect").alias("rects")).mapInArrow(_covered_batches, ", ".join(f"{c} double" for c in SIDES) + ", _full boolean")
    return keyed.join(found, list(SIDES), "left").select("id", F.coalesce("_full", F.lit(False)).alias("covered"))


def resolve_elevation(sources: list[tuple[Source, bool]], prefer: str | None = None) -> Source:
    """Of the sources, each with whether it covers the box, the finest of bare ground, else the finest; the first of equals."""
    if prefer:
        for s, covers in sources:
            if s.id == prefer:
                if not covers:
                    raise FetchError(f"{prefer} does not cover the extent")
                return s
        raise FetchError(f"unknown source {prefer!r}; known: {[s.id for s, _ in sources]}")
    there = [s for s, covers in sources if covers]
    if not there:
        raise FetchError("no elevation source covers the extent")
    return min([s for s in there if s.kind == "dtm"] or there, key=lambda s: s.native_m)


def resolve_hydro(prefer: str | None = None, national: bool = False) -> str:
    """nhd where the terrain came from the national service, else osm, unless one is asked for."""
    if prefer in ("nhd", "osm"):
        return prefer
    if prefer:
        raise FetchError(f"unknown hydrography {prefer!r}; choose nhd or osm")
    return "nhd" if national else "osm"


def warp(files: DataFrame, on: Grid, epsg: int | None, native_px: float | None = None, fill: float | None = None, nodata: float | None = None) -> DataFrame:
    """r, c, z of a grid from files (ord, west, north, mpp, r, c, z) that share a pixel size: of several over a place the first valid
    value counts. With ``epsg`` (of the grid) the files are in degrees, else in the grid's metres. Values beyond ``LOWEST`` and
    ``HIGHEST`` are none; ``fill`` takes the place of every NULL of the mosaic. The kernel follows ``geo.resampling``: a spline
    where pixels get finer, bilinear, or the mean of the pixels whose middle is inside."""
    spark = files.sparkSession
    size = files.select("mpp", "west", "north").agg(F.min("mpp").alias("step"), F.min("west").alias("x0"), F.max("north").alias("y0")).first()
    z = F.when((F.col("z") >= LOWEST) & (F.col("z") <= HIGHEST) & (F.col("z") != F.lit(nodata) if nodata is not None else F.lit(True)), F.col("z"))
    shift = lambda a, b: F.rint((a - b) / size.step).cast("int")
    put = files.select("ord", (F.col("r") + shift(F.lit(size.y0), F.col("north"))).alias("r"), (F.col("c") + shift(F.col("west"), F.lit(size.x0))).alias("c"), z.alias("z"))
    mosaic = resample.mosaic(put, fill)
    cells = spark.range(on.rows).select(F.col("id").cast("int").alias("tr")).crossJoin(spark.range(on.cols).select(F.col("id").cast("int").alias("tc")))
    x, y = F.lit(on.minx) + (F.col("tc") + 0.5) * on.mpp, F.lit(on.maxy) - (F.col("tr") + 0.5) * on.mpp
    if epsg is not None:
        x, y = geo.from_utm(x, y, F.lit(epsg))
    points = cells.select("tr", "tc", ((x - size.x0) / size.step).alias("x"), ((F.lit(size.y0) - y) / size.step).alias("y"))
    native = native_px if native_px is not None else size.step * (111_000 if epsg is not None else 1)
    if native > on.mpp:
        out = resample.cubic_spline(mosaic, F.col("x"), F.col("y"), points)
    elif native > on.mpp / 2:
        from fluvius.operators.grid import bilinear

        out = bilinear(mosaic, F.col("x"), F.col("y"), points)
    else:
        if epsg is not None:
            px, py = geo.to_utm(F.lit(size.x0) + (F.col("c") + 0.5) * size.step, F.lit(size.y0) - (F.col("r") + 0.5) * size.step, F.lit(epsg))
        else:
            px, py = F.lit(size.x0) + (F.col("c") + 0.5) * size.step, F.lit(size.y0) - (F.col("r") + 0.5) * size.step
        to = mosaic.select(F.floor((on.maxy - py) / on.mpp).cast("int").alias("tr"), F.floor((px - on.minx) / on.mpp).cast("int").alias("tc"), "z")
        out = to.groupBy("tr", "tc").agg(F.avg("z").alias("z"))
    d = cells.join(out.select("tr", "tc", "z"), ["tr", "tc"], "left")
    return d.select(F.col("tr").alias("r"), F.col("tc").alias("c"), (F.coalesce("z", F.lit(float(fill))) if fill is not None else F.col("z")).alias("z"))


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The site dimension of a JSON list (slug, name, country, lat, lon, tags, notes, expected)."""
    return spark.read.option("multiLine", True).json(path)


def one_site(known: DataFrame, slug: str):
    """The row of a slug; an unknown one is an error that names those known."""
    row = known.where(F.col("slug") == slug).first()
    if row is None:
        raise FetchError(f"unknown site {slug!r}; known: {sorted(r.slug for r in known.select('slug').collect())}")
    return row
