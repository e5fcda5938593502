"""Raster operators on long-form rasters (r, c, z), nodata as NULL.

Minima, maxima and gradients run over strips: a row or column of pixels is cut into strips of ``STRIP`` with the window's halo
copied to both neighbours, so no window partition grows with the raster. Means, de-terracing and distances are array kernels
over tiles or strips (``tiles``): one shuffle each, two for distances.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from fluvius.operators import tiles

STRIP = 512


def block_mean(df: DataFrame, f: int, checked: bool = False) -> DataFrame:
    """f x f means that ignore nodata; the pixel counts of both sides must be multiples of f (see ``block_display``), which is an
    error otherwise if ``checked``."""
    if checked:
        n = df.agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
        even = F.expr(f"_h % {f} = 0 and _w % {f} = 0")
        df = df.crossJoin(F.broadcast(n)).where(F.when(even, F.lit(True)).otherwise(F.raise_error(F.lit(f"the raster is not a whole number of blocks of {f}")).cast("boolean"))).drop("_h", "_w")
    return df.groupBy(F.expr(f"r div {f}").cast("int").alias("r"), F.expr(f"c div {f}").cast("int").alias("c")).agg(F.avg("z").alias("z"))


def block_display(df: DataFrame, f: int) -> DataFrame:
    """f x f means of whole blocks; rows and columns left over at the ends are cut off."""
    n = df.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    return block_mean(df.crossJoin(F.broadcast(n)).where(F.expr(f"r < h - h % {f} and c < w - w % {f}")), f)


def _along(df: DataFrame, axis: str, halo: int, make: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``df`` with window columns along an axis, computed in strips with a halo."""
    other = "c" if axis == "r" else "r"
    strips = F.sequence(F.floor((F.col(axis) - halo) / STRIP), F.floor((F.col(axis) + halo) / STRIP))
    cut = df.withColumn("_s", F.explode(strips))
    w = Window.partitionBy(other, "_s").orderBy(axis)
    return cut.withColumns(make(w)).where(F.floor(F.col(axis) / STRIP) == F.col("_s")).drop("_s")


def _frame(axis_w: WindowSpec, half: int) -> WindowSpec:
    return axis_w.rangeBetween(-half, half)


def focal_min_max(df: DataFrame, size: int) -> DataFrame:
    """Least and greatest of a centred odd window; at the edges of the part inside, as mirrored edges bring no new values."""
    h = size // 2
    one = _along(df, "c", h, lambda w: {"lo": F.min("z").over(_frame(w, h)), "hi": F.max("z").over(_frame(w, h))})
    return _along(one, "r", h, lambda w: {"lo": F.min("lo").over(_frame(w, h)), "hi": F.max("hi").over(_frame(w, h))})


def focal_mean(df: DataFrame, size: int, column: str = "z", out: str = "mean") -> DataFrame:
    """Mean of a centred odd window with mirrored edges."""
    h = size // 2
    return tiles.tiled(df, h, lambda a: {column: a[column], out: tiles.window_mean(a[column], h)}, [column], {column: "double", out: "double"})


def deterrace(df: DataFrame, flat: float = 2.5, size: int = 7) -> DataFrame:
    """Smooths integer terraces: where the window's range is at most ``flat`` the window's mean, twice."""
    h = size // 2

    def kernel(a: tiles.Arrays) -> tiles.Arrays:
        z = a["z"]
        low, high = tiles.window_range(z, h)
        level = high - low <= flat
        for _ in range(2):
            z = np.where(level, tiles.window_mean(z, h), z)
        return {"z": z}

    return tiles.tiled(df, 3 * h, kernel, ["z"], {"z": "double"})


def masked_mean(df: DataFrame, size: int) -> DataFrame:
    """Mean of a window over mask pixels (column m) with mirrored edges, NULL where it holds none."""
    h = size // 2

    def kernel(a: tiles.Arrays) -> tiles.Arrays:
        on = a["m"] == 1
        n = tiles.window_sum(on.astype(float), h)
        total = tiles.window_sum(np.where(on, np.nan_to_num(a["z"]), 0.0), h)
        return {"mean": np.where(n > 0, total / np.where(n > 0, n, 1), np.nan)}

    return tiles.tiled(df, h, kernel, ["z", "m"], {"mean": "double"})


def gradient(df: DataFrame, mpp: float) -> DataFrame:
    """dx and dy per metre: central differences, one-sided at the edges."""

    def d(w: WindowSpec) -> Column:
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        return F.coalesce((after - before) / (2 * mpp), (after - F.col("z")) / mpp, (F.col("z") - before) / mpp, F.lit(0.0))

    return _along(_along(df, "c", 1, lambda w: {"dx": d(w)}), "r", 1, lambda w: {"dy": d(w)})


def slope_percent(df: DataFrame, mpp: float) -> DataFrame:
    return gradient(df, mpp).withColumn("slope", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * 100)


#: Edges of the slope histogram and classes (fixed values).
SLOPE_EDGES = (0, 2, 5, 10, 15, 20, 30, 45, 60, 90, 1e9)
CLASS_EDGES = (5, 10, 20)


def slope_bins(df: DataFrame) -> DataFrame:
    """bin, n, share of all pixels: half-open bins, empty ones included."""
    s = F.col("slope")
    bin_ = F.lit(0)
    for i, low in enumerate(SLOPE_EDGES[:-1]):
        bin_ = F.when(s >= low, F.lit(i)).otherwise(bin_)
    counts = df.where(s.isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(len(SLOPE_EDGES) - 1).select(F.col("id").cast("int").alias("bin"))
    total = F.broadcast(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    return bins.join(counts, "bin", "left").crossJoin(total).select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)), 4).alias("share"))


def slope_class(slope: Column) -> Column:
    """0..3 by the class edges."""
    return sum(F.when(slope >= e, 1).otherwise(0) for e in CLASS_EDGES)


def buildable(df: DataFrame, limit: float = 10.0, land: Column | None = None) -> DataFrame:
    """Share of (land) pixels flatter than ``limit`` percent, 0 without any."""
    rows = df if land is None else df.where(land)
    return rows.agg(F.coalesce(F.avg(F.when(F.col("slope") < limit, 1.0).otherwise(0.0)), F.lit(0.0)).alias("buildable"))


def hillshade(df: DataFrame, mpp: float, exaggeration: float = 2.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light from an azimuth and altitude on the surface's normals, 0..1."""
    import math

    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    lx, ly, lz = math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt)
    g = gradient(df, mpp)
    nx, ny = -F.col("dx") * exaggeration, F.col("dy") * exaggeration  # rows run south
    return g.withColumn("shade", F.greatest(F.lit(0.0), (nx * lx + ny * ly + lz) / F.sqrt(nx * nx + ny * ny + 1)))


def tinted(shade: Column, water: Column, share: float = 0.35, light: float = 0.65) -> Column:
    """Shades with water told from land: a share of the shade and a light of its own."""
    return F.when(water, shade * share + light).otherwise(shade)


def terracing(df: DataFrame, step: float = 1.0) -> DataFrame:
    """Share of non-zero heights that are multiples of a step, within 1 %; 0 without any. All pixels count."""
    q = F.col("z") / step
    return df.where(F.col("z").isNotNull() & (F.col("z") != 0)).agg(F.coalesce(F.avg(F.when(F.abs(q - F.rint(q)) < 0.01, 1.0).otherwise(0.0)), F.lit(0.0)).alias("terracing"))


def relief(df: DataFrame) -> DataFrame:
    return df.agg(F.min("z").alias("lo"), F.max("z").alias("hi"), (F.max("z") - F.min("z")).alias("relief"), F.avg(F.when(F.col("z").isNull(), 1.0).otherwise(0.0)).alias("nodata"))


def plan_vertical(stats: DataFrame, exaggeration: float = 1.0, margin: float = 5.0, sea_level: float | None = None) -> DataFrame:
    """From one row (lo, hi, ws: the water surface) the sea level, height scale and offset; a scale beyond 10 km is an error, and
    so is a given sea level too low for the lowest terrain."""
    ex = exaggeration
    least = (F.col("ws") - F.col("lo")) * ex + margin
    given = F.ceil(least).cast("double")
    if sea_level is not None:
        given = F.when(least > sea_level, F.raise_error(F.lit("the sea level is too low for the terrain")).cast("double")).otherwise(F.lit(float(sea_level)))
    d = stats.withColumn("sea", given)
    d = d.withColumn("offset", F.col("sea") - F.col("ws") * ex)
    d = d.withColumns({"u_min": F.col("lo") * ex + F.col("offset"), "u_max": F.col("hi") * ex + F.col("offset")})
    d = d.withColumn("scale", F.ceil(F.col("u_max") * 1.02 / 10) * 10.0)
    d = d.withColumn("scale", F.when(F.col("scale") > 10000, F.raise_error(F.lit("the terrain is too high")).cast("double")).otherwise(F.greatest("scale", F.lit(200.0))))
    return d.withColumn("m_per_level", F.col("scale") / 65535)


def quantise(z: Column, scale: Column) -> Column:
    """16-bit level of a height: half to even, clipped within half a level, else an error."""
    v = z / scale * 65535
    ok = (v >= -0.5) & (v <= 65535.5)
    return F.when(z.isNull(), None).when(~ok, F.raise_error(F.lit("height outside the scale")).cast("int")).otherwise(F.greatest(F.lit(0), F.least(F.lit(65535), F.rint(v).cast("int"))))


def centre_overwrite(world: DataFrame, playable: DataFrame, factor: int, top: int, left: int) -> DataFrame:
    """The world with its centre replaced by the playable area's block means (rounded half to even)."""
    small = block_mean(playable, factor).select((F.col("r") + top).alias("r"), (F.col("c") + left).alias("c"), F.rint("z").alias("p"))
    return world.join(small, ["r", "c"], "left").select("r", "c", F.coalesce("p", "z").alias("z"), F.col("z").alias("before"), "p")


def burn(z: Column, mask: Column, surface: Column, depth: Column) -> Column:
    """Carves channels: where the mask holds, at most the surface less the depth."""
    return F.when(mask & surface.isNotNull(), F.least(z, surface - depth)).otherwise(z)


def cross_section(df: DataFrame, axis: str, at: int) -> DataFrame:
    return df.where(F.col(axis) == at)


def subsample(df: DataFrame, step: int) -> DataFrame:
    return df.where((F.col("r") % step == 0) & (F.col("c") % step == 0))


def bilinear(df: DataFrame, x: Column, y: Column, points: DataFrame) -> DataFrame:
    """z at pixel-centre coordinates (x to the right, y down) of ``points``: four neighbours by an equality join."""
    p = points.withColumns({"_x": x - 0.5, "_y": y - 0.5})
    p = p.withColumns({"_c": F.floor("_x").cast("int"), "_r": F.floor("_y").cast("int")})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    p = p.withColumn("_n", near)
    fx, fy = F.col("_x") - F.col("_c"), F.col("_y") - F.col("_r")
    weight = F.when(F.col("_n.j") == 1, fx).otherwise(1 - fx) * F.when(F.col("_n.i") == 1, fy).otherwise(1 - fy)
    p = p.select(*points.columns, (F.col("_r") + F.col("_n.i")).alias("r"), (F.col("_c") + F.col("_n.j")).alias("c"), weight.alias("_w"))
    return p.join(df.select("r", "c", "z"), ["r", "c"]).where(F.col("z").isNotNull()).groupBy(*points.columns).agg((F.sum(F.col("z") * F.col("_w")) / F.sum("_w")).alias("z"))


def window_level(df: DataFrame, points: DataFrame, half: int) -> DataFrame:
    """pr, pc, lvl: the level at each place (pr, pc) of ``points``, the median of the pixels of the mask ``m`` in the window of
    ``half`` pixels around it, else the lowest pixel. A place without any pixel near it is left out."""

    def kernel(px: pa.Table, of: pa.Table, at: np.ndarray, points: np.ndarray) -> pa.Table:
        known, wet = px["z"].is_valid().to_numpy(), px["m"].fill_null(False).to_numpy()
        z = px["z"].to_numpy()
        level, there = np.full(len(points[0]), np.nan), np.zeros(len(points[0]), bool)
        found = np.zeros(len(points[0]), bool)
        for on, what in ((np.ones(len(z), bool), "any"), (known, "least"), (known & wet, "median")):
            for some, v, begin in tiles.window_values(z[on], at[:, on], points, half):
                n = np.diff(begin)
                if what == "any":
                    there[some] = n > 0
                    continue
                s, n = begin[:-1][n > 0], n[n > 0]
                i = np.flatnonzero(np.diff(begin)) + some.start
                level[i] = v[s] if what == "least" else 0.5 * v[s + (n - 1) // 2] + 0.5 * v[s + n // 2]
                found[i] = True
        return pa.table({"pr": of["pr"], "pc": of["pc"], "lvl": pa.array(level, pa.float64(), mask=~found)}).filter(pa.array(there))

    places = points.select("pr", "pc", F.col("pr").alias("_r"), F.col("pc").alias("_c")).distinct()
    return tiles.near_points(df, places, half, kernel, ["z", "m"], StructType([StructField("pr", IntegerType()), StructField("pc", IntegerType()), StructField("lvl", DoubleType())]))


def nearest_distance(df: DataFrame, target: str) -> DataFrame:
    """For each pixel the squared distance (d2, in pixels) to the nearest pixel where ``target`` holds, at any distance, and that
    pixel's z; NULL where the raster has no such pixel. Ties to the smaller row, then column. Two passes: the nearest within each
    column, then over the rows."""
    one = tiles.strips(df.select("r", "c", "z", F.col(target).alias("t")), "c", lambda a: {"z": a["z"], "t": a["t"], **tiles.nearest_in_columns(a)}, ["z", "t"], {"z": "double", "t": "boolean", "tr": "double", "tz": "double"})
    two = tiles.strips(one, "r", lambda a: {"z": a["z"], "t": a["t"], **tiles.nearest_in_rows(a)}, ["z", "t", "tr", "tz"], {"z": "double", "t": "boolean", "d2": "long", "near_z": "double"})
    return two.select("r", "c", "z", F.col("t").alias(target), "d2", "near_z")


def fill_nodata(df: DataFrame) -> DataFrame:
    """NULL pixels take the value of the nearest valid one at any distance; filled tells which. A raster without a valid pixel is
    an error. See ``filled_share``."""
    near = nearest_distance(df.select("r", "c", "z", F.col("z").isNotNull().alias("_v")), "_v")
    void = F.col("z").isNull()
    none = F.raise_error(F.lit("the raster is entirely nodata")).cast("double")
    return near.select("r", "c", F.when(void & F.col("d2").isNull(), none).otherwise(F.coalesce("z", "near_z")).alias("z"), void.alias("filled"))


def filled_share(filled: DataFrame) -> DataFrame:
    """Share of the pixels that were filled."""
    return filled.agg(F.avg(F.col("filled").cast("double")).alias("share"))


def taper(d2: Column, mpp: float, limit: float) -> Column:
    """Bank profile: the root of the distance's share of a limit, at most 1."""
    return F.sqrt(F.least(F.coalesce(F.sqrt(d2.cast("double")) * mpp / limit, F.lit(1.0)), F.lit(1.0)))


def raster_components(df: DataFrame, mask: str) -> DataFrame:
    """r, c, component of the 4-connected parts of a mask. Rows become runs; only touching runs are edges of the graph."""
    from fluvius.operators.graph import components

    w = Window.partitionBy("r").orderBy("c")
    on = df.where(F.col(mask)).select("r", "c")
    cell = on.withColumn("_g", F.col("c") - F.row_number().over(w))
    runs = cell.groupBy("r", "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    runs = runs.withColumn("run", F.col("r").cast("long") * (1 << 31) + F.col("c0"))
    # runs meet over cells of columns, so that a row of many runs is not joined with all of the next
    spread = runs.withColumn("_k", F.explode(F.sequence(F.floor(F.col("c0") / STRIP), F.floor(F.col("c1") / STRIP))))
    a, b = spread.alias("a"), spread.alias("b")
    meet = (F.col("a.r") + 1 == F.col("b.r")) & (F.col("a._k") == F.col("b._k")) & (F.col("a.c0") <= F.col("b.c1")) & (F.col("b.c0") <= F.col("a.c1"))
    touch = a.join(b, meet)
    found = components(touch.select(F.col("a.run").alias("src"), F.col("b.run").alias("dst")))
    labelled = runs.join(found, runs["run"] == found["node"], "left").select("r", "c0", "c1", F.coalesce("component", "run").alias("component"))
    return labelled.select("r", F.explode(F.sequence("c0", "c1")).alias("c"), "component")
