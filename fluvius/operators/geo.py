"""Scalar geography as column expressions: zones, projection, grids, orders, source choice."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXELS, PLAYABLE_M, WORLD_M = 4096, 14_336.0, 57_344.0

#: Drainage areas (km2) at which a stream's order rises (fixed values).
AREA_STEPS = (1.5, 8, 30, 120, 450, 1800, 7000, 30000)
#: Channel width and depth (m) by order, 2 to 10 (fixed values).
WIDTHS = {2: 4.0, 3: 8.0, 4: 14.0, 5: 24.0, 6: 40.0, 7: 70.0, 8: 120.0, 9: 200.0, 10: 300.0}
DEPTHS = {2: 0.8, 3: 1.2, 4: 2.0, 5: 3.0, 6: 4.0, 7: 6.0, 8: 8.0, 9: 12.0, 10: 15.0}


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone, with the two northern exceptions; NULL outside 80 S to 84 N."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    north = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when(north & (lon < 9), 31).when(north & (lon < 21), 33).when(north & (lon < 33), 35).when(north, 37).otherwise(zone)
    return F.when((lat >= -80) & (lat <= 84), F.when(lat >= 0, F.lit(32600)).otherwise(32700) + F.least(zone, F.lit(60)))


#: Third flattening series of the ellipsoid WGS84.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series (third order)."""
    centre = (epsg % 100) * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - centre)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    x = eta + reduce(lambda a, b: a + b, [F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a for j, a in enumerate(_ALPHA, 1)])
    y = xi + reduce(lambda a, b: a + b, [F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a for j, a in enumerate(_ALPHA, 1)])
    return x * (_K0 * _A) + 500000.0, y * (_K0 * _A) + F.when(epsg >= 32700, 10000000.0).otherwise(0.0)


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = (y - F.when(epsg >= 32700, 10000000.0).otherwise(0.0)) / (_K0 * _A)
    eta = (x - 500000.0) / (_K0 * _A)
    xi0 = xi - reduce(lambda a, b: a + b, [F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b for j, b in enumerate(_BETA, 1)])
    eta0 = eta - reduce(lambda a, b: a + b, [F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b for j, b in enumerate(_BETA, 1)])
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi + reduce(lambda a, b: a + b, [F.sin(chi * 2 * j) * d for j, d in enumerate(_DELTA, 1)])
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (epsg % 100) * 6 - 183, F.degrees(phi)


def square(cx: Column, cy: Column, side: float) -> Column:
    h = side / 2
    return F.struct((cx - h).alias("minx"), (cy - h).alias("miny"), (cx + h).alias("maxx"), (cy + h).alias("maxy"))


def sites(places: DataFrame) -> DataFrame:
    """Adds epsg, cx, cy (the centre in metres) and the playable and world squares to places (lon, lat); a place beyond the zones is
    an error."""
    out = F.raise_error(F.lit("the place is outside of the zones")).cast("int")
    d = places.withColumn("epsg", F.coalesce(utm_zone(F.col("lon"), F.col("lat")), out))
    x, y = to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    d = d.withColumns({"cx": x, "cy": y})
    return d.withColumns({"playable": square(F.col("cx"), F.col("cy"), PLAYABLE_M), "world": square(F.col("cx"), F.col("cy"), WORLD_M)})


def centre(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a box's middle, all that counts of it; its sides must be in order."""
    ok = (west < east) & (south < north)
    wrong = F.raise_error(F.lit("a box must be west, south, east, north in degrees")).cast("double")
    return F.when(ok, (west + east) / 2).otherwise(wrong), F.when(ok, (south + north) / 2).otherwise(wrong)


def degrees(box: Column, epsg: Column, pad: float = 0.0) -> Column:
    """The envelope in degrees of a box's corners."""
    corners = [from_utm(box[x], box[y], epsg) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    lon, lat = ([c[k] for c in corners] for k in (0, 1))
    return F.struct((F.least(*lon) - pad).alias("minx"), (F.least(*lat) - pad).alias("miny"), (F.greatest(*lon) + pad).alias("maxx"), (F.greatest(*lat) + pad).alias("maxy"))


def box_text(box: Column, digits: int = 3) -> Column:
    return F.concat_ws(",", *[F.format_string(f"%.{digits}f", F.bround(box[k], digits)) for k in ("minx", "miny", "maxx", "maxy")])


def pixel(x: Column, y: Column, minx: Column, maxy: Column, mpp: float, size: int = PIXELS) -> tuple[Column, Column]:
    """Column and row of a point, clamped to the grid."""
    top = F.lit(size - 1)
    return F.greatest(F.lit(0), F.least(top, F.floor((x - minx) / mpp).cast("int"))), F.greatest(F.lit(0), F.least(top, F.floor((maxy - y) / mpp).cast("int")))


def snap_edge(c: Column, r: Column, size: int = PIXELS) -> Column:
    """(edge, c, r): the nearest edge, ties in the order W, E, N, S, and the pixel on it."""
    n = size - 1
    west, east, north, south = c, n - c, r, n - r
    least = F.least(west, east, north, south)
    edge = F.when(west == least, "W").when(east == least, "E").when(north == least, "N").otherwise("S")
    return F.struct(edge.alias("edge"), F.when(edge == "W", 0).when(edge == "E", n).otherwise(c).alias("c"), F.when(edge == "N", 0).when(edge == "S", n).otherwise(r).alias("r"))


def order_from_area(km2: Column) -> Column:
    """1 to 9 by the area steps, each strict."""
    out = F.lit(len(AREA_STEPS) + 1)
    for i, step in reversed(list(enumerate(AREA_STEPS, 1))):
        out = F.when(km2 < step, F.lit(i)).otherwise(out)
    return F.when(km2.isNotNull(), out)


def channel(order: Column, discharge: Column, intermittent: Column, depth_scale: float = 1.0) -> tuple[Column, Column]:
    """Width (whole metres) and depth (tenths): by discharge where there is one, else by order; half the depth if intermittent."""
    k = F.greatest(F.lit(2), F.least(F.lit(10), order))
    width, depth = (F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), k) for table in (WIDTHS, DEPTHS))
    flows = F.coalesce(discharge > 0, F.lit(False))
    width = F.when(flows, F.greatest(F.lit(3.0), F.sqrt(discharge) * 4.8)).otherwise(width)
    depth = F.when(flows, F.greatest(F.lit(0.5), F.pow(discharge, F.lit(0.3)) * 0.35)).otherwise(depth) * depth_scale
    return F.rint(width), F.rint(F.when(intermittent, depth * 0.5).otherwise(depth) * 10) / 10


def region(lat: Column, lon: Column) -> Column:
    """Code of the continental hydrography set."""
    far_north = F.when((lon >= 60) | (lon < -170), "si").when(lon < -60, "ar").when(lon < -10, "gr").otherwise("eu")
    return (
        F.when((lat >= 60) & ((lon >= 60) | (lon < -10)), far_north).when((lon >= -170) & (lon < -30), F.when(lat >= 8, "na").otherwise("sa"))
        .when((lon >= -30) & (lon < 60), F.when(lat >= 34, "eu").otherwise("af")).when((lon >= 60) & (lat >= -10), "as").otherwise("au")
    )


def resample_policy(native: Column, target: Column, force: Column) -> Column:
    """(name, factor, resolution) with which a source is read for a target resolution."""
    f = F.when(force > 1, F.struct(F.lit("oversample-forced").alias("name"), force.alias("factor"), (target / force).alias("res"))).when(force == 1, F.struct(F.lit("direct").alias("name"), F.lit(1).alias("factor"), target.alias("res")))
    fine = F.struct(F.lit("fetch-fine-then-block-average").alias("name"), F.lit(2).alias("factor"), (target / 2).alias("res"))
    direct = lambda name: F.struct(F.lit(name).alias("name"), F.lit(1).alias("factor"), target.alias("res"))
    return F.coalesce(f, F.when(native <= target / 2, fine).when(native <= target, direct("direct-bilinear")).otherwise(direct("upsample-cubic-spline")))


def resampling(native: Column, target: Column) -> Column:
    return F.when(native > target, "cubic_spline").when(native > target / 2, "bilinear").otherwise("average")


def tile_grid(extents: DataFrame, mpp: float, tile: int) -> DataFrame:
    """Tiles of each extent (id, minx, miny, maxx, maxy), from the north-west in rows; edge tiles are smaller."""
    n = extents.withColumns({"w": F.rint((F.col("maxx") - F.col("minx")) / mpp).cast("int"), "h": F.rint((F.col("maxy") - F.col("miny")) / mpp).cast("int")})
    whole = (F.abs(F.col("w") * mpp - (F.col("maxx") - F.col("minx"))) <= 1e-6) & (F.abs(F.col("h") * mpp - (F.col("maxy") - F.col("miny"))) <= 1e-6)
    n = n.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("an extent is not a whole number of pixels")).cast("boolean")))
    t = n.withColumn("r0", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(tile)))).withColumn("c0", F.explode(F.sequence(F.lit(0), F.col("w") - 1, F.lit(tile))))
    return t.select("id", "r0", "c0", F.least(F.lit(tile), F.col("h") - F.col("r0")).alias("th"), F.least(F.lit(tile), F.col("w") - F.col("c0")).alias("tw"), (F.col("minx") + F.col("c0") * mpp).alias("x0"), (F.col("maxy") - F.col("r0") * mpp).alias("y0"))


def tile_names(boxes: DataFrame) -> DataFrame:
    """Names of the one-degree tiles that touch each box (id, west, south, east, north)."""
    t = boxes.withColumn("lat", F.explode(F.sequence(F.floor("south"), F.floor(F.col("north") - 1e-9)))).withColumn("lon", F.explode(F.sequence(F.floor("west"), F.floor(F.col("east") - 1e-9))))
    name = F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", F.when(F.col("lat") >= 0, "N").otherwise("S"), F.abs("lat"), F.when(F.col("lon") >= 0, "E").otherwise("W"), F.abs("lon"))
    return t.select("id", name.alias("tile"))
