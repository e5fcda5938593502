"""Array kernels over long-form rasters: one shuffle into tiles with a halo, or into strips of whole rows or columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TILE = 256
STRIP = 16  # rows or columns that a task holds whole
NEAR = 128  # pixels of the tiles that points are dealt to

Arrays = dict[str, np.ndarray]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column as floats, NULL as NaN."""
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _table(r: np.ndarray, c: np.ndarray, values: Arrays, types: dict[str, str]) -> pa.Table:
    made = {"r": pa.array(r, pa.int32()), "c": pa.array(c, pa.int32())}
    for name, kind in types.items():
        v = values[name]
        column = pa.array(v, pa.float64(), mask=np.isnan(v))
        made[name] = column if kind == "double" else column.cast(pa.int64()) if kind == "long" else column.cast(pa.int8()).cast(pa.bool_())
    return pa.table(made)


def tiled(df: DataFrame, halo: int, kernel: Callable[[Arrays], Arrays], inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """r, c and ``outputs`` (name: double, long or boolean) of each pixel. ``kernel`` gets the inputs of a tile as arrays with
    ``halo`` more pixels on each side, mirrored at the raster's edges (d c b a | a b c d | d c b a), and gives arrays of that size."""
    n = F.broadcast(df.agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w")))

    def spread(axis: str, size: str):
        low, high = F.floor((F.col(axis) - halo) / TILE), F.floor((F.col(axis) + halo) / TILE)
        return F.explode(F.sequence(F.greatest(F.lit(0), low), F.least(F.floor((F.col(size) - 1) / TILE), high)))

    cut = df.select("r", "c", *inputs).crossJoin(n).withColumn("_tr", spread("r", "_h")).withColumn("_tc", spread("c", "_w"))

    def run(t: pa.Table) -> pa.Table:
        size, tile = (t["_h"][0].as_py(), t["_w"][0].as_py()), (t["_tr"][0].as_py(), t["_tc"][0].as_py())
        core = [(k * TILE, min(n, (k + 1) * TILE)) for k, n in zip(tile, size, strict=True)]
        have = [(max(0, a - halo), min(n, b + halo)) for (a, b), n in zip(core, size, strict=True)]
        pad = [(lo - (a - halo), b + halo - hi) for (a, b), (lo, hi) in zip(core, have, strict=True)]
        i, j = t["r"].to_numpy() - have[0][0], t["c"].to_numpy() - have[1][0]
        shape = tuple(hi - lo for lo, hi in have)
        given = {}
        for name in inputs:
            a = np.full(shape, np.nan)
            a[i, j] = _numbers(t[name])
            given[name] = np.pad(a, pad, mode="symmetric")
        here = np.zeros(shape, bool)
        here[i, j] = True
        inner = tuple(slice(a - lo, b - lo) for (a, b), (lo, _) in zip(core, have, strict=True))
        r, c = np.nonzero(here[inner])
        middle = tuple(slice(halo, halo + b - a) for a, b in core)
        return _table(r + core[0][0], c + core[1][0], {k: v[middle][r, c] for k, v in kernel(given).items()}, outputs)

    schema = ", ".join(["r int", "c int", *[f"{k} {v}" for k, v in outputs.items()]])
    return cut.groupBy("_tr", "_tc").applyInArrow(run, schema)


def strips(df: DataFrame, axis: str, kernel: Callable[[Arrays], Arrays], inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """r, c and ``outputs`` of each pixel; ``kernel`` gets the inputs of ``STRIP`` whole rows (axis r) or columns (axis c), and the
    places "r" and "c" of their pixels."""

    def run(t: pa.Table) -> pa.Table:
        r, c = t["r"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64)
        i, j = r - r.min(), c - c.min()
        shape = (int(i.max()) + 1, int(j.max()) + 1)
        given = {"r": np.arange(shape[0])[:, None] + r.min(), "c": np.arange(shape[1])[None, :] + c.min()}
        for name in inputs:
            given[name] = np.full(shape, np.nan)
            given[name][i, j] = _numbers(t[name])
        return _table(r, c, {k: v[i, j] for k, v in kernel(given).items()}, outputs)

    schema = ", ".join(["r int", "c int", *[f"{k} {v}" for k, v in outputs.items()]])
    return df.select("r", "c", *inputs, F.floor(F.col(axis) / STRIP).alias("_s")).groupBy("_s").applyInArrow(run, schema)


def near_points(df: DataFrame, points: DataFrame, reach: int, kernel: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table], inputs: list[str], schema: StructType) -> DataFrame:
    """What ``kernel`` gives for the points of a tile, whose pixels are ``_r`` and ``_c``. It gets the pixels (r, c, ``inputs``)
    within ``reach`` of the tile, the points, and the places of the pixels and the points in an array of ``NEAR + 2 * reach``
    rows and columns that begins ``reach`` before the tile. Both sides are shuffled once, whatever their sizes: a pixel goes to
    one tile, near a border to two or four, and no row is made for a pair of a point and a pixel."""
    tile = lambda a, off=0: F.floor((F.col(a) + off) / NEAR)
    spread = lambda a: F.explode(F.sequence(tile(a, -reach), tile(a, reach)))
    px = df.where("r is not null and c is not null").select("r", "c", *inputs).withColumn("_tr", spread("r")).withColumn("_tc", spread("c"))
    at = points.where("_r is not null and _c is not null").withColumns({"_tr": tile("_r"), "_tc": tile("_c")})

    def run(pixels: pa.Table, of: pa.Table) -> pa.Table:
        if not pixels.num_rows or not of.num_rows:
            return empty
        start = [of[k][0].as_py() * NEAR - reach for k in ("_tr", "_tc")]
        place = lambda t, names: np.stack([t[k].to_numpy().astype(np.int64) - s for k, s in zip(names, start, strict=True)])
        return kernel(pixels, of, place(pixels, ("r", "c")), place(of, ("_r", "_c")))

    empty = to_arrow_schema(schema).empty_table()
    return px.groupBy("_tr", "_tc").cogroup(at.groupBy("_tr", "_tc")).applyInArrow(run, schema)


def window_values(values: np.ndarray, at: np.ndarray, points: np.ndarray, half: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The values in the window of ``half`` pixels around each point, in order, some points (a slice) at once: all values, and where
    each point's begin (with the end). ``at`` and ``points`` are places as ``near_points`` gives them; several values of one pixel
    all count, NaN is the greatest."""
    width = NEAR + 2 * half
    cell = at[0] * width + at[1]
    values = values[np.argsort(cell, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=width * width))])
    first = (points[0][:, None] + np.arange(-half, half + 1)) * width + points[1][:, None] - half
    low, size = begin[first], begin[first + 2 * half + 1] - begin[first]  # of each row of each window
    total = size.sum(axis=1)
    cut = np.concatenate([[0], np.cumsum(total)])
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + (1 << 21), side="right")) - 1)
        n, k = size[i:j].ravel(), low[i:j].ravel()
        index = np.repeat(k - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        got = values[index]
        yield slice(i, j), got[np.lexsort((got, np.repeat(np.arange(j - i), total[i:j])))], cut[i : j + 1] - cut[i]
        i = j


def _shifted(a: np.ndarray, half: int, axis: int, fill: float):
    """The array moved by -half .. half along an axis."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (half, half)
    wide = np.pad(a, pad, constant_values=fill)
    for k in range(2 * half + 1):
        yield wide[k : k + a.shape[0]] if axis == 0 else wide[:, k : k + a.shape[1]]


def window_sum(a: np.ndarray, half: int) -> np.ndarray:
    for axis in (1, 0):
        a = sum(_shifted(a, half, axis, 0.0))
    return a


def window_mean(a: np.ndarray, half: int) -> np.ndarray:
    """Mean of a centred window, along rows and then columns, each without missing values."""
    for axis in (1, 0):
        known = ~np.isnan(a)
        n = sum(_shifted(known.astype(float), half, axis, 0.0))
        with np.errstate(invalid="ignore", divide="ignore"):
            a = sum(_shifted(np.where(known, a, 0.0), half, axis, 0.0)) / n
    return a


def window_range(a: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a centred window."""
    low = high = a
    for axis in (1, 0):
        low = np.fmin.reduce(list(_shifted(low, half, axis, np.nan)))
        high = np.fmax.reduce(list(_shifted(high, half, axis, np.nan)))
    return low, high


def distance_within(target: np.ndarray, reach: int) -> np.ndarray:
    """Distance of each pixel to the nearest target, exact up to ``reach``; what lies farther may come out too far, up to infinity."""
    r = np.broadcast_to(np.arange(target.shape[0], dtype=float)[:, None], target.shape)
    up = np.maximum.accumulate(np.where(target, r, -np.inf), axis=0)
    down = np.minimum.accumulate(np.where(target, r, np.inf)[::-1], axis=0)[::-1]
    own = np.minimum(r - up, down - r) ** 2
    best = own.copy()
    for dx in range(1, min(reach + 1, target.shape[1])):
        if dx * dx > best.max():
            break
        np.minimum(best[:, dx:], own[:, :-dx] + dx * dx, out=best[:, dx:])
        np.minimum(best[:, :-dx], own[:, dx:] + dx * dx, out=best[:, :-dx])
    return np.sqrt(best)


def nearest_in_columns(a: Arrays) -> Arrays:
    """tr, tz: row and value of the nearest target pixel of each column, the upper one on a tie."""
    r = np.broadcast_to(a["r"].astype(float), a["t"].shape)
    on = a["t"] == 1
    up = np.maximum.accumulate(np.where(on, r, -np.inf), axis=0)
    down = np.minimum.accumulate(np.where(on, r, np.inf)[::-1], axis=0)[::-1]
    row = np.where(down - r < r - up, down, up)
    found = np.isfinite(row)
    at = np.where(found, row - a["r"].min(), 0).astype(np.int64)
    z = np.take_along_axis(a["z"], at, axis=0)
    return {"tr": np.where(found, row, np.nan), "tz": np.where(found, z, np.nan)}


def nearest_in_rows(a: Arrays) -> Arrays:
    """d2, near_z: squared distance and value of the nearest target, from the nearest ones of all columns; ties to the smaller row,
    then column. Columns are taken in order of their distance until none can be nearer."""
    own = (a["tr"] - a["r"]) ** 2
    own = np.where(np.isnan(own), np.inf, own)
    best, row, z = own.copy(), a["tr"].copy(), a["tz"].copy()
    col = np.broadcast_to(a["c"].astype(float), own.shape).copy()
    for dx in range(1, own.shape[1] if np.isfinite(own).any() else 0):
        if dx * dx > best.max():
            break
        for to, of in ((np.s_[:, dx:], np.s_[:, :-dx]), (np.s_[:, :-dx], np.s_[:, dx:])):
            d, tr, tc = own[of] + dx * dx, a["tr"][of], np.broadcast_to(a["c"], own.shape)[of]
            better = (d < best[to]) | (d == best[to]) & np.isfinite(d) & ((tr < row[to]) | (tr == row[to]) & (tc < col[to]))
            for kept, new in ((best, d), (row, tr), (col, tc), (z, a["tz"][of])):
                kept[to][better] = new[better]
    return {"d2": np.where(np.isfinite(best), best, np.nan), "near_z": z}
