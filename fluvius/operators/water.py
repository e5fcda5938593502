"""Water layers of a raster: mask, depth and surface from polygon and line pixels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvius.operators import tiles

BANK = 60.0  # metres over which a polygon's depth grows from its bank
SMOOTH = 120.0  # metres over which a polygon's surface is smoothed
LEAST_SHARE = 0.7  # of a channel's depth at its banks


def layers(dem: DataFrame, polygons: DataFrame, lines: DataFrame, mpp: float) -> DataFrame:
    """r, c, z, polygon, mask, depth, surface of each pixel of ``dem`` (r, c, z).

    ``polygons`` (r, c, depth) are pixels whose centres are in water bodies, ``lines`` (r, c, depth, half: half the width in
    pixels) those that channels touch; where several meet the greatest counts. A polygon wins over lines. Depth grows with the
    root of the distance to the bank, in channels from ``LEAST_SHARE`` on. The surface of polygons is the smoothed terrain,
    never above the terrain itself, and that of channels the terrain; it is NULL on land.

    One shuffle into tiles: their halo holds the banks' reach, the widest channel's half and the smoothing window, beyond which
    no pixel matters.
    """
    p = polygons.groupBy("r", "c").agg(F.max("depth").alias("pd"))
    n = lines.groupBy("r", "c").agg(F.max("depth").alias("ld"), F.greatest(F.max("half"), F.lit(1.0)).alias("half"))
    d = dem.select("r", "c", "z").join(p, ["r", "c"], "left").join(n, ["r", "c"], "left")
    window = max(3, round(SMOOTH / mpp) | 1) // 2
    widest = n.agg(F.coalesce(F.max("half"), F.lit(1.0))).first()[0]
    halo = max(math.ceil(BANK / mpp), math.ceil(widest), window) + 1

    def kernel(a: tiles.Arrays) -> tiles.Arrays:
        z, pd, ld, half = a["z"], np.nan_to_num(a["pd"]), np.nan_to_num(a["ld"]), np.where(np.isnan(a["half"]), 1.0, a["half"])
        polygon = pd > 0
        line = (ld > 0) & ~polygon
        mask = polygon | line
        bank, shore = tiles.distance_within(~polygon, halo), tiles.distance_within(~mask, halo)
        of_polygon = pd * np.sqrt(np.minimum(bank * mpp / BANK, 1.0))
        of_line = ld * np.maximum(np.sqrt(np.minimum(shore / half, 1.0)), LEAST_SHARE)
        count = tiles.window_sum(polygon.astype(float), window)
        mean = tiles.window_sum(np.where(polygon, np.nan_to_num(z), 0.0), window) / np.where(count > 0, count, 1)
        surface = np.where(polygon, np.fmin(z, mean), np.where(line, z, np.nan))
        return {"z": z, "polygon": polygon.astype(float), "mask": mask.astype(float), "depth": np.where(polygon, of_polygon, np.where(line, of_line, 0.0)), "surface": surface}

    return tiles.tiled(d, halo, kernel, ["z", "pd", "ld", "half"], {"z": "double", "polygon": "boolean", "mask": "boolean", "depth": "double", "surface": "double"})
