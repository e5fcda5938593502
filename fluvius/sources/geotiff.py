"""Single-band GeoTIFF with the standard library and numpy: reading tiles and strips, plain or deflated, and writing strips."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF field types: number to struct code (fixed values).
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Tag numbers (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113


class RasterError(ValueError):
    """A file that is no GeoTIFF of a kind read here."""


@dataclass(frozen=True)
class Raster:
    z: np.ndarray  # float64, NaN where there is no data
    west: float
    north: float
    mpp: float


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise RasterError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("<" + code) * n
        place = 8 if size <= 4 else None
        body = entry[8 : 8 + size] if place else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + size]
        tags[tag] = (body.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{n}{code}", body)
    return order, tags


def decode(data: bytes) -> Raster:
    """The first band of a file; pixels that equal its nodata value, or are not finite, are NaN."""
    order, t = _tags(data)
    w, h, bits = t[WIDTH][0], t[HEIGHT][0], t.get(BITS, (1,))[0]
    if t.get(BANDS, (1,))[0] != 1 or t.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise RasterError("expected one band, plain or deflated")
    kind = {1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]]
    dtype, predictor = np.dtype(f"{order}{kind}{bits // 8}"), t.get(PREDICTOR, (1,))[0]
    tiled = TILES in t
    bw, bh = (t[TILE_W][0], t[TILE_H][0]) if tiled else (w, min(h, t.get(STRIP_ROWS, (h,))[0]))
    starts, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    across, out = -(-w // bw), np.empty((h, w), np.float64)
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        raw = data[start : start + size]
        raw = raw if t.get(COMPRESSION, (1,))[0] == 1 else zlib.decompress(raw)
        r, c = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - r)
        if predictor == 3:  # bytes of floats by significance, each row differenced
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, bits // 8, bw)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{bits // 8}")[:, :, 0]
        else:
            block = np.frombuffer(raw, dtype)[: rows * bw].reshape(rows, bw)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = block[: h - r, : w - c]
        out[r : r + part.shape[0], c : c + part.shape[1]] = part
    if NODATA in t and t[NODATA][0].strip():
        out[out == float(t[NODATA][0])] = np.nan
    out[~np.isfinite(out)] = np.nan
    scale, tie = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.get(TIE_POINT, (0.0,) * 6)
    return Raster(out, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0])


def encode(raster: Raster, nodata: float = -999999.0, rows: int = 256) -> bytes:
    """A deflated file of 32-bit floats in strips; NaN is written as ``nodata``."""
    z = np.where(np.isnan(raster.z), nodata, raster.z).astype("<f4")
    h, w = z.shape
    strips = [zlib.compress(z[i : i + rows].tobytes(), 6) for i in range(0, h, rows)]
    starts = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    fields = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [32]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, starts), (BANDS, 3, [1]),
        (STRIP_ROWS, 4, [rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (FORMAT, 3, [3]), (PIXEL_SCALE, 12, [raster.mpp, raster.mpp, 0.0]),
        (TIE_POINT, 12, [0.0, 0.0, 0.0, raster.west, raster.north, 0.0]), (NODATA, 2, f"{nodata:g}".encode() + b"\0"),
    ]
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    head, extra, at = [], b"", 8 + len(body) + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        packed = values if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        if len(packed) > 4:
            packed += b"\0" * (len(packed) % 2)
            place, extra = struct.pack("<I", at + len(extra)), extra + packed
        else:
            place = packed.ljust(4, b"\0")
        head.append(struct.pack("<HHI", tag, kind, len(values)) + place)
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + struct.pack("<H", len(fields)) + b"".join(head) + struct.pack("<I", 0) + extra


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, west, north, mpp, r, c, z of the files of a path or glob: one task's memory holds one file at a time; nodata is NULL."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                got = decode(data)
                h, w = got.z.shape
                for r0 in range(0, h, 256):
                    z = got.z[r0 : r0 + 256]
                    r, c = np.indices(z.shape, np.int32)
                    flat = pd.Series(z.ravel()).astype("Float64")
                    yield pd.DataFrame({"file": name, "west": got.west, "north": got.north, "mpp": got.mpp, "r": (r + r0).ravel(), "c": c.ravel(), "z": flat})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, west double, north double, mpp double, r int, c int, z double")


def bounds(rasters: DataFrame) -> DataFrame:
    """(file, minx, miny, maxx, maxy) of the files read."""
    g = rasters.groupBy("file", "west", "north", "mpp").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    return g.select("file", F.col("west").alias("minx"), (F.col("north") - F.col("h") * F.col("mpp")).alias("miny"), (F.col("west") + F.col("w") * F.col("mpp")).alias("maxx"), F.col("north").alias("maxy"))
